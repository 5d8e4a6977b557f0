"""Packing of token sequences by shortest-pack-first over the histogram of lengths.

1. Each text becomes token ids and the end id; ids are cut into pieces of at most CAPACITY.
   A piece is a row with its ids, written once, and knows its place among the pieces of equal
   length of its partition. Places before a partition come from one count a partition and
   length, so a piece's rank among all of its length takes no sort.
2. The histogram of lengths, at most CAPACITY counts, goes to the driver, which places lengths
   longest first, all pieces of a length at once: into the shortest packs if they fit there,
   else into new packs as long as fewer than ceil(tokens / CAPACITY) are open, else cut at
   the space of the shortest packs; what is cut off waits as a shorter length. Packs that
   hold the same are one pattern with a count. As many packs are made as tokens need, so all
   padding together is less than one pack.
3. A pattern's place for a length is a run of ranks. These runs, some for each length and cut,
   are joined back to the pieces by length and rank; a piece that was cut becomes several.

Texts: null is the empty text, which is the end id alone. Strings of special tokens are
ordinary text. Rows that repeat and rows with a null id are documents of their own. Other
columns don't matter; an empty table has no pieces. A text's ids are in memory at once.
"""

from __future__ import annotations

import json
import os
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize

CAPACITY = 1024
END = 0
#: White space that long in one run goes to the tokenizer itself: the faster coder recurses.
LONG = regex.compile(r"\s{10000}")
#: Runs of ranks that are broadcast; more are joined by shuffle.
RUNS = 1 << 16


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level tokenizer file. Raises if ids don't follow the merges,
    since ids are then no ranks."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # Byte-level files write a byte as the character of its number if that is printable and
    # no space, else as the next one from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids aren't in the order of the merges")
    made = set(merged)
    return {bytes(byte[c] for c in w): i for w, i in vocab.items() if i in made or w in byte}


class Encoder:
    """Token ids of texts by the tokenizer file at `path`, as little-endian numbers of `size`
    bytes. Texts go through tiktoken with the file's vocabulary, which gives the ids of the
    tokenizer in less than a third of its time."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=byte_vocabulary(path), special_tokens={})
        self.size = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def encode(self, text: str) -> bytes:
        if len(text) >= 10_000 and LONG.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, f"<u{self.size}").tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary and Python process."""
    if (path, pattern) not in _encoders:
        _encoders[(path, pattern)] = Encoder(path, pattern)
    return _encoders[(path, pattern)]


def pieces(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """key, start, length, doc_tokens, ids (binary, Encoder.size bytes each), `part` and `at`,
    the piece's place among those of its length in its partition. Written."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        size, last = code.size, np.array([end], f"<u{code.size}").tobytes()
        seen: Counter[int] = Counter()
        for batch in batches:
            rows, starts, lengths, totals, ids, places = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                raw = code.encode(value.as_py() or "") + last
                n = len(raw) // size
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    rows.append(i)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(n)
                    ids.append(raw[size * start : size * (start + length)])
                    places.append(seen[length])
                    seen[length] += 1
            whole = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(whole(rows)), whole(starts), pa.array(lengths, pa.int32()), whole(totals), pa.array(ids, pa.binary()), whole(places)],
                [key, "start", "length", "doc_tokens", "ids", "at"],
            )

    cut = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, start bigint, length int, doc_tokens bigint, ids binary, at bigint")
    return materialize(cut.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "pieces")


@dataclass
class Run:
    """Tokens [start, start + size) of the pieces of `length` with ranks [first, last) go to
    the sequences from `sequence` on, one each, at `offset`."""

    length: int
    start: int
    size: int
    first: int
    last: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces of each length go. A pattern is (count, [(length, start, size, first
    rank, offset)]); item k of it holds the ranks first + k."""
    waiting: dict[int, deque] = {n: deque([(n, 0, 0, c)]) for n, c in histogram.items() if c}
    most = -(-sum(n * c for n, c in histogram.items()) // capacity)
    open_: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]  # by space
    done: list[tuple[int, list]] = []
    made, space, size = 0, 0, max(waiting, default=0)

    def put(count: int, parts: list, left: int) -> None:
        if left:
            open_[left].append((count, parts))
        else:
            done.append((count, parts))

    while size:
        if not waiting.get(size):
            size -= 1
            continue
        length, start, first, count = waiting[size].popleft()
        space = next((s for s in range(capacity, 0, -1) if open_[s]), 0)
        if space < size and made < most:
            taken = min(count, most - made)
            made += taken
            put(taken, [(length, start, size, first, 0)], capacity - size)
        else:
            packs, parts = open_[space].pop()
            taken, fits = min(count, packs), min(size, space)
            if packs > taken:
                open_[space].append((packs - taken, [(n, a, m, r + taken, o) for n, a, m, r, o in parts]))
            put(taken, [*parts, (length, start, fits, first, capacity - space)], space - fits)
            if fits < size:
                waiting.setdefault(size - fits, deque()).append((length, start + fits, first, taken))
        if count > taken:
            waiting[size].appendleft((length, start, first + taken, count - taken))
    out, sequence = [], 0
    for count, parts in [*done, *(p for some in reversed(open_) for p in some)]:
        out += [Run(n, a, m, r, r + count, sequence, o) for n, a, m, r, o in parts]
        sequence += count
    return out


_RUN = "_length int, _start bigint, _size int, _first bigint, _last bigint, _sequence bigint, _offset int"


def pack(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """key, start, length, doc_tokens, sequence_id, offset and ids (binary, little-endian 32-bit
    numbers) of each piece of each document."""
    spark = docs.sparkSession
    cut = pieces(docs, path, pattern, key, text, capacity, end)
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    so_far = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("part", "length", (F.sum("n").over(so_far) - F.col("n")).alias("_before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("at"))
    where = spark.createDataFrame([tuple(vars(r).values()) for r in runs], _RUN)
    if len(runs) <= RUNS:
        where = F.broadcast(where)
    met = ranked.join(where, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last")))
    size = F.octet_length("ids") / F.col("length")
    ids = F.substring(F.col("ids"), (size * F.col("_start") + 1).cast("int"), (size * F.col("_size")).cast("int"))
    return met.select(
        F.col(key), (F.col("start") + F.col("_start")).alias("start"), F.col("_size").cast("long").alias("length"), "doc_tokens",
        (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").cast("long").alias("offset"), _widened(ids, F.col("_size")).alias("ids"),
    )


def _widened(ids: Column, count: Column) -> Column:
    """Numbers of 2 or 4 bytes as numbers of 4."""

    @F.arrow_udf("binary")
    def widen(col: pa.Array, counts: pa.Array) -> pa.Array:
        n = counts.to_numpy()
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        _, at, data = col.buffers()
        width = np.int64 if pa.types.is_large_binary(col.type) else np.int32
        ends = np.frombuffer(at, width)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if len(col) else np.zeros(0, np.uint8)
        wide = raw.view(f"<u{len(raw) // max(1, int(offsets[-1])) or 4}").astype("<u4")
        return pa.BinaryArray.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(offsets * 4), pa.py_buffer(wide.tobytes())])

    return widen(ids, count)


def padded(used: Column, capacity: int = CAPACITY) -> Column:
    """Tokens of a sequence with its padding: capacity, but powers of two stay."""
    return F.when(used.bitwiseAND(used - 1) == 0, used).otherwise(F.lit(capacity).cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary), used and padded of each sequence; a sequence has at most as
    many pieces as its capacity."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"), F.sum("length").alias("used"))
    joined = F.aggregate(F.col("x"), F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), "used", padded(F.col("used")).alias("padded"))
