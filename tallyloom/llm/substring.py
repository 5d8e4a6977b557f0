"""Removal of every byte covered by a string of WINDOW bytes that starts more than once.

Exact for all windows of all texts (up to collisions of 64-bit hashes), without sorting or
shuffling a row a byte. Each step asks Spark which keys occur twice (a partially aggregated
count, so a string that a third of all texts share is no hot spot) and joins the answer
back; what one step settles, the next doesn't look at:

A. Coarse filter. Of all runs of GRAM bytes, those that are the smallest by hash among
   WINDOW - GRAM + 1 neighbours are kept (winnowing), so every window holds a kept one, the
   same one wherever the window occurs. Only windows around kept runs that occur twice can
   be repeated; texts with none are done.
B. The texts left are written once, bucketed by row, so that no later join moves them.
C. Anchors are positions that the next TRIGGER bytes mark; a window belongs to the first
   anchor in its first REACH bytes. A pass over the texts writes a row an anchor: the range
   of its windows, the hash of its stretch (all bytes of its windows) and of the bytes that
   its windows have in common. A stretch that occurs twice settles all its windows at once:
   the inside of every repeated passage. An anchor whose windows' common bytes don't occur
   twice has no repeated window.
D. The windows of other anchors, the ends of repeated passages, and the few without any
   anchor are counted one by one, together with those of settled anchors that share their
   common bytes, once for each different stretch.

Passages of some 50 words often have less than WINDOW bytes and stay. Whether a text shares one
with another document is told beside (`shares_passage`), found in the same way over words: the
windows of PASSAGE words are dealt to their smallest run of PASSAGE_GRAM words, in ranges;
ranges whose run is in one document only are done, a stretch of a range that is in two settles
their documents, and only the windows of those left are looked at one by one.

Null and empty texts, and texts shorter than WINDOW, lose nothing. Rows that repeat count
as starts of their own, so they lose all; a null id is an id like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textbatch import Block, blocks, mix, running_hash, window_hash
from tallyloom.session import discard, materialize, scratch_path

WINDOW = 400
GRAM = 200
TRIGGER = 16
#: An anchor every so many bytes on average.
SPACING = 40
#: Windows whose first anchor is within NEAR (or REACH) bytes share WINDOW - that many bytes.
NEAR, REACH = 64, 200
#: Words of a passage, and of the runs that find candidates.
PASSAGE = 51
PASSAGE_GRAM = 10
_MOST = np.uint64(2**64 - 1)
_ID = ["_k", "_h"]


def _sliding(ufunc: np.ufunc, a: np.ndarray, width: int, fill) -> np.ndarray:
    """ufunc over a[i : i + width] for each i; beyond the end counts as `fill`."""
    n = len(a)
    size = -(-(n + width) // width) * width
    padded = np.full(size, fill, a.dtype)
    padded[:n] = a
    rows = padded.reshape(-1, width)
    ahead = ufunc.accumulate(rows, axis=1).reshape(-1)
    behind = ufunc.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return ufunc(behind[:n], ahead[width - 1 : width - 1 + n])


def winnowed(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Kept runs of a block: positions and hashes."""
    n = len(block.data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = block.run_hash(block.prefix_hash(), GRAM)
    valid = np.ones(n, bool)
    for end in block.offsets[1:-1]:  # runs that would cross into the next text
        valid[max(0, end - GRAM + 1) : end] = False
    h[~valid] = _MOST
    width = WINDOW - GRAM + 1
    least = _sliding(np.minimum, h, width, _MOST)
    # h[i] is some window's least iff the largest of the leasts of windows that hold i is h[i].
    most = _sliding(np.maximum, least[::-1], width, np.uint64(0))[::-1]
    at = np.flatnonzero(valid & (most == h))
    return at, h[at]


def _winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(2)):
            at, h = winnowed(block)
            doc = block.doc_of(at)
            row = pa.array(doc + block.first)
            pos = pa.array((at - block.offsets[doc]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pos], ["key", *_ID, "pos"])


class Anchored:
    """Candidate windows of one text, dealt to anchors. windows low[i]..high[i] belong to
    anchor at[i]; `alone` are those without."""

    def __init__(self, raw: bytes, hits: list[int]) -> None:
        self.data = np.frombuffer(raw, np.uint8)
        self.block = Block(0, self.data, np.array([0, len(raw)]))
        self.prefix = self.block.prefix_hash()
        n = len(raw) - WINDOW + 1
        edge = np.zeros(n + 1, np.int64)
        hit = np.asarray(hits, np.int64)
        np.add.at(edge, np.clip(hit - (WINDOW - GRAM), 0, n), 1)
        np.add.at(edge, np.clip(hit + 1, 0, n), -1)
        window = np.flatnonzero(np.cumsum(edge)[:n] > 0)
        anchors = np.flatnonzero(self.block.run_hash(self.prefix, TRIGGER) % np.uint64(SPACING) == 0)
        own = np.searchsorted(anchors, window)
        first = anchors[np.minimum(own, len(anchors) - 1)] if len(anchors) else np.zeros(len(window), np.int64)
        has = (own < len(anchors)) & (first - window <= REACH) & (first >= window)
        self.alone = window[~has]
        window, first = window[has], first[has]
        at, index = np.unique(first, return_index=True)
        self.at, self.low = at, window[index]
        self.high = window[np.concatenate((index[1:], [len(window)])).astype(np.int64) - 1] if len(at) else at

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.block.span_hash(self.prefix, start, end)

    def stretches(self) -> np.ndarray:
        return mix(self.hash(self.low, self.high + WINDOW) + np.uint64(1))

    def common(self, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that all windows up to `reach` before an anchor share: which anchors
        have so many, and their hashes (0 for the others)."""
        has = self.at + WINDOW - reach <= len(self.data)
        out = np.zeros(len(self.at), np.uint64)
        out[has] = mix(self.hash(self.at[has], self.at[has] + WINDOW - reach) + np.uint64(reach))
        return has, out

    def lone_ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each run of windows without an anchor."""
        gap = np.flatnonzero(np.diff(self.alone) > 1)
        ends = np.concatenate((gap, [len(self.alone) - 1])).astype(np.int64)
        starts = np.concatenate(([0], gap + 1)).astype(np.int64)
        return (self.alone[starts], self.alone[ends]) if len(self.alone) else (self.alone, self.alone)


#: A range of windows as one number: the first above 32 bits, the last below.
def _range(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low.astype(np.int64) << 32) | high.astype(np.int64)


def _windows(ranges: list[int] | None) -> np.ndarray:
    """All windows of some ranges."""
    r = np.asarray(ranges or [], np.int64)
    low, size = r >> 32, (r & 0xFFFFFFFF) - (r >> 32) + 1
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())


_ANCHOR = "_k bigint, _h bigint, range bigint, stretch bigint, near bigint, far bigint, own bigint"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row an anchor: `near` and `far` are the hashes of the bytes that windows near to it
    or far from it share, `own` that of its own windows. Runs of windows without an anchor
    have a range only."""
    names = ["range", "stretch", "near", "far", "own"]
    for batch in batches:
        parts: dict[str, list] = {c: [] for c in names}
        valid: dict[str, list] = {c: [] for c in names}
        sizes = []
        for raw, hits in zip(batch.column("raw").to_pylist(), batch.column("hits").to_pylist()):
            a = Anchored(raw, hits)
            low, high = a.lone_ranges()
            n, m = len(a.at), len(low)
            (has_near, near), (has_far, far) = a.common(NEAR), a.common(REACH)
            own = np.where(a.at - a.low <= NEAR, near, far)
            all_, none, rest = np.ones(n, bool), np.zeros(m, bool), np.zeros(m, np.int64)
            values = {"range": _range(a.low, a.high), "stretch": a.stretches().view(np.int64), "near": near.view(np.int64), "far": far.view(np.int64), "own": own.view(np.int64)}
            masks = {"range": all_, "stretch": all_, "near": has_near, "far": has_far, "own": all_}
            for c in names:
                parts[c] += [values[c], _range(low, high) if c == "range" else rest]
                valid[c] += [masks[c], ~none if c == "range" else none]
            sizes.append(n + m)
        row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *parts[c]]), mask=~np.concatenate([np.zeros(0, bool), *valid[c]])) for c in names]
        yield pa.RecordBatch.from_arrays([batch.column("_k").take(row), batch.column("_h").take(row), *columns], [*_ID, *names])


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows to count: open ones with their places, lent ones with -1."""
    for batch in batches:
        keys, places, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for raw, open_, lent in zip(*(batch.column(c).to_pylist() for c in ("raw", "open", "lent"))):
            block = Block(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            at, more = _windows(open_), _windows(lent)
            both = np.concatenate((at, more))
            keys.append(block.span_hash(block.prefix_hash(), both, both + WINDOW))
            places.append(np.concatenate((at, np.full(len(more), -1))))
            sizes.append(len(both))
        row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), batch.column("_k").take(row), batch.column("_h").take(row), pa.array(np.concatenate(places).astype(np.int32))], ["key", *_ID, "pos"]
        )


def passage_ranges(block: Block) -> tuple[np.ndarray, ...]:
    """Windows of PASSAGE words in ranges of one smallest run: document, first and last
    window (as words of that document), hash of that run and of all words of the range."""
    start, end = block.words()
    doc = block.doc_of(start)
    h = block.span_hash(block.prefix_hash(), start, end)
    n = max(0, len(h) - PASSAGE + 1)
    least = _sliding(np.minimum, window_hash(h, PASSAGE_GRAM), PASSAGE - PASSAGE_GRAM + 1, _MOST)[:n]
    window = np.flatnonzero(doc[:n] == doc[PASSAGE - 1 :]) if n else np.zeros(0, np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(window) > 1) | (least[window[1:]] != least[window[:-1]])
    low, high = window[new], window[np.append(new[1:], [True])] if len(window) else window
    stretch = mix(block.span_hash(running_hash(h), low, high + PASSAGE) + np.uint64(1))
    before = np.searchsorted(doc, doc[low])
    return doc[low], low - before, high - before, least[low], stretch


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(2)):
            doc, low, high, least, stretch = passage_ranges(block)
            row = pa.array(doc + block.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(least.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(_range(low, high)), pa.array(stretch.view(np.int64))], ["key", *_ID, "range", "stretch"]
            )


def _passage_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of PASSAGE words to look at, those of texts in question as `open`."""
    for batch in batches:
        for k, h, raw, open_, lent in zip(*(batch.column(c).to_pylist() for c in (*_ID, "raw", "open", "lent"))):
            block = Block(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            words = running_hash(block.span_hash(block.prefix_hash(), *block.words()))
            at, more = _windows(open_), _windows(lent)
            both = np.concatenate((at, more))
            n = len(both)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.span_hash(words, both, both + PASSAGE).view(np.int64)), pa.array(np.full(n, k)), pa.array(np.full(n, h)), pa.array(np.arange(n) < len(at))], ["key", *_ID, "open"]
            )


def _cut(raw: bytes, ranges: list[int]) -> tuple[bytes, int, int]:
    """What stays of a text without the windows of `ranges`, the bytes removed and the runs
    they form."""
    r = np.asarray(ranges, np.int64)
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, r >> 32, 1)
    np.add.at(edge, (r & 0xFFFFFFFF) + WINDOW, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _repeated(keys: DataFrame) -> DataFrame:
    """The keys of two rows or more; written, so that a join with them can be split where
    one key has many rows."""
    return materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")


def _by_row(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The places whose keys are among `keys`, of each id and text, once however many rows
    repeat these."""
    return rows.join(keys, "key").groupBy(*_ID).agg(F.collect_set("pos").alias(name))


def _across(rows: DataFrame, key: str) -> DataFrame:
    """The keys of two documents or more, written."""
    doc = F.xxhash64(*_ID)
    return materialize(rows.groupBy(key).agg(F.min(doc).alias("a"), F.max(doc).alias("b")).where("a <> b").select(key), "across")


def _ranges(c: Column) -> Column:
    """The distinct ranges (first start above 32 bits, last one below), as an aggregate. A set
    hashes a long by its two halves' difference, which ranges of one length share, so it
    holds first start and length."""
    return F.transform(F.collect_set(c - F.shiftright(c, 32)), lambda x: x + F.shiftright(x, 32))


def _bucketed(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, bucketed by row: joins by row don't move it. Its
    name, for the one who drops it."""
    spark = df.sparkSession
    path = scratch_path(spark, "texts")
    name = "tallyloom_" + path.rpartition("-")[2]
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(n, *_ID).write.option("path", path).bucketBy(n, *_ID).sortBy(*_ID).saveAsTable(name)
    return spark.table(name), name


def _sharing(texts: DataFrame) -> DataFrame:
    """The ids of the documents with PASSAGE words in a row that are in another one too. Rows
    of one id and text are one document."""
    long = texts.where(F.octet_length("raw") >= 2 * PASSAGE - 1)
    ranges = materialize(long.select(*_ID, F.col("raw").cast("string")).mapInArrow(_passages, "key bigint, _k bigint, _h bigint, range bigint, stretch bigint"), "ranges")
    some = materialize(ranges.join(_across(ranges, "key"), "key"), "passages")
    discard(ranges)
    settled = materialize(some.join(_across(some, "stretch"), "stretch").select(*_ID).distinct(), "settled")
    left = some.join(settled, _ID, "left_anti")
    wanted = materialize(left.select("key").distinct(), "wanted")
    lenders = some.join(settled, _ID, "left_semi").join(wanted, "key", "left_semi")
    lenders = lenders.groupBy("stretch").agg(F.min(F.struct(*_ID, "range")).alias("x")).select("x.*", F.lit("lent").alias("what"))
    asked = left.select(*_ID, "range", F.lit("open").alias("what")).unionByName(lenders)
    of = lambda what: _ranges(F.when(F.col("what") == what, F.col("range"))).alias(what)
    asked = asked.groupBy(*_ID).agg(of("open"), of("lent"))
    windows = materialize(long.select(*_ID, "raw").join(asked, _ID).select(*_ID, "raw", "open", "lent").mapInArrow(_passage_windows, "key bigint, _k bigint, _h bigint, open boolean"), "windows")
    found = windows.where("open").join(_across(windows, "key"), "key").select(*_ID)
    sharing = materialize(settled.union(found).distinct(), "sharing")
    discard(windows)
    discard(some)
    return sharing


def _removed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """The rows of remove_repeats(), and the table of texts that they are read from."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    base = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_k"), F.xxhash64(F.col(text), F.col(key).isNull()).alias("_h"), F.col(text).alias("_t"))
    long = base.where(F.octet_length("_t") >= WINDOW)
    grams = materialize(long.select(*_ID, "_t").mapInArrow(_winnow, "key bigint, _k bigint, _h bigint, pos int"), "grams")
    hits = _by_row(grams, _repeated(grams), "hits")
    joined = base.join(hits, _ID, "left").select("_id", *_ID, F.encode(F.coalesce("_t", F.lit("")), "UTF-8").alias("raw"), "hits")
    texts, name = _bucketed(joined)
    discard(grams)
    some = texts.where("hits IS NOT NULL")

    anchors = materialize(some.select(*_ID, "raw", "hits").mapInArrow(_anchors, _ANCHOR), "anchors")
    twice = _repeated(anchors.select(F.explode(F.array_compact(F.array("stretch", "near", "far"))).alias("key")))
    settled = twice.select(F.col("key").alias("stretch"), F.lit(True).alias("settled"))
    shared = twice.select(F.col("key").alias("own"), F.lit(True).alias("shared"))
    marked = anchors.join(settled, "stretch", "left").join(shared, "own", "left")
    marked = marked.select(*_ID, "range", "stretch", "near", "far", "own", F.when(F.col("settled"), "settled").when(F.col("shared") | F.col("stretch").isNull(), "open").alias("what")).where("what IS NOT NULL")
    marked = materialize(marked, "marked")
    discard(anchors)
    wanted = materialize(marked.where("what = 'open' AND own IS NOT NULL").select(F.col("own").alias("key")).distinct(), "wanted")
    lenders = marked.where("what = 'settled'").select(*_ID, "range", "stretch", F.explode(F.array_compact(F.array("near", "far"))).alias("key")).join(wanted, "key", "left_semi")
    lenders = lenders.groupBy("stretch").agg(F.min(F.struct(*_ID, "range")).alias("x")).select("x.*", F.lit("lent").alias("what"))
    asked = marked.where("what = 'open'").select(*_ID, "range", "what").unionByName(lenders)
    of = lambda what: _ranges(F.when(F.col("what") == what, F.col("range"))).alias(what)
    asked = asked.groupBy(*_ID).agg(of("open"), of("lent"))
    windows = materialize(some.select(*_ID, "raw").join(asked, _ID).select(*_ID, "raw", "open", "lent").mapInArrow(_open_windows, "key bigint, _k bigint, _h bigint, pos int"), "windows")
    single = windows.where("pos >= 0").join(_repeated(windows), "key").select(*_ID, (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("pos")).alias("range"))
    cuts = materialize(marked.where("what = 'settled'").select(*_ID, "range").unionByName(single).groupBy(*_ID).agg(_ranges(F.col("range")).alias("cuts")), "cuts")
    discard(windows)
    discard(marked)
    sharing = _sharing(texts).withColumn("shares", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for raw, ranges in zip(batch.column("raw").to_pylist(), batch.column("cuts").to_pylist()):
                body, gone, runs = _cut(raw, ranges) if ranges else (raw, 0, 0)
                kept.append(body)
                sizes.append(len(raw))
                removed.append(gone)
                spans.append(runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), batch.column("shares_passage")],
                ["_id", "kept", "n_bytes", "n_removed", "n_spans", "shares_passage"],
            )

    kind = docs.schema[key].dataType.simpleString()
    full = texts.join(cuts, _ID, "left").join(sharing, _ID, "left").select("_id", "raw", "cuts", F.coalesce("shares", F.lit(False)).alias("shares_passage"))
    return full.mapInArrow(run, f"_id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, shares_passage boolean"), name


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, kept (the bytes that stay, as binary), n_bytes, n_removed, n_spans, shares_passage: a
    row a row of docs. It is read from a table in the shared folder that stays until that is cleared."""
    return _removed(docs, key, text)[0]


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, the SHA-256 of what stays, whether anything went,
    whether PASSAGE words in a row are in another document too, and what stays as text (bytes
    that are no UTF-8 any more become U+FFFD). The texts and the large scratch tables are
    gone afterwards."""
    rows, name = _removed(docs, key, text)
    out = materialize(
        rows.select(
            F.col("_id").alias(key), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"), "shares_passage",
            F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
        ),
        "repeats",
    )
    spark = docs.sparkSession
    texts = spark.table(name)
    discard(texts)
    spark.sql(f"DROP TABLE {name}")
    return out
