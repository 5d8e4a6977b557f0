"""Byte-level BPE encoding and decoding of whole texts.

Merging uses a rank queue: each possible merge rank owns a bucket of linked-list
positions, a two-level bitmap marks the ranks that have any, and find-first-set walks
down the levels to the lowest one. Entries are never removed when a neighbour merges
away; a popped position whose pair no longer has the bucket's rank is stale and skipped. A pre-token
of n bytes costs O(n) queue steps, so one with a million bytes is no special case.

Texts: null encodes as the empty text. Rows that repeat, and rows with a null id, are coded
each on its own. Other columns stay as they are, whatever their names; an empty table gives
no rows. Each Arrow batch is handled on its own; the ids of
pre-tokens that were met before come from a cache of two generations, of at most CACHE
entries each, in each Python worker; the older one is dropped when the younger is full.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE = 1 << 19
#: Pre-tokens looked up before the younger generation is fetched anew.
CHUNK = 1 << 14
#: Longer pre-tokens are not cached.
CACHED_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 and rank pairs."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


#: Ranks a word of the bitmap's lower level covers.
WORD = 256
_BIT = [1 << k for k in range(4 * WORD)]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.words = [0] * (max(ranks.values(), default=0) // WORD + 1)  # all zero between calls
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.cache_size = cache
        self.bytes_of = {str(i): b for b, i in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, get = self.ranks, self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # the symbol at i covers piece[i:end[i]]
        before = list(range(-1, n))
        pair = [-1] * (n + 1)  # rank of the pair that starts at i, as it is now
        bucket: dict[int, list[int]] = {}
        words, top = self.words, 0  # upper level: a bit for each word that isn't zero

        def push(r: int, i: int) -> int:
            held = bucket.get(r)
            if held is not None:
                held.append(i)
                return 0
            bucket[r] = [i]
            word = words[r >> 8]
            words[r >> 8] = word | _BIT[r & 255]
            return 0 if word else _BIT[r >> 8]

        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is None:
                continue
            pair[i] = r
            if r in bucket:
                bucket[r].append(i)
            else:
                bucket[r] = [i]
                words[r >> 8] |= _BIT[r & 255]
                top |= _BIT[r >> 8]
        while top:
            first = top & -top
            a = first.bit_length() - 1
            word = words[a]
            bit = word & -word
            words[a] = word = word ^ bit
            if not word:
                top ^= first
            rank = (a << 8) | (bit.bit_length() - 1)
            positions = bucket.pop(rank)
            if len(positions) > 1:
                positions.sort()  # leftmost first within a rank
            for k, i in enumerate(positions):
                if pair[i] != rank:
                    continue  # stale
                j = end[i]
                e = end[i] = end[j]
                pair[j] = -1
                lower = False
                if e < n:
                    before[e] = i
                    r = get(piece[i : end[e]])
                    if r is not None:
                        pair[i] = r
                        top |= push(r, i)
                        lower = r <= rank
                    else:
                        pair[i] = -1
                else:
                    pair[i] = -1
                p = before[i]
                if p >= 0:
                    r = get(piece[p:e])
                    if r is not None:
                        pair[p] = r
                        top |= push(r, p)
                        lower = lower or r <= rank
                    else:
                        pair[p] = -1
                if lower and k + 1 < len(positions):  # a lower rank came up: the rest wait
                    for q in positions[k + 1 :]:
                        top |= push(rank, q)
                    break
        out, i = [], 0
        while i < n:
            e = end[i]
            out.append(ranks[piece[i:e]])
            i = e
        return out

    def _ids_of(self, token: str) -> str:
        raw = token.encode("utf-8")
        ids = self.old.get(token) or " ".join(map(str, self.merge(raw)))
        if len(raw) <= CACHED_BYTES:
            if len(self.young) >= self.cache_size:
                self.old = self.young
                self.young = {}
            self.young[token] = ids
        return ids

    def encode_joined(self, text: str) -> str:
        """Decimal ids joined by one space."""
        make, out = self._ids_of, []
        for i in range(0, len(found := self.split.findall(text)), CHUNK):
            get = self.young.get
            out += [get(t) or make(t) for t in found[i : i + CHUNK]]
        return " ".join(out)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return list(map(int, joined.split(" "))) if joined else []

    def decode_joined(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_joined(" ".join(map(str, ids)))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and Python process."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(path), pattern)
    return _codecs[key]


DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with a column of token ids (array of int). Other columns pass through; `out`
    replaces a column of that name. `path` must be readable on every executor."""
    schema = T.StructType([f for f in docs.schema if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            ids = pa.array([coder.encode(t or "") for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            kept = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), ids], [*kept, out])

    return docs.mapInArrow(run, schema)


def decode_column(tokens: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """tokens with a binary column of the decoded bytes; null ids decode to no bytes."""
    schema = T.StructType([f for f in tokens.schema if f.name != out] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            raw = pa.array([coder.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary())
            kept = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), raw], [*kept, out])

    return tokens.mapInArrow(run, schema)


def round_trip_digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids and return the digests of both, one row a row of
    docs: key, n_tokens, ids_sha256, decoded_sha256."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            counts, ids_hex, raw_hex = [], [], []
            for value in batch.column(1):
                ids = coder.encode_joined(value.as_py() or "")
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_hex.append(hashlib.sha256(ids.encode()).hexdigest())
                raw_hex.append(hashlib.sha256(coder.decode_joined(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(raw_hex)],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {DIGEST}")
