"""Hard-negative mining with rotated one-bit codes.

Vectors become integers, floor(SCALE * x); a score is an integer inner product. An anchor's
positives are its best rows of the same label; its hard negatives, for each positive, the
best rows of other labels whose score lies between two shares of the positive's.

1. Every vector v is rotated (three rounds of random signs and a Hadamard transform, by a
   fixed seed) and stored as one bit a dimension: the signs of the rotated vector, the unit
   code vector c. With it go its alignment a = <v, c> and the length r of what is left,
   r * r = |v|**2 - a * a.
2. An anchor q is rotated and cut to PLANES bits a dimension, so that <q, c> is a sum of
   popcounts, p, up to the length e of what was cut off. Then <q, v> is a * p up to
   a * e + r * sqrt(|q|**2 - max(0, |p| - e)**2): what is left of v is orthogonal to c, so by
   Cauchy-Schwarz it meets only the part of q that is. No chance is involved.
3. A row whose interval can't reach an anchor's k-th score so far, or lies outside of all of
   its windows, is dropped; the rest are scored as integers.

Rows lie in groups of GROUP rows, by label bucket; TILE groups are a tile, anchors lie in
packs of ANCHORS, and PACKS packs meet a tile in a task. A pack keeps its k-th scores
over the tile and hands on k rows an anchor (and positive), which windows merge. Positives
are looked for only in tiles that have the label's bucket. The anchors meet all rows in
blocks; a task holds a tile and a set of packs, whatever the table's size.

In independent random vectors of few dimensions the intervals are wide and few rows are
dropped; where vectors have structure, or many dimensions, most are.

Rows whose id, label or vector is null or holds null or non-finite components take no part.
Missing components of shorter vectors count as 0; an empty vector scores 0 with all. An
anchor never finds a row with its own id; rows that repeat an id are candidates of their own,
and of anchors that repeat an id the least (label, vector) is the anchor. Ties go to the
smaller id. An anchor without positives, or a positive without negatives, has no rows, and
so has an empty table. Other columns don't matter. A score beyond 64 bits raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.topk import _best, _exact, _pad
from tallyloom.session import materialize

SCALE = 256
GROUP = 4096
TILE = 32
ANCHORS = 256
PACKS = 256
PLANES = 6
BUCKETS = 64
_SALTS = 32
#: Share of a block from which all of it is scored by one matrix product.
DENSE = 0.05


def code_width(dims: int) -> int:
    """Bits of a code: a power of two, whole words."""
    return max(64, 1 << max(0, dims - 1).bit_length())


def rotated(m: np.ndarray, width: int) -> np.ndarray:
    """Rows of m, padded to width (a power of two), turned by a fixed orthogonal transform."""
    x = _pad(m.astype(np.float64), width)
    signs = np.random.default_rng(width).integers(0, 2, (3, width)) * 2.0 - 1.0
    for s in signs:
        x = x * s
        h = 1
        while h < width:
            y = x.reshape(len(x), width // (2 * h), 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), width)
            h *= 2
        x = x / np.sqrt(width)
    return x


@dataclass
class Codes:
    """One-bit codes: words of sign bits, alignment with the code vector, residual length."""

    words: np.ndarray
    alignment: np.ndarray
    residual: np.ndarray


def encode(m: np.ndarray, width: int) -> Codes:
    x = rotated(m, width)
    bits = np.packbits(x >= 0, axis=1, bitorder="little").view(np.uint64) if len(x) else np.zeros((0, width // 64), np.uint64)
    with np.errstate(over="ignore", invalid="ignore"):
        alignment = np.abs(x).sum(axis=1) / np.sqrt(width)
        residual = np.sqrt(np.maximum((x * x).sum(axis=1) - alignment**2, 0))
    return Codes(bits, alignment, residual)


def intervals(q: np.ndarray, codes: Codes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) possible inner product of each row of q with each coded vector."""
    x = rotated(q, width)
    low = x.min(axis=1)
    step = np.maximum((x.max(axis=1) - low) / ((1 << PLANES) - 1), np.finfo(float).tiny)
    with np.errstate(over="ignore", invalid="ignore"):
        units = np.clip(np.nan_to_num(np.rint((x - low[:, None]) / step[:, None])), 0, (1 << PLANES) - 1).astype(np.uint8)
        cut = np.sqrt(((x - (low[:, None] + step[:, None] * units)) ** 2).sum(axis=1))
        length = np.sqrt((x * x).sum(axis=1))
        ones = np.bitwise_count(codes.words).sum(axis=1, dtype=np.int64)
        dot = np.zeros((len(q), len(codes.words)), np.float64)
        for b in range(PLANES):
            plane = np.packbits((units >> b) & 1, axis=1, bitorder="little").view(np.uint64)
            for w in range(plane.shape[1]):
                dot += np.bitwise_count(plane[:, w][:, None] & codes.words[:, w][None]) * float(1 << b)
        p = (low[:, None] * (2.0 * ones - width) + step[:, None] * (2 * dot - units.sum(axis=1, dtype=np.int64)[:, None])) / np.sqrt(width)
        about = p * codes.alignment
        apart = np.sqrt(np.maximum(length[:, None] ** 2 - np.maximum(np.abs(p) - cut[:, None], 0) ** 2, 0))
        size = length[:, None] * np.hypot(codes.alignment, codes.residual)
        # A little more than the exact interval, for rounding.
        off = codes.alignment * cut[:, None] + codes.residual * apart + 1e-9 * size + 1e-3
        least, most = about - off, about + off
    return np.where(np.isfinite(least), least, -np.inf), np.where(np.isfinite(most), most, np.inf)


def scores_of(q: np.ndarray, d: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact inner products where `wanted`; anything elsewhere."""
    width = max(q.shape[1], d.shape[1])
    q, d = _exact(_pad(q, width), _pad(d, width))
    if np.count_nonzero(wanted) > DENSE * wanted.size:
        return q @ d.T
    out = np.zeros(wanted.shape, q.dtype)
    i, j = np.nonzero(wanted)
    for a in range(0, len(i), 1 << 16):
        x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        out[x, y] = (q[x] * d[y]).sum(axis=1)
    return out


_whole = np.frompyfunc(int, 1, 1)


@dataclass
class Group:
    ids: np.ndarray
    labels: np.ndarray
    mat: np.ndarray
    codes: Codes | None = None


class Kept:
    """The best k (score, id) so far of each of n lists."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.rows, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(n, -np.inf)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids = np.concatenate([self.rows, rows]), np.concatenate([self.ids, ids])
        if len(self.scores) and self.scores.dtype != scores.dtype:
            self.scores, scores = _whole(self.scores), _whole(scores)
        scores = np.concatenate([self.scores, scores]) if len(self.scores) else scores
        keep = _best(rows, ids, scores, self.k)
        self.rows, self.ids, self.scores = rows[keep], ids[keep], scores[keep]
        ends = np.searchsorted(self.rows, np.arange(len(self.least) + 1))
        full = np.flatnonzero(np.diff(ends) == self.k)
        kth = self.scores[ends[full] + self.k - 1].astype(np.float64)
        self.least[full] = np.where(np.abs(kth) < 2**53, kth, kth - np.abs(kth) * 1e-15)


def _highest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf if it has fewer."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -np.inf)


def closest(q: Group, groups: Iterator[Group], k: int, width: int) -> tuple[Kept, int]:
    """The best k rows of each anchor's own label, and how many pairs were scored."""
    kept, scored = Kept(len(q.ids), k), 0
    for g in groups:
        same = (q.labels[:, None] == g.labels[None]) & (q.ids[:, None] != g.ids[None])
        if not same.any():
            continue
        least, most = intervals(q.mat, g.codes, width)
        floor = np.maximum(kept.least, _highest(np.where(same, least, -np.inf), k))
        wanted = same & (most >= floor[:, None])
        scored += np.count_nonzero(wanted)
        s = scores_of(q.mat, g.mat, wanted)
        i, j = np.nonzero(wanted & (s >= floor[:, None]))
        kept.add(i, g.ids[j], s[i, j])
    return kept, scored


def between(q: Group, low: np.ndarray, high: np.ndarray, groups: Iterator[Group], k: int, width: int) -> tuple[Kept, int]:
    """The best k rows of other labels in each window [low, high] (anchors x windows; empty
    where low > high): lists are numbered anchor by anchor. Also how many pairs were scored."""
    n, m = low.shape
    kept, scored = Kept(n * m, k), 0
    lowest, top = low.min(axis=1, where=low <= high, initial=2**62), high.max(axis=1, where=low <= high, initial=-(2**62))
    for g in groups:
        other = (q.labels[:, None] != g.labels[None]) & (q.ids[:, None] != g.ids[None]) & (lowest <= top)[:, None]
        if not other.any():
            continue
        # What a window still asks for, and the least of an anchor's windows.
        ask = np.where(low <= high, np.maximum(low.astype(np.float64), kept.least.reshape(n, m)), np.inf)
        least, most = intervals(q.mat, g.codes, width)
        wanted = other & (most >= ask.min(axis=1)[:, None]) & (least <= top[:, None])
        scored += np.count_nonzero(wanted)
        s = scores_of(q.mat, g.mat, wanted)
        for w in range(m):
            fits = wanted & (s >= low[:, w][:, None]) & (s <= high[:, w][:, None]) & (s >= ask[:, w][:, None])
            if np.count_nonzero(fits) > 4 * k * n:
                kth = _highest(np.where(fits, s.astype(np.float64), -np.inf), k)
                fits &= s >= (kth - np.abs(kth) * 1e-15)[:, None]
            i, j = np.nonzero(fits)
            kept.add(i * m + w, g.ids[j], s[i, j])
    return kept, scored


_RECORD = "bucket int, ids binary, labels binary, dims int, itemsize int, mat binary, words binary, alignment binary, residual binary"


def _packing(rows: int, width: int | None):
    """Records of up to `rows` vectors of one bucket, coded if width is given."""

    def emit(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, labels = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        dims = max(p[2].shape[1] for p in parts)
        mat = np.concatenate([_pad(p[2], dims) for p in parts])
        kind = np.dtype(np.int16 if np.abs(mat).max(initial=0) < 2**15 else np.float64)
        codes = encode(mat, width) if width else Codes(*(np.zeros(0),) * 3)
        binary = lambda a: pa.array([a.tobytes()], pa.binary())
        whole = lambda v: pa.array([v], pa.int32())
        columns = [whole(bucket), binary(ids), binary(labels), whole(dims), whole(kind.itemsize), binary(mat.astype(kind)), *(binary(x) for x in (codes.words, codes.alignment, codes.residual))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, n = None, [], 0
        for batch in batches:
            buckets, ids, labels = (batch.column(c).to_numpy() for c in ("bucket", "k", "label"))
            mat = _matrix(batch.column("v"))
            ends = [*(np.flatnonzero(np.diff(buckets)) + 1), len(buckets)]
            at = 0
            for end in ends:
                while at < end:
                    if parts and (buckets[at] != now or n == rows):
                        yield emit(now, parts)
                        parts, n = [], 0
                    now = int(buckets[at])
                    take = min(rows - n, end - at)
                    parts.append((ids[at : at + take], labels[at : at + take], mat[at : at + take]))
                    n, at = n + take, at + take
        if parts:
            yield emit(now, parts)

    return run


def _matrix(col: pa.Array) -> np.ndarray:
    """Components as floats that are whole numbers, a row a vector, padded with 0."""
    size = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, np.int64)
    out = np.zeros((len(col), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False))
    return out


def _group(row: dict, width: int | None) -> Group:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    flat = np.frombuffer(row["mat"], np.int16 if row["itemsize"] == 2 else np.float64).astype(np.float64)
    codes = None
    if width:
        words = np.frombuffer(row["words"], np.uint64).reshape(len(ids), width // 64)
        codes = Codes(words, np.frombuffer(row["alignment"]), np.frombuffer(row["residual"]))
    return Group(ids, labels, flat.reshape(len(ids), row["dims"]), codes)


def _records(rows: DataFrame, size: int, width: int | None, name: str) -> tuple[DataFrame, int]:
    """Records numbered by a gapless `at`, and how many there are."""
    salt = F.pmod(F.xxhash64("k", "v"), F.lit(_SALTS))
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")).repartition("bucket", salt).sortWithinPartitions("bucket")
    made = placed.select("bucket", "k", "label", "v").mapInArrow(_packing(size, width), _RECORD)
    records = materialize(made.withColumn("_at", F.monotonically_increasing_id()), name)
    counts = sorted((r[0], r[1]) for r in records.groupBy(F.shiftright("_at", 33)).agg(F.count("*")).collect())  # a row a partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    joined = records.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(rows.sparkSession.createDataFrame(before, "_p bigint, _before bigint")), "_p")
    return joined.withColumn("at", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_before"), total


def _met(groups: DataFrame, packs: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """run(groups of a tile, packs) for each tile and set of packs. pairs: pack, tile."""
    part = F.shiftright("pack", PACKS.bit_length() - 1).alias("part")
    asked = pairs.select("tile", part).distinct()
    left = groups.withColumn("tile", F.expr(f"at div {TILE}")).join(asked, "tile")
    right = packs.join(pairs, "pack").select("*", part)
    by = [F.col("tile"), F.col("part")]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def mine(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 10, least: tuple[int, int] = (3, 10), most: tuple[int, int] = (9, 10), key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    anchor and each of its positives, the negatives whose score is at least `least` and at
    most `most` (shares, as fractions of whole numbers) of the positive's."""
    rows, asked = _usable(vectors, key, label, vector), _usable(anchors, key, label, vector)
    one = asked.groupBy("k").agg(F.min(F.struct("label", "v")).alias("x")).select("k", "x.label", "x.v")
    width = code_width(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    # Anchors may be no rows of the table: their codes are as wide as the longer.
    width = max(width, code_width(one.agg(F.max(F.size("v"))).first()[0] or 0))
    groups, n_groups = _records(rows, GROUP, width, "groups")
    packs, _ = _records(one, ANCHORS, None, "anchors")
    packs = packs.select(F.col("at").alias("pack"), "bucket", "ids", "labels", "dims", "itemsize", "mat")
    last = max(n_groups - 1, 0) // TILE

    def each(group_rows: pa.Table, pack_rows: pa.Table):
        groups = sorted(group_rows.to_pylist(), key=lambda r: r["at"])
        for pack in pack_rows.to_pylist():
            q = _group(pack, None)
            yield pack, q, groups

    def positives(group_rows: pa.Table, pack_rows: pa.Table) -> pa.Table:
        out = []
        for pack, q, rows_ in each(group_rows, pack_rows):
            kept, _ = closest(q, (_group(r, width) for r in rows_ if r["bucket"] == pack["bucket"]), n_positives, width)
            out.append(_found(kept, pack=np.full(len(kept.rows), pack["pack"]), a=kept.rows))
        return pa.concat_tables(out)

    tiles = groups.select("bucket", F.expr(f"at div {TILE}").alias("tile")).distinct()
    near = _met(groups, packs, packs.select("pack", "bucket").join(tiles, "bucket").select("pack", "tile"), positives, "pack bigint, a bigint, id bigint, score bigint")
    best = Window.partitionBy("pack", "a").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("p", F.row_number().over(best) - 1).where(F.col("p") < n_positives)
    of_pack = ranked.groupBy("pack").agg(F.collect_list(F.struct("a", "p", "id", "score")).alias("positives"))  # n_positives an anchor of the pack
    full = materialize(packs.join(of_pack, "pack"), "positives")

    def negatives(group_rows: pa.Table, pack_rows: pa.Table) -> pa.Table:
        out = []
        for pack, q, rows_ in each(group_rows, pack_rows):
            best = np.zeros((len(q.ids), n_positives), np.int64), np.zeros((len(q.ids), n_positives), np.int64)
            low, high = np.ones((len(q.ids), n_positives), np.int64), np.zeros((len(q.ids), n_positives), np.int64)
            for x in pack["positives"]:
                low[x["a"], x["p"]] = -(-least[0] * x["score"] // least[1])
                high[x["a"], x["p"]] = most[0] * x["score"] // most[1]
                best[0][x["a"], x["p"]], best[1][x["a"], x["p"]] = x["id"], x["score"]
            kept, _ = between(q, low, high, (_group(r, width) for r in rows_), n_negatives, width)
            a, p = kept.rows // n_positives, kept.rows % n_positives
            out.append(_found(kept, anchor_id=q.ids[a], p=p, positive_id=best[0][a, p], positive_score=best[1][a, p]))
        return pa.concat_tables(out)

    all_tiles = full.select("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("tile"))
    hard = _met(groups, full, all_tiles, negatives, "anchor_id bigint, p bigint, positive_id bigint, positive_score bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor_id", "p").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _usable(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine).select(F.col(key).cast("long").alias("k"), F.col(label).cast("long").alias("label"), v.alias("v"))


def _found(kept: Kept, **where: np.ndarray) -> pa.Table:
    scores = [int(x) for x in kept.scores] if kept.scores.dtype == object else kept.scores.astype(np.int64)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in {**where, "id": kept.ids, "score": scores}.items()})
