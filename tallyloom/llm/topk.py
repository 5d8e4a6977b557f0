"""Exact top-k by integer inner product, with block-at-a-time pruning.

Vectors become integers, floor(SCALE * x).

1. A sample of at most SAMPLE rows, those of the least hashed ids, goes to the driver. Its
   first CENTRES are centres: every row is dealt to the nearest one, so that alike rows
   come together, in whatever files they were. For each query the k-th score among the
   sample is a first bound of its k-th score among all.
2. Rows are packed in the order of their centres into groups of GROUP rows: one record with
   ids and the component matrix, cut into blocks of BLOCK rows whose largest and smallest
   component in every dimension are kept (the term maxima). Queries are packed likewise.
3. A block's bound for a query is the sum over dimensions of the larger of q * max and
   q * min. TILE groups are a tile and PACKS packs of queries a part; a task has one tile and
   one part. Each query's blocks of a group are ordered by bound and scored through their
   matrix, the best block of all queries first, until a bound falls below the query's k-th
   score; a block whose bound equals it is scored, since a smaller id would win the tie.
4. A query's k-th score goes from group to group of a tile, so a tile yields at most k rows a
   query, and only such that reach the first bound. A ranked window merges the tiles.

The query set meets all rows in blocks: groups are sent once a part and queries once a tile,
what a tile yields grows with queries times tiles, no task holds more than a tile and a part,
and what is broadcast is the sample, SAMPLE_BYTES at most.
Blocks are skipped where vectors have structure: groups of like vectors, sparse or
non-negative ones. In independent random vectors of many dimensions no block of two or more
rows has a bound below the k-th score, and all are scored.

Vectors that are null or hold null or non-finite components take no part; an empty vector
has the score 0 with all. Missing components of shorter vectors count as 0. A query never
finds a row with its own id. Rows that repeat an id are candidates of their own; of queries
that repeat an id, the least vector is the query. Rows with a null id take no part. Other
columns don't matter; an empty table gives no rows. Sums are exact whatever their size
(floats up to 2**53, then 64-bit, then Python integers); a score beyond 64 bits raises only
if it is one of those returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize

SCALE = 64
GROUP = 8192
BLOCK = 256
QUERY_PACK = 2048
SAMPLE = 4096
CENTRES = 256
#: The sample's components, as they are broadcast.
SAMPLE_BYTES = 64 << 20
#: Groups of a tile, and packs of queries of a part.
TILE = 16
PACKS = 8
_SALTS = 64


def _matrix(col: pa.Array) -> np.ndarray:
    """Components as floats that are whole numbers, a row a vector, padded with 0."""
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, np.int64)
    width = int(size.max(initial=0))
    out = np.zeros((len(col), width))
    out[np.arange(width) < size[:, None]] = np.floor(SCALE * values)
    return out


def _pad(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine).select(F.col(key).cast("long").alias("k"), v.alias("v"))


def _sampled(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    found = rows.orderBy(F.xxhash64("k"), "k", "v").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, width))))).toArrow()
    return found.column("k").to_numpy(), _matrix(found.column("v").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.float64())))


def _celled(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with `cell`, the nearest centre."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, c = _matrix(batch.column(1)), shared.value
            width = max(m.shape[1], c.shape[1])
            m, c = _pad(m, width), _pad(c, width)
            scale = max(1.0, np.abs(m).max(initial=0), np.abs(c).max(initial=0))
            m, c = m / scale, c / scale
            cell = (m @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1) if len(c) else np.zeros(len(m))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["k", "v", "cell"])

    return rows.mapInArrow(run, "k bigint, v array<double>, cell int")


_RECORD = "ids binary, dims int, itemsize int, mat binary, high binary, low binary"


def _pack(rows: int):
    """Records of up to `rows` vectors: ids, dims, components, maxima and minima of blocks."""

    def emit(ids: list[np.ndarray], mats: list[np.ndarray]) -> pa.RecordBatch:
        width = max(m.shape[1] for m in mats)
        mat, own = np.concatenate([_pad(m, width) for m in mats]), np.concatenate(ids)
        starts = range(0, len(own), BLOCK)
        high = np.array([mat[s : s + BLOCK].max(axis=0) for s in starts])
        low = np.array([mat[s : s + BLOCK].min(axis=0) for s in starts])
        kind = np.dtype(np.int16 if np.abs(mat).max(initial=0) < 2**15 else np.float64)
        binary = lambda a: pa.array([a.tobytes()], pa.binary())
        columns = [binary(own), pa.array([width], pa.int32()), pa.array([kind.itemsize], pa.int32()), *(binary(m.astype(kind)) for m in (mat, high, low))]
        return pa.RecordBatch.from_arrays(columns, ["ids", "dims", "itemsize", "mat", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mats, n = [], [], 0
        for batch in batches:
            own, mat = batch.column(0).to_numpy(), _matrix(batch.column(1))
            while len(own):
                take = min(rows - n, len(own))
                ids.append(own[:take])
                mats.append(mat[:take])
                n += take
                own, mat = own[take:], mat[take:]
                if n == rows:
                    yield emit(ids, mats)
                    ids, mats, n = [], [], 0
        if n:
            yield emit(ids, mats)

    return run


def _packed(rows: DataFrame, size: int, centres: np.ndarray, name: str) -> tuple[DataFrame, int]:
    """Records numbered by a gapless `at`, and how many there are."""
    salt = F.pmod(F.xxhash64("k"), F.lit(_SALTS))
    sorted_ = _celled(rows, centres).repartition("cell", salt).sortWithinPartitions("cell")
    records = materialize(sorted_.select("k", "v").mapInArrow(_pack(size), _RECORD).withColumn("at", F.monotonically_increasing_id()), name)
    # monotonically_increasing_id holds the partition above 33 bits: one count a partition.
    counts = sorted((r[0], r[1]) for r in records.groupBy(F.shiftright("at", 33)).agg(F.count("*")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "p bigint, before bigint")  # a row a partition
    placed = records.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(offsets), "p")
    return placed.withColumn("at", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("p", "before"), total


def _unpack(row: dict, field: str = "mat", prefix: str = "") -> np.ndarray:
    kind = np.int16 if row[prefix + "itemsize"] == 2 else np.float64
    flat = np.frombuffer(row[prefix + field], kind).astype(np.float64)
    dims = row[prefix + "dims"]
    return flat.reshape(-1, dims) if dims else np.zeros((len(row[prefix + "ids"]) // 8 if field == "mat" else 1, 0))


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """queries x blocks; a little above the exact sums, so that rounding never prunes."""
    width = max(q.shape[1], high.shape[1])
    q, high, low = _pad(q, width), _pad(high, width), _pad(low, width)
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        slack = (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T) * 1e-12
        out = out + np.where(slack > 0.5, slack, 0)
    return np.where(np.isfinite(out), out, np.inf)


def _exact(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """q and d in a kind in which all products and sums are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return q, d
    if most < 2**62:
        return q.astype(np.int64), d.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(q), whole(d)


def _best(i: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the best k of their query."""
    order = np.lexsort((ids, -scores, i))
    first = np.searchsorted(i[order], i[order], side="left")
    return order[np.arange(len(order)) - first < k]


_whole = np.frompyfunc(int, 1, 1)
Found = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of two kinds as ones of one kind."""
    return (a, b) if a.dtype == b.dtype or not len(a) else (_whole(a), _whole(b))


def _raise_floor(least: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> None:
    """least, at the k-th score of the queries that have so many (rows in order of rank)."""
    ends = np.searchsorted(rows, np.arange(len(least) + 1))
    full = np.flatnonzero(np.diff(ends) == k)
    # A float a little below the k-th score where that has no float of its own.
    kth = scores[ends[full] + k - 1].astype(np.float64)
    least[full] = np.maximum(least[full], np.where(np.abs(kth) < 2**53, kth, kth - np.abs(kth) * 1e-15))


def search_group(qid: np.ndarray, q: np.ndarray, did: np.ndarray, d: np.ndarray, k: int, floor: np.ndarray | None = None, block: int = BLOCK, before: Found | None = None, limits: tuple[np.ndarray, np.ndarray] | None = None) -> Found:
    """(query indexes, ids, scores, blocks scored): the best k rows of a group and of those
    found before for each query, less those below floor, by query and rank. limits: maxima and
    minima of the blocks, if they are known."""
    width = max(q.shape[1], d.shape[1])
    q, d = _pad(q, width), _pad(d, width)
    starts = list(range(0, len(did), block))
    high, low = limits or (np.array([d[s : s + block].max(axis=0) for s in starts]), np.array([d[s : s + block].min(axis=0) for s in starts]))
    bound = bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    qx, dx = _exact(q, d)
    least = np.full(len(qid), -np.inf) if floor is None else floor.astype(np.float64)
    rows, ids, scores, scored = before or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, qx.dtype), 0)
    if len(rows):
        _raise_floor(least, rows, scores, k)
    for step in range(len(starts)):
        at = order[:, step]
        active = np.flatnonzero(bound[np.arange(len(qid)), at] >= least)
        if not len(active):
            break
        scored += len(active)
        new_rows, new_ids, new_scores = [rows], [ids], [scores]
        for b in np.unique(at[active]):
            own = active[at[active] == b]
            part = slice(starts[b], starts[b] + block)
            s = qx[own] @ dx[part].T
            x, y = np.nonzero((s >= least[own][:, None]) & (did[part][None] != qid[own][:, None]))
            new_rows.append(own[x])
            new_ids.append(did[part][y])
            new_scores.append(s[x, y])
        new_scores[0], more = _alike(new_scores[0], np.concatenate(new_scores[1:]))
        rows, ids, scores = np.concatenate(new_rows), np.concatenate(new_ids), np.concatenate([new_scores[0], more]) if len(new_scores[0]) else more
        keep = _best(rows, ids, scores, k)
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
        _raise_floor(least, rows, scores, k)
    return rows, ids, scores, scored


def _floors(qid: np.ndarray, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The k-th score of each query among the sample, -inf if it has fewer."""
    did, d = sample
    out = np.full(len(qid), -np.inf)
    width = max(q.shape[1], d.shape[1])
    q, d = _exact(_pad(q, width), _pad(d, width))
    for a in range(0, len(qid), 256):
        s = (q[a : a + 256] @ d.T).astype(np.float64)
        s[qid[a : a + 256][:, None] == did[None]] = -np.inf
        if s.shape[1] >= k:
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            out[a : a + 256] = np.where(np.abs(kth) < 2**53, kth, kth - np.abs(kth) * 1e-15)
    return out


def met(groups: DataFrame, packs: DataFrame, n_groups: int, n_packs: int):
    """Every tile of groups (numbered by at) with every part of packs (numbered by q)."""
    all_of = lambda n, size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0) // size).cast("long")))
    left = groups.withColumns({"tile": F.expr(f"at div {TILE}"), "part": all_of(n_packs, PACKS)})
    right = packs.withColumns({"part": F.expr(f"q div {PACKS}"), "tile": all_of(n_groups, TILE)})
    return left.groupBy(F.col("tile"), F.col("part")).cogroup(right.groupBy(F.col("tile"), F.col("part")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other rows."""
    spark = vectors.sparkSession
    rows = _usable(vectors, key, vector)
    asked = _usable(queries, key, vector).groupBy("k").agg(F.min("v").alias("v"))
    sample = _sampled(rows)
    centres = sample[1][:CENTRES]
    groups, n_groups = _packed(rows, GROUP, centres, "groups")
    packs, n_packs = _packed(asked, QUERY_PACK, centres, "queries")
    known = spark.sparkContext.broadcast(sample)

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                floors.append(_floors(np.frombuffer(row["ids"], np.int64), _unpack(row), known.value, k).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("at", "ids", "dims", "itemsize", "mat")] + [pa.array(floors, pa.binary())], ["q", "q_ids", "q_dims", "q_itemsize", "q_mat", "q_floor"])

    packs = materialize(packs.mapInArrow(with_floor, "q bigint, q_ids binary, q_dims int, q_itemsize int, q_mat binary, q_floor binary"), "packs")

    def run(group_rows: pa.Table, pack_rows: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("about", pa.float64())])
        groups = [(np.frombuffer(g["ids"], np.int64), _unpack(g), (_unpack(g, "high"), _unpack(g, "low"))) for g in sorted(group_rows.to_pylist(), key=lambda g: g["at"])]
        out = [kinds.empty_table()]
        for row in pack_rows.to_pylist():
            qid, q, floor, best = np.frombuffer(row["q_ids"], np.int64), _unpack(row, prefix="q_"), np.frombuffer(row["q_floor"]), None
            for did, d, limits in groups:
                best = search_group(qid, q, did, d, k, floor, before=best, limits=limits)
            own, ids, scores, _ = best or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0)
            # Scores beyond 64 bits go as nulls and raise if they are among the results.
            fits = np.abs(scores) < 2**63 if scores.dtype == object else np.ones(len(scores), bool)
            part = np.where(fits, scores, 0).astype(np.int64)
            out.append(pa.table([pa.array(qid[own]), pa.array(ids), pa.array(part, mask=~fits), pa.array(scores.astype(np.float64))], schema=kinds))
        return pa.concat_tables(out)

    found = met(groups, packs, n_groups, n_packs).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint, about double")
    # `about` settles the order only where a score is beyond 64 bits.
    large = F.when(F.col("score").isNull(), F.col("about")).otherwise(0.0)
    best = Window.partitionBy("query_id").orderBy(F.desc(large), F.desc_nulls_last("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.when(F.col("score").isNull(), F.raise_error(F.lit("a score is beyond 64 bits")).cast("long")).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
