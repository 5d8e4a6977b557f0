"""Uniform random sharding with exact shard sizes, by a communication matrix.

1. One narrow pass reads the rows; what is needed of each (id, size, checksum) and its
   partition are written to the shared folder, so later steps see the same partitions.
2. The matrix of how many rows go from each partition to each shard follows the
   multivariate hypergeometric law given its row sums (partition sizes) and column sums
   (shard sizes, which differ by one at most). Each partition draws its own row of it: the
   partitions form a binary tree, every node's counts are split between its two halves
   with a generator seeded by the node, and a task walks from the root to its leaf. So no
   process holds the matrix, and equal nodes draw equal splits wherever they run.
3. Each partition permutes its rows and deals them out by its row of the matrix.
4. After the exchange each shard is permuted again: a row gets a random key, the keys'
   leading bits cut a shard into parts, and a row's slot is the number of rows in earlier
   parts plus its place in its own part. So a shard's slots don't come from one task.

Null texts have size OVERHEAD and checksum 0. Rows that repeat, and rows with a null id, are
rows of their own. Other columns don't matter, whatever their names; an empty table gives
no rows. Counts are exact; draws from populations of 10**9 rows or more weigh by floats.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize

OVERHEAD = 16
#: Rows of a part of a shard, on average.
PART_ROWS = 50_000
#: numpy's generators take populations below this.
_NUMPY_MOST = 10**9


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most; the first ones are larger."""
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items without replacement are good; any population size."""
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1)))
    # Weights relative to the mode's, from the ratios of neighbours; what lies beyond is
    # less than a float can tell.
    span = int(14 * sd) + 64
    k = np.arange(max(low, mode - span), min(high, mode + span), dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.cumsum(np.exp(logs - logs.max()))
    return max(low, mode - span) + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def split_counts(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """Of items of several colours, how many of each are among `draws` drawn."""
    out = np.zeros_like(counts)
    rest = int(counts.sum())
    for k, n in enumerate(counts):
        if draws == 0:
            break
        rest -= int(n)
        out[k] = hypergeometric(rng, int(n), rest, draws) if rest else draws
        draws -= int(out[k])
    return out


def matrix_row(ends: np.ndarray, sizes: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """Rows that `partition` sends to each shard. ends: running sum of partition sizes,
    with a leading 0."""
    low, high, counts = 0, len(ends) - 1, sizes.copy()
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = split_counts(rng, counts, int(ends[mid] - ends[low]))
        low, high, counts = (low, mid, left) if partition < mid else (mid, high, counts - left)
    return counts


def assign(docs: DataFrame, shards: int, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard: a row a row of docs."""
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = materialize(
        docs.select(
            F.col(key).alias("_k"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + OVERHEAD).alias("_size"),
            F.crc32(raw).alias("_crc"), F.spark_partition_id().alias("_p"),
        ),
        "rows",
    )
    # One count a partition of the input, not a row.
    count = {r[0]: r[1] for r in rows.groupBy("_p").agg(F.count("*")).collect()}
    numbers = sorted(count)
    place = {p: i for i, p in enumerate(numbers)}
    ends = np.concatenate(([0], np.cumsum([count[p] for p in numbers], dtype=np.int64)))
    sizes = shard_sizes(int(ends[-1]), shards)
    shared = docs.sparkSession.sparkContext.broadcast((place, ends, sizes))
    kind = docs.schema[key].dataType.simpleString()

    def deal(_: tuple, batch: pa.Table) -> pa.Table:
        """One partition's rows: permuted, then dealt out by its row of the matrix."""
        place, ends, sizes = shared.value
        p = batch.column("_p")[0].as_py()
        order = pc.sort_indices(batch, [("_k", "ascending"), ("_crc", "ascending")])
        batch = batch.take(order)
        rng = np.random.default_rng([seed, zlib.crc32(b"deal"), p])
        row = matrix_row(ends, sizes, place[p], seed)
        shard = np.repeat(np.arange(shards), row)
        shard = shard[np.argsort(rng.random(len(shard)), kind="stable")]
        return pa.table(
            {"_k": batch.column("_k"), "_size": batch.column("_size"), "_crc": batch.column("_crc"),
             "_shard": pa.array(shard, pa.int32()), "_u": pa.array(rng.integers(0, 2**62, len(shard)))}
        )

    dealt = rows.groupBy("_p").applyInArrow(deal, f"_k {kind}, _size bigint, _crc bigint, _shard int, _u bigint")
    parts = max(1, math.ceil(int(ends[-1]) / shards / PART_ROWS))
    width = 2**62 // parts + 1
    dealt = materialize(dealt.withColumn("_part", F.expr(f"cast(_u div {width} as int)")), "dealt")
    before = (
        dealt.groupBy("_shard", "_part").agg(F.count("*").alias("_n"))  # shards * parts rows
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("_shard").orderBy("_part")) - F.col("_n"))
        .select("_shard", "_part", "_before")
    )
    within = Window.partitionBy("_shard", "_part").orderBy("_u", "_k", "_crc")
    slotted = dealt.withColumn("_in", F.row_number().over(within) - 1).join(before, ["_shard", "_part"])
    return slotted.select(
        F.col("_k").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), (F.col("_before") + F.col("_in")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 1, text: str = "text") -> None:
    """All rows of docs with their shard and slot (columns of these names are replaced),
    written to path/shard=N, each shard's files in slot order. Rows are told apart by a
    number they get here, so ids may repeat or be null."""
    row = "_shard_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    docs = materialize(docs.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()), "numbered")
    placed = assign(docs, shards, seed, row, text).select(row, "shard", "slot")
    full = docs.join(placed, row).drop(row)
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
