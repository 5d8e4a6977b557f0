"""Best-fit packing of documents into training sequences, under conflicts.

A document becomes pieces of at most `capacity` units (its length; a longer document is
cut). Pieces go into bins of that capacity so that no bin holds two documents of one
duplicate cluster, nor two of one source. The items of a pack group are taken in order of
decreasing length; open bins are ordered by residual (a list of bins for each residual, a
bitmap of the residuals that have any), and each bin carries a bitmap of its sources and
one of its clusters. The search starts at the smallest residual that holds the item and
goes to the successor until a bin's bitmaps don't meet the item's; that is the tightest
compatible bin. If none is left, a new bin opens.

Documents are dealt to pack groups by a hash of their id, text and place in the input,
about GROUP_ROWS each, so a hot source, a hot cluster or a row that repeats without end
spreads over all groups and no task holds more than its groups' items: four numbers an
item, never the text. Groups pack independently.

A null or empty text has length 0 and takes up one piece of length 0. A null source
conflicts with no source. Null ids and rows that repeat are items of their own; copies of
a row are one cluster. Which of equal items goes first is settled by a hash of id and text.
Other columns don't matter, whatever their names; an empty table gives no bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialize

CAPACITY = 2048
GROUP_ROWS = 4096
#: UTF-8 bytes counted as one unit of length.
UNIT_BYTES = 4


class Bins:
    """Open bins of one group, ordered by residual."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_residual: dict[int, list[int]] = {}
        self.present = 0  # bit r: some open bin has residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of an item; source and cluster are bitmaps (0: no conflict)."""
        above = self.present >> length
        residual = length
        sources, clusters = self.sources, self.clusters
        while above:
            step = (above & -above).bit_length() - 1
            residual += step
            held = self.by_residual[residual]
            for at, b in enumerate(held):
                if not (sources[b] & source or clusters[b] & cluster):
                    del held[at]
                    if not held:
                        self.present ^= 1 << residual
                    return self._put(b, residual, length, source, cluster)
            above >>= step + 1
            residual += 1
        b = len(self.used)
        self.used.append(0)
        sources.append(0)
        clusters.append(0)
        return self._put(b, self.capacity, length, source, cluster)

    def _put(self, b: int, residual: int, length: int, source: int, cluster: int) -> tuple[int, int]:
        offset = self.used[b]
        self.used[b] += length
        self.sources[b] |= source
        self.clusters[b] |= cluster
        residual -= length
        if residual:
            self.by_residual.setdefault(residual, []).append(b)
            self.present |= 1 << residual
        return b, offset


def _bits(values: np.ndarray, valid: np.ndarray) -> list[int]:
    """A bitmap a row, with one bit for each value that two or more rows hold."""
    bits = [0] * len(values)
    where = np.flatnonzero(valid)
    if len(where):
        _, inverse, count = np.unique(values[where], return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        for i, k in zip(where.tolist(), inverse.tolist()):
            if count[k] > 1:
                bits[i] = 1 << int(number[k])
    return bits


def pack_items(length: np.ndarray, source: np.ndarray, has_source: np.ndarray, cluster: np.ndarray, order: np.ndarray, capacity: int):
    """(item, piece, length, bin, offset) arrays for one group; `order` breaks ties."""
    full, rest = np.divmod(length, capacity)
    n_full = np.where((rest == 0) & (full > 0), full, full + 1)
    item = np.repeat(np.arange(len(length)), n_full)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(n_full) - n_full, n_full)
    size = np.minimum(length[item] - piece * capacity, capacity)
    source_bits, cluster_bits = _bits(source, has_source), _bits(cluster, np.ones(len(cluster), bool))
    # All pieces of a document but one fill their bins, so two of them never meet.
    bins = Bins(capacity)
    bin_of, offset = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    for k in np.lexsort((piece, order[item], -size)).tolist():
        i = int(item[k])
        bin_of[k], offset[k] = bins.place(int(size[k]), source_bits[i], cluster_bits[i])
    return item, piece, size, bin_of, offset


def pack(
    docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source",
    length: Column | None = None, cluster: Column | None = None, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """key, piece, n_units, bin_group, bin, bin_offset: a row a piece, at least one a row
    of docs. length: units of a row (default: UTF-8 bytes / UNIT_BYTES, rounded up);
    cluster: any 64-bit cluster id (default: a hash of the text)."""
    body = F.coalesce(F.col(text), F.lit(""))
    length = F.ceil(F.octet_length(body) / F.lit(UNIT_BYTES)) if length is None else length
    cluster = F.xxhash64(body) if cluster is None else cluster
    items = docs.select(
        F.col(key).alias("_k"), length.cast("long").alias("_n"), F.xxhash64(F.col(source)).alias("_s"), F.col(source).isNotNull().alias("_has"),
        cluster.cast("long").alias("_c"), F.xxhash64(F.lit(17), F.col(key), body, F.monotonically_increasing_id()).alias("_g"),
        F.xxhash64(F.col(key), body).alias("_o"),
    )
    # Written first: a task that is run again finds its rows in the groups they had. Only the
    # row count reaches the driver.
    items = materialize(items, "items")
    groups = max(1, -(-items.count() // group_rows))
    items = items.withColumn("_g", F.pmod("_g", F.lit(groups)).cast("int"))
    kind = docs.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).combine_chunks() for c in table.column_names}
        num = {c: col[c].to_numpy(zero_copy_only=False) for c in ("_n", "_s", "_has", "_c", "_o")}
        item, piece, size, b, offset = pack_items(num["_n"].astype(np.int64), num["_s"], num["_has"].astype(bool), num["_c"], num["_o"], capacity)
        return pa.table(
            {key: col["_k"].take(pa.array(item)), "piece": pa.array(piece, pa.int32()), "n_units": pa.array(size, pa.int64()),
             "bin_group": col["_g"].take(pa.array(item)), "bin": pa.array(b, pa.int32()), "bin_offset": pa.array(offset, pa.int64())}
        )

    return items.groupBy("_g").applyInArrow(run, f"`{key}` {kind}, piece int, n_units bigint, bin_group int, bin int, bin_offset bigint")
