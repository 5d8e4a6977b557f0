"""Positions of rows within groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize


def ranked(rows: DataFrame, group: str, order: list[str], name: str = "ranked") -> DataFrame:
    """rows with `pos`, 0, 1, ... within each value of `group` (never null) by `order`, nulls
    first, and `n`, the size of the group.

    rows are written first, so that rows which tie have an order that a repeated task sees
    again; then range-partitioned and sorted, ties included, so that a hot group or many equal
    rows are spread over tasks. What a range has before it comes from one row a range and
    group. Columns _tie, _at, _p, _first and _before are used on the way."""
    stable = materialize(rows, name).withColumn("_tie", F.monotonically_increasing_id())
    by = [group, *order, "_tie"]
    placed = materialize(stable.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_p", F.shiftright("_at", 33)).drop("_tie")
    runs = placed.groupBy("_p", group).agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    so_far = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_before", F.sum("n").over(so_far) - F.col("n")).withColumn("n", F.sum("n").over(Window.partitionBy(group)))
    joined = placed.join(runs, ["_p", group])
    return joined.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_p", "_at", "_first", "_before")
