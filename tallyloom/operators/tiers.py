"""The matching rules as set-based joins and aggregates.

Each works on a table of open legs (schema.LEG) and is what the rule alone does to legs that
no other rule disputes, for analysis over a whole table. operators.resolve settles all rules
together, incrementally: pairs and duplicates by aggregation, the rest by a fold in order of
arrival. "Incoming" is the leg with the larger ingest_seq, whose amount the tolerance refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.columns import derived_id, tolerance, tolerant_confidence, within_days
from tallyloom.rules import Rules
from tallyloom.session import materialize

WINDOW_KEY = ["currency", "counterparty"]


def _pairs(legs: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """(l, c): incoming and earlier leg of other sources that agree on keys, near in date."""
    side = legs.select(F.struct(*[c for c in legs.columns]).alias("x"), *[F.col(k).alias(f"_{k}") for k in keys])
    on = [f"_{k}" for k in keys]
    met = side.withColumnRenamed("x", "l").join(side.withColumnRenamed("x", "c"), on)
    return met.where((F.col("l.ingest_seq") > F.col("c.ingest_seq")) & (F.col("l.source") != F.col("c.source")) & within_days(F.col("l.value_date"), F.col("c.value_date"), rules)).drop(*on)


def match_columns(l: Column, c: Column, tier: int, rule: str, confidence: Column) -> dict[str, Column]:
    ids = F.array_sort(F.array(l["id"], c["id"]))
    return {
        "id": derived_id("m", ids), "leg_ids": ids, "tier": F.lit(tier), "rule_id": F.lit(rule), "confidence": confidence,
        "residual_minor": c["amount_minor"] - l["amount_minor"], "currency": l["currency"],
    }


def _best(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """One partner a leg, by the given order and then the canonical one."""
    by = Window.partitionBy("l.id").orderBy(*order, "c.value_date", "c.txn_ref", "c.id")
    return pairs.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def _match(pairs: DataFrame, tier: int, rule: str, confidence: Column) -> DataFrame:
    cols = match_columns(F.col("l"), F.col("c"), tier, rule, confidence)
    return pairs.select(*[v.alias(k) for k, v in cols.items()])


def exact(legs: DataFrame, rules: Rules) -> DataFrame:
    """Same reference, window and amount."""
    return _match(_best(_pairs(legs, [*WINDOW_KEY, "txn_ref", "amount_minor"], rules), []), 1, S.T1_EXACT, F.lit(1.0))


def ref_tolerant(legs: DataFrame, rules: Rules) -> DataFrame:
    """Same reference and window, amounts that differ within tolerance; least difference."""
    diff = F.abs(F.col("c.amount_minor") - F.col("l.amount_minor"))
    tol = tolerance(F.col("l.amount_minor"), rules)
    found = _pairs(legs, [*WINDOW_KEY, "txn_ref"], rules).where((diff <= tol) & (diff > 0))
    return _match(_best(found, [diff]), 2, S.T2_REF, tolerant_confidence(diff, tol))


def amount_date(legs: DataFrame, rules: Rules) -> DataFrame:
    """Equal amounts without a shared reference, each the only candidate of the other within
    the date window, and neither reference known on the other's source."""
    same = [*WINDOW_KEY, "amount_minor"]
    # Read several times, so normalised and written once.
    legs = materialize(legs.select(*same, "value_date", "source", "ingest_seq", "id", "txn_ref"), "legs")
    # A row a day and source, so that a popular amount is no more rows than it has days.
    days = legs.dropna(subset=[*same, "value_date", "source"]).groupBy(*same, "value_date", "source").agg(F.count("*").alias("n"))
    span = rules.value_date_window_days
    near = Window.partitionBy(*same).orderBy(F.unix_date("value_date")).rangeBetween(-span, span)
    # Two legs of one source and day are rivals of each other for every partner.
    others = F.filter(F.collect_list(F.struct("source", "value_date", "n")).over(near), lambda y: y["source"] != F.col("source"))
    lone = days.withColumn("_y", F.when(F.col("n") == 1, others)).withColumn("_y", F.when(F.size("_y") == 1, F.get("_y", 0))).where("_y.n = 1")
    # The only candidate of each other: then the pair comes twice.
    pair = lone.select(*same, F.array_sort(F.array(F.struct("source", "value_date"), F.struct("_y.source", "_y.value_date"))).alias("p")).groupBy(*same, "p").agg(F.count("*").alias("n"))
    pair = pair.where("n = 2").select(*same, "p", F.col("p")[0]["source"].alias("source"), F.col("p")[0]["value_date"].alias("value_date"))
    side = F.struct("ingest_seq", "id", "txn_ref", "source", "currency", "amount_minor")
    found = pair.join(legs, [*same, "source", "value_date"]).select(*same, side.alias("x"), F.col("p")[1]["source"].alias("source"), F.col("p")[1]["value_date"].alias("value_date"))
    found = found.join(legs, [*same, "source", "value_date"]).select("x", side.alias("y")).where("x.ingest_seq <> y.ingest_seq AND x.txn_ref <> y.txn_ref")
    later = F.col("x.ingest_seq") > F.col("y.ingest_seq")
    found = materialize(found.select(F.when(later, F.col("x")).otherwise(F.col("y")).alias("l"), F.when(later, F.col("y")).otherwise(F.col("x")).alias("c")), "by_amount")
    # A reference known on the other's source: only references move, no pairs.
    uses = F.explode(F.array(F.struct(F.col("c.txn_ref").alias("r"), F.col("l.source").alias("s")), F.struct(F.col("l.txn_ref").alias("r"), F.col("c.source").alias("s"))))
    known = found.select(F.col("l.id").alias("_id"), uses.alias("u")).select("_id", F.col("u.r").alias("txn_ref"), F.col("u.s").alias("source"))
    known = known.join(legs.select("txn_ref", "source"), ["txn_ref", "source"], "left_semi").select("_id").distinct()
    found = found.join(known, F.col("l.id") == F.col("_id"), "left_anti")
    return _match(found, 2, S.T2_AMOUNT_DATE, F.lit(0.75))


def full_batches(legs: DataFrame, rules: Rules) -> DataFrame:
    """Settlements that equal, within tolerance, the sum of all legs of their batch: 2 to
    t3_max_subset legs of one other source, all near the settlement's date."""
    batch = F.try_element_at("attrs", F.lit("batch_ref"))
    parts = legs.where(F.coalesce(batch, F.lit("")) != "").select(*WINDOW_KEY, batch.alias("_b"), F.col("id").alias("_id"), F.col("source").alias("_src"), F.col("amount_minor").alias("_amount"), F.col("value_date").alias("_date"))
    one = legs.select(*WINDOW_KEY, F.coalesce(F.when(batch != "", batch), F.col("txn_ref")).alias("_b"), "id", "source", "amount_minor", "value_date")
    met = parts.join(one, [*WINDOW_KEY, "_b"]).where((F.col("_src") != F.col("source")) & (F.col("_id") != F.col("id")) & within_days(F.col("_date"), F.col("value_date"), rules))
    # Counted first: ids are only collected of settlements with few enough legs, whose sums fit.
    few = met.groupBy("id", "_src").agg(F.count("*").alias("_n"), F.sum("_amount").alias("_sum"), F.any_value("amount_minor").alias("_target"))
    tol, residual = tolerance(F.col("_target"), rules), F.col("_sum") - F.col("_target")
    few = few.where((F.col("_n") >= 2) & (F.col("_n") <= rules.t3_max_subset) & (F.abs(residual) <= tol)).drop("_n")
    found = met.join(few, ["id", "_src"]).groupBy("id", "_src").agg(
        F.any_value("_sum").alias("_sum"), F.any_value("_target").alias("_target"), F.any_value("currency").alias("currency"), F.collect_list("_id").alias("_ids")
    )
    ids = F.array_sort(F.array_append("_ids", F.col("id")))
    return found.select(
        derived_id("m", ids).alias("id"), ids.alias("leg_ids"), F.lit(3).alias("tier"), F.lit(S.T3_SUBSET).alias("rule_id"),
        (tolerant_confidence(residual, tol) - F.lit(0.1)).alias("confidence"), residual.alias("residual_minor"), "currency",
    )


def reused_refs(legs: DataFrame) -> DataFrame:
    """Legs whose source had used their reference before, with other content."""
    first = legs.groupBy("source", "txn_ref").agg(F.min("ingest_seq").alias("_first"))
    return legs.join(first, ["source", "txn_ref"]).where("ingest_seq > _first").drop("_first").select(legs.columns)
