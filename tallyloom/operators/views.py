"""Queries over the projections: statistics, break listings, lookups and event pages."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import __version__
from tallyloom.functions.columns import age_seconds
from tallyloom.operators.resolve import State
from tallyloom.rules import Rules

# Bounds of residuals in a histogram, minor units.
RESIDUAL_BOUNDS = (0, 1, 2, 5, 10, 25, 50, 100, 500)


def leg_counts(legs: DataFrame) -> DataFrame:
    """total, open, matched, in_break and the automatic match rate (open legs left out)."""
    done = F.count_if(F.col("status") == "matched")
    failed = F.count_if(F.col("status") == "break")
    return legs.agg(
        F.count("*").alias("legs_total"), F.count_if(F.col("status") == "open").alias("legs_open"), done.alias("legs_matched"), failed.alias("legs_in_break"),
        F.when(done + failed > 0, done / (done + failed)).otherwise(F.lit(0.0)).alias("auto_match_rate"),
    )


def count_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def tier_name(tier: Column) -> Column:
    return F.when(tier.between(1, 3), F.concat(F.lit("T"), tier.cast("string"))).otherwise(F.lit("unknown"))


def break_counts(breaks: DataFrame) -> DataFrame:
    is_open = F.col("status") == "open"
    return breaks.agg(F.count_if(is_open).alias("breaks_open"), F.count_if(F.col("status") == "resolved").alias("breaks_resolved"), F.min(F.when(is_open, F.col("opened_at"))).alias("oldest_open"))


def stats(state: State, rules: Rules | None = None) -> DataFrame:
    """One row of all statistics; counts by group as maps, with the rules and the version
    of the package if rules are given."""

    def as_map(df: DataFrame, name: str, out: str) -> DataFrame:
        return df.agg(F.map_from_entries(F.collect_list(F.struct(name, "n"))).alias(out))  # a row a group

    parts = [
        leg_counts(state.legs), as_map(count_by(state.legs, F.col("source"), "source"), "source", "legs_by_source"),
        as_map(count_by(state.matches, tier_name(F.col("tier")), "tier"), "tier", "matches_by_tier"), as_map(count_by(state.matches, F.col("rule_id"), "rule"), "rule", "matches_by_rule"),
        as_map(count_by(state.breaks.where("status = 'open'"), F.col("category"), "category"), "category", "open_breaks_by_category"), break_counts(state.breaks),
        state.events.agg(F.count("*").alias("events_total")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:  # each is one row
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    if rules is not None:
        out = out.withColumns({"rules": F.struct(*[F.lit(v).alias(k) for k, v in asdict(rules).items()]), "version": F.lit(__version__)})
    return out.drop("_one")


def list_breaks(
    breaks: DataFrame, now: Column, status: str | None = None, category: str | None = None, currency: str | None = None,
    counterparty: str | None = None, min_age_s: float | None = None, limit: int = 100, offset: int = 0,
) -> DataFrame:
    """A page of breaks by age, oldest first, with age_seconds."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be within [1,1000] and offset not negative")
    if status not in (None, "open", "resolved"):
        raise ValueError("status must be open or resolved")
    age = age_seconds(F.col("opened_at"), F.col("resolved_at"), now)
    out = breaks.withColumn("age_seconds", age)
    for name, value in (("status", status), ("category", category), ("currency", currency and currency.upper()), ("counterparty", counterparty)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if min_age_s is not None:
        out = out.where(F.unix_micros(F.coalesce("resolved_at", now)) - F.unix_micros("opened_at") >= int(min_age_s * 1e6))
    return out.orderBy("opened_at", "id").offset(offset).limit(limit)


def lookup(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.where(F.col("id").isin(ids))


def legs_of(grouped: DataFrame, legs: DataFrame) -> DataFrame:
    """The legs of matches or breaks in their order; ids that aren't known are left out."""
    parts = grouped.select(F.col("id").alias("group_id"), F.posexplode("leg_ids").alias("pos", "leg_id"))
    return parts.join(legs, parts["leg_id"] == legs["id"]).drop("leg_id")


def legs_by_ref(legs: DataFrame, refs: DataFrame) -> DataFrame:
    """All legs with one of the references (column txn_ref), whatever their status."""
    return legs.join(refs.select("txn_ref").distinct(), "txn_ref", "left_semi")


def events_page(events: DataFrame, first: int = 1, limit: int = 100) -> DataFrame:
    if first < 1 or not 1 <= limit <= 1000:
        raise ValueError("from must be positive and limit within [1,1000]")
    return events.where(F.col("seq") >= first).orderBy("seq").limit(limit)


def residual_histogram(matches: DataFrame) -> DataFrame:
    """How many matches have an absolute residual up to each bound."""
    r = F.abs(F.col("residual_minor"))
    bucket = F.coalesce(*[F.when(r <= b, F.lit(str(b))) for b in RESIDUAL_BOUNDS], F.lit("+Inf"))
    return count_by(matches, bucket, "le")


def batch_tallies(outcomes: DataFrame) -> DataFrame:
    """Counts of outcomes; accepted includes duplicates, matched includes healed breaks."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count("*").alias("accepted"), F.count_if(o.isin("matched", "resolved_break")).alias("matched"), F.count_if(o == "break").alias("breaks"),
        F.count_if(o == "open").alias("open"), F.count_if(o == "duplicate").alias("duplicates"),
    )


def replay_tallies(log: DataFrame, outcomes: DataFrame, first: int = 1) -> DataFrame:
    """One row: what lifecycle.replay read of `log` (the events before it) and what came of it."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    first = max(1, first)
    read = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("through_seq"), F.count_if(F.col("seq") >= first).alias("events_read"))
    came = outcomes.agg(F.count("*").alias("legs_replayed"), n("matched", "resolved_break").alias("matched"), n("break").alias("breaks"), n("open").alias("open"))
    return read.join(came, F.lit(True)).select(F.lit(first).cast("long").alias("from_seq"), "*")  # one row each
