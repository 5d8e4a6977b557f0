"""Expiry of open legs, manual resolution of breaks, and replay of the event log."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.columns import derived_id
from tallyloom.operators import classify as C
from tallyloom.operators.normalize import normalize, valid
from tallyloom.operators.resolve import LEG_COLUMNS, Changes, Classifier, State, apply, ingest, last_seq, open_breaks
from tallyloom.rules import Rules
from tallyloom.session import materialize


def expired(legs: DataFrame, now: Column, older_than_s: float) -> DataFrame:
    """Open legs ingested that long ago or longer."""
    return legs.where((F.col("status") == "open") & (F.unix_micros("ingested_at") <= F.unix_micros(now) - int(older_than_s * 1e6)))


def expire(state: State, rules: Rules, now: Column, older_than_s: float, forced: bool = False, classifier: Classifier = C.classify) -> tuple[Changes, int]:
    """Turn expired legs into breaks. forced: a window close (recorded when it expires any),
    rather than the periodic sweep."""
    gone = materialize(expired(state.legs, now, max(0.0, older_than_s) if forced else older_than_s), "expired")
    # The classifier asks for the first leg of a reference on each source.
    each = state.legs.join(gone.select("txn_ref").distinct(), "txn_ref", "left_semi").groupBy("txn_ref", "source").agg(F.min_by(F.struct(*LEG_COLUMNS), "ingest_seq").alias("x"))
    of_ref = each.groupBy("txn_ref").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.signum(a["ingest_seq"] - b["ingest_seq"]).cast("int")).alias("related"))
    raw = gone.select("txn_ref", "ingest_seq", derived_id("brk", F.array("id")).alias("id"), F.lit(S.WINDOW_EXPIRED).alias("trigger"), F.array(F.struct(*LEG_COLUMNS)).alias("legs"))
    raw = raw.join(of_ref, "txn_ref").drop("txn_ref")
    breaks = materialize(open_breaks(raw, rules, now, classifier), "breaks")
    legs = gone.withColumns({"status": F.lit("break"), "break_id": derived_id("brk", F.array("id"))}).select(LEG_COLUMNS)
    count = gone.count()
    by = F.concat_ws("\0", F.date_format("value_date", "yyyy-MM-dd"), "txn_ref", "id")  # canonical order
    order = gone.select("id", by.alias("by"))
    said = order.select(F.lit("leg.expired").alias("type"), F.col("id").alias("aggregate_id"), "by", F.lit(0).alias("ord"), F.to_json(F.struct(F.col("id").alias("leg_id"), F.lit(forced).alias("forced"))).alias("payload"))
    names = [f.name for f in S.BREAK]
    opened = breaks.withColumn("leg", F.col("leg_ids")[0]).join(order.withColumnRenamed("id", "leg"), "leg").select(
        F.lit("break.opened").alias("type"), F.col("id").alias("aggregate_id"), "by", F.lit(1).alias("ord"), F.to_json(F.struct(*names)).alias("payload")
    )
    events = said.unionByName(opened)
    if forced and count:
        last = state.legs.sparkSession.createDataFrame([("window.closed", "window", None, 2, f'{{"expired":{count},"older_than_s":{max(0.0, older_than_s)}}}')], "type string, aggregate_id string, by string, ord int, payload string")
        events = events.unionByName(last.withColumn("by", F.lit("￿")))
    spark = state.legs.sparkSession
    events = events.select(F.col("by").alias("at_seq"), "ord", "type", "aggregate_id", "payload").withColumn("at", now)
    none = spark.createDataFrame([], S.MATCH)
    return Changes(spark.createDataFrame([], S.OUTCOME), legs, none, breaks.select(names), events), count


class BreakResolved(ValueError):
    """The break had been resolved before."""


def resolve_break(state: State, break_id: str, reason: str, actor: str, now: Column) -> Changes:
    """Close one break with an audited reason. Raises KeyError or BreakResolved."""
    if not reason or not actor:
        raise ValueError("reason and actor are required")
    one = state.breaks.where(F.col("id") == break_id)
    held = one.select("status").take(1)
    if not held:
        raise KeyError(break_id)
    if held[0][0] == "resolved":
        raise BreakResolved(break_id)
    spark = state.legs.sparkSession
    closed = one.withColumns({"status": F.lit("resolved"), "resolved_at": now, "reason": F.lit(reason), "actor": F.lit(actor)})
    events = closed.select(
        F.lit(0).cast("long").alias("at_seq"), F.lit(0).alias("ord"), F.lit("break.resolved").alias("type"), F.col("id").alias("aggregate_id"),
        F.to_json(F.struct(F.col("id").alias("break_id"), "reason", "actor", F.col("resolved_at").alias("at"))).alias("payload"), now.alias("at"),
    )
    return Changes(spark.createDataFrame([], S.OUTCOME), spark.createDataFrame([], S.LEG), spark.createDataFrame([], S.MATCH), closed.select([f.name for f in S.BREAK]), events)


def logged_legs(events: DataFrame, first: int, last: int) -> DataFrame:
    """The ingested legs of the log, in its order, stripped of what was derived."""
    ddl = f"id string, {S.LEG_FIELDS}"
    rows = events.where((F.col("type") == "leg.ingested") & F.col("seq").between(first, last))
    return rows.select(F.from_json("payload", ddl).alias("x"), "seq").select("x.*", F.col("seq").alias("ingest_seq")).drop("id")


def replay_started(state: State, now: Column, first: int = 1) -> tuple[State, int]:
    """No projections, and the log with the event that a replay adds before it begins; also
    the number of the last event that is replayed."""
    spark = state.legs.sparkSession
    through = last_seq(state.events)
    start = spark.createDataFrame([(through + 1, "replay.started", "replay", f'{{"from":{max(1, first)},"through":{through}}}')], "seq bigint, type string, aggregate_id string, payload string").withColumn("at", now)
    return replace(State.empty(spark), events=state.events.unionByName(start.select(state.events.columns))), through


def rebuild(state: State, rules: Rules, now: Column, first: int = 1, classifier: Classifier = C.classify) -> tuple[State, int, Changes]:
    """replay_started, and the changes that the log's legs lead to under `rules`."""
    started, through = replay_started(state, now, first)
    legs = valid(normalize(logged_legs(state.events, max(1, first), through), now))
    return started, through, ingest(legs, started.reset(), rules, now, classifier, log_ingest=False)


def replay(state: State, rules: Rules, now: Column, first: int = 1, classifier: Classifier = C.classify) -> tuple[State, DataFrame]:
    """Rebuild the projections from the log under `rules`; also the outcomes. Manual
    resolutions of breaks that come about again are restored."""
    first = max(1, first)
    started, through, changes = rebuild(state, rules, now, first, classifier)
    rebuilt = apply(started, changes)
    payload = F.from_json("payload", "break_id string, reason string, actor string, at timestamp, match_id string").alias("x")
    manual = state.events.where((F.col("type") == "break.resolved") & F.col("seq").between(first, through)).select(payload, "seq").where("x.match_id IS NULL")
    once = manual.groupBy("x.break_id").agg(F.min_by("x", "seq").alias("x")).select(F.col("break_id").alias("id"), F.col("x.reason").alias("_r"), F.col("x.actor").alias("_a"), F.col("x.at").alias("_t"))
    hit = (F.col("status") == "open") & F.col("_t").isNotNull()
    fixed = rebuilt.breaks.join(once, "id", "left").withColumns(
        {"resolved_at": F.when(hit, F.col("_t")).otherwise(F.col("resolved_at")), "reason": F.when(hit, F.col("_r")).otherwise(F.col("reason")), "actor": F.when(hit, F.col("_a")).otherwise(F.col("actor")), "status": F.when(hit, F.lit("resolved")).otherwise(F.col("status"))}
    )
    return State(rebuilt.legs, rebuilt.matches, fixed.select([f.name for f in S.BREAK]), rebuilt.events), changes.outcomes
