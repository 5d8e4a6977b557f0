"""Incremental matching of a batch of legs against the state.

Legs influence each other only through a shared reference, a shared (currency,
counterparty, amount) within the date window, or a shared batch key in a window.

1. One aggregation over the reference settles what needs nothing else: single legs, and
   pairs of two sources, whether their first leg is new or known to the state (exact,
   tolerant, in conflict, or late for a leg that is closed).
2. References with more legs are settled by rank. Of each source only the first leg counts,
   the others are duplicates, and only the first leg of all is ever open: the second meets
   it, and all later ones either heal a leg whose break is still open or conflict. A round
   settles the k-th legs of all references, since what they may heal was decided before.
3. A shared amount only matters where a leg could be matched by it. That takes an open leg,
   so the first of its reference, and a leg of another source, neither of whose references
   is known on the other's source. Where the open legs of an amount are all of one source,
   and so are the first legs of the other legs' references, it can't happen. Amounts of which
   this isn't sure are looked at again by runs of dates, and only what stays sends its
   references to step 4, together with those that a batch of new legs touches.
4. The rest is labelled by connected components, and a fold in order of arrival
   (operators.fold) runs over whole components, many of them a task.

Without the batch hint all legs of a window belong together, so a component is as large as
its window; the fold then reads a window at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.columns import derived_id, tolerance, tolerant_confidence, within_days
from tallyloom.operators import classify as C
from tallyloom.operators import fold as folding
from tallyloom.operators.groups import Batches, Groups, whole_batches
from tallyloom.operators.groups import settle as settle_groups
from tallyloom.operators.normalize import once_each
from tallyloom.operators.tiers import WINDOW_KEY, match_columns
from tallyloom.plans.components import connected_components
from tallyloom.rules import Rules
from tallyloom.session import materialize

Classifier = Callable[[DataFrame, Rules], DataFrame]
LEG_COLUMNS = [f.name for f in S.LEG]
LEG_DDL = f"id string, {S.LEG_FIELDS}, ingest_seq bigint, status string, match_id string, break_id string"
#: What the log holds of a leg.
LOGGED = ("id", "source", "txn_ref", "amount_minor", "currency", "value_date", "direction", "counterparty", "attrs", "ingested_at")
#: Legs a fold takes at a time, on average, if no component is larger.
FOLDED = 20_000


def none(spark: SparkSession, schema) -> DataFrame:
    """No rows, which the optimizer knows: it drops joins with them."""
    return spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


@dataclass
class State:
    """The projections and the event log."""

    legs: DataFrame
    matches: DataFrame
    breaks: DataFrame
    events: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(*(none(spark, s) for s in (S.LEG, S.MATCH, S.BREAK, S.EVENT)))

    def reset(self) -> State:
        """No projections; the events stay."""
        return replace(State.empty(self.legs.sparkSession), events=self.events)


@dataclass
class Changes:
    """What one step adds: rows to put over the state's rows of equal id, and events."""

    outcomes: DataFrame
    legs: DataFrame
    matches: DataFrame
    breaks: DataFrame
    events: DataFrame  # without seq; `at_seq` and `ord` give their order


def _batch_ref() -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit("batch_ref")), F.lit(""))


_ROW = [*LEG_COLUMNS, "is_new", "break_open", "break_n"]
_AMOUNT = [*WINDOW_KEY, "amount_minor"]
#: Sources a reference may have to be settled by rank; those with more are folded.
ROUNDS = 8


def _order() -> Column:
    """Arrival: legs of the state come before new ones."""
    return F.struct("is_new", "ingest_seq", "id")


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def _by_ref(legs: DataFrame, batches: bool, rules: Rules) -> DataFrame:
    """One row a reference: first and last leg, n, `plain` (no batch can reach its legs) and
    `simple` (plain, and one leg or two of different sources). batches: whether any leg has a
    batch key."""
    refs = legs.groupBy("txn_ref").agg(
        F.min_by(F.struct(*_ROW), _order()).alias("first"), F.max_by(F.struct(*_ROW), _order()).alias("last"), F.count("*").alias("n"),
        (F.min("source") != F.max("source")).alias("apart"), F.min(~F.col("is_new") | (_batch_ref() == "")).alias("own"),
    )
    plain = F.col("own") & F.lit(rules.t3_require_batch_hint)
    if batches:
        # References that a leg names as its batch, and open legs of batches that new legs name.
        named = legs.where(_batch_ref() != "").select(_batch_ref().alias("txn_ref"))
        keys = legs.where("is_new").select(F.explode(F.array("txn_ref", _batch_ref())).alias("_b")).distinct()
        touched = legs.where("NOT is_new AND status = 'open'").withColumn("_b", _batch_ref()).where("_b <> ''").join(keys, "_b", "left_semi").select("txn_ref")
        refs = refs.join(named.union(touched).distinct().withColumn("named", F.lit(True)), "txn_ref", "left")
        plain = plain & F.col("named").isNull()
    refs = refs.withColumn("plain", plain)
    simple = F.col("plain") & ((F.col("n") == 1) | ((F.col("n") == 2) & F.col("apart")))
    return materialize(refs.select("txn_ref", "first", "last", "n", "plain", simple.alias("simple")), "refs")


def _crowd(legs: DataFrame, refs: DataFrame) -> DataFrame | None:
    """The legs of references that are not simple, if there are any, with `earliest` (the first of its source),
    `rank` of the source among those of the reference, `opener` (the first source), the number
    of `sources` and `plain`."""
    some = refs.where("NOT simple").select("txn_ref", "plain")
    if some.isEmpty():
        return None
    many = legs.join(some, "txn_ref").withColumn("_at", _order())
    of_ref = Window.partitionBy("txn_ref")  # a row a source
    each = many.groupBy("txn_ref", "source").agg(F.min("_at").alias("_first"))
    each = each.withColumns({"opener": F.min_by("source", "_first").over(of_ref), "sources": F.count("*").over(of_ref), "rank": F.row_number().over(of_ref.orderBy("_first"))})
    joined = many.join(each, ["txn_ref", "source"]).withColumn("earliest", F.col("_at") == F.col("_first")).drop("_first", "_at")
    return materialize(joined, "crowd")


def _disputed(amounts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys under which two legs might match by amount alone."""
    began, pair = F.col("source") == F.col("opener"), F.struct("source", "opener")
    found = amounts.groupBy(*keys).agg(
        (F.min("txn_ref") == F.max("txn_ref")).alias("_one"), (F.min("source") == F.max("source")).alias("_single"), F.max("is_new").alias("_new"),
        F.min(F.when(began, F.col("source"))).alias("_lo"), F.max(F.when(began, F.col("source"))).alias("_hi"), F.collect_set(F.when(~began, pair)).alias("_joined"),
    )
    lo = F.col("_lo")
    calm = lo.isNull() | ((lo == F.col("_hi")) & F.forall("_joined", lambda p: (p["opener"] == lo) | (p["source"] == lo)))
    return found.where(F.col("_new") & ~(F.col("_one") | F.col("_single") | calm)).select(*keys)


def _by_amount(refs: DataFrame, crowd: DataFrame | None, rules: Rules) -> DataFrame | None:
    """id, txn_ref, amount_key: the legs that share a disputed amount within the date window,
    if any amount is disputed."""
    columns = ["id", "txn_ref", "source", "opener", *_AMOUNT, "value_date", "is_new"]
    pair = F.when(F.col("n") == 1, F.array("first")).otherwise(F.array("first", "last"))
    simple = refs.where("simple").select(F.col("first.source").alias("opener"), F.explode(pair).alias("x")).select("x.*", "opener")
    live = F.col("is_new") | (F.col("status") == "open")
    amounts = simple.where(live).select(columns)
    if crowd is not None:
        amounts = amounts.unionByName(crowd.where(F.col("earliest") & live).select(columns))
    keys = materialize(_disputed(amounts, _AMOUNT), "amounts")
    if keys.isEmpty():
        return None
    some = materialize(amounts.join(keys, _AMOUNT, "left_semi"), "amounts")
    # Dates further apart than the window start a new run; one row a day and amount.
    order = Window.partitionBy(*_AMOUNT).orderBy("value_date")
    gap = F.datediff("value_date", F.lag("value_date").over(order))
    days = some.select(*_AMOUNT, "value_date").distinct().withColumn("_new", (gap > rules.value_date_window_days).cast("int"))
    days = days.withColumn("run", F.sum(F.coalesce("_new", F.lit(0))).over(order)).drop("_new")
    keyed = some.join(days, [*_AMOUNT, "value_date"])
    keyed = keyed.join(_disputed(keyed, [*_AMOUNT, "run"]), [*_AMOUNT, "run"], "left_semi")
    return materialize(keyed.select("id", "txn_ref", F.concat_ws("\0", *_AMOUNT, "run").alias("amount_key")), "disputed")


def _fits(leg: Column, other: Column, rules: Rules) -> Column:
    """Whether a late leg may heal another: currency and tolerance, whatever the date."""
    return (leg["currency"] == other["currency"]) & (F.abs(other["amount_minor"] - leg["amount_minor"]) <= tolerance(leg["amount_minor"], rules))


def _verdicts(pairs: DataFrame, rules: Rules) -> DataFrame:
    """pairs: a row a reference with first (earlier leg), last (later leg), n legs and `crowded`,
    whether there are other legs. Where the first leg is closed, `heal` or `closed` if it is the
    only one that the last could heal, else `late`."""
    a, b = F.col("last"), F.col("first")
    diff = F.abs(a["amount_minor"] - b["amount_minor"])
    meets = (a["currency"] == b["currency"]) & (a["counterparty"] == b["counterparty"]) & within_days(a["value_date"], b["value_date"], rules)
    met = F.when(meets & (diff == 0), S.T1_EXACT).when(meets & (diff <= tolerance(a["amount_minor"], rules)), S.T2_REF).otherwise("break")
    heals = (b["status"] == "break") & F.coalesce(b["break_open"], F.lit(False)) & (b["break_n"] == 1) & _fits(a, b, rules)
    verdict = (
        F.when(~a["is_new"], "known").when(F.col("n") == 1, "open").when(b["is_new"] | (b["status"] == "open"), met)
        .when(F.col("crowded"), "late").when(F.coalesce(heals, F.lit(False)), "heal").otherwise("closed")
    )
    return pairs.withColumns({"diff": diff, "verdict": verdict})


def _late(apart: DataFrame, free: DataFrame | None, rules: Rules) -> tuple[DataFrame, bool]:
    """(leg, first, target): the legs that found their reference's first leg closed, with the
    leg they heal, if any; and whether targets may be new legs. free: the legs of references
    settled by rank. One round a rank: a leg heals the first by arrival that fits and that no
    earlier leg healed; one that heals none has a break that later ones may heal."""
    alone = apart.where(F.col("verdict").isin("heal", "closed")).select(F.col("last").alias("leg"), "first", F.when(F.col("verdict") == "heal", F.col("first")).alias("target"))
    if free is None:
        return alone, False
    row = F.struct(*_ROW)
    second = apart.where("verdict = 'late'").select("txn_ref", F.lit(2).alias("rank"), F.col("last").alias("leg"), "first")
    later = free.where("earliest AND is_new AND rank > 2").select("txn_ref", "rank", row.alias("leg")).join(apart.select("txn_ref", "first"), "txn_ref")
    asked = materialize(second.unionByName(later), "asked")
    most = asked.agg(F.max("rank")).first()[0]
    if most is None:
        return alone, False
    single = F.col("is_new") & ~F.col("earliest") | ~F.col("is_new") & (F.col("status") == "break") & F.coalesce("break_open", F.lit(False)) & (F.col("break_n") == 1)
    pool = free.where(single).select("txn_ref", row.alias("x"))
    at = lambda c: F.struct(F.col(c)["is_new"], F.col(c)["ingest_seq"], F.col(c)["id"])
    out = alone
    for k in range(2, most + 1):
        now = asked.where(F.col("rank") == k)
        met = now.join(pool, "txn_ref").where((at("x") < at("leg")) & (F.col("x.source") != F.col("leg.source")) & _fits(F.col("leg"), F.col("x"), rules))
        hit = met.groupBy(F.col("leg.id").alias("_id")).agg(F.min_by("x", at("x")).alias("target"))
        done = materialize(now.join(hit, F.col("leg.id") == F.col("_id"), "left").select("txn_ref", "leg", "first", "target"), "late")
        out = out.unionByName(done.select("leg", "first", "target"))
        taken = done.where("target IS NOT NULL").select(F.col("target.id").alias("_id"))
        pool = pool.join(taken, F.col("x.id") == F.col("_id"), "left_anti").unionByName(done.where("target IS NULL").select("txn_ref", F.col("leg").alias("x")))
    return out, True


def _components(legs: DataFrame, amounts: DataFrame | None, rules: Rules) -> DataFrame:
    """legs with `component`."""
    key = lambda kind, value: F.concat_ws("\0", F.lit(kind), value)
    joint = lambda value: F.concat_ws("\0", F.lit("b"), *WINDOW_KEY, value)
    if not rules.t3_require_batch_hint:
        # Whole windows belong together, and windows that share a reference.
        keys = F.array(key("r", F.col("txn_ref")), F.concat_ws("\0", F.lit("w"), *WINDOW_KEY))
    else:
        keys = F.array_compact(F.array(key("r", F.col("txn_ref")), joint(F.col("txn_ref")), F.when(_batch_ref() != "", joint(_batch_ref()))))
    nodes = legs.select("id", F.explode(keys).alias("dst"))
    if amounts is not None:
        nodes = nodes.unionByName(amounts.select("id", key("a", F.col("amount_key")).alias("dst")))
    found = connected_components(nodes.select(F.concat(F.lit("leg:"), "id").alias("src"), "dst")).where(F.col("node").startswith("leg:")).select(F.expr("substring(node, 5)").alias("id"), "component")
    return legs.join(found, "id")


def _neighbours(new: DataFrame, state: State, rules: Rules) -> DataFrame:
    """Legs of the state that new legs can meet, with the state of their breaks: any with
    the same reference; open ones with the same amount or batch; and any that share a
    reference with those."""
    held = state.legs
    near = held.where("status = 'open'")
    window = lambda df, value: df.select(*WINDOW_KEY, value.alias("_v"))
    batch = window(new, F.col("txn_ref")).union(window(new, _batch_ref())).where("_v <> ''").distinct()
    own = near.withColumn("_v", F.explode(F.array_compact(F.array(F.col("txn_ref"), F.when(_batch_ref() != "", _batch_ref())))))
    refs = (
        new.select("txn_ref")
        .union(near.join(new.select(*WINDOW_KEY, "amount_minor").distinct(), [*WINDOW_KEY, "amount_minor"], "left_semi").select("txn_ref"))
        .union(own.join(batch, [*WINDOW_KEY, "_v"], "left_semi").select("txn_ref"))
    ).distinct()
    if not rules.t3_require_batch_hint:
        refs = refs.union(near.join(new.select(*WINDOW_KEY).distinct(), WINDOW_KEY, "left_semi").select("txn_ref")).distinct()
    found = held.join(refs, "txn_ref", "left_semi")
    info = state.breaks.select(F.col("id").alias("break_id"), (F.col("status") == "open").alias("break_open"), F.size("leg_ids").alias("break_n"))
    return found.join(info, "break_id", "left").select(*LEG_COLUMNS, F.lit(False).alias("is_new"), "break_open", "break_n")


def _joined(parts: list[DataFrame], spark: SparkSession, schema) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _leg(c: str) -> Column:
    """A struct column as a leg, without what is only known here."""
    return F.struct(*[F.col(f"{c}.{x}").alias(x) for x in LEG_COLUMNS])


@dataclass
class _Settled:
    """What became of the legs. apart: verdicts of pairs, kinds: those that occur; the others
    are None where there are none: late legs, legs whose source had used their reference
    (reused; origin has the first leg of each source), and results of the fold. legs: all that
    took part; batches: those settled before all others."""

    apart: DataFrame
    kinds: set[str]
    late: DataFrame | None
    healed_new: bool
    reused: DataFrame | None
    origin: DataFrame | None
    groups: Groups | None
    folded: DataFrame | None
    batches: Batches | None
    legs: DataFrame

    def parsed(self, kind: str, ddl: str) -> list[DataFrame]:
        """Rows of a kind of the fold."""
        if self.folded is None:
            return []
        return [self.folded.where(F.col("kind") == kind).select("ingest_seq", F.from_json("payload", ddl).alias("x"))]


def _settle(legs: DataFrame, rules: Rules) -> _Settled:
    """legs: the new ones and those of the state that they can meet."""
    taking_part, batches = legs, None
    batched = not legs.where(_batch_ref() != "").isEmpty()
    if batched and rules.t3_require_batch_hint:
        batches = whole_batches(legs, _batch_ref(), _order(), rules)
        legs = none(legs.sparkSession, legs.schema) if batches.left is None else batches.left
        batched = batches.left is not None and not legs.where(_batch_ref() != "").isEmpty()
    refs = _by_ref(legs, batched, rules)
    crowd = _crowd(legs, refs)
    amounts = _by_amount(refs, crowd, rules) if rules.t3_require_batch_hint else None
    by_rank = F.col("plain") & (F.col("sources") <= ROUNDS)
    bound = [x.select("txn_ref") for x in (amounts, None if crowd is None else crowd.where(~by_rank)) if x is not None]
    bound = materialize(_joined(bound, legs.sparkSession, None).distinct(), "bound") if bound else None
    bound = None if bound is None or bound.isEmpty() else bound
    unbound = lambda df: df if bound is None else df.join(bound, "txn_ref", "left_anti")
    row = F.struct(*_ROW)
    pairs = unbound(refs.where("simple")).select("txn_ref", "first", "last", "n", F.lit(False).alias("crowded"))
    free = reused = origin = None
    if crowd is not None:
        free = unbound(crowd.where(by_rank))
        firsts = free.where("earliest AND rank <= 2").groupBy("txn_ref").agg(F.min_by(row, "rank").alias("first"), F.max_by(row, "rank").alias("last"), F.count("*").alias("n"))
        pairs = pairs.unionByName(firsts.withColumn("crowded", F.lit(True)))
        reused = free.where("is_new AND NOT earliest").select("txn_ref", "source", row.alias("leg"))
        origin = free.where("earliest").select("txn_ref", "source", row.alias("origin"))
    apart = _verdicts(pairs, rules)
    if crowd is not None or bound is not None:  # else it is refs, with a few more columns
        apart = materialize(apart, "apart")
    kinds = {r[0] for r in apart.select("verdict").distinct().collect()}
    late, healed_new = _late(apart, free, rules) if free is not None or kinds & {"heal", "closed"} else (None, False)
    groups = folded = None
    if bound is not None:
        rest = legs.join(bound, "txn_ref", "left_semi")
        if rules.t3_require_batch_hint:
            groups = settle_groups(rest.join(refs.select("txn_ref", "n"), "txn_ref"), amounts, _batch_ref(), _order(), _ROW, rules)
            rest = rest.join(groups.done, "txn_ref", "left_anti")
            amounts = None if amounts is None else amounts.join(groups.done, "txn_ref", "left_anti")
        folded = _folded(rest, amounts, rules)
    return _Settled(apart, kinds, late, healed_new, reused, origin, groups, folded, batches, taking_part)


def _folded(rest: DataFrame, amounts: DataFrame | None, rules: Rules) -> DataFrame | None:
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        return folding.fold(rows, rules)

    n = rest.count()
    if not n:
        return None
    bucket = F.pmod(F.xxhash64("component"), F.lit(n // FOLDED + 1))
    return materialize(_components(rest, amounts, rules).withColumn("bucket", bucket).groupBy("bucket").applyInPandas(settle, folding.RESULT), "folded")


def _matches(s: _Settled, rules: Rules) -> list[DataFrame]:
    parts = []
    if s.kinds & {S.T1_EXACT, S.T2_REF}:
        hit, exact = s.apart.where(F.col("verdict").isin(S.T1_EXACT, S.T2_REF)), F.col("verdict") == S.T1_EXACT
        conf = F.when(exact, F.lit(1.0)).otherwise(tolerant_confidence(F.col("diff"), tolerance(F.col("last.amount_minor"), rules)))
        cols = match_columns(F.col("last"), F.col("first"), 0, "", conf) | {"tier": F.when(exact, F.lit(1)).otherwise(F.lit(2)), "rule_id": F.col("verdict")}
        parts.append(hit.select(F.col("last.ingest_seq").alias("ingest_seq"), *[v.alias(k) for k, v in cols.items()]))
    if s.late is not None:
        diff = F.col("target.amount_minor") - F.col("leg.amount_minor")
        conf = tolerant_confidence(diff, tolerance(F.col("leg.amount_minor"), rules)) - F.lit(0.05)
        cols = match_columns(F.col("leg"), F.col("target"), 2, S.T2_LATE, conf)
        parts.append(s.late.where("target IS NOT NULL").select(F.col("leg.ingest_seq").alias("ingest_seq"), *[v.alias(k) for k, v in cols.items()]))
    for settled in (s.groups, s.batches):
        if settled is None:
            continue
        ids = F.array_sort(F.transform(F.array_append("others", F.col("leg")), lambda x: x["id"]))
        residual = F.aggregate("others", F.lit(0).cast("long"), lambda a, x: a + x["amount_minor"]) - F.col("leg.amount_minor")
        of_group = {"id": derived_id("m", ids), "leg_ids": ids, "tier": F.col("tier"), "rule_id": F.col("rule_id"), "confidence": F.col("confidence"), "residual_minor": residual, "currency": F.col("leg.currency")}
        parts.append(settled.matched.select(F.col("leg.ingest_seq").alias("ingest_seq"), *[v.alias(k) for k, v in of_group.items()]))
    ddl = "id string, leg_ids array<string>, tier int, rule_id string, confidence double, residual_minor bigint, currency string"
    return parts + [x.select("ingest_seq", "x.*") for x in s.parsed("match", ddl)]


def _breaks(s: _Settled) -> list[DataFrame]:
    """ingest_seq, id, trigger, legs (incoming first), related."""

    def broken(rows: DataFrame, leg: str, trigger: str, others: list[str], related: Column) -> DataFrame:
        ids = F.array(*[F.col(f"{x}.id") for x in (leg, *others)])
        return rows.select(
            F.col(f"{leg}.ingest_seq").alias("ingest_seq"), derived_id("brk", ids).alias("id"), F.lit(trigger).alias("trigger"),
            F.array(*[_leg(x) for x in (leg, *others)]).alias("legs"), related.alias("related"),
        )

    parts = []
    if "break" in s.kinds:
        parts.append(broken(s.apart.where("verdict = 'break'"), "last", S.REF_CONFLICT, ["first"], F.array(_leg("first"))))
    if s.late is not None:
        parts.append(broken(s.late.where("target IS NULL"), "leg", S.REF_CONFLICT, [], F.array(_leg("first"))))
    if s.reused is not None:
        # The first leg of the source is enough to tell, with the first two of the reference.
        before = lambda c: ~F.col(c)["is_new"] | (F.col(c)["ingest_seq"] < F.col("leg.ingest_seq"))
        third = (F.col("origin.id") != F.col("first.id")) & (F.col("origin.id") != F.col("last.id"))
        related = F.array_compact(F.array(F.when(before("first"), _leg("first")), F.when((F.col("n") == 2) & before("last"), _leg("last")), F.when(third, _leg("origin"))))
        again = s.reused.join(s.apart.select("txn_ref", "first", "last", "n"), "txn_ref").join(s.origin, ["txn_ref", "source"])
        parts.append(broken(again, "leg", S.DUPLICATE, [], related))
    full = f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in LEG_DDL.split(', '))}>>"
    known = lambda c: F.transform(c, lambda x: F.struct(*[x[k].alias(k) for k in LEG_COLUMNS])).alias(c)
    for x in s.parsed("break", f"id string, trigger string, legs {full}, related {full}"):
        parts.append(x.select("ingest_seq", "x.*").select("ingest_seq", "id", "trigger", known("legs"), known("related")))
    return parts


def _legs(s: _Settled) -> list[DataFrame]:
    """New legs and those of the state that changed."""
    null = F.lit(None).cast("string")
    verdict, ids = F.col("verdict"), F.array("first.id", "last.id")
    both = s.apart.where(verdict.isin("open", "break", S.T1_EXACT, S.T2_REF)).select(
        F.when(verdict == "open", "open").when(verdict == "break", "break").otherwise("matched").alias("_s"),
        F.when(verdict.isin(S.T1_EXACT, S.T2_REF), derived_id("m", ids)).alias("_m"), F.when(verdict == "break", derived_id("brk", ids)).alias("_b"),
        F.explode(F.when(F.col("n") == 1, F.array(_leg("first"))).otherwise(F.array(_leg("first"), _leg("last")))).alias("x"),
    )
    put = lambda df, **values: df.withColumns(values).select(LEG_COLUMNS)
    parts = [put(both.select("x.*", "_s", "_m", "_b"), status=F.col("_s"), match_id=F.col("_m"), break_id=F.col("_b"))]
    single = [s.reused] if s.reused is not None else []
    if s.late is not None:
        single.append(s.late.where("target IS NULL"))
        healing = s.late.where("target IS NOT NULL")
        cured = healing.select(derived_id("m", F.array("leg.id", "target.id")).alias("_m"), F.explode(F.array(_leg("leg"), _leg("target"))).alias("x"))
        parts.append(put(cured.select("x.*", "_m"), status=F.lit("matched"), match_id=F.col("_m"), break_id=null))
    for rows in single:
        rows = put(rows.select("leg.*"), status=F.lit("break"), match_id=null, break_id=derived_id("brk", F.array("id")))
        parts.append(rows.join(healing.select("target.id"), "id", "left_anti").select(LEG_COLUMNS) if s.healed_new else rows)
    if s.groups is not None:
        members = F.array_append("others", F.col("leg"))
        met = s.groups.matched.select(derived_id("m", F.transform(members, lambda x: x["id"])).alias("_m"), F.explode(members).alias("x")).select("x.*", "_m")
        parts.append(put(met, status=F.lit("matched"), match_id=F.col("_m"), break_id=null))
        parts.append(put(s.groups.waiting.join(met.select("id"), "id", "left_anti"), status=F.lit("open"), match_id=null, break_id=null))
    if s.batches is not None:
        members = F.transform(F.array_append("others", F.col("leg")), lambda x: x["id"])
        met = s.batches.matched.select(derived_id("m", members).alias("_m"), F.explode(members).alias("id"))
        own = s.legs.join(s.batches.members.select("id").join(met, "id", "left"), "id").where("is_new OR _m IS NOT NULL")
        parts.append(put(own, status=F.when(F.col("_m").isNull(), "open").otherwise("matched"), match_id=F.col("_m"), break_id=null))
    return parts + [x.select("x.*").select(LEG_COLUMNS) for x in s.parsed("leg", LEG_DDL)]


def _outcomes(s: _Settled, again: DataFrame) -> list[DataFrame]:
    null = F.lit(None).cast("string")

    def told(rows: DataFrame, leg: str, outcome: Column, rule: Column = null, match: Column = null, broke: Column = null) -> DataFrame:
        return rows.select(
            F.col(f"{leg}ingest_seq").alias("ingest_seq"), F.col(f"{leg}id").alias("leg_id"), outcome.alias("outcome"), rule.alias("rule_id"), match.alias("match_id"), broke.alias("break_id")
        )

    parts = [told(again, "", F.lit("duplicate")), told(s.apart.where("first.is_new"), "first.", F.lit("open"))]
    if s.kinds & {"break", S.T1_EXACT, S.T2_REF}:
        met, both, hit = s.apart.where(F.col("verdict").isin("break", S.T1_EXACT, S.T2_REF)), F.array("first.id", "last.id"), F.col("verdict") != "break"
        parts.append(told(met, "last.", F.when(hit, "matched").otherwise("break"), F.when(hit, F.col("verdict")), F.when(hit, derived_id("m", both)), F.when(~hit, derived_id("brk", both))))
    own = derived_id("brk", F.array("leg.id"))
    if s.late is not None:
        found = F.col("target").isNotNull()
        healed = F.when(found, derived_id("m", F.array("leg.id", "target.id"))), F.when(found, derived_id("brk", F.array("target.id"))).otherwise(own)
        parts.append(told(s.late, "leg.", F.when(found, "resolved_break").otherwise("break"), F.when(found, S.T2_LATE), *healed))
    if s.reused is not None:
        parts.append(told(s.reused, "leg.", F.lit("break"), broke=own))
    if s.groups is not None:
        members = F.transform(F.array_append("others", F.col("leg")), lambda x: x["id"])
        parts.append(told(s.groups.matched, "leg.", F.lit("matched"), F.col("rule_id"), derived_id("m", members)))
        parts.append(told(s.groups.waiting.join(s.groups.matched.select("leg.id"), "id", "left_anti"), "", F.lit("open")))
    if s.batches is not None:
        members = F.transform(F.array_append("others", F.col("leg")), lambda x: x["id"])
        parts.append(told(s.batches.matched, "leg.", F.lit("matched"), F.col("rule_id"), derived_id("m", members)))
        parts.append(told(s.batches.members.where("is_new").join(s.batches.matched.select("leg.id"), "id", "left_anti"), "", F.lit("open")))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.OUTCOME if f.name != "ingest_seq")
    return parts + [x.select("ingest_seq", "x.*").select([f.name for f in S.OUTCOME]) for x in s.parsed("outcome", ddl)]


def ingest(new: DataFrame, state: State, rules: Rules, now: Column, classifier: Classifier = C.classify, log_ingest: bool = True) -> Changes:
    """new: valid, normalised legs (operators.normalize) with ingest_seq, the order of
    arrival. log_ingest: whether deliveries become events (a replay's don't)."""
    spark = new.sparkSession
    blank = {"status": F.lit(None).cast("string"), "match_id": F.lit(None).cast("string"), "break_id": F.lit(None).cast("string")}
    new = materialize(new.withColumns(blank).select(LEG_COLUMNS), "new")
    fresh, again = once_each(new)
    known = state.legs.select("id").distinct()
    again = again.unionByName(fresh.join(known, "id", "left_semi").select(again.columns))
    fresh = fresh.join(known, "id", "left_anti").select(LEG_COLUMNS)
    held = _neighbours(fresh, state, rules)
    legs = fresh.select("*", F.lit(True).alias("is_new"), F.lit(None).cast("boolean").alias("break_open"), F.lit(None).cast("int").alias("break_n")).unionByName(held)
    # Against an empty state they are `new`, which is written already.
    s = _settle(legs if state.legs.isEmpty() else materialize(legs, "legs"), rules)

    matches = materialize(_joined(_matches(s, rules), spark, "ingest_seq bigint, " + _ddl(S.MATCH)).withColumn("matched_at", now), "matches")
    names = [f.name for f in S.BREAK]
    raw = _breaks(s)
    opened = materialize(open_breaks(_joined(raw, spark, None), rules, now, classifier), "breaks") if raw else spark.createDataFrame([], "ingest_seq bigint, " + _ddl(S.BREAK))
    # A leg that can be healed is the only one of its break, whose id follows from it.
    cured = [x.select("ingest_seq", "x.*") for x in s.parsed("heal", "id string, match_id string")]
    if s.late is not None:
        ids = derived_id("brk", F.array("target.id")).alias("id"), derived_id("m", F.array("leg.id", "target.id")).alias("match_id")
        cured.append(s.late.where("target IS NOT NULL").select(F.col("leg.ingest_seq").alias("ingest_seq"), *ids))
    healed = materialize(resolve_late(_joined(cured, spark, None), opened, state.breaks, now), "healed") if cured else None
    breaks = opened.select(names) if healed is None else opened.select(names).join(healed.select("id"), "id", "left_anti").unionByName(healed.select(names))

    # Events, in the order of arrival and, within a step, of `ord`.
    def said(rows: DataFrame, ord_: int, type_: str, payload: Column) -> DataFrame:
        return rows.select(F.col("ingest_seq").alias("at_seq"), F.lit(ord_).alias("ord"), F.lit(type_).alias("type"), F.col("id").alias("aggregate_id"), F.to_json(payload).alias("payload"))

    log = [said(matches, 1, "match.created", F.struct(*[f.name for f in S.MATCH]))]
    if raw:
        log.append(said(opened, 1, "break.opened", F.struct(*names)))
    if healed is not None:
        log.append(said(healed, 2, "break.resolved", F.struct(F.col("id").alias("break_id"), "reason", "actor", F.col("resolved_at").alias("at"), "match_id")))
    if log_ingest:
        log += [said(fresh, 0, "leg.ingested", F.struct(*LOGGED)), said(again, 0, "leg.duplicate", F.struct(*LOGGED))]
    events = _joined(log, spark, None).withColumn("at", now)
    return Changes(_joined(_outcomes(s, again), spark, S.OUTCOME), _joined(_legs(s), spark, S.LEG), matches.select([f.name for f in S.MATCH]), breaks, events)


def open_breaks(raw: DataFrame, rules: Rules, now: Column, classifier: Classifier = C.classify) -> DataFrame:
    """raw: ingest_seq, id, trigger, legs (incoming first), related -> rows of breaks."""
    found = classifier(raw, rules).withColumns(
        {
            "leg_ids": F.transform("legs", lambda x: x["id"]), "currency": F.col("legs")[0]["currency"], "counterparty": F.col("legs")[0]["counterparty"],
            "status": F.lit("open"), "opened_at": now, "resolved_at": F.lit(None).cast("timestamp"), "actor": F.lit(None).cast("string"),
        }
    )
    return found.select("ingest_seq", *[f.name for f in S.BREAK])


def resolve_late(healed: DataFrame, opened: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    names = [f.name for f in S.BREAK]
    source = opened.select(names).unionByName(held.select(names))
    out = healed.join(source, "id").withColumns(
        {"status": F.lit("resolved"), "resolved_at": now, "reason": F.lit(f"late arrival matched by {S.T2_LATE}"), "actor": F.lit("system")}
    )
    return out.select("ingest_seq", "match_id", *names)


def over(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, and the rows of old whose id it doesn't hold."""
    return old.join(new.select("id"), "id", "left_anti").select(new.columns).unionByName(new)


def apply(state: State, changes: Changes) -> State:
    """The state after a step; events get the numbers that follow the state's."""
    return State(
        over(state.legs, changes.legs), over(state.matches, changes.matches), over(state.breaks, changes.breaks),
        state.events.unionByName(numbered(changes.events, last_seq(state.events)).select(state.events.columns)),
    )


def last_seq(events: DataFrame) -> int:
    return events.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def numbered(events: DataFrame, base: int) -> DataFrame:
    """events with seq = base + 1, 2, ... by (at_seq, ord)."""
    return gapless(events, ["at_seq", "ord", "aggregate_id"], base, "seq").select("seq", "type", "at", "aggregate_id", "payload")


def gapless(rows: DataFrame, order: list[str], base: int, name: str) -> DataFrame:
    """rows with `name` = base + 1, 2, ... by `order`: range-partitioned and sorted, then
    shifted by the counts of earlier partitions, so no task sees them all."""
    at = F.monotonically_increasing_id()
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "gapless")
    counts = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright("_at", 33)).agg(F.count("*")).collect())  # a row a partition
    before, total = [], base + 1
    for p, n in counts:
        before.append((p, total))
        total += n
    if not before:
        return rows.drop("_at").withColumn(name, F.lit(0).cast("long"))
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_p bigint, _before bigint"))
    placed = rows.withColumn("_p", F.shiftright("_at", 33)).join(offsets, "_p")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_before")
