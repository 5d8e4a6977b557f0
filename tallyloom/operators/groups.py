"""Batches and shared amounts that need no fold.

Legs that are alone with their reference can only meet by a batch or by an amount. They are
put into clusters, one a batch key and window, or one a disputed amount. A cluster that
shares no leg, amount or reference with another is settled by its shape:

* pair: two legs of one disputed amount. The later one matches the earlier by amount and date
  if they are of two sources and near.
* batch: the leg that comes last is the only one of its source, and all others are of one other
  source. Nothing happens before it comes; then it settles what bounded_subset finds among
  its batch's first t3_max_candidates legs in canonical order, in an Arrow kernel on one
  row a settlement.
* quiet: one source only, or two legs of different amounts. They wait.

Other clusters (a settlement before its last part, several settlements, references with more
legs) go to the fold. A window ranks the parts of a batch and keeps those few, so that a
batch of any size passes through no task whole.

Most batches touch nothing else and are small. `whole_batches` settles those before all other
steps from a few columns of their legs, so that no whole leg of theirs is moved; what it can't
be sure of is left to the steps above. It tells references and amounts apart by 64-bit hashes;
an equal hash by chance only sends a batch the longer way, but for one of two batch keys or
sources of one amount, about one pair in 2**64.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.columns import tolerance, tolerant_confidence, within_days
from tallyloom.operators.fold import bounded_subset
from tallyloom.operators.tiers import WINDOW_KEY
from tallyloom.rules import Rules
from tallyloom.session import materialize


@dataclass
class Groups:
    """matched: leg (that came last), others, tier, rule_id, confidence; waiting: the new legs
    of all settled clusters, as they came; done: their references and those of the known legs
    beside them."""

    matched: DataFrame
    waiting: DataFrame
    done: DataFrame


def _clusters(rest: DataFrame, amounts: DataFrame | None, batch_ref: Column) -> DataFrame:
    """rest (with n, the legs of their reference) with `cluster`, `batch` (whether it is one),
    `amount_key` and `mixed`, for legs of two batches; a row a leg and cluster."""
    named = rest.where(batch_ref != "").select(*WINDOW_KEY, batch_ref.alias("txn_ref")).distinct().withColumn("_named", F.lit(True))
    joint = lambda key: F.when(key != "", F.concat_ws("\0", F.lit("b"), *WINDOW_KEY, key))
    keys = F.array_distinct(F.array_compact(F.array(joint(batch_ref), F.when(F.col("_named"), joint(F.col("txn_ref"))))))
    legs = rest.join(named, [*WINDOW_KEY, "txn_ref"], "left").withColumn("_keys", keys).drop("_named")
    if amounts is None:
        legs = legs.withColumn("amount_key", F.lit(None).cast("string"))
    else:
        legs = legs.join(amounts.select("id", "amount_key"), "id", "left")
    alone = F.coalesce(F.concat(F.lit("a\0"), "amount_key"), F.concat(F.lit("r\0"), "txn_ref"))
    placed = legs.withColumns({"batch": F.size("_keys") > 0, "mixed": F.size("_keys") > 1})
    return placed.withColumn("cluster", F.explode(F.when(F.size("_keys") > 0, F.col("_keys")).otherwise(F.array(alone)))).drop("_keys")


def _shapes(placed: DataFrame, order: Column) -> DataFrame:
    """cluster, shape: those that can be settled here."""
    live = F.col("is_new") | (F.col("status") == "open")
    shared = placed.where("amount_key IS NOT NULL").groupBy("amount_key").agg((F.min("cluster") != F.max("cluster")).alias("_across"), F.count("*").alias("_of_amount"))
    each = placed.join(shared, "amount_key", "left").groupBy("cluster", "source").agg(
        F.count_if(live).alias("m"), F.max(F.when(live, order)).alias("at"), F.max((F.col("n") > 1) | F.col("mixed") | F.coalesce("_across", F.lit(False))).alias("bad"),
        F.count_if(live & F.col("amount_key").isNotNull()).alias("priced"), F.max("_of_amount").alias("of_amount"),
        F.min("amount_key").alias("lo"), F.max("amount_key").alias("hi"), F.max("batch").alias("batch"),
    )
    whole = each.groupBy("cluster").agg(
        F.max("bad").alias("bad"), F.sum("m").alias("m"), F.count_if(F.col("m") > 0).alias("sources"), F.max_by("m", "at").alias("last"),
        F.sum("priced").alias("priced"), F.max("of_amount").alias("of_amount"), (F.min("lo") == F.max("hi")).alias("one_amount"), F.max("batch").alias("batch"),
    )
    pair = (F.col("m") == 2) & (F.col("priced") == 2) & F.col("one_amount") & (F.col("of_amount") == 2)
    unpriced = F.col("priced") == 0
    shape = (
        F.when(F.col("bad"), None).when(pair, "pair").when(unpriced & ((F.col("sources") <= 1) | (F.col("m") <= 2)), "quiet")
        .when(unpriced & F.col("batch") & (F.col("sources") == 2) & (F.col("last") == 1), "batch")
    )
    return whole.select("cluster", shape.alias("shape")).where("shape IS NOT NULL")


#: Legs of a batch that is settled at once; larger ones go the longer way.
AT_ONCE = 64
_KEY = [*WINDOW_KEY, "key"]


@dataclass
class Batches:
    """What became of whole batches. matched: as in Groups, with some columns of the legs;
    members: id, ingest_seq and is_new of all their legs; left: the other legs, if any."""

    matched: DataFrame
    members: DataFrame
    left: DataFrame | None


def _touched(legs: DataFrame, batch_ref: Column, live: Column) -> DataFrame | None:
    """The keys of legs that may meet another leg by a reference, by a second batch or, outside
    of their key, by an amount; None if there are none."""
    ref, batch, amount = F.xxhash64("txn_ref"), F.xxhash64(batch_ref), F.xxhash64(*WINDOW_KEY, "amount_minor")
    uses = F.array(
        F.struct(ref.alias("h"), F.lit(1).alias("n"), (batch_ref != "").alias("own"), F.lit(False).alias("named")),
        F.struct(batch.alias("h"), F.lit(0).alias("n"), F.lit(False).alias("own"), F.lit(True).alias("named")),
    )
    uses = legs.select(F.explode(F.when(batch_ref != "", uses).otherwise(F.slice(uses, 1, 1))).alias("u")).select("u.*")
    met = uses.groupBy("h").agg(F.sum("n").alias("n"), F.max("own").alias("own"), F.max("named").alias("named"))
    met = materialize(met.where("n > 1 OR (own AND named)").select("h"), "met")
    source, key = F.xxhash64("source"), F.xxhash64("key")
    priced = legs.where(live).groupBy(amount.alias("h")).agg(
        F.min(source).alias("s0"), F.max(source).alias("s1"), F.min(key).alias("k0"), F.max(key).alias("k1"), F.max("is_new").alias("is_new")
    )
    priced = materialize(priced.where("is_new AND s0 <> s1 AND k0 <> k1").select("h"), "priced")
    found = []
    if not met.isEmpty():
        found.append(legs.withColumn("h", F.explode(F.array(ref, batch))).join(met, "h", "left_semi").select(_KEY))
    if not priced.isEmpty():
        found.append(legs.where(live).withColumn("h", amount).join(priced, "h", "left_semi").select(_KEY))
    return reduce(DataFrame.unionByName, found).distinct() if found else None


def whole_batches(legs: DataFrame, batch_ref: Column, order: Column, rules: Rules) -> Batches:
    """legs: the new ones and those of the state that they can meet."""
    keyed = legs.withColumn("key", F.when(batch_ref != "", batch_ref).otherwise(F.col("txn_ref")))
    live = F.col("is_new") | F.coalesce(F.col("status") == "open", F.lit(False))
    touched = _touched(keyed, batch_ref, live)
    canonical = Window.partitionBy(*_KEY).orderBy("value_date", "txn_ref", "id")
    some = keyed.select(*_KEY, "value_date", "txn_ref", "id", "source", "ingest_seq", "amount_minor", "is_new", live.alias("live"), (batch_ref != "").alias("part"))
    some = some.withColumn("_n", F.row_number().over(canonical)).where(F.col("_n") <= AT_ONCE + 1)
    row = F.struct("id", "source", "ingest_seq", "amount_minor", "value_date", "is_new", "part", "currency")
    each = some.groupBy(*_KEY).agg(
        F.count("*").alias("m"), F.min("live").alias("live"), F.max("is_new").alias("new"), F.max("part").alias("batch"),
        F.max_by(row, order).alias("leg"), F.array_sort(F.collect_list(F.struct("_n", row.alias("x")))).alias("all"),
    )
    l = F.col("leg")
    each = each.withColumn("others", F.filter(F.transform("all", lambda p: p["x"]), lambda x: x["id"] != l["id"])).drop("all")
    quiet = F.forall("others", lambda x: x["source"] == l["source"])
    one = F.forall("others", lambda x: (x["source"] != l["source"]) & (x["source"] == F.get("others", F.lit(0))["source"]) & (x["amount_minor"] != l["amount_minor"]))
    pair = (F.col("m") == 2) & ~quiet
    clean = (F.col("m") <= AT_ONCE) & F.col("live") & F.col("new") & F.col("batch") & (quiet | one | pair)
    if touched is not None:
        each = each.join(touched.withColumn("touched", F.lit(True)), _KEY, "left")
        clean = clean & F.col("touched").isNull()
    each = each.withColumn("clean", clean)
    own = lambda c: F.when(F.col("clean"), F.col(c)).alias(c)
    each = materialize(each.select(*_KEY, "clean", own("leg"), own("others")), "batches")
    n, n_clean = each.agg(F.count("*"), F.count_if("clean")).first()
    left = None
    if n_clean < n:  # by the fewer keys
        by = each.where("NOT clean" if 2 * n_clean > n else "clean").select(_KEY)
        left = materialize(keyed.join(by, _KEY, "left_semi" if 2 * n_clean > n else "left_anti").select(legs.columns), "left")
    each = each.where("clean")
    members = each.select(F.explode(F.array_append("others", l)).alias("x")).select("x.id", "x.ingest_seq", "x.is_new")

    # Two legs of one amount, which no other leg has in two sources, meet by it.
    c = F.get("others", F.lit(0))
    alike = (F.size("others") == 1) & (c["source"] != l["source"]) & (c["amount_minor"] == l["amount_minor"]) & within_days(c["value_date"], l["value_date"], rules)
    pairs = each.where(alike).select("leg", "others", F.lit(2).alias("tier"), F.lit(S.T2_AMOUNT_DATE).alias("rule_id"), F.lit(0.75).alias("confidence"))

    near = F.filter("others", lambda x: x["part"] & (x["source"] != l["source"]) & within_days(x["value_date"], l["value_date"], rules))
    pool = each.select("leg", F.slice(near, 1, rules.t3_max_candidates).alias("pool"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: F.try_add(a, x))
    amounts, most, target = F.transform("pool", lambda x: x["amount_minor"]), rules.t3_max_subset, l["amount_minor"]
    tol = tolerance(target, rules)
    small = F.size("pool") < 2
    unreached = total(F.slice(F.sort_array(amounts, asc=False), 1, most)) < target - tol
    # The search takes larger amounts first: all of them, unless they do without the smallest.
    lesser = (F.size("pool") > 2) & (F.abs(total(amounts) - F.array_min(amounts) - target) <= tol)
    entire = (F.size("pool") <= most) & (F.abs(total(amounts) - target) <= tol) & ~lesser
    sure = lambda c: F.coalesce(c, F.lit(False))
    entire, hopeless = sure(entire) & ~small, small | sure(unreached)
    found = pool.where(entire).select("leg", F.col("pool").alias("others"))
    hard = pool.where(~entire & ~hopeless)
    if not hard.isEmpty():
        taken = hard.select("leg", "pool", _subset(most)(amounts, target, tol).alias("taken")).where("taken IS NOT NULL")
        found = found.unionByName(materialize(taken.select("leg", F.transform("taken", lambda i: F.element_at("pool", i + 1)).alias("others")), "searched"))
    return Batches(pairs.unionByName(_settled(found, rules)), members, left)


def _settled(found: DataFrame, rules: Rules) -> DataFrame:
    """leg, others of settlements and what they take, with tier, rule and confidence."""
    residual = F.aggregate("others", F.lit(0).cast("long"), lambda a, p: a + p["amount_minor"]) - F.col("leg.amount_minor")
    confidence = tolerant_confidence(residual, tolerance(F.col("leg.amount_minor"), rules)) - F.lit(0.1)
    return found.select("leg", "others", F.lit(3).alias("tier"), F.lit(S.T3_SUBSET).alias("rule_id"), confidence.alias("confidence"))


def _subset(most: int):
    """Positions of the legs that a settlement takes; null if there are none."""

    @F.pandas_udf("array<int>")
    def found(amounts: pd.Series, target: pd.Series, tol: pd.Series) -> pd.Series:
        return pd.Series([bounded_subset([int(x) for x in a], int(t), int(w), 2, most) for a, t, w in zip(amounts, target, tol, strict=True)], dtype=object)

    return found


def settle(rest: DataFrame, amounts: DataFrame | None, batch_ref: Column, order: Column, columns: list[str], rules: Rules) -> Groups:
    """rest: the legs of references that amounts or batches touch, with n. columns: those of a
    leg; order: its arrival."""
    placed = materialize(_clusters(rest, amounts, batch_ref), "placed")
    shaped = placed.join(_shapes(placed, order), "cluster")
    row = F.struct(*columns)
    live = shaped.where((F.col("is_new") | (F.col("status") == "open")) & F.col("shape").isin("pair", "batch"))
    last = live.groupBy("cluster", "shape").agg(F.max_by(row, order).alias("leg"), F.min_by(row, order).alias("first")).where("leg.is_new")
    last = materialize(last, "last")

    c, l = F.col("first"), F.col("leg")
    met = (l["source"] != c["source"]) & within_days(l["value_date"], c["value_date"], rules)
    pairs = last.where((F.col("shape") == "pair") & met).select("leg", F.array("first").alias("others"), F.lit(2).alias("tier"), F.lit(S.T2_AMOUNT_DATE).alias("rule_id"), F.lit(0.75).alias("confidence"))

    one = last.where("shape = 'batch'").select("cluster", "leg")
    parts = live.withColumn("_b", batch_ref).where("_b <> ''").select("cluster", row.alias("x")).join(one, "cluster")
    parts = parts.where((F.col("x.source") != F.col("leg.source")) & within_days(F.col("x.value_date"), F.col("leg.value_date"), rules))
    canonical = F.struct("x.value_date", "x.txn_ref", "x.id")
    parts = parts.withColumn("_n", F.row_number().over(Window.partitionBy("cluster").orderBy(canonical))).where(F.col("_n") <= rules.t3_max_candidates)
    pool = parts.groupBy("cluster").agg(F.any_value("leg").alias("leg"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "x")), lambda a, b: a["_n"] - b["_n"]), lambda p: p["x"]).alias("pool"))
    tol = tolerance(F.col("leg.amount_minor"), rules)
    taken = _subset(rules.t3_max_subset)(F.transform("pool", lambda p: p["amount_minor"]), F.col("leg.amount_minor"), tol).alias("taken")
    found = pool.select("leg", "pool", taken).where("taken IS NOT NULL").select("leg", F.transform("taken", lambda i: F.element_at("pool", i + 1)).alias("others"))
    return Groups(
        materialize(pairs.unionByName(_settled(found, rules)), "grouped"), shaped.where("is_new").select(*columns), shaped.select("txn_ref").distinct()
    )
