"""The break classifier: a CASE over a break's legs and the known legs of its reference.

A classifier is any function from a DataFrame with columns legs (the incoming leg first),
related (legs known before, in order of arrival) and trigger, to the same DataFrame with
category, confidence, classifier_id and reason; classify() is the built-in one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.columns import first_attr, within_days, within_tolerance
from tallyloom.rules import Rules


@dataclass(frozen=True)
class FeeBand:
    min_bps: float = 20.0
    max_bps: float = 400.0
    # Attribute names that mark fees and currency conversion.
    fee_keys: tuple[str, ...] = ("fee_minor", "fee", "interchange_minor", "scheme_fee_minor")
    fx_keys: tuple[str, ...] = ("fx_rate", "original_currency", "settlement_currency")


def _result(category: str, confidence: Column | float, reason: Column) -> Column:
    conf = F.lit(confidence) if isinstance(confidence, float) else F.round(confidence * 1000) / 1000
    return F.struct(F.lit(category).alias("category"), conf.cast("double").alias("confidence"), reason.alias("reason"))


def classify(breaks: DataFrame, rules: Rules, band: FeeBand = FeeBand()) -> DataFrame:
    """breaks with category, confidence, classifier_id and reason; first rule that holds."""
    p = F.try_element_at(F.col("legs"), F.lit(1))
    others = F.slice("legs", 2, F.greatest(F.size("legs"), F.lit(1)))
    related = F.coalesce(F.col("related"), F.slice("legs", 1, 0))
    other_source = lambda arr: F.try_element_at(F.filter(arr, lambda x: x["source"] != p["source"]), F.lit(1))
    reused = F.try_element_at(F.filter(related, lambda x: (x["source"] == p["source"]) & (x["id"] != p["id"])), F.lit(1))
    base = breaks.withColumns({"_p": p, "_q": F.coalesce(other_source(others), other_source(related)), "_d": reused})

    p, q, d = F.col("_p"), F.col("_q"), F.col("_d")
    a, b = p["amount_minor"], q["amount_minor"]
    diff = F.abs(a - b)
    bps = diff.cast("double") / F.greatest(a, b).cast("double") * 10_000
    fx, fee = first_attr([p["attrs"], q["attrs"]], band.fx_keys), first_attr([p["attrs"], q["attrs"]], band.fee_keys)
    in_band = (bps >= band.min_bps) & (bps <= band.max_bps)
    fee_conf = F.least(F.lit(0.8), F.greatest(F.lit(0.6), F.lit(0.8) - F.lit(0.1) * F.abs(bps - 150) / 250))
    say = F.format_string
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    n = str(rules.value_date_window_days)
    # Categories, confidences and reasons, as breaks carry them, and their order.
    verdict = (
        F.when(F.size("legs") == 0, _result("unclassified", 0.0, F.lit("no legs")))
        .when(d.isNotNull(), _result("duplicate", 0.95, say('same source "%s" re-used txn_ref "%s" (existing leg %s)', p["source"], p["txn_ref"], d["id"])))
        .when(q.isNotNull() & (q["currency"] != p["currency"]), _result("fx_drift", 0.92, say('currency mismatch %s vs %s on txn_ref "%s"', p["currency"], q["currency"], p["txn_ref"])))
        .when(q.isNotNull() & fx.isNotNull(), _result("fx_drift", 0.88, say('fx attribute "%s" present; amounts %d vs %d', fx, a, b)))
        .when(
            q.isNotNull() & within_tolerance(a, b, rules) & ~within_days(p["value_date"], q["value_date"], rules),
            _result("timing", 0.9, say(f"amounts agree, value dates %s vs %s exceed ±{n}d window", day(p["value_date"]), day(q["value_date"]))),
        )
        .when(q.isNotNull() & fee.isNotNull(), _result("fee", 0.95, say('fee attribute "%s" present; amount difference %d', fee, diff)))
        .when(
            q.isNotNull() & in_band,
            _result("fee", fee_conf, say(f"amount difference %d minor = %.1f bps, inside fee band [{band.min_bps:.0f},{band.max_bps:.0f}] bps", diff, bps)),
        )
        .when(q.isNotNull(), _result("unclassified", 0.4, say("same ref, amount difference %d minor outside every known pattern", diff)))
        .when(
            F.col("trigger") == S.WINDOW_EXPIRED,
            _result("missing_counterparty", F.when(p["source"] == "ledger", F.lit(0.8)).otherwise(F.lit(0.75)), say('no leg with txn_ref "%s" from any other source within the window', p["txn_ref"])),
        )
        .otherwise(_result("unclassified", 0.3, F.lit("no counterparty and no recognisable pattern")))
    )
    return (
        base.withColumn("_v", verdict)
        .withColumns({"category": F.col("_v.category"), "confidence": F.col("_v.confidence"), "classifier_id": F.lit(S.CLASSIFIER), "reason": F.col("_v.reason")})
        .drop("_p", "_q", "_d", "_v")
    )
