from fractions import Fraction
from math import floor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.operators.fold import bounded_subset
from tallyloom.rules import Rules, duration_seconds


@given(st.integers(0, 10**12), st.integers(0, 10_000), st.integers(0, 50))
def test_tolerance_is_rounded_half_up(amount, bps, least):
    exact = Fraction(amount * bps, 10_000)
    assert Rules(tolerance_bps=bps, tolerance_abs_minor=least).tolerance(amount) == max(floor(exact + Fraction(1, 2)), least)


@given(st.integers(-500, 500), st.integers(-3, 300))
def test_confidence_falls_with_the_residual(residual, tol):
    r = Rules()
    got = r.confidence(residual, tol)
    assert got == r.confidence(-residual, tol) and 0.8 <= got <= 0.95 and got <= r.confidence(0, tol)
    assert abs(got - (0.95 if tol <= 0 else 0.95 - 0.15 * min(1, abs(residual) / tol))) <= 0.0005 + 1e-9


@pytest.mark.parametrize("wrong", [{"tolerance_bps": 10_001}, {"tolerance_abs_minor": -1}, {"value_date_window_days": 366}, {"t3_max_candidates": 1}, {"t3_max_subset": 13}])
def test_rules_are_checked(wrong):
    with pytest.raises(ValueError):
        Rules(**wrong)


def test_rules_from_env():
    assert Rules.from_env({"TALLYLOOM_TOLERANCE_BPS": "5", "TALLYLOOM_T3_REQUIRE_BATCH_HINT": "false"}) == Rules(tolerance_bps=5, t3_require_batch_hint=False)
    with pytest.raises(ValueError, match="tolerance_bps.*t3_max_subset"):
        Rules.from_env({"TALLYLOOM_TOLERANCE_BPS": "x", "TALLYLOOM_T3_MAX_SUBSET": "y"})


def test_durations():
    assert duration_seconds("1h30m") == 5400 and duration_seconds("250ms") == 0.25 and duration_seconds("-2s") == -2 and duration_seconds("0") == 0
    for bad in ("", "5", "3x", "1h!"):
        with pytest.raises(ValueError):
            duration_seconds(bad)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=9), st.integers(0, 5), st.data())
def test_planted_subsets_are_found(amounts, tol, data):
    take = data.draw(st.sets(st.integers(0, len(amounts) - 1), min_size=1, max_size=4))
    target = sum(amounts[i] for i in take)
    found = bounded_subset(amounts, target, tol, 1, 4)
    assert found is not None and len(set(found)) == len(found) <= 4
    assert abs(sum(amounts[i] for i in found) - target) <= tol


def test_subset_limits():
    assert bounded_subset([5, 5], 10, 0, 2, 2) == [0, 1]
    assert bounded_subset([10], 10, 0, 2, 6) is None
    assert bounded_subset([], 10, 0, 1, 6) is None
    assert bounded_subset([1] * 8, 8, 0, 2, 6) is None
    assert bounded_subset([3, 7, 4], 7, 0, 1, 6) == [1]  # larger amounts first
    assert bounded_subset([2 * i + 1000 for i in range(40)], 10**6 + 1, 0, 2, 12) is None


def test_classifier_rules_in_order(spark):
    """Each rule by a break that it is the first to hold for, next to ones it doesn't."""
    import datetime as dt

    from tallyloom import schema as S
    from tallyloom.operators.classify import FeeBand, classify

    def leg(id, source, amount, ccy="NOK", day=0, **attrs):
        return {"id": id, "source": source, "txn_ref": "Z-1", "amount_minor": amount, "currency": ccy, "value_date": dt.date(2027, 5, 1) + dt.timedelta(days=day), "attrs": attrs}

    a = leg("a", "rail", 40_000)
    table = {  # legs, related, trigger -> category, confidence
        "nothing": ([], [], S.REF_CONFLICT, "unclassified", 0.0),
        "again, though fees differ": ([a, leg("b", "ledger", 39_000)], [leg("c", "rail", 7)], S.DUPLICATE, "duplicate", 0.95),
        "itself is no other": ([a], [a], S.WINDOW_EXPIRED, "missing_counterparty", 0.75),
        "currency before attributes": ([a, leg("b", "ledger", 40_000, "SEK", fx_rate="1.1")], [], S.REF_CONFLICT, "fx_drift", 0.92),
        "attribute of the partner": ([a, leg("b", "ledger", 39_000, original_currency="SEK")], [], S.REF_CONFLICT, "fx_drift", 0.88),
        "blank attribute": ([leg("a", "rail", 40_000, fx_rate="  "), leg("b", "ledger", 39_000, fee="9")], [], S.REF_CONFLICT, "fee", 0.95),
        "late": ([a, leg("b", "ledger", 40_040, day=3, fee="9")], [], S.REF_CONFLICT, "timing", 0.9),
        "in the window": ([a, leg("b", "ledger", 40_040, day=-2, scheme_fee_minor="9")], [], S.REF_CONFLICT, "fee", 0.95),
        "band, lower end": ([a, leg("b", "ledger", 39_920)], [], S.REF_CONFLICT, "fee", 0.748),
        "band, middle": ([a, leg("b", "ledger", 39_400)], [], S.REF_CONFLICT, "fee", 0.8),
        "band, upper end": ([a, leg("b", "ledger", 38_400)], [], S.REF_CONFLICT, "fee", 0.7),
        "beyond the band": ([a, leg("b", "ledger", 38_399)], [], S.REF_CONFLICT, "unclassified", 0.4),
        "partner among related": ([a], [leg("b", "ledger", 39_400)], S.WINDOW_EXPIRED, "fee", 0.8),
        "own legs before related": ([a, leg("b", "card", 20_000)], [leg("c", "ledger", 39_400)], S.REF_CONFLICT, "unclassified", 0.4),
        "alone, ledger": ([leg("a", "ledger", 5)], [], S.WINDOW_EXPIRED, "missing_counterparty", 0.8),
        "alone, not expired": ([a], [], S.REF_CONFLICT, "unclassified", 0.3),
    }
    kind = "array<struct<id string, source string, txn_ref string, amount_minor bigint, currency string, value_date date, attrs map<string,string>>>"
    df = spark.createDataFrame([(k, t, legs, rel) for k, (legs, rel, t, _, _) in table.items()], f"name string, trigger string, legs {kind}, related {kind}")
    got = {r["name"]: (r["category"], r["confidence"]) for r in classify(df, Rules()).collect()}
    assert got == {k: (c, x) for k, (_, _, _, c, x) in table.items()}
    wide = classify(df.where("name = 'beyond the band'"), Rules(), FeeBand(max_bps=500.0, fee_keys=("levy",))).first()
    assert wide["category"] == "fee" and wide["reason"]
    odd = classify(df.where("name = 'late'"), Rules(value_date_window_days=3), FeeBand(fee_keys=("levy",))).first()
    assert odd["category"] == "unclassified"
