"""A feed with a published mix of outcomes, in an order drawn at random: 200 legs, of which 191
match by themselves."""

import random

from pyspark.sql import functions as F
from test_matching import at, leg, legs_of, settled

from tallyloom import schema as S
from tallyloom.operators import lifecycle, views
from tallyloom.operators.resolve import State, apply, ingest
from tallyloom.rules import Rules

RULES = Rules()
# How many matches by each rule and breaks of each category the mix gives.
BY_RULE = {S.T1_EXACT: 76, S.T2_REF: 9, S.T2_AMOUNT_DATE: 2, S.T3_SUBSET: 4}
BY_CATEGORY = {"duplicate": 1, "fee": 1, "fx_drift": 1, "missing_counterparty": 2, "timing": 1}
#: Legs that the batches leave for their parts, so that there are 200 in all.
PARTS = 13


def mix(seed):
    """What each outcome needs, with all else drawn: amounts (no two alike), dates, windows,
    differences, the sizes of batches and the order of arrival."""
    r = random.Random(seed)
    amounts, names = iter(r.sample(range(20_000, 900_000), 300)), iter(r.sample(range(10**6), 300))
    rows = []

    def window():
        return {"ccy": r.choice(["NOK", "CZK", "PLN"]), "cp": r.choice(["ORBIT", "HALO", "DELTA"])}

    def two(amount, other, days, here, there=None, ref=None):
        own, day = f"N{next(names)}", r.randrange(20)
        rows.append(("ledger", own, amount, day, {}, here))
        rows.append(("rail", ref or own, other, day + days, {}, there or here))

    for _ in range(BY_RULE[S.T1_EXACT]):
        amount = next(amounts)
        two(amount, amount, r.randint(-2, 2), window())
    for _ in range(BY_RULE[S.T2_REF]):
        amount = next(amounts)
        two(amount, amount + r.choice([-1, 1]) * r.randint(1, amount // 1100), r.randint(-2, 2), window())
    for _ in range(BY_RULE[S.T2_AMOUNT_DATE]):
        amount = next(amounts)
        two(amount, amount, r.randint(-2, 2), window(), ref=f"N{next(names)}")
    amount = next(amounts)
    two(amount, amount - amount * r.randint(50, 350) // 10_000, 0, window())  # a fee
    here, amount = window(), next(amounts)
    two(amount, amount, 0, here, here | {"ccy": "SEK"})  # another currency
    amount = next(amounts)
    two(amount, amount, r.choice([-1, 1]) * r.randint(3, 9), window())  # another time
    rows += [("ledger", f"N{next(names)}", next(amounts), 0, {}, window()) for _ in range(BY_CATEGORY["missing_counterparty"])]

    while sum(sizes := [r.randint(2, 6) for _ in range(BY_RULE[S.T3_SUBSET])]) != PARTS:
        pass
    for size in sizes:
        key, here, day = f"N{next(names)}", window(), r.randrange(20)
        parts = [next(amounts) for _ in range(size)]
        rows += [("ledger", f"N{next(names)}", a, day, {"batch_ref": key}, here) for a in parts]
        rows.append(("rail", key, sum(parts), day, {}, here))
    again = rows[r.randrange(2 * BY_RULE[S.T1_EXACT])]
    r.shuffle(rows)
    rows.insert(r.randint(rows.index(again) + 1, len(rows)), (*again[:4], {"sent": "again"}, again[5]))
    return [leg(n, *x[:5], **x[5]) for n, x in enumerate(rows, 1)]


def test_mix_of_outcomes(spark):
    state, changes = State.empty(spark), ingest(legs_of(spark, mix(8)), State.empty(spark), RULES, at())
    assert views.batch_tallies(changes.outcomes).first().asDict() == {"accepted": 200, "matched": 91, "breaks": 4, "open": 105, "duplicates": 0}
    state = settled(apply(state, changes))
    closed, n = lifecycle.expire(state, RULES, at(1), 0.0, forced=True)
    assert n == 2
    state = settled(apply(state, closed))
    assert {r["rule_id"]: r["n"] for r in views.count_by(state.matches, F.col("rule_id"), "rule_id").collect()} == BY_RULE
    assert {r["category"]: r["n"] for r in views.count_by(state.breaks.where("status = 'open'"), F.col("category"), "category").collect()} == BY_CATEGORY
    # Matched legs over all legs: those in breaks are the one sent again, the two alone and three pairs.
    found = views.leg_counts(state.legs).first()
    assert found["legs_total"] == 200 and found["legs_open"] == 0 and found["legs_matched"] == 191 and found["auto_match_rate"] == 0.955
    one = state.breaks.where("category = 'fee'").first()["id"]
    state = settled(apply(state, lifecycle.resolve_break(state, one, "known fee", "me", at(2))))
    _, outcomes = lifecycle.replay(state, RULES, at(3))
    told = views.replay_tallies(state.events, outcomes).first().asDict()
    assert told == {"from_seq": 1, "through_seq": 301, "events_read": 301, "legs_replayed": 200, "matched": 91, "breaks": 4, "open": 105}
