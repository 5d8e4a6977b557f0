"""References settled by rank, over several batches, equal the serial fold and need none."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.operators import lifecycle, resolve
from tallyloom.operators.fold import fold
from tallyloom.operators.resolve import State, apply, ingest
from tallyloom.rules import Rules

from test_matching import at, leg, legs_of, settled


@pytest.fixture
def no_fold(monkeypatch):
    def never(*_):
        raise AssertionError("legs went to the fold")

    monkeypatch.setattr(resolve, "_components", never)


def serially(state, new):
    """Outcomes, legs and heals of the serial fold of a batch after a state."""
    breaks = {r["id"]: r for r in state.breaks.collect()}
    known = state.legs.toPandas().assign(is_new=False)
    held = [breaks.get(b) for b in known["break_id"]]
    known = known.assign(break_open=[b is not None and b["status"] == "open" for b in held], break_n=[len(b["leg_ids"]) if b else 0 for b in held])
    fresh = new.toPandas().assign(status=None, match_id=None, break_id=None, is_new=True, break_open=None, break_n=None)
    rows = [*known.to_dict("records"), *fresh[[c for c in known.columns]].to_dict("records")]
    out = fold(pd.DataFrame(rows, columns=known.columns), Rules())
    told = {k: [json.loads(p) for kind, p in zip(out["kind"], out["payload"], strict=True) if kind == k] for k in ("outcome", "leg", "match", "heal", "break")}
    return (
        {x["leg_id"]: (x["outcome"], x["rule_id"], x["match_id"], x["break_id"]) for x in told["outcome"]},
        {x["id"]: (x["status"], x["match_id"], x["break_id"]) for x in told["leg"]},
        {x["id"]: (tuple(x["leg_ids"]), x["rule_id"], x["tier"], round(x["confidence"], 9), x["residual_minor"]) for x in told["match"]},
        {x["id"] for x in told["heal"]},
        {x["id"]: (x["trigger"], tuple(y["id"] for y in x["legs"])) for x in told["break"]},
    )


def settled_by(changes):
    names = ("outcome", "rule_id", "match_id", "break_id")
    breaks = changes.breaks.collect()
    events = [(r["type"], r["aggregate_id"]) for r in changes.events.collect()]
    return (
        {r["leg_id"]: tuple(r[n] for n in names) for r in changes.outcomes.collect()},
        {r["id"]: (r["status"], r["match_id"], r["break_id"]) for r in changes.legs.collect()},
        {r["id"]: (tuple(r["leg_ids"]), r["rule_id"], r["tier"], round(r["confidence"], 9), r["residual_minor"]) for r in changes.matches.collect()},
        {i for t, i in events if t == "break.resolved"},
        {i for t, i in events if t == "break.opened"},
        {r["id"]: r for r in breaks},
    )


def feed(seed, n, first):
    """Legs of four sources and few references, amounts of a reference apart from all others'."""
    r = random.Random(seed)
    rows = []
    for k in range(first, first + n):
        ref = r.randrange(9)
        amount = 100_000 * (ref + 1) + r.choice([0, 0, 0, 7, -60, 130, 900])
        rows.append(leg(k, r.choice(["ledger", "rail", "card", "bank"]), f"R{ref}", amount, r.choice([0, 0, 1, 4]), {"n": str(k)}, ccy=r.choice(["USD"] * 5 + ["EUR"]), cp="N"))
    return rows


@pytest.mark.parametrize("seed", [3])
def test_many_sources_over_batches_equal_the_fold(spark, no_fold, seed):
    state, kinds = State.empty(spark), set()
    for step, n in enumerate((9, 14, 22)):
        # Numbers needn't go on from batch to batch: what the state knows came before.
        rows = feed(10 * seed + step, n, 1000 - 300 * step)
        want = serially(state, legs_of(spark, rows, step))
        changes = ingest(legs_of(spark, rows, step), state, Rules(), at(step))
        outcomes, legs, matches, heals, opened, breaks = settled_by(changes)
        assert outcomes == want[0] and legs == want[1] and matches == want[2] and heals == want[3]
        assert opened == set(want[4])
        for i, (trigger, ids) in want[4].items():
            assert breaks[i]["trigger"] == trigger and tuple(breaks[i]["leg_ids"]) == ids
        kinds |= {(o, r) for o, r, *_ in outcomes.values()}
        state = settled(apply(state, changes))
        swept, _ = lifecycle.expire(state, Rules(), at(step + 40), 24 * 3600.0)
        state = settled(apply(state, swept))
    assert {("resolved_break", S.T2_LATE), ("break", None), ("open", None)} <= kinds


def test_two_claimants_of_one_break(spark, no_fold):
    """The first of two late legs heals the expired one; the other finds it matched. A late leg
    that conflicts is healed by a third source's."""
    state = settled(apply(State.empty(spark), ingest(legs_of(spark, [leg(1, "ledger", "A", 50_000), leg(2, "ledger", "B", 50_010)]), State.empty(spark), Rules(), at())))
    state = settled(apply(state, lifecycle.expire(state, Rules(), at(30), 24 * 3600.0)[0]))
    rows = [leg(11, "rail", "A", 50_001), leg(12, "card", "A", 50_002), leg(13, "rail", "B", 70_000), leg(14, "card", "B", 70_003)]
    changes = ingest(legs_of(spark, rows, 31), state, Rules(), at(31))
    out = {(r["leg_id"].split(":")[0], r["leg_id"].split(":")[1]): (r["outcome"], r["break_id"]) for r in changes.outcomes.collect()}
    assert {k: v[0] for k, v in out.items()} == {("rail", "A"): "resolved_break", ("card", "A"): "break", ("rail", "B"): "break", ("card", "B"): "resolved_break"}
    assert out["card", "B"][1] == out["rail", "B"][1]
    done = {r["id"]: r for r in settled(apply(state, changes)).breaks.collect()}
    assert [done[out[k][1]]["status"] for k in (("rail", "A"), ("card", "A"), ("rail", "B"))] == ["resolved", "open", "resolved"]
    assert changes.legs.count() == 5  # four new ones and the healed one; B's first leg stays


def test_partners_of_earlier_batches_need_no_fold(spark, no_fold):
    n = 400
    pairs = [(leg(2 * k, "ledger", f"V{k}", 700 + k % 7), leg(2 * k + 1, "rail", f"V{k}", 700 + k % 7)) for k in range(n)]
    state = State.empty(spark)
    for part in ([a for a, _ in pairs[: n // 2]], [a for a, _ in pairs[n // 2 :]] + [b for _, b in pairs[: n // 2]], [b for _, b in pairs[n // 2 :]]):
        state = settled(apply(state, ingest(legs_of(spark, part), state, Rules(), at())))
    assert state.matches.where(F.col("rule_id") == S.T1_EXACT).count() == n == state.matches.count()
    assert state.legs.count() == 2 * n == state.legs.where("status = 'matched'").count()


def test_known_legs_with_shared_amounts(spark):
    """Amounts decide where no reference does, whichever batch a leg came in."""
    state = settled(apply(State.empty(spark), ingest(legs_of(spark, [leg(1, "ledger", "P", 900), leg(2, "ledger", "Q", 1_300, attrs={"batch_ref": "S"}), leg(3, "ledger", "Q2", 700, attrs={"batch_ref": "S"})]), State.empty(spark), Rules(), at())))
    changes = ingest(legs_of(spark, [leg(1, "rail", "X", 900), leg(2, "rail", "S", 2_000), leg(3, "rail", "Q", 1_300)]), state, Rules(), at())
    rules = {tuple(sorted(x.split(":")[1] for x in r["leg_ids"])): r["rule_id"] for r in changes.matches.collect()}
    assert rules == {("P", "X"): S.T2_AMOUNT_DATE, ("Q", "Q2", "S"): S.T3_SUBSET}
    assert {r["leg_id"].split(":")[1]: r["outcome"] for r in changes.outcomes.collect()}["Q"] == "break"


def batches(seed, last):
    """Batches and equal amounts, each in a window of its own; settlements last, or anywhere."""
    r = random.Random(seed)
    groups = []
    for g in range(18):
        place, key, day = {"cp": f"W{g}"}, f"K{g}", r.choice([0, 0, 2, 3])
        if g % 3 == 2:
            # The same amount under two references or, less often, three.
            legs = [("ledger", f"A{g}", 500, 0, {}, place), (r.choice(["rail", "rail", "ledger"]), f"B{g}", 500, day, {}, place)]
            if not last and r.random() < 0.3:
                legs.append((r.choice(["rail", "card"]), f"C{g}", 500, 1, {}, place))
            groups.append(legs)
            continue
        amounts = [r.randrange(10_000, 90_000) for _ in range(r.choice([1, 2, 3, 4, 8, 30]))]
        target = sum(r.sample(amounts, min(len(amounts), r.choice([2 if last else 1, 2, 3, 6, 6])))) + r.choice([0, 0, 3, 500_000])
        parts = [("ledger", f"P{g}-{k}", a, r.choice([0, 0, 0, 1, 4]), {"batch_ref": key}, place) for k, a in enumerate(amounts)]
        settlement = ("rail", key, target, 1, {}, place) if r.random() < 0.6 else ("rail", f"S{g}", target, 1, {"batch_ref": key}, place)
        groups.append([*parts, settlement] if last else r.sample([*parts, settlement], len(parts) + 1))
    # Groups arrive interleaved, each in its own order.
    rows = []
    while groups := [x for x in groups if x]:
        rows.append(r.choice(groups).pop(0))
    return [leg(n, *x[:5], **x[5]) for n, x in enumerate(rows, 1)]


@pytest.mark.parametrize("last", [True, False])
def test_batches_and_amounts_equal_the_fold(spark, monkeypatch, last):
    if last:
        monkeypatch.setattr(resolve, "_components", lambda *_: (_ for _ in ()).throw(AssertionError("legs went to the fold")))
    state, rules = State.empty(spark), set()
    rows = batches(5, last)
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        want = serially(state, legs_of(spark, part))
        changes = ingest(legs_of(spark, part), state, Rules(), at())
        assert settled_by(changes)[:4] == want[:4]
        rules |= {x[1] for x in want[0].values()}
        state = settled(apply(state, changes))
    assert {S.T2_AMOUNT_DATE, S.T3_SUBSET} <= rules


def test_an_empty_state_costs_no_join(spark):
    legs = legs_of(spark, [leg(1, "ledger", "A", 50_000)])
    fresh = legs.join(State.empty(spark).legs.select("id"), "id", "left_anti")
    assert "Join" not in fresh._jdf.queryExecution().optimizedPlan().toString()
    assert fresh.count() == 1 and State.empty(spark).legs.isEmpty()


def test_once_each_keeps_first_deliveries(spark):
    from tallyloom.operators.normalize import once_each

    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 4)], "id string, ingest_seq bigint")
    first, again = once_each(rows)
    assert sorted(first.collect()) == [("a", 1), ("b", 4)] and sorted(again.collect()) == [("a", 2), ("a", 3)]
    # Rows of ids that come once aren't joined with a row for each id.
    assert "Aggregate" not in first._jdf.queryExecution().optimizedPlan().toString()
