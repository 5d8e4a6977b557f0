"""Reference cases, and equality of the parallel plan with one serial fold."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom import queries as registered
from tallyloom import schema as S
from tallyloom.functions.columns import BLANK, blank, stripped
from tallyloom.operators import lifecycle, tiers, views
from tallyloom.operators.fold import fold
from tallyloom.operators.normalize import normalize, require_valid, valid
from tallyloom.operators.resolve import LEG_COLUMNS, State, apply, ingest
from tallyloom.rules import Rules
from tallyloom.session import materialize

DAY = dt.date(2027, 3, 9)
FIELDS = "ingest_seq bigint, source string, txn_ref string, amount_minor bigint, currency string, value_date date, direction string, counterparty string, attrs map<string,string>"


def leg(seq, source, ref, amount, day=0, attrs=None, ccy="USD", cp="NORD"):
    return (seq, source, ref, amount, ccy, DAY + dt.timedelta(days=day), "debit" if source == "ledger" else "credit", cp, attrs or {})


def at(hours=0):
    return F.lit("2026-09-15 09:00:00").cast("timestamp") + F.expr(f"interval {hours} hours")


def legs_of(spark, rows, hours=0):
    return valid(normalize(spark.createDataFrame(rows, FIELDS), at(hours)))


def settled(state):
    return State(*(materialize(x, "state") for x in (state.legs, state.matches, state.breaks, state.events)))


def run(spark, rows, rules=Rules(), state=None, hours=0):
    state = state or State.empty(spark)
    changes = ingest(legs_of(spark, rows, hours), state, rules, at(hours))
    return settled(apply(state, changes)), changes


SET = {"batch_ref": "SET-9"}
#: One group of legs for each rule, in windows of their own where amounts could meet.
FEED = [
    leg(1, "ledger", "P-77", 83_120), leg(2, "rail", "P-77", 83_120),
    leg(3, "ledger", "P-78", 64_000), leg(4, "rail", "P-78", 64_032, -2),
    leg(5, "ledger", "S-1", 15_731), leg(6, "rail", "T-5", 15_731, 1),
    leg(10, "ledger", "M1", 3_300, attrs=SET), leg(11, "ledger", "M2", 1_250, attrs=SET), leg(12, "ledger", "M3", 610, attrs=SET), leg(13, "ledger", "OTHER", 610),
    leg(14, "rail", "SET-9", 5_160),
    leg(20, "ledger", "C1", 250_000, cp="N"), leg(21, "rail", "C1", 245_000, cp="N"),
    leg(22, "ledger", "C2", 250_000, cp="O"), leg(23, "rail", "C2", 230_000, attrs={"fee_minor": "20000"}, cp="O"),
    leg(24, "ledger", "C3", 90_000, cp="P"), leg(25, "rail", "C3", 88_000, ccy="JPY", cp="P"),
    leg(26, "ledger", "C4", 6_400, cp="R"), leg(27, "rail", "C4", 6_400, 5, cp="R"),
    leg(30, "ledger", "C5", 1_888, cp="S"), leg(31, "rail", "C5", 1_888, cp="S"), leg(32, "rail", "C5", 1_888, attrs={"sent": "twice"}, cp="S"),
    leg(40, "ledger", "U1", 432, cp="U"), leg(41, "ledger", "U2", 432, cp="U"), leg(42, "rail", "U3", 432, cp="U"),
    leg(50, "ledger", "P-77", 83_120),
]


def test_each_rule_by_itself(spark):
    state, changes = run(spark, FEED)
    rules = {tuple(sorted(x.split(":")[1] for x in r["leg_ids"])): (r["rule_id"], round(r["confidence"], 6)) for r in state.matches.collect()}
    assert rules == {
        ("P-77", "P-77"): (S.T1_EXACT, 1.0), ("P-78", "P-78"): (S.T2_REF, 0.875), ("S-1", "T-5"): (S.T2_AMOUNT_DATE, 0.75),
        ("M1", "M2", "M3", "SET-9"): (S.T3_SUBSET, 0.85), ("C5", "C5"): (S.T1_EXACT, 1.0),
    }
    breaks = {r["leg_ids"][0].split(":")[1]: (r["category"], r["confidence"], r["trigger"], len(r["leg_ids"])) for r in state.breaks.collect()}
    assert breaks == {
        "C1": ("fee", 0.78, "ref_conflict", 2), "C2": ("fee", 0.95, "ref_conflict", 2), "C3": ("fx_drift", 0.92, "ref_conflict", 2),
        "C4": ("timing", 0.9, "ref_conflict", 2), "C5": ("duplicate", 0.95, "duplicate", 1),
    }
    assert {r["txn_ref"] for r in state.legs.where("status = 'open'").collect()} == {"OTHER", "U1", "U2", "U3"}
    out = [r["outcome"] for r in changes.outcomes.collect()]
    tallies = views.batch_tallies(changes.outcomes).first().asDict()
    # What doesn't match or break at its arrival is open then.
    assert tallies == {"accepted": len(FEED), "matched": 5, "breaks": 5, "open": len(FEED) - 11, "duplicates": 1} and len(out) == len(FEED)
    seqs = [r["seq"] for r in state.events.orderBy("seq").collect()]
    assert seqs == list(range(1, len(seqs) + 1))
    one = views.stats(state, Rules(tolerance_bps=12)).first()
    assert one["rules"]["tolerance_bps"] == 12 and one["rules"]["t3_require_batch_hint"] is True and one["version"]
    assert one["legs_matched"] == 12 and one["matches_by_rule"][S.T1_EXACT] == 2 and one["events_total"] == len(seqs)


def test_one_popular_amount(spark):
    """Pairs of one amount, the second leg 500 pairs later: none needs the fold. Legs of that
    amount without a partner in sight stay open, and are many for the fold."""
    n = 3_000
    pairs = [leg(2 * k, "ledger", f"V{k}", 700) for k in range(n)] + [leg(2 * (k + 500) + 1, "rail", f"V{k}", 700) for k in range(n)]
    state, changes = run(spark, pairs)
    assert state.matches.where(F.col("rule_id") == S.T1_EXACT).count() == n and state.matches.count() == n
    began = time.time()
    rows = [{"id": f"x{k}", "ingest_seq": k, "source": "ledger" if k % 2 else "rail", "txn_ref": f"W{k}", "amount_minor": 700, "currency": "USD", "value_date": DAY, "direction": "debit", "counterparty": "V",
             "attrs": {}, "ingested_at": None, "status": None, "match_id": None, "break_id": None, "is_new": True, "break_open": None, "break_n": None} for k in range(50_000)]
    out = fold(pd.DataFrame(rows), Rules())
    assert len(out) >= 100_000 and time.time() - began < 60


def test_redelivery_changes_nothing(spark):
    state, _ = run(spark, FEED[:6])
    again, changes = run(spark, [(r[0] + 100, *r[1:]) for r in FEED[:6]], state=state)
    assert {r["outcome"] for r in changes.outcomes.collect()} == {"duplicate"}
    assert again.events.count() == state.events.count() + 6 and again.legs.count() == state.legs.count()


def test_expiry_late_arrival_and_replay(spark):
    state, _ = run(spark, [leg(1, "ledger", "SLOW", 7_450), leg(2, "ledger", "WIDE", 52_000), leg(3, "ledger", "LOST", 61)])
    none, n = lifecycle.expire(state, Rules(), at(10), 24 * 3600)
    assert n == 0 and none.events.count() == 0
    changes, n = lifecycle.expire(state, Rules(), at(25), 24 * 3600)
    assert n == 3
    state = settled(apply(state, changes))
    assert {(r["category"], r["confidence"]) for r in state.breaks.collect()} == {("missing_counterparty", 0.8)}
    state, changes = run(spark, [leg(11, "rail", "SLOW", 7_452), leg(12, "rail", "WIDE", 50_500)], state=state, hours=26)
    out = {r["leg_id"].split(":")[1]: r for r in changes.outcomes.collect()}
    assert out["SLOW"]["outcome"] == "resolved_break" and out["SLOW"]["rule_id"] == S.T2_LATE and out["WIDE"]["outcome"] == "break"
    healed = state.breaks.where("status = 'resolved'").collect()
    assert len(healed) == 1 and healed[0]["actor"] == "system"
    assert state.breaks.where("category = 'fee'").count() == 1
    gone = state.breaks.where("array_contains(transform(leg_ids, x -> split(x, ':')[1]), 'LOST')").first()["id"]
    with pytest.raises(ValueError):
        lifecycle.resolve_break(state, gone, "", "me", at(27))
    with pytest.raises(KeyError):
        lifecycle.resolve_break(state, "brk_none", "why", "me", at(27))
    state = settled(apply(state, lifecycle.resolve_break(state, gone, "written off", "me", at(27))))
    with pytest.raises(lifecycle.BreakResolved):
        lifecycle.resolve_break(state, gone, "again", "me", at(28))
    rebuilt, outcomes = lifecycle.replay(state, Rules(), at(30))
    # Expiry isn't replayed: the late pair matches as an ordinary one, LOST waits again.
    assert {(r["rule_id"]) for r in rebuilt.matches.collect()} == {S.T2_REF}
    told = views.replay_tallies(state.events, outcomes).first().asDict()
    through = state.events.count()
    assert told == {"from_seq": 1, "through_seq": through, "events_read": through, "legs_replayed": 5, "matched": 1, "breaks": 1, "open": 3}
    assert outcomes.count() == 5 and rebuilt.legs.where("status = 'open'").count() == 1
    assert rebuilt.events.where("type = 'leg.ingested'").count() == 5 and rebuilt.events.where("type = 'replay.started'").count() == 1


def test_manual_resolution_survives_replay(spark):
    state, _ = run(spark, FEED)
    one = state.breaks.orderBy("id").first()["id"]
    state = settled(apply(state, lifecycle.resolve_break(state, one, "agreed", "me", at(1))))
    rebuilt, _ = lifecycle.replay(state, Rules(), at(2))
    key = lambda df: sorted((r["id"], r["status"], r["reason"]) for r in df.collect())
    assert key(rebuilt.breaks) == key(state.breaks)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(rebuilt.matches) == ids(state.matches)
    later, _ = lifecycle.replay(state, Rules(), at(2), first=5)
    assert later.legs.count() < state.legs.count()


def test_close_window_is_recorded_once(spark):
    state, _ = run(spark, [leg(1, "ledger", "A", 10)])
    changes, n = lifecycle.expire(state, Rules(), at(0), -5.0, forced=True)
    state = settled(apply(state, changes))
    assert n == 1 and [r["type"] for r in state.events.orderBy("seq").collect()] == ["leg.ingested", "leg.expired", "break.opened", "window.closed"]
    _, n = lifecycle.expire(state, Rules(), at(1), 0.0, forced=True)
    assert n == 0


def test_unhinted_batches(spark):
    rows = [leg(1, "ledger", "P", 1_000), leg(2, "ledger", "Q", 2_500), leg(3, "rail", "R", 3_500)]
    assert run(spark, rows)[0].matches.count() == 0
    assert run(spark, rows, Rules(t3_require_batch_hint=False))[0].matches.first()["rule_id"] == S.T3_SUBSET


def test_all_or_nothing(spark):
    bad = spark.createDataFrame([leg(1, "ledger", "A", 10), leg(2, "ledger", " ", -1, ccy="US")], FIELDS)
    with pytest.raises(ValueError, match="txn_ref is required; amount_minor must be > 0; currency"):
        require_valid(normalize(bad, at()))


def random_feed(seed, n):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        batch = r.choice([None, None, "R0", "R1", "B1"])
        rows.append(leg(k + 1, r.choice(["ledger", "rail", "card"]), f"R{r.randrange(14)}", r.choice([100, 200, 300, 500, 10_000, 10_005]), r.randrange(5), {"batch_ref": batch} if batch else {}, ccy=r.choice(["USD", "USD", "EUR"]), cp=r.choice(["V", "W"])))
    return rows


def serial(spark, rows):
    pdf = legs_of(spark, rows).toPandas()
    frame = pdf.sort_values("ingest_seq").drop_duplicates("id").assign(status=None, match_id=None, break_id=None, is_new=True, break_open=None, break_n=None)
    out = fold(frame, Rules())
    import json

    return {json.loads(p)["leg_id"]: (json.loads(p)["outcome"], json.loads(p)["rule_id"], json.loads(p)["match_id"], json.loads(p)["break_id"]) for k, p in zip(out["kind"], out["payload"]) if k == "outcome"}


@pytest.mark.parametrize("seed", [1, 2])
def test_parallel_equals_serial(spark, seed):
    rows = random_feed(seed, 70)
    want = serial(spark, rows)
    _, changes = run(spark, rows)
    got = {r["leg_id"]: (r["outcome"], r["rule_id"], r["match_id"], r["break_id"]) for r in changes.outcomes.where("outcome <> 'duplicate'").collect()}
    assert got == want
    # The same in three batches, with state carried over.
    state, got = State.empty(spark), {}
    for part in (rows[:25], rows[25:45], rows[45:]):
        state, changes = run(spark, part, state=state)
        got |= {r["leg_id"]: (r["outcome"], r["rule_id"], r["match_id"], r["break_id"]) for r in changes.outcomes.where("outcome <> 'duplicate'").collect()}
    assert got == want


def test_views(spark):
    state, _ = run(spark, FEED)
    page = views.list_breaks(state.breaks, at(2), status="open", limit=2, offset=1).collect()
    assert len(page) == 2 and page[0]["age_seconds"] == 7200
    assert views.list_breaks(state.breaks, at(2), min_age_s=7201).count() == 0
    assert views.list_breaks(state.breaks, at(2), category="fee").count() == 2
    for wrong in ({"limit": 0}, {"limit": 1001}, {"offset": -1}, {"status": "odd"}):
        with pytest.raises(ValueError):
            views.list_breaks(state.breaks, at(2), **wrong)
    assert [r["seq"] for r in views.events_page(state.events, 5, 3).collect()] == [5, 6, 7]
    m = state.matches.where("tier = 3")
    assert [r["id"] for r in views.legs_of(m, state.legs).orderBy("pos").collect()] == m.first()["leg_ids"]
    assert views.legs_of(m, state.legs).count() == 4
    assert set(LEG_COLUMNS) <= set(state.legs.columns)
    assert isinstance(state.legs.limit(1).toPandas(), pd.DataFrame)


def test_amount_is_unique_within_the_date_window(spark):
    rows = [
        leg(1, "ledger", "P1", 700), leg(2, "rail", "Q1", 700, 1), leg(3, "ledger", "P2", 700, 90), leg(4, "rail", "Q2", 700, 88), leg(5, "card", "Z", 700, 45),
        leg(10, "ledger", "A1", 800), leg(11, "ledger", "A2", 800, 1), leg(12, "rail", "B", 800, 2),  # a rival
        leg(20, "ledger", "C1", 900, -2), leg(21, "ledger", "C2", 900, 2), leg(22, "rail", "D", 900),  # two candidates
        leg(30, "ledger", "E", 950), leg(31, "rail", "F1", 950), leg(32, "card", "F2", 950),  # on two sources
        leg(40, "ledger", "G", 960), leg(41, "rail", "H", 960, 3),  # too far
        leg(50, "ledger", "I", 970), leg(51, "rail", "J", 970), leg(52, "rail", "I", 5),  # a known reference
    ]
    found = tiers.amount_date(legs_of(spark, rows), Rules()).collect()
    assert sorted(sorted(x.split(":")[1] for x in r["leg_ids"]) for r in found) == [["P1", "Q1"], ["P2", "Q2"]]


def test_amount_date_query_takes_all_orders(spark, tmp_path):
    # 19 has no rail leg, but its ledger leg makes the amount of 1 ambiguous; 2 is alone.
    rows = [(1, 8, 12.5, dt.datetime(1995, 1, 1)), (19, 8, 12.5, dt.datetime(1995, 1, 2)), (2, 8, 99.0, dt.datetime(1995, 1, 1))]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    found = registered.j4_t2_amount_date(spark, str(tmp_path)).collect()
    assert [sorted(x.split(":")[1] for x in r["leg_ids"].split("|")) for r in found] == [["ARN-2", "ORD-2"]]


def test_amount_date_equals_all_pairs_and_normalises_once(spark, monkeypatch):
    r = random.Random(4)
    rows = [leg(i, r.choice(["ledger", "rail", "card"]), f"R{r.randrange(150)}", r.randrange(1, 25), r.randrange(40)) for i in range(160)]
    plans, write = [], tiers.materialize
    monkeypatch.setattr(tiers, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    legs = legs_of(spark, rows)
    assert "array_compact" not in (plan := legs._jdf.queryExecution().optimizedPlan().toString()) and "filter(" not in plan
    found = sorted(sorted(x["leg_ids"]) for x in tiers.amount_date(legs, Rules()).collect())
    assert sum("sha2" in x for x in plans) <= 1 and not any("sequence(" in x for x in plans)
    all_, want = legs.collect(), []
    met = lambda l: [c for c in all_ if c["source"] != l["source"] and (c["currency"], c["counterparty"], c["amount_minor"]) == (l["currency"], l["counterparty"], l["amount_minor"]) and abs((c["value_date"] - l["value_date"]).days) <= 2]
    known = {(x["txn_ref"], x["source"]) for x in all_}
    for l in all_:
        for c in met(l):
            lone = len(met(l)) == len(met(c)) == 1 and l["ingest_seq"] > c["ingest_seq"] and l["txn_ref"] != c["txn_ref"]
            if lone and (c["txn_ref"], l["source"]) not in known and (l["txn_ref"], c["source"]) not in known:
                want.append(sorted([l["id"], c["id"]]))
    assert found == sorted(want) and len(want) > 3


def test_blank_and_stripped_follow_the_patterns(spark):
    texts = ["", " ", "\t\n", "\n", "\u0085", "\u2028", "\u00a0", "a", " a", "a ", "a\n", "a\u0085", "é", " é ", "\x1c", "\x7f", " \u2028", None, "usd", " usd ", "a b"]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(
        blank(F.col("t")).alias("a"), (F.col("t").isNull() | F.col("t").rlike(BLANK)).alias("b"), stripped(F.col("t")).alias("c"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("d")
    )
    assert all(x["a"] == x["b"] and x["c"] == x["d"] for x in got.collect())


def test_full_batches_move_no_whole_legs(spark):
    rows = [leg(i, "ledger", f"P{i}", 10 * i, attrs={"batch_ref": "B"}) for i in range(1, 4)] + [leg(4, "rail", "B", 60), leg(5, "rail", "C", 60)]
    legs = valid(normalize(spark.createDataFrame(rows, FIELDS), at())).withColumns({c: F.lit(None).cast("string") for c in ("status", "match_id", "break_id")})
    found = tiers.full_batches(legs, Rules())
    got = found.first()
    assert found.count() == 1 and len(got["leg_ids"]) == 4 and got["residual_minor"] == 0
    assert "struct(" not in found._jdf.queryExecution().optimizedPlan().toString()
