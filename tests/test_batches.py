"""Batches by way of ingest."""

import datetime as dt
import random

import duckdb
from test_matching import leg, legs_of, run, serial

from tallyloom import queries as registered
from tallyloom import schema as S
from tallyloom.operators import groups, resolve
from tallyloom.operators.normalize import once_each
from tallyloom.operators.resolve import State
from tallyloom.rules import Rules


def tables(spark, folder, orders):
    """orders: prices of the lines by order key, all of one customer and day."""
    day = dt.datetime(1995, 1, 1)
    rows = [(k, 24, day) for k in orders]
    lines = [(k, 1, 1, i + 1, float(p), day) for k, prices in orders.items() for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    ddl = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, ddl).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def by_sql(folder, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(con.execute(f"SELECT id, n_legs, round(confidence, 6), residual_minor, currency FROM ({registered.ORACLES[name]})").fetchall())


def test_lines_that_equal_settlements_of_other_orders(spark, tmp_path):
    """The seven lines of 1 stay open, and one equals the settlement of 2; the settlement of 3 stays
    open, and a line of 4 equals it. A single line is a pair, in 6 with the amount of 5's."""
    orders = {1: [300, 50, 60, 70, 80, 90, 95], 2: [100, 200], 3: [10, 11, 12, 13, 14, 15, 16], 4: [91, 20, 30], 5: [75], 6: [75], 7: [75, 75]}
    folder = tables(spark, tmp_path, orders)
    found = sorted(tuple(r[c] for c in ("id", "n_legs", "confidence", "residual_minor", "currency")) for r in registered.w1_batches(spark, folder).collect())
    assert found == by_sql(folder, "w1_batches") and len(found) == 3


def batch(k, amounts, settled=None, cp="V", day=0):
    parts = [leg(k * 1000 + i, "ledger", f"L-{k}-{i}", a, day, {"batch_ref": f"B-{k}"}, cp=cp) for i, a in enumerate(amounts)]
    return [*parts, leg(k * 1000 + 999, "rail", f"B-{k}", sum(amounts) if settled is None else settled, day, cp=cp)]


def test_whole_batches_move_few_columns(spark, monkeypatch):
    """Batches that touch nothing else take no part in the steps that move whole legs."""
    plans, rows = {}, {}

    def seen(write):
        def wrote(df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            out = write(df, name)
            rows[name] = rows.get(name, 0) + out.count()
            return out

        return wrote

    monkeypatch.setattr(resolve, "materialize", seen(resolve.materialize))
    monkeypatch.setattr(groups, "materialize", seen(groups.materialize))
    feed = [x for k in range(30) for x in batch(k, [100 * k + 1, 100 * k + 2, 100 * k + 3][: k % 3 + 1], cp=f"V{k}")]
    changes = resolve.ingest(legs_of(spark, feed), State.empty(spark), Rules(), resolve.F.current_timestamp())
    assert {r["tier"]: r["count"] for r in changes.matches.groupBy("tier").count().collect()} == {2: 10, 3: 20}
    assert rows["refs"] == 0 and not {"crowd", "placed", "left"} & set(rows)
    assert "Exchange" in plans["batches"] and "direction" not in plans["batches"]


def test_batches_equal_a_serial_fold(spark):
    """At once where nothing else is touched, else the longer way; in one go and in two."""
    r = random.Random(7)
    rows = [x for k in range(40) for x in batch(k, [r.randrange(1, 60) for _ in range(r.randrange(1, 9))], cp=r.choice("VW"), day=r.randrange(9))]
    rows += batch(100, [50_000, 40_000, 30_000, 20_000, 10_000, 5_000, 4_000], 90_003, cp="X")  # some of the parts
    rows += batch(101, [50_000, 40_000, 9], cp="Y")  # all but the smallest are near enough
    rows += batch(102, [*range(1_000, 1_070)], 1_000 + 1_001 + 1_005, cp="Z")  # more than are settled at once
    rows += batch(103, [70, 80], cp="T")[:2] + [leg(103_500, "rail", "B-103", 150, 5, cp="T")]  # too late
    rows += batch(104, [7, 8], cp="S") + [leg(104_999_000, "rail", "B-104", 15, 1, cp="S")]  # a reference twice
    rows += batch(105, [7, 9], cp="R") + [leg(105_999_000, "card", "Q", 16, 0, {"batch_ref": "L-105-0"}, cp="R")]  # a part that is named itself
    rows += [leg(106_000, "rail", "B-106", 30, cp="Q"), leg(106_001, "ledger", "L-106-0", 10, 0, {"batch_ref": "B-106"}, cp="Q"), leg(106_002, "ledger", "L-106-1", 20, 0, {"batch_ref": "B-106"}, cp="Q")]
    rows += batch(107, [5], cp="P", day=0)[:1] + [leg(107_999, "rail", "B-107", 5, 4, cp="P")]  # a pair too far apart
    rows += [(x[0] + 10**9, *x[1:]) for x in rows[:5]]
    want = serial(spark, rows)
    told = lambda changes: {x["leg_id"]: (x["outcome"], x["rule_id"], x["match_id"], x["break_id"]) for x in changes.outcomes.where("outcome <> 'duplicate'").collect()}
    state, changes = run(spark, rows)
    assert told(changes) == want and {S.T3_SUBSET, S.T2_AMOUNT_DATE} <= {v[1] for v in want.values()}
    assert {x["id"]: x["match_id"] for x in state.legs.collect()}.keys() == want.keys()
    rows.sort()
    half = len(rows) // 2
    state, first = run(spark, rows[:half])
    _, second = run(spark, rows[half:], state=state)
    assert told(first) | told(second) == want


def test_once_each_by_hash(spark):
    rows = [leg(1, "ledger", "A", 1), leg(2, "ledger", "B", 2), leg(3, "ledger", "A", 1), leg(4, "ledger", "A", 1)]
    first, again = once_each(legs_of(spark, rows))
    assert sorted(x["ingest_seq"] for x in first.collect()) == [1, 2] and sorted(x["ingest_seq"] for x in again.collect()) == [3, 4]
    first, again = once_each(legs_of(spark, rows[:2]))
    assert first.count() == 2 and again.count() == 0 and again.columns == first.columns
