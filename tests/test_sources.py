import json
import random

from pyspark.sql import functions as F

from tallyloom.operators.resolve import State
from tallyloom.plans.components import connected_components
from tallyloom.rules import Rules
from tallyloom.sources import feeds
from tallyloom.streaming.stream import Store, start

GOOD = {"source": "acquirer", "txn_ref": "Q-5", "amount_minor": 4375, "currency": "chf", "value_date": "2027-02-03", "direction": "Credit", "counterparty": "ORBIT"}


def test_json_batches(spark):
    bodies = [(1, json.dumps({"legs": [GOOD, GOOD]})), (2, json.dumps([GOOD])), (3, "{}"), (4, "[]"), (5, "oops"), (6, json.dumps([GOOD] * 3))]
    out = feeds.from_json_batches(spark.createDataFrame(bodies, "n int, body string"), most=2)
    got = {}
    for r in out.collect():
        got.setdefault(r["n"], []).append((r["refused"], r["source"]))
    assert got[1] == [(None, "acquirer")] * 2 and got[2] == [(None, "acquirer")]
    assert got[3] == got[4] == got[5] == [("no legs", None)] and got[6] == [("more than 2 legs", None)]


def test_record_decode(spark):
    """Records with any of source, reference, topic prefix and key missing; some unreadable."""
    r, rows, want = random.Random(31), [], {}
    for n in range(80):
        body = {k: v for k, v in GOOD.items() if k not in ("source", "txn_ref") or r.random() < 0.5}
        topic, key = r.choice(["bank.in", "desk", "bank.a.b"]), r.choice([f"K{n}", None])
        odd = r.choice([None, None, None, "{", "nonsense", '{"amount_minor": 5', ""])
        rows.append((topic, 0, n, key and key.encode(), (json.dumps(body) if odd is None else odd).encode()))
        ref = body.get("txn_ref", key)
        want[n] = "not JSON" if odd is not None else (body.get("source", topic.split(".")[0]), ref) if ref else "txn_ref is required"
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, key binary, value binary").withColumn("timestamp", F.lit("2027-02-04 10:00:00").cast("timestamp"))
    for x in feeds.decode_records(df).collect():
        if isinstance(want[x["offset"]], str):
            assert want[x["offset"]] in x["problems"], x
        else:
            assert not x["problems"] and (x["source"], x["txn_ref"], x["currency"], x["direction"]) == (*want[x["offset"]], "CHF", "credit")


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7), (200, 200)] + [(500, 501 + i) for i in range(40)]
    got = dict(connected_components(spark.createDataFrame(chain, "src bigint, dst bigint")).collect())
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
    assert {got[i] for i in range(500, 541)} == {500} and 200 not in got
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_stream(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/state")
    source.mkdir()

    def feed(n, rows):
        (source / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))

    def go():
        legs = feeds.read_files(spark, f"file://{source}", streaming=True)
        q = start(legs, store, f"file://{tmp_path}/check", Rules(), 48 * 3600.0, lambda: "2027-02-04 10:00:00", available_now=True, dead_letters=f"file://{tmp_path}/dead")
        q.awaitTermination(300)

    feed(1, [GOOD | {"ingest_seq": 1}, GOOD | {"ingest_seq": 2, "txn_ref": "B", "amount_minor": -1}])
    go()
    feed(2, [GOOD | {"ingest_seq": 3, "source": "rail"}])
    go()
    go()  # nothing new
    state = store.read(store.latest())
    assert isinstance(state, State) and state.matches.count() == 1 and state.legs.where("status = 'matched'").count() == 2
    assert [r["type"] for r in state.events.orderBy("seq").collect()] == ["leg.ingested", "leg.ingested", "match.created"]
    assert "amount_minor must be > 0" in spark.read.json(f"file://{tmp_path}/dead").first()["problems"]


def test_micro_batch_orders_records(spark, tmp_path):
    from tallyloom.streaming.stream import micro_batch

    body = {k: v for k, v in GOOD.items() if k not in ("source", "txn_ref")}
    rows = [(f"{s}.legs", 0, n, b"K1", json.dumps(body).encode()) for n, s in enumerate(["ledger", "rail", "ledger"])]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, key binary, value binary").withColumn("timestamp", F.lit("2027-02-04 10:00:00").cast("timestamp"))
    store = Store(spark, f"file://{tmp_path}/state")
    told = []
    run = micro_batch(store, Rules(), 3600.0, lambda: "2027-02-04 10:00:00", hook=lambda version, counts: told.append((version, counts)))
    run(feeds.decode_records(df), 0)
    run(feeds.decode_records(df), 0)  # repeated: nothing happens, nothing is told
    some = {table: {k: n for k, n in counts.items() if n} for table, counts in told[0][1].items()}
    assert len(told) == 1 and told[0][0] == 0
    assert some == {"legs": {"matched": 2}, "matches": {"T1.exact@v1": 1}, "breaks": {}, "events": {"leg.ingested": 2, "leg.duplicate": 1, "match.created": 1}}
    state = store.read(0)
    assert state.matches.count() == 1 and state.events.where("type = 'leg.duplicate'").count() == 1


def written(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet") if f.stat().st_size)


def records(lo, hi, source="ledger"):
    return [GOOD | {"ingest_seq": k, "source": source, "txn_ref": f"R{k}", "amount_minor": 1000 + k} for k in range(lo, hi)]


def test_versions_hold_changes_and_snapshots_replace_them(spark, tmp_path, monkeypatch):
    from tallyloom.streaming import stream

    monkeypatch.setattr(stream, "COMPACT", 2)
    store = Store(spark, f"file://{tmp_path}/state")
    run = stream.micro_batch(store, Rules(), 1e9, lambda: "2027-02-04 10:00:00")

    def rows(made):
        path = tmp_path / f"in{made[0]['ingest_seq']}.json"
        path.write_text("\n".join(json.dumps(r) for r in made))
        return feeds.read_files(spark, f"file://{path}")

    run(rows(records(1, 3001)), 0)
    # One partner of an old leg and one new leg: that, and not the state, is written.
    for n in range(1, 6):
        partner = GOOD | {"ingest_seq": 5000 + 2 * n, "source": "rail", "txn_ref": f"R{n}", "amount_minor": 1000 + n}
        run(rows([partner, *records(5001 + 2 * n, 5002 + 2 * n)]), n)
        assert spark.read.parquet(f"file://{tmp_path}/state/v={n}/legs").count() == 3
    state = store.read(5)
    assert state.matches.count() == 5 and state.legs.count() == 3010 and state.legs.where("status = 'matched'").count() == 10
    assert store.versions("base") == [3, 5] and store.versions() == [4, 5]
    assert written(tmp_path / "state" / "v=5") * 4 < written(tmp_path / "state" / "base=5")
    assert [r["seq"] for r in state.events.select("seq").orderBy("seq").collect()] == list(range(1, 3000 + 10 + 5 + 1)) and store.last_seq(5) == 3015
    # An earlier version, a snapshot and one change, is still there.
    assert store.read(4).matches.count() == 4 and store.read(4).legs.count() == 3008


def test_idle_stream_sweeps(spark, tmp_path):
    import time

    from tallyloom.streaming.stream import micro_batch, with_heartbeat

    source, store, clock = tmp_path / "in", Store(spark, f"file://{tmp_path}/state"), ["2027-02-04 10:00:00"]
    source.mkdir()
    (source / "1.json").write_text(json.dumps(GOOD | {"ingest_seq": 1}))
    legs = with_heartbeat(feeds.read_files(spark, f"file://{source}", streaming=True))
    run = micro_batch(store, Rules(), 3600.0, lambda: clock[0])
    q = legs.writeStream.foreachBatch(run).option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="1 second").start()
    try:
        def wait(done):
            end = time.time() + 120
            while not done() and q.isActive and time.time() < end:
                time.sleep(0.5)
            assert q.exception() is None and done()

        wait(lambda: store.latest() >= 0)
        first = store.latest()
        assert store.read(first).legs.where("status = 'open'").count() == 1
        clock[0] = "2027-02-04 11:00:00"  # no more legs
        wait(lambda: store.latest() > first)
        state = store.read(store.latest())
        assert state.breaks.where("status = 'open'").count() == 1 and state.legs.where("status = 'break'").count() == 1
        assert [r["type"] for r in state.events.orderBy("seq").collect()] == ["leg.ingested", "leg.expired", "break.opened"]
    finally:
        q.stop()
    # A tick with nothing to do leaves no version.
    assert len(store.versions()) == 2


def test_one_row_group_is_spread(spark, tmp_path):
    # One row group in a file that is cut into more parts than there are cores.
    rows = spark.range(60_000).selectExpr("id AS o_orderkey", "id AS o_custkey", "id * 1.5 AS o_totalprice", "timestamp'2026-01-01' AS o_orderdate", "sha2(string(id), 256) AS o_comment")
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        legs = feeds.order_pairs(spark, str(tmp_path))
        parts = legs.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r[1] for r in parts) == 117_000 and max(r[1] for r in parts) < 117_000 / 4


def test_records_are_parsed_once(spark):
    records = spark.createDataFrame([("rail.legs.v1", 0, 1, b"A", b"{}", None)], "topic string, partition int, offset bigint, key binary, value binary, timestamp timestamp")
    out = feeds.decode_records(records).where("size(problems) = 0").select("id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
