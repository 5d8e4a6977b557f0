import json

import pytest
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.rules import Rules
from tallyloom.settings import Settings
from tallyloom.sources import feeds
from tallyloom.sources.sinks import TARGETS, KeyedSink
from tallyloom.streaming import stream
from tallyloom.streaming.stream import Store, micro_batch
from tallyloom.streaming.totals import Totals

LEG = {"source": "desk", "txn_ref": "K-1", "amount_minor": 8125, "currency": "SEK", "value_date": "2027-05-11", "direction": "debit", "counterparty": "HARBOR", "attrs": {"fee_minor": "3", "note": 'say "a"'}}


@pytest.fixture
def sink(spark, tmp_path):
    # The embedded database that comes with Spark.
    found = KeyedSink(spark, f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, connections=4)
    found.create()
    found.create()  # again: nothing
    return found


class Feed:
    def __init__(self, spark, folder, sink=None, hook=None, ttl=3600.0):
        self.spark, self.folder, self.clock = spark, folder, "2027-05-11 09:00:00"
        self.store = Store(spark, f"file://{folder}/state")
        self.run = micro_batch(self.store, Rules(), ttl, lambda: self.clock, hook=hook, sink=sink)

    def __call__(self, n, rows):
        path = self.folder / f"in{n}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        self.run(feeds.read_files(self.spark, f"file://{path}"), n)


def rows_of(state, name):
    columns = [f.name for f in TARGETS[name].kind]
    return sorted(map(repr, (tuple(dict(v) if isinstance(v, dict) else v for v in r) for r in getattr(state, name).select(columns).collect())))


def same(sink, store):
    there, here = sink.state(), store.read(store.latest())
    for name in TARGETS:
        assert rows_of(there, name) == rows_of(here, name), name


def test_database_follows_the_store(spark, sink, tmp_path):
    feed = Feed(spark, tmp_path, sink)
    feed(0, [LEG | {"ingest_seq": 1}, LEG | {"ingest_seq": 2, "txn_ref": "K-2", "attrs": {}}, LEG | {"ingest_seq": 3, "txn_ref": "K-3"}])
    feed(1, [LEG | {"ingest_seq": 4, "source": "bank"}])
    same(sink, feed.store)
    assert sink.newest() == 1 and sink.read("matches").count() == 1
    feed(1, [LEG | {"ingest_seq": 4, "source": "bank"}])  # repeated
    same(sink, feed.store)
    feed.clock = "2027-05-11 11:00:00"  # K-2 and K-3 expire, then K-2 is healed
    feed(2, [LEG | {"ingest_seq": 5, "source": "bank", "txn_ref": "K-9"}])
    feed(3, [LEG | {"ingest_seq": 6, "source": "bank", "txn_ref": "K-2", "attrs": {}}])
    same(sink, feed.store)
    breaks = {r["status"] for r in sink.read("breaks").collect()}
    assert breaks == {"open", "resolved"} and [r["seq"] for r in sink.read("events").orderBy("seq").collect()] == list(range(1, sink.read("events").count() + 1))
    sink.reset()
    assert sink.read("legs").isEmpty() and not sink.read("events").isEmpty() and sink.newest() == 3


def test_failure_before_the_commit_leaves_no_trace(spark, sink, tmp_path, monkeypatch):
    feed = Feed(spark, tmp_path)
    feed(0, [LEG | {"ingest_seq": 1}])
    feed(1, [LEG | {"ingest_seq": 2, "source": "bank"}])
    whole = KeyedSink._merge
    with monkeypatch.context() as m:
        # All but the last table are merged when the statement fails.
        m.setattr(KeyedSink, "_merge", lambda self, name, target: whole(self, name, target) if name != "events" else ["DELETE FROM no_such_table"])
        with pytest.raises(Exception, match="(?i)no_such_table"):
            sink.follow(feed.store)
    assert sink.newest() == -1 and sink.read("legs").isEmpty()
    assert sink.follow(feed.store) == [0, 1] and sink.follow(feed.store) == []
    same(sink, feed.store)


def test_rows_of_a_task_that_ran_twice_and_known_keys(spark, sink):
    leg = spark.createDataFrame([("a", *[None] * 9, 1, "open", None, None)], S.LEG)
    none = {name: spark.createDataFrame([], t.kind) for name, t in TARGETS.items()}
    assert sink.apply(4, none | {"legs": leg.unionByName(leg)})
    changed = leg.withColumns({"status": F.lit("matched"), "match_id": F.lit("m_1"), "source": F.lit("other")})
    assert not sink.apply(4, none | {"legs": changed}) and not sink.apply(3, none | {"legs": changed})
    assert sink.read("legs").first()["status"] == "open"
    assert sink.apply(5, none | {"legs": changed})
    (row,) = sink.read("legs").collect()
    assert (row["status"], row["match_id"], row["source"], row["attrs"]) == ("matched", "m_1", None, None)


def test_snapshot_stands_for_deleted_changes(spark, sink, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "COMPACT", 1)
    feed = Feed(spark, tmp_path)
    for n in range(3):
        feed(n, [LEG | {"ingest_seq": n + 1, "txn_ref": f"K-{n}", "source": ("desk", "bank")[n % 2]}])
    assert feed.store.versions("base") == [1, 2] and feed.store.versions() == [2]
    assert sink.follow(feed.store) == [1, 2]
    same(sink, feed.store)


def test_totals(spark, tmp_path):
    totals = Totals()
    feed = Feed(spark, tmp_path, hook=totals)
    feed(0, [LEG | {"ingest_seq": 1}, LEG | {"ingest_seq": 2, "source": "bank", "amount_minor": 8122}, LEG | {"ingest_seq": 3, "txn_ref": "K-2"}, LEG | {"ingest_seq": 4, "amount_minor": 9000}])
    feed(1, [LEG | {"ingest_seq": 5, "source": "bank", "txn_ref": "K-2"}])
    feed(1, [LEG | {"ingest_seq": 5, "source": "bank", "txn_ref": "K-2"}])
    totals(1, {"matches": {"T1": 5}})  # told again
    assert totals.histogram(1) == dict.fromkeys(["0", "1", "2", "5", "10", "25", "50", "100", "500", "+Inf"], 1)
    assert totals.histogram(2) == {"0": 0, "1": 0, "2": 0} | dict.fromkeys(["5", "10", "25", "50", "100", "500", "+Inf"], 1)
    text = totals.text().splitlines()
    assert 'tally_match_residual_minor_sum{tier="T2"} 3' in text and 'tally_matches_total{rule="T1.exact@v1"} 1' in text
    assert 'tally_breaks_opened_total{category="duplicate",trigger="duplicate"} 1' in text and 'tally_events_total{type="leg.ingested"} 5' in text


def test_settings():
    env = {"TTL": "1h30m", "SWEEP": "500ms", "TOPICS": " a.legs, ,b.legs", "SINK_URL": "jdbc:x:y", "FEE_MIN_BPS": "5", "T3_MAX_SUBSET": "4", "SERVERS": ""}
    got = Settings.from_env({f"TALLYLOOM_{k}": v for k, v in env.items()})
    assert (got.ttl_s, got.sweep_s, got.topics, got.sink_url, got.band.min_bps, got.band.max_bps) == (5400.0, 0.5, ("a.legs", "b.legs"), "jdbc:x:y", 5.0, 400.0)
    assert got.rules == Rules(t3_max_subset=4) and got.servers == Settings().servers and Settings.from_env({}) == Settings()
    env = {"TTL": "-1s", "SWEEP": "soon", "TOPICS": ",", "SINK_URL": "db", "FEE_MIN_BPS": "500", "T3_MAX_SUBSET": "x"}
    with pytest.raises(ValueError) as e:
        Settings.from_env({f"TALLYLOOM_{k}": v for k, v in env.items()})
    for part in ("TTL", "SWEEP", "TOPICS", "SINK_URL", "FEE_MIN_BPS", "T3_MAX_SUBSET"):
        assert part in str(e.value).upper()


def test_text_that_does_not_fit_is_an_error(spark, tmp_path):
    sink = KeyedSink(spark, f"jdbc:derby:{tmp_path}/db;create=true", types={"string": "VARCHAR(10)"})
    sink.create()
    events = lambda text: {"events": spark.createDataFrame([(1, "x", None, "a", text)], S.EVENT)}
    with pytest.raises(Exception, match="payload: longer than 10"):
        sink.apply(0, events("0123456789a"))
    assert sink.newest() == -1 and sink.apply(0, events("0123456789")) and sink.read("events").first()["payload"] == "0123456789"
