"""Continuous reconciliation: each micro-batch runs the same plan as a batch ingest.

The state below a shared path is a snapshot and the changes since: v=N holds the rows that
micro-batch N put over those of equal id, events/batch=N its events; a `_COMMIT` file
marks both as whole and holds the last event's number. What a micro-batch writes follows
its own size. Every COMPACT versions base=N is written, the whole projections; changes and
snapshots before the last snapshot but one are deleted, so a reader has that long. Events
are never deleted.

A hook is told after each version what it holds (counts by status, rule, category and type
of event; a hook with the attribute `detailed`, also breaks by trigger and the residuals'
histogram by tier). The counts are observed while the version is written, so they cost no
job. `streaming.totals` adds them up.

A sink (`sources.sinks`) follows the store: after each micro-batch, also one that is repeated,
it takes over the versions that it lacks.

A restarted query that repeats a micro-batch finds its version committed and leaves it, so
delivery is at least once and effects are exactly once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom import schema as S
from tallyloom.operators import classify as C
from tallyloom.operators import lifecycle
from tallyloom.operators.normalize import normalize, rejected, valid
from tallyloom.operators.resolve import Changes, State, Classifier, gapless, ingest, last_seq, numbered, over
from tallyloom.operators.views import RESIDUAL_BOUNDS
from tallyloom.rules import Rules
from tallyloom.session import scratch

PROJECTIONS = {"legs": S.LEG, "matches": S.MATCH, "breaks": S.BREAK}
TIERS = (1, 2, 3)
#: Versions between two snapshots.
COMPACT = 32
#: What a hook is told: counts of a version, by table.
Told = dict[str, dict[str, int]]
# States of legs, categories of breaks and types of events.
STATUSES = ("open", "matched", "break")
TRIGGERS = (S.DUPLICATE, S.REF_CONFLICT, S.WINDOW_EXPIRED)
CATEGORIES = ("duplicate", "fee", "fx_drift", "timing", "missing_counterparty", "unclassified")
EVENTS = ("leg.ingested", "leg.duplicate", "leg.expired", "match.created", "break.opened", "break.resolved", "window.closed", "replay.started")


def _counts(detailed: bool = False) -> dict[str, list[Column]]:
    by = lambda column, values: [F.count_if(F.col(column) == v).alias(v) for v in values]
    rules = (S.T1_EXACT, S.T2_REF, S.T2_AMOUNT_DATE, S.T2_LATE, S.T3_SUBSET)
    off = F.abs("residual_minor")
    residual = F.coalesce(F.sum(off), F.lit(0)).alias("residual_minor")
    found = {"legs": by("status", STATUSES), "matches": [*by("rule_id", rules), residual], "breaks": [*by("category", CATEGORIES), *by("status", ("resolved",))], "events": by("type", EVENTS)}
    if detailed:
        # T1<=0 counts the matches of tier 1 with a residual of at most 0, and so on.
        for t in TIERS:
            own = F.col("tier") == t
            found["matches"] += [F.count_if(own).alias(f"T{t}"), F.coalesce(F.sum(F.when(own, off)), F.lit(0)).alias(f"T{t} sum")]
            found["matches"] += [F.count_if(own & (off <= b)).alias(f"T{t}<={b}") for b in RESIDUAL_BOUNDS]
        opened = F.col("status") == "open"
        found["breaks"] += [F.count_if(opened & (F.col("category") == c) & (F.col("trigger") == t)).alias(f"{c}/{t}") for c in CATEGORIES for t in TRIGGERS]
    return found


class Store:
    """The state and its changes below a shared path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def committed(self, version: int, kind: str = "v") -> bool:
        return self._fs.exists(self._at(f"{kind}={version}/_COMMIT"))

    def versions(self, kind: str = "v") -> list[int]:
        """The whole versions (v) or snapshots (base) that there are."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName().partition("=") for s in self._fs.listStatus(self._root)]
        return sorted(int(n) for k, _, n in names if k == kind and self.committed(int(n), kind))

    def latest(self) -> int:
        """The newest whole version, or -1."""
        return max(self.versions(), default=-1)

    def last_seq(self, version: int) -> int:
        """The number of the last event as of a version."""
        if version < 0:
            return 0
        held = self._fs.open(self._at(f"v={version}/_COMMIT"))
        try:
            return held.readLong()
        finally:
            held.close()

    def _commit(self, folder: str, seq: int) -> None:
        out = self._fs.create(self._at(f"{folder}/_COMMIT"), True)
        out.writeLong(seq)
        out.close()

    def read(self, version: int) -> State:
        """The state as of a version that isn't older than the oldest snapshot."""
        empty = State.empty(self.spark)
        if version < 0:
            return empty
        bases = [n for n in self.versions("base") if n <= version]
        since = [n for n in self.versions() if n <= version and (not bases or n > bases[-1])]

        def projection(name: str, kind) -> DataFrame:
            old = self.spark.read.schema(kind).parquet(f"{self.path}/base={bases[-1]}/{name}") if bases else getattr(empty, name)
            if not since:
                return old
            columns = [f.name for f in kind]
            ddl = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kind)}, _v bigint"
            each = self.spark.read.schema(ddl).parquet(*[f"{self.path}/v={n}/{name}" for n in since])
            newest = each if len(since) == 1 else each.groupBy("id").agg(F.max_by(F.struct(*columns), "_v").alias("x")).select("x.*")
            return over(old, newest.select(columns)) if bases else newest.select(columns)

        return State(*(projection(n, k) for n, k in PROJECTIONS.items()), self.events(-1, version))

    def part(self, name: str, version: int, kind: str = "v") -> DataFrame:
        """The rows of a projection that a version (v) changed or a snapshot (base) holds."""
        return self.spark.read.schema(PROJECTIONS[name]).parquet(f"{self.path}/{kind}={version}/{name}")

    def events(self, after: int, version: int) -> DataFrame:
        """The events of the versions after `after` up to `version`."""
        ddl = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in S.EVENT)}, batch bigint"
        return self.spark.read.schema(ddl).parquet(f"{self.path}/events").where((F.col("batch") > after) & (F.col("batch") <= version)).drop("batch")

    def write(self, version: int, steps: list[Changes], detailed: bool = False) -> Told:
        """The changes of a micro-batch's steps, in their order, as one version; what it
        holds."""
        empty, seq = State.empty(self.spark), self.last_seq(self.latest())
        counts, seen = _counts(detailed), {name: Observation(f"{name}-{version}") for name in (*PROJECTIONS, "events")}
        for name in PROJECTIONS:
            rows = reduce(over, [getattr(c, name) for c in steps], getattr(empty, name))
            rows.withColumn("_v", F.lit(version).cast("long")).observe(seen[name], *counts[name]).write.mode("overwrite").parquet(f"{self.path}/v={version}/{name}")
        events = empty.events
        for step in steps:
            found = numbered(step.events, seq)
            seq = max(seq, last_seq(found))
            events = events.unionByName(found.select(events.columns))
        events.observe(seen["events"], *counts["events"]).write.mode("overwrite").parquet(f"{self.path}/events/batch={version}")
        self._commit(f"v={version}", seq)
        return {name: o.get for name, o in seen.items()}

    def compact(self) -> None:
        """A new snapshot if COMPACT versions have come since the last; then what only older
        snapshots need is deleted."""
        bases, versions = self.versions("base"), self.versions()
        if len([n for n in versions if not bases or n > bases[-1]]) < COMPACT:
            return
        version = versions[-1]
        state = self.read(version)
        for name in PROJECTIONS:
            getattr(state, name).write.mode("overwrite").parquet(f"{self.path}/base={version}/{name}")
        self._commit(f"base={version}", self.last_seq(version))
        for kind, held in (("base", bases[:-1]), ("v", [n for n in versions if bases and n <= bases[-1]])):
            for n in held:
                self._fs.delete(self._at(f"{kind}={n}"), True)


class Follower(Protocol):
    def follow(self, store: Store) -> list[int]: ...


def with_heartbeat(legs: DataFrame) -> DataFrame:
    """The stream of legs and a tick a second, marked in `_tick`: without rows there is no
    micro-batch, and without one no sweep."""
    ticks = legs.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(True).alias("_tick"))
    return legs.withColumn("_tick", F.lit(False)).unionByName(ticks, allowMissingColumns=True)


def micro_batch(store: Store, rules: Rules, ttl_s: float, clock: Callable[[], str], dead_letters: str | None = None, hook: Callable[[int, Told], None] | None = None, sink: Follower | None = None, classifier: Classifier = C.classify):
    """A foreachBatch function: sweep what has expired, then ingest, then call hook(version,
    counts); after a failure between the last two the hook isn't called. Rows need ingest_seq or
    (topic, partition, offset), whose order they arrive in. Where there is nothing to ingest
    and nothing has expired, no version is written."""

    detailed = getattr(hook, "detailed", False)

    def step(batch: DataFrame, batch_id: int) -> None:
        state = store.read(store.latest())
        now = F.lit(clock()).cast("timestamp")
        if "_tick" in batch.columns:
            batch = batch.where("NOT _tick").drop("_tick")
        swept, n = lifecycle.expire(state, rules, now, ttl_s)
        if batch.isEmpty():
            if n:
                tell(batch_id, store.write(batch_id, [swept], detailed))
            return
        state = State(*(over(getattr(state, name), getattr(swept, name)) for name in PROJECTIONS), state.events) if n else state
        rows = batch if "problems" in batch.columns else normalize(batch, now)
        if dead_letters:
            rejected(rows).write.mode("overwrite").json(f"{dead_letters}/batch={batch_id}")
        legs = valid(rows)
        if "ingest_seq" not in legs.columns:
            order = ["ingested_at", "topic", "partition", "offset"]
            base = state.legs.agg(F.coalesce(F.max("ingest_seq"), F.lit(0))).first()[0]
            legs = gapless(legs, order, base, "ingest_seq")
        tell(batch_id, store.write(batch_id, [swept, ingest(legs, state, rules, now, classifier)], detailed))

    def tell(version: int, told: Told) -> None:
        if hook is not None:
            hook(version, told)

    def run(batch: DataFrame, batch_id: int) -> None:
        if not store.committed(batch_id):
            with scratch(store.spark):
                step(batch, batch_id)
        if sink is not None:
            sink.follow(store)
        with scratch(store.spark):
            store.compact()

    return run


def start(legs: DataFrame, store: Store, checkpoint: str, rules: Rules, ttl_s: float, clock: Callable[[], str], available_now: bool = False, dead_letters: str | None = None, hook: Callable[[int, Told], None] | None = None, sink: Follower | None = None, classifier: Classifier = C.classify, every_s: float = 30) -> StreamingQuery:
    """Run continuously, a micro-batch and a sweep every every_s seconds, also while no legs
    arrive; or until what is there has been read."""
    legs = legs if available_now else with_heartbeat(legs)
    writer = legs.writeStream.foreachBatch(micro_batch(store, rules, ttl_s, clock, dead_letters, hook, sink, classifier)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{every_s} seconds")).start()


__all__ = ["Changes", "Store", "micro_batch", "start", "with_heartbeat"]
