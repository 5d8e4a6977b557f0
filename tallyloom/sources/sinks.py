"""A keyed durable sink: projections and events in a relational database, over JDBC.

A version of the stream's store goes there in two steps. Executors write its rows in
parallel into staging tables, each partition in its own transaction. Then one transaction
on the driver's connection merges them by key inside the database and notes the version;
no row passes through the driver. Whatever fails before the commit leaves the tables as
they were, and a version that is noted isn't applied again, so a repeated micro-batch has
one effect.

A task that runs twice, after its executor was lost, doubles its rows in the staging table;
they are equal, and only distinct rows are merged.

A key that is known keeps its row, but for the columns that change in an entity's life: the
status and links of a leg, the status and resolution of a break. Matches and events never
change. Lists and maps are kept as JSON text. The database needs MERGE (SQL:2003).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import schema as S
from tallyloom.operators.resolve import State
from tallyloom.streaming.stream import PROJECTIONS, Store


@dataclass(frozen=True)
class Target:
    """kind: the rows; key: their key; changes: the columns that a known row takes over."""

    kind: T.StructType
    key: str
    changes: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.kind]


TARGETS = {
    "legs": Target(S.LEG, "id", ("status", "match_id", "break_id")), "matches": Target(S.MATCH, "id"),
    "breaks": Target(S.BREAK, "id", ("status", "resolved_at", "reason", "actor")), "events": Target(S.EVENT, "seq"),
}
#: SQL types of columns by their Spark types; `key` for text in a key.
TYPES = {"key": "VARCHAR(512)", "string": "VARCHAR(32000)", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "date": "DATE", "timestamp": "TIMESTAMP"}


def _nested(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.ArrayType | T.MapType)


def _list(columns: list[str], of: str = "") -> str:
    return ", ".join(f'{of}"{c}"' for c in columns)


@dataclass
class KeyedSink:
    """url: of the database; properties: user, password and driver; prefix: of the tables'
    names; types: SQL types instead of those in TYPES, such as TEXT for `string`; connections: most partitions that
    write or read at a time."""

    spark: SparkSession
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    prefix: str = "tally_"
    types: dict[str, str] = field(default_factory=dict)
    connections: int = 16

    def _connect(self):
        jvm = self.spark.sparkContext._jvm
        info = jvm.java.util.Properties()
        for k, v in self.properties.items():
            info.setProperty(k, v)
        if driver := self.properties.get("driver"):
            # The session's loader also sees drivers that came with --packages.
            return jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(driver).newInstance().connect(self.url, info)
        return jvm.java.sql.DriverManager.getConnection(self.url, info)

    def _run(self, statements: list[str]) -> None:
        """All of the statements in one transaction, or none."""
        connection = self._connect()
        try:
            connection.setAutoCommit(False)
            try:
                statement = connection.createStatement()
                for s in statements:
                    statement.executeUpdate(s)
                connection.commit()
            except Exception:
                connection.rollback()
                raise
        finally:
            connection.close()

    def _number(self, query: str) -> int | None:
        connection = self._connect()
        try:
            rows = connection.createStatement().executeQuery(query)
            rows.next()
            n = rows.getLong(1)
            return None if rows.wasNull() else n
        finally:
            connection.close()

    def create(self) -> None:
        """Make the tables, where the list of versions isn't there yet."""
        names = self._tables()
        if f"{self.prefix}versions".lower() in names:
            return
        made = []
        for name, target in TARGETS.items():
            columns = ", ".join(f'"{f.name}" {self._type(target, f)}{" NOT NULL" if f.name == target.key else ""}' for f in target.kind)
            made += [f'CREATE TABLE {self.prefix}{name}{part} ({columns}, PRIMARY KEY ("{target.key}"))' for part in ("", "_ready")]
        self._run([*made, f'CREATE TABLE {self.prefix}versions ("version" BIGINT NOT NULL PRIMARY KEY)'])

    def _type(self, target: Target, f: T.StructField) -> str:
        kind = "string" if _nested(f) else f.dataType.simpleString()
        return (TYPES | self.types)["key" if (f.name, kind) == (target.key, "string") else kind]

    def _staged(self, target: Target, f: T.StructField) -> Column:
        """A column as it is staged. Text that its type can't hold is an error here, since
        a cast would cut it in some databases."""
        c = F.to_json(f.name) if _nested(f) else F.col(f.name)
        room = re.fullmatch(r"VARCHAR\((\d+)\)", self._type(target, f).upper())
        if room:
            c = F.when(F.length(c) > int(room[1]), F.raise_error(F.lit(f"{f.name}: longer than {room[1]}"))).otherwise(c)
        return c.alias(f.name)

    def _tables(self) -> set[str]:
        connection = self._connect()
        try:
            rows, found = connection.getMetaData().getTables(None, None, None, None), set()
            while rows.next():
                found.add(rows.getString("TABLE_NAME").lower())
            return found
        finally:
            connection.close()

    def newest(self) -> int:
        """The newest version that the database holds, or -1."""
        found = self._number(f'SELECT MAX("version") FROM {self.prefix}versions')
        return -1 if found is None else found

    def _options(self, name: str) -> dict[str, str]:
        return {"url": self.url, "dbtable": f"{self.prefix}{name}", "numPartitions": str(self.connections), **self.properties}

    def apply(self, version: int, rows: dict[str, DataFrame]) -> bool:
        """Merge a version's rows (by the names in TARGETS; rows of one key must be equal)
        and note it; False, and nothing, where it or a later one is noted."""
        if self.newest() >= version:
            return False
        for name, df in rows.items():
            # Spark makes the staging table anew, in types of its dialect.
            staged = df.select([self._staged(TARGETS[name], f) for f in TARGETS[name].kind])
            staged.write.format("jdbc").options(**self._options(f"{name}_stage")).mode("overwrite").save()
        # The version comes first: its key stops a second writer.
        merge = [f"INSERT INTO {self.prefix}versions VALUES ({version})"]
        for name in rows:
            merge += self._merge(name, TARGETS[name])
        self._run(merge)
        return True

    def _merge(self, name: str, target: Target) -> list[str]:
        table, columns = f"{self.prefix}{name}", _list(target.columns)
        cast = ", ".join(f'CAST("{f.name}" AS {self._type(target, f)})' for f in target.kind)
        update = ", ".join(f'"{c}" = s."{c}"' for c in target.changes)
        known = f" WHEN MATCHED THEN UPDATE SET {update}" if update else ""
        return [
            f"DELETE FROM {table}_ready", f"INSERT INTO {table}_ready ({columns}) SELECT DISTINCT {cast} FROM {table}_stage",
            f'MERGE INTO {table} t USING {table}_ready s ON t."{target.key}" = s."{target.key}"{known} WHEN NOT MATCHED THEN INSERT ({columns}) VALUES ({_list(target.columns, "s.")})',
        ]

    def follow(self, store: Store) -> list[int]:
        """Apply the store's versions that the database lacks, in their order; those applied.
        Where changes were deleted meanwhile, the oldest snapshot stands for them."""
        done, bases, out = self.newest(), store.versions("base"), []
        # Changes up to the oldest snapshot are only deleted once there is a second one.
        steps = [(bases[0], "base")] if len(bases) > 1 and bases[0] > done else []
        after = steps[0][0] if steps else done
        steps += [(n, "v") for n in store.versions() if n > after]
        for version, kind in steps:
            rows = {name: store.part(name, version, kind) for name in PROJECTIONS}
            if self.apply(version, rows | {"events": store.events(done, version)}):
                out.append(version)
            done = version
        return out

    def reset(self) -> None:
        """Empty the projections; events and versions stay."""
        self._run([f"DELETE FROM {self.prefix}{name}" for name in PROJECTIONS])

    def read(self, name: str) -> DataFrame:
        """A table as the rest of the library knows it, read by ranges."""
        target, options = TARGETS[name], self._options(name)
        number = {"events": "seq", "legs": "ingest_seq"}.get(name)
        if number:
            lo, hi = (self._number(f'SELECT {f}("{number}") FROM {self.prefix}{name}') or 0 for f in ("MIN", "MAX"))
            rows = self.spark.read.format("jdbc").options(**options, partitionColumn=f'"{number}"', lowerBound=str(lo), upperBound=str(hi + 1)).load()
        else:
            # Ids end in hexadecimal digits, so their first ones cut them evenly; the ranges
            # hold whatever else there is.
            prefix = {"matches": "m_", "breaks": "brk_"}[name]
            cuts = [f"{prefix}{d}" for d in "123456789abcdef"]
            ranges = [f"\"id\" < '{cuts[0]}'", *(f"\"id\" >= '{a}' AND \"id\" < '{b}'" for a, b in zip(cuts, cuts[1:], strict=False)), f"\"id\" >= '{cuts[-1]}'"]
            rows = self.spark.read.jdbc(options["url"], options["dbtable"], predicates=ranges, properties=self.properties)
        parsed = [(F.from_json(f.name, f.dataType) if _nested(f) else F.col(f.name).cast(f.dataType)).alias(f.name) for f in target.kind]
        return rows.select(parsed)

    def state(self) -> State:
        return State(*(self.read(name) for name in (*PROJECTIONS, "events")))
