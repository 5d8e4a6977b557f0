"""Where legs come from: JSON batches, files, Kafka records, and feeds derived from the
orders tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.operators.normalize import normalize, parse_date
from tallyloom.session import spread, table

_RAW = S.LEG_FIELDS.replace("value_date date", "value_date string")


def from_json_batches(bodies: DataFrame, body: str = "body", most: int = 5000) -> DataFrame:
    """Legs of JSON documents, either {"legs": [...]} or a bare array, with the document's
    columns and `position`. Documents that are neither, are empty or hold more than `most`
    legs yield one row with `refused` set."""
    text = F.trim(F.col(body))
    legs = F.when(text.startswith("["), F.from_json(text, f"array<struct<{_fields(_RAW)}>>")).otherwise(F.from_json(text, f"struct<legs:array<struct<{_fields(_RAW)}>>>")["legs"])
    n = F.coalesce(F.size(legs), F.lit(-1))
    refused = F.when(n <= 0, "no legs").when(n > most, f"more than {most} legs")
    kept = [c for c in bodies.columns if c != body]
    rows = bodies.select(*kept, refused.alias("refused"), F.posexplode_outer(F.when(refused.isNull(), legs)).alias("position", "leg"))
    return rows.select(*kept, "refused", "position", "leg.*")


def _fields(ddl: str) -> str:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:i].strip().replace(" ", ":", 1))
            start = i + 1
    return ",".join(out)


def read_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One leg a line of JSON; a stream of new files if asked for."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(f"{_RAW}, ingest_seq bigint").json(path)


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 1000) -> DataFrame:
    """Records of the topics from the earliest on; the query's checkpoint holds the offsets."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    )


def topic_source(topic: Column) -> Column:
    return F.substring_index(topic, ".", 1)


def decode_records(records: DataFrame) -> DataFrame:
    """Legs of Kafka records (topic, partition, offset, key, value, timestamp), normalised;
    those with `problems` are dead letters. Missing source, reference and time come from
    the record."""
    value, key = F.col("value").cast("string"), F.col("key").cast("string")
    read = F.from_json(value, f"{_RAW}, _unread string", {"columnNameOfCorruptRecord": "_unread"})
    # A row a record; a filter on what follows can't move below it and parse the text again.
    parsed = records.select("topic", "partition", "offset", "timestamp", key.alias("_key"), F.explode(F.array(read)).alias("x"))
    rows = parsed.select(
        "topic", "partition", "offset",
        F.coalesce(F.when(F.col("x.source") != "", F.col("x.source")), topic_source(F.col("topic"))).alias("source"),
        F.coalesce(F.when(F.col("x.txn_ref") != "", F.col("x.txn_ref")), F.col("_key")).alias("txn_ref"),
        F.col("x.amount_minor").alias("amount_minor"), F.col("x.currency").alias("currency"), parse_date(F.col("x.value_date")).alias("value_date"),
        F.col("x.direction").alias("direction"), F.col("x.counterparty").alias("counterparty"), F.col("x.attrs").alias("attrs"),
        F.coalesce(F.col("x.ingested_at"), F.col("timestamp")).alias("ingested_at"), (F.col("x._unread").isNotNull() | F.col("x").isNull()).alias("_bad"),
    )
    out = normalize(rows)
    return out.withColumn("problems", F.when(F.col("_bad"), F.array(F.lit("not JSON"))).otherwise(F.col("problems"))).drop("_bad")


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger leg for each order and, for 19 in 20, a rail leg that agrees with it exactly,
    within tolerance, but for a fee, a late date or a currency; by order key."""
    k, b = F.col("o_orderkey"), F.col("o_orderkey") % 20
    amount = F.round(F.col("o_totalprice") * 100).cast("long")
    base = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")).select(
        k.alias("k"), b.alias("b"), F.concat(F.lit("ORD-"), k).alias("txn_ref"), amount.alias("amt"),
        F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("GBP")), (F.col("o_custkey") % 3).cast("int") + 1).alias("ccy"),
        F.concat(F.lit("CP-"), F.col("o_custkey") % 8).alias("counterparty"), F.col("o_orderdate").cast("date").alias("d"),
    )
    amt, none = F.col("amt"), F.create_map().cast("map<string,string>")
    ledger = F.struct(
        (2 * F.col("k")).alias("ingest_seq"), F.lit("ledger").alias("source"), amt.alias("amount_minor"), F.col("ccy").alias("currency"),
        F.col("d").alias("value_date"), F.lit("debit").alias("direction"), none.alias("attrs"),
    )
    moved = F.when(F.col("b") == 13, amt + 1).when(F.col("b") == 14, amt - 2).when(F.col("b").isin(15, 16), amt - F.expr("(amt * 25) div 1000")).otherwise(amt)
    rail = F.struct(
        (2 * F.col("k") + 1).alias("ingest_seq"), F.lit("rail").alias("source"), moved.alias("amount_minor"), F.when(F.col("b") == 18, "JPY").otherwise(F.col("ccy")).alias("currency"),
        F.date_add("d", F.when(F.col("b") == 17, 6).otherwise(1)).alias("value_date"), F.lit("credit").alias("direction"),
        F.when(F.col("b") == 15, F.create_map(F.lit("interchange_minor"), F.lit("25"))).otherwise(none).alias("attrs"),
    )
    # No array_compact: its filter would make Spark interpret all of both legs, row by row.
    legs = F.when(F.col("b") < 19, F.array(ledger, rail)).otherwise(F.array(ledger))
    return base.select("k", "b", "txn_ref", "counterparty", F.explode(legs).alias("leg")).select("k", "b", "txn_ref", "counterparty", "leg.*")


def lineitem_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger leg for each line of an order with the order's batch reference, and a rail
    leg that settles their sum."""
    from pyspark.sql import Window

    key = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("GBP")), (F.col("o_custkey") % 3).cast("int") + 1).alias("currency"),
        F.concat(F.lit("CP-"), F.col("o_custkey") % 8).alias("counterparty"), F.col("o_orderdate").cast("date").alias("value_date"),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(key).alias("rn"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_minor"))
    # The settlement comes with the first line, so that lines are dealt out and read once.
    whole = Window.partitionBy("l_orderkey", "currency", "counterparty", "value_date")
    rows = rows.join(orders, "l_orderkey").withColumns({"total": F.sum("amount_minor").over(whole), "nth": F.row_number().over(whole.orderBy("rn"))})
    k, batch = F.col("l_orderkey"), F.concat(F.lit("B-"), F.col("l_orderkey"))
    ledger = F.struct(
        (k * 1000 + F.col("rn")).alias("ingest_seq"), F.lit("ledger").alias("source"), F.concat(F.lit("L-"), k, F.lit("-"), F.col("rn")).alias("txn_ref"), F.col("amount_minor"),
        F.lit("debit").alias("direction"), F.create_map(F.lit("batch_ref"), batch).alias("attrs"),
    )
    rail = F.struct(
        (k * 1000 + 999).alias("ingest_seq"), F.lit("rail").alias("source"), batch.alias("txn_ref"), F.col("total").alias("amount_minor"),
        F.lit("credit").alias("direction"), F.create_map().cast("map<string,string>").alias("attrs"),
    )
    legs = F.explode(F.when(F.col("nth") == 1, F.array(ledger, rail)).otherwise(F.array(ledger)))
    return rows.select("currency", "value_date", "counterparty", legs.alias("leg")).select(
        "leg.ingest_seq", "leg.source", "leg.txn_ref", "leg.amount_minor", "currency", "value_date", "leg.direction", "counterparty", "leg.attrs"
    )
