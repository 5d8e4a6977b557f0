"""Validation, normalisation and identity of incoming legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import blank, leg_id, stripped
from tallyloom.session import materialize

#: Columns that callers may leave out, with their types.
OPTIONAL = {"attrs": "map<string,string>", "ingested_at": "timestamp"}


def parse_date(text: Column) -> Column:
    """Strict yyyy-MM-dd; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def problems() -> Column:
    """Every reason why a normalised leg isn't valid, in a fixed order."""
    # The texts, as dead letters carry them.
    checks = [
        (blank(F.col("source")), "source is required"),
        (blank(F.col("txn_ref")), "txn_ref is required"),
        (~F.coalesce(F.col("amount_minor") > 0, F.lit(False)), "amount_minor must be > 0"),
        (~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)), "currency must be a 3-letter ISO 4217 code"),
        (F.col("value_date").isNull(), "value_date is required"),
        (~F.coalesce(F.col("direction").isin("debit", "credit"), F.lit(False)), "direction must be debit or credit"),
        (blank(F.col("counterparty")), "counterparty is required"),
    ]
    # No array_compact: its filter would make Spark interpret all checks, row by row.
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(bad, F.array(F.lit(text))).otherwise(none) for bad, text in checks])


def normalize(legs: DataFrame, now: Column | None = None) -> DataFrame:
    """Legs with currency, direction and date in their normal form, an id, and `problems`.
    ingested_at defaults to `now`; columns beyond the schema pass through."""
    for name, kind in OPTIONAL.items():
        if name not in legs.columns:
            legs = legs.withColumn(name, F.lit(None).cast(kind))
    date = F.col("value_date") if dict(legs.dtypes)["value_date"] == "date" else parse_date(F.col("value_date").cast("string"))
    out = legs.withColumns(
        {
            "currency": F.upper(stripped(F.col("currency"))), "direction": F.lower("direction"), "value_date": date,
            "attrs": F.coalesce("attrs", F.create_map().cast("map<string,string>")),
        }
    )
    if now is not None:
        out = out.withColumn("ingested_at", F.coalesce("ingested_at", now.cast("timestamp")))
    return out.withColumns({"id": leg_id({c: F.col(c) for c in out.columns}), "problems": problems()})


def valid(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.size("problems") == 0).drop("problems")


def rejected(normalized: DataFrame) -> DataFrame:
    """Dead letters, with a readable reason."""
    return normalized.where(F.size("problems") > 0).withColumn("problems", F.array_join("problems", "; "))


def require_valid(normalized: DataFrame) -> DataFrame:
    """All or nothing: raises on the first invalid leg by arrival."""
    bad = rejected(normalized).orderBy("ingest_seq").limit(1).collect()
    if bad:
        r = bad[0]
        raise ValueError(f"leg[{r['ingest_seq']}] {r['source']}/{r['txn_ref']}: invalid leg: {r['problems']}")
    return valid(normalized)


def once_each(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first delivery of every id, all later ones)."""
    # Of ids that come once nothing moves but their hash; equal hashes are looked at again by id.
    like = F.xxhash64("id").alias("_h")
    again = materialize(legs.groupBy(like).agg(F.count("*").alias("_n")).where("_n > 1").select("_h"), "again")
    if again.isEmpty():
        return legs.where("id IS NOT NULL AND ingest_seq IS NOT NULL"), legs.where(F.lit(False))
    some = legs.select("id", "ingest_seq", like).join(again, "_h", "left_semi")
    each = some.groupBy("id").agg(F.min("ingest_seq").alias("_first"), F.max("ingest_seq").alias("_last"))
    twice = materialize(each.where("_first < _last").select("id", "_first"), "twice")
    first = legs.where("id IS NOT NULL AND ingest_seq IS NOT NULL").join(twice, "id", "left").where("_first IS NULL OR ingest_seq = _first")
    return first.drop("_first"), legs.join(twice, "id").where("ingest_seq > _first").drop("_first")
