"""Entities of reconciliation as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def struct(ddl: str) -> T.StructType:
    """A schema from its text; unlike StructType.fromDDL it needs no session, so workers
    can import this module."""
    fields, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = ddl[start:i].split()
            fields.append(T.StructField(name, _KINDS[kind]))
            start = i + 1
    return T.StructType(fields)


LEG_FIELDS = (
    "source string, txn_ref string, amount_minor bigint, currency string, value_date date, direction string, "
    "counterparty string, attrs map<string,string>, ingested_at timestamp"
)
LEG = struct(f"id string, {LEG_FIELDS}, ingest_seq bigint, status string, match_id string, break_id string")
MATCH = struct("id string, leg_ids array<string>, tier int, rule_id string, confidence double, residual_minor bigint, currency string, matched_at timestamp")
BREAK = struct(
    "id string, leg_ids array<string>, currency string, counterparty string, category string, confidence double, classifier_id string, "
    "trigger string, status string, opened_at timestamp, resolved_at timestamp, reason string, actor string"
)
EVENT = struct("seq bigint, type string, at timestamp, aggregate_id string, payload string")
OUTCOME = struct("ingest_seq bigint, leg_id string, outcome string, rule_id string, match_id string, break_id string")

# Names of rules, triggers and outcomes, as results carry them.
T1_EXACT = "T1.exact@v1"
T2_REF = "T2.ref-tolerant@v1"
T2_AMOUNT_DATE = "T2.amount-date@v1"
T2_LATE = "T2.late-arrival@v1"
T3_SUBSET = "T3.subset-sum@v1"
CLASSIFIER = "heuristic@v1"
DUPLICATE, REF_CONFLICT, WINDOW_EXPIRED = "duplicate", "ref_conflict", "window_expired"
