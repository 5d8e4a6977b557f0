"""Line deduplication between documents, in DataFrame operations only.

Every line has a key: the line without ASCII white space at its ends, A-Z in lower case.
Keys of at least MIN_KEY code points that are found in two or more documents lose all
their lines except those in the smallest document id. What travels is 128 bits of hash a
line, never its text:

1. The lines' hashes with document and position are written once to the shared folder.
2. The hashes are range-partitioned and sorted by (hash, document, position); a window
   streams over them, so each line sees the first document of its hash. Hashes with a
   large share of all lines (at most HOT_KEYS of them, found by a sketch over all lines)
   would overload one range: their first documents come from a partially aggregated
   minimum, which is joined back by broadcast, at most HOT_KEYS rows.
3. The lines to drop become sparse bitmaps, one a document (map of word number to 63
   bits), and only these meet the texts again.

The sketch only decides on which way a line goes; both ways give the same answer.

Rows with a null id are left as they are and count as no document. A null text counts as
one empty line and stays null. Rows that repeat an id and its text are one document; rows
that share an id but not the text are one document as well, for the rule above, and each
is cut by its own lines. Columns of docs pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize

MIN_KEY = 10
#: Sketched keys at most, and the share of all lines that makes a key hot.
HOT_KEYS = 1000
HOT_SHARE = 1 / 5000
_WORD = 63
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """The lines to drop: _k (id), _h (hash of the text), _pos (from 0)."""
    split = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_k"), F.xxhash64(F.col(text)).alias("_h"), F.posexplode(_lines(F.col(text))).alias("_pos", "_line")
    )
    keyed = split.select("_k", "_h", "_pos", line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= min_key)
    lines = materialize(
        keyed.select("_k", "_h", "_pos", F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit(1), "_key").alias("_b")), "lines"
    )
    # Only the sketch's own size reaches the driver.
    sketch = lines.agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(_a, {HOT_KEYS}, {HOT_KEYS * 10})").alias("top")
    ).first()
    hot = [x["item"] for x in (sketch["top"] or []) if x["count"] >= max(HOT_SHARE * sketch["n"], 100)]
    first = Window.partitionBy("_a", "_b").orderBy("_k", "_pos")
    rest = lines.where(~F.col("_a").isin(hot)) if hot else lines
    found = (
        rest.repartitionByRange("_a", "_b").withColumn("_first", F.first("_k").over(first))
        .where(F.col("_k") != F.col("_first")).select("_k", "_h", "_pos")
    )
    if hot:
        popular = lines.where(F.col("_a").isin(hot))
        origin = popular.groupBy("_a", "_b").agg(F.min("_k").alias("_first"))
        found = found.unionByName(
            popular.join(F.broadcast(origin), ["_a", "_b"]).where(F.col("_k") != F.col("_first")).select("_k", "_h", "_pos")
        )
    return found


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """One row a document that loses lines: _k, _h, _drop (map of word to 63 bits)."""
    bits = dropped.groupBy("_k", "_h", F.expr(f"_pos div {_WORD}").cast("int").alias("_w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, _pos % {_WORD})")).alias("_bits")
    )
    return bits.groupBy("_k", "_h").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_drop"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """_row (the row of docs, its text cut), _n_lines (before) and _n_dropped."""
    bitmaps = keep_bitmaps(repeated_lines(docs, key, text, min_key))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_k"), F.xxhash64(F.col(text)).alias("_h"))
    held = base.join(bitmaps, ["_k", "_h"], "left")
    body = F.col("_row")[text]

    def stays(_: Column, i: Column) -> Column:
        word = F.try_element_at(F.col("_drop"), F.floor(i / F.lit(_WORD)).cast("int"))
        return F.coalesce(F.getbit(word, (i % F.lit(_WORD)).cast("int")), F.lit(0)) == 0

    cut = F.when(F.col("_drop").isNull(), body).otherwise(F.array_join(F.filter(_lines(body), stays), "\n"))
    dropped = F.when(F.col("_drop").isNull(), F.lit(0).cast("long")).otherwise(
        F.aggregate(F.map_values("_drop"), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    )
    n_lines = F.coalesce(F.char_length(body) - F.char_length(F.replace(body, F.lit("\n"))), F.lit(0)) + 1
    columns = [cut.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns]
    return held.select(F.struct(*columns).alias("_row"), n_lines.cast("long").alias("_n_lines"), dropped.alias("_n_dropped"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with their texts cut; the columns as they were."""
    return dedup_lines(docs, key, text).select("_row.*")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines, n_dropped and the SHA-256 of what is kept."""
    kept = F.coalesce(F.col("_row")[text], F.lit(""))
    return dedup_lines(docs, key, text).select(
        F.col("_row")[key].alias(key), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"),
    )
