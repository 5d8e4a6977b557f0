"""Cases that went wrong once: repeated rows, labels of absent documents, clashing columns."""

import random
import time

import pytest

pytest.importorskip("tallyloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from tallyloom.llm import neardup, packing, pii, quality, sharding, substring  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(r, n, vocab=3000):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def test_copies_of_one_row_are_linear(spark):
    r = random.Random(1)
    body = words(r, 300)
    alone = words(r, 300)
    rows = [(7, body, "en", "s", 1)] * 3000 + [(None, body, "en", "s", 1)] * 500 + [(8, alone, "en", "s", 1)]
    began = time.time()
    got = substring.digest(spark.createDataFrame(rows, DOCS).repartition(4)).groupBy("doc_id").agg(F.min("n_removed").alias("a"), F.max("n_removed").alias("b"), F.count("*").alias("n")).collect()
    n = len(body.encode())
    assert {(x["doc_id"], x["a"], x["b"], x["n"]) for x in got} == {(7, n, n, 3000), (None, n, n, 500), (8, 0, 0, 1)}
    assert time.time() - began < 240


def test_labels_of_absent_documents_take_no_places(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 50)
    r = random.Random(2)
    docs = spark.createDataFrame([(i, words(r, 60, 200), "en", "s", 1) for i in range(120)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(10_000 + i, i % 2) for i in range(4000)], "doc_id bigint, quality int")
    chosen = quality._sample(docs, labels, "doc_id", "text", "quality").groupBy("_label").count().collect()
    assert {x["_label"]: x["count"] for x in chosen} == {0: 50, 1: 50}


def test_shapes_mark_nothing_that_fixed_patterns_refuse():
    good, bad = "4539578763621486", "4539578763621487"
    text = f"nr {good} and {bad} at 300.1.2.3 or 10.1.2.3 for ab12"
    found = {v: (k, p) for _, k, _, v, p in pii.fillers(text, pii.base_spans(text))}
    shape = pii._hash("shape", pii._shape(good))
    assert found[good][0] == 2 and shape in found[good][1]
    assert found[bad][0] == 4 and shape not in found[bad][1] and found[bad][1]
    assert pii._hash("shape", pii._shape("300.1.2.3")) not in found["300.1.2.3"][1]
    assert pii._hash("shape", pii._shape("ab12")) in found["ab12"][1]


def test_clashing_columns(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, words(r, 40), "en", "s", 1) for i in range(12)] + [(12, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    odd = docs.selectExpr("*", "7 AS _pii_a", "8 AS _pii_b", "'x' AS _pii_own", "9 AS _shard_row")
    table = spark.createDataFrame([(1,), (2,)], "pattern bigint")
    for patterns in (pii.Patterns(table, 2), pii.Patterns(table, pii.MOST + 1)):
        back = pii.redact(odd, patterns)
        assert back.columns == odd.columns and sorted(map(str, back.collect())) == sorted(map(str, odd.collect()))
        assert pii.find(odd.withColumnRenamed("doc_id", "_k").withColumnRenamed("_pii_a", "doc_id"), patterns, "_k").count() == 13
    path = str(tmp_path / "shards")
    sharding.write_shards(odd, path, 3)
    assert {x["_shard_row"] for x in spark.read.parquet(path).collect()} == {9}
    keyed = docs.withColumnRenamed("doc_id", "_k")
    assert {(x["_k"], x["class_id"]) for x in neardup.classes(keyed, "_k").collect()} == {(i, i) for i in range(13)}
    assert neardup.one_of_each(keyed, "_k").count() == 13


def test_groups_are_fixed_before_packing(spark):
    """The group of a row is read, not drawn again: an input in another order each time gives
    every row once."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit(None).cast("string").alias("source")).orderBy(F.rand())
    got = packing.pack(docs, capacity=64, group_rows=50)
    assert sorted(x["doc_id"] for x in got.collect()) == list(range(500))


def test_passages_shorter_than_the_window_are_told(spark):
    r = random.Random(9)
    base = " ".join(r.choice("abcdefg") * r.randrange(1, 4) for _ in range(400)).split(" ")
    rows = [(i, " ".join([words(r, r.randrange(40)), *base[a : a + n], words(r, r.randrange(40))]).strip()) for i in range(40) for a, n in [(r.randrange(330), r.choice([20, 49, 50, 51, 52, 70]))]]
    alone, twice, lines = words(r, 80), words(r, 60), words(r, 51)
    # One document's own repeat, equal rows, copies, other white space, one word less, few words.
    rows += [(50, f"{alone} . {alone}"), (51, twice), (51, twice), (52, words(r, 60)), (53, "to " * 90), (54, "it " * 3 + "to " * 51), (55, None), (None, "")]
    rows += [(60, lines), (61, "x\n" + lines.replace(" ", "\n\t") + " y"), (62, "z " + lines.rpartition(" ")[0])]
    rows += [(63, rows[43][1]), (64, "short")]
    seen = {}
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - 50):
            seen.setdefault(tuple(w[p : p + 51]), set()).add((i, t))
    want = sorted((i or 0, any(len(seen[tuple((t or "").split()[p : p + 51])]) > 1 for p in range(len((t or "").split()) - 50))) for i, t in rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = substring.digest(docs).collect()
    assert sorted((x["doc_id"] or 0, x["shares_passage"]) for x in got) == want
    one = {x["doc_id"]: x for x in got}
    assert [one[i]["shares_passage"] for i in (50, 51, 60, 61, 62)] == [False, False, True, True, False]
    assert one[60]["n_removed"] == one[61]["n_removed"] == 0 and one[50]["n_removed"] > 0
    assert 5 < sum(shared for _, shared in want) < len(want) - 5
    assert substring.digest(docs.limit(0)).count() == 0
