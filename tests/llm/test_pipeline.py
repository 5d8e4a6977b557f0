import pytest

pytest.importorskip("tallyloom.llm")
import corpus_pipeline  # noqa: E402

from tallyloom.llm import linededup, neardup, packing, pii, quality  # noqa: E402
from tallyloom.session import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_and_effects(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "personal_data", "best_fit_packing"]
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [docs]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{n}"
        stage(spark, seen[-1], SF).write.parquet(path)
        seen.append(spark.read.parquet(path))
    good, lines, single, clean, bins = seen[1:]
    assert all(x.columns == columns for x in (good, lines, single, clean))
    model = quality.fit(docs, table(spark, SF, "labels"))
    keep = {r["doc_id"] for r in quality.score(docs, model).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == keep and 0 < len(keep) < docs.count()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    marked = [labels[i] for i in keep if i in labels]
    assert sum(marked) >= 0.95 * len(marked)
    assert {r["doc_id"] for r in lines.collect()} == keep and linededup.repeated_lines(lines).count() == 0
    classes = neardup.classes(lines).collect()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["class_id"] for r in classes})
    assert clean.count() == single.count() and not any(pii.base_spans(r["text"]) for r in clean.collect())
    assert bins.select("doc_id").distinct().count() == clean.count()
    assert bins.groupBy("bin_group", "bin").sum("n_units").agg({"sum(n_units)": "max"}).first()[0] <= packing.CAPACITY
    assert corpus_pipeline.run(spark, SF).count() == bins.count()


def test_odd_tables_pass_through(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, a null id, clashing columns, no rows."""
    full = table(spark, SF, "documents")
    first = full.where("text IS NOT NULL").orderBy("doc_id").limit(60)
    blank = spark.createDataFrame([(None, None, None, None, None), (9001, None, None, None, None), (9002, "", "en", None, 0), (9003, "\n\n", "en", "a", None)], full.schema)
    nameless = first.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", *[c for c in full.columns if c != "doc_id"]).select(full.columns)
    odd = first.unionByName(first.limit(5)).unionByName(blank).unionByName(nameless).selectExpr("*", "1 AS _k", "'x' AS node", "2 AS label", "3 AS _t")
    for name, docs, labels in (("odd", odd, table(spark, SF, "labels")), ("empty", odd.limit(0), table(spark, SF, "labels")), ("unlabelled", odd, table(spark, SF, "labels").limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        labels.coalesce(1).write.parquet(f"{folder}/labels.parquet")
        now = table(spark, folder, "documents")
        for n, (stage, run) in enumerate(corpus_pipeline.STAGES[:-1]):
            run(spark, now, folder).write.parquet(f"{folder}/{n}")
            now = spark.read.parquet(f"{folder}/{n}")
            assert now.columns == docs.columns, stage
        bins = corpus_pipeline.run(spark, folder)
        assert bins.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
        assert (now.count() > 20) == (name != "empty")
