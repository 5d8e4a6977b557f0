import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rule_id" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    out = con.execute(entry.oracle_sql()[name])
    found = [d[0] for d in out.description]
    assert sorted(found) == cols
    place = [found.index(c) for c in cols]
    tidy = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    want = sorted((tidy(r[i] for i in place) for r in out.fetchall()), key=repr)
    got = sorted((tidy(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == want
