"""The registered queries: every SQL has a query, names match, nothing forbidden in the plans."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "primary_domain", "n", "uncategorized"] and df.count() > 0


def normal(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = db.execute(entry.oracle_sql()[name])
    heads = [d[0] for d in result.description]
    want = result.fetchall()
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(heads)
    assert normal(df.select(*heads).collect()) == normal(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
