"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from tallyforge.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_sequence_expand_where_digits_grow(spark, tmp_path):
    """Pairs from 999 to 1000, 9999 to 10000 and 99999 to 100000."""
    keys = [(k, s) for n in (1_000, 10_000, 100_000) for k in range(n - 5, n + 2) for s in (1, 4)]
    spark.createDataFrame(keys, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.QUERIES["sequence_expand"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = c.execute(catalogue.SQL["sequence_expand"]).fetchall()
    assert ("shot_9999.png" in {r[1] for r in want}) and rows(got.columns, got.collect()) == rows(["p_partkey", "name"], want)


def test_rows_only_queries(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.SQL)):
        assert catalogue.QUERIES[name](spark, SF).count() > 0
