"""Every catalogue query against its SQL in DuckDB."""

import decimal

import duckdb
import pytest

from strataq import catalog, catalog_archives  # noqa: F401  the second adds to the first

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(int(v)) if v == int(v) else repr(round(float(v), 6))
    return repr(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def same_on(spark, name, tmp_path, **tables):
    """Whether a query and its SQL agree on tables of the caller's own."""
    own = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        own.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df, want = catalog.QUERIES[name](spark, str(tmp_path)), own.sql(catalog.SQL[name])
    return rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_block_grep_keeps_empty_and_null_texts_and_rows_of_one_id(spark, tmp_path):
    texts = [(1, ""), (2, None), (3, "a License, License"), (3, "License"), (4, "none"), (None, "License")]
    assert same_on(spark, "block_grep", tmp_path, documents=spark.createDataFrame(texts, "doc_id long, text string"))
