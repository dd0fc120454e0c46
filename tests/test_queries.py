"""Every query with a DuckDB equivalent gives its rows, at the smallest scale."""

import datetime

import duckdb
import pytest

from foliolens.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat()[:19] if isinstance(value, datetime.datetime) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert df.columns and rows
        return
    expected = duck.sql(catalog.ORACLES[name])
    assert sorted(expected.columns) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(expected.columns, expected.fetchall())


def test_paragraphs_of_odd_documents(spark, duck, tmp_path):
    """Blank and missing texts have no paragraphs, rows of one id are one text, a lone carriage return is no line's end."""
    made = [
        (1, "a\r\n\r\nb < c\n d ", "s"), (2, " \n\n ", "s"), (3, "", "s"), (4, None, "s"), (6, "x", None), (7, "a\r\rb\n\t\nc", "s"), (8, "", "s"), (9, " ", " "),
        (11, "p\n\nq", "s"), (11, "p\n\nq", "s"), (12, "one\n \n\ntwo", "s"), (12, "one\n \n\ntwo", "s"), (13, None, "s"), (13, "z", "s"), (14, "\n\nlate", "s"), (14, "early", "s"), (16, "z\n\ny", "s"), (16, "b\n\na", "s"), (None, "u", "s"),
    ]
    for n, rows in (("odd", made), ("single", made[:8])):
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / n / "documents.parquet"))
        duck.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/{n}/documents.parquet/*.parquet'")
        expected = duck.sql(catalog.ORACLES["text_paragraphs"]).fetchall()
        duck.sql("DROP VIEW temp.documents")
        df = catalog.QUERIES["text_paragraphs"](spark, str(tmp_path / n))
        assert sorted(map(tuple, df.select("doc_id", "digest").collect()), key=str) == sorted(expected, key=str)
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
