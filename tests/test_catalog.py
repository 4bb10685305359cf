"""Every catalogue query against its DuckDB oracle."""

import os

import duckdb
import pytest

from strataloom import catalog
from strataloom.operators import corpus
from strataloom.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    rel = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(repr, rel.fetchall()))
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    assert len(got) == len(want) and got == want, [x for x in zip(got, want) if x[0] != x[1]][:6]


def test_upsert_and_scan(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, corpus.upsert(a, b, "k").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    (tmp_path / "src").mkdir(), (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("print(1)"), (tmp_path / "node_modules/b.js").write_text("x")
    assert [(r.file_path, r.language, r.content) for r in files.scan(spark, str(tmp_path)).collect()] == [("src/a.py", "python", "print(1)")]
