"""Where queries and the SQL they are held against are registered."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: operators that run in Python workers need it there."""
    sc = spark.sparkContext
    if getattr(sc, "_strataloom_sent", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="code-")) / "strataloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"strataloom/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._strataloom_sent = True


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_code(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def query(sql: str):
    def take(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
        SQL[f.__name__] = sql
        return f

    return take


def _cell(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int):
        return f"CAST({x} AS BIGINT)"
    if isinstance(x, float):
        return f"CAST({x} AS DOUBLE)"
    if isinstance(x, list):
        return "[" + ", ".join(map(_cell, x)) + "]"
    parts = ["'" + part.replace("'", "''") + "'" for part in x.split("\n")]
    return " || chr(10) || ".join(parts)


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_cell, r)) + ')' for r in rows)}) AS v({columns})"


def expected(columns: str, rows: list[tuple]):
    """A query over a fixture whose rows were worked out by hand."""
    return query(values(columns, rows))
