"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_strataloom_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="code-")) / "strataloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"strataloom/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._strataloom_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; every operator takes the path as a parameter, this is only its default."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession, path: str):
    """Broadcast a vocabulary file (1 to 2 MB whatever the corpus size), so executors need no local copy."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, which a single machine alone may use."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_strataloom_shared", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = sc._strataloom_shared = tempfile.mkdtemp(prefix="checkpoints-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Spark gives a checkpoint the estimated size of the plan it cuts. In a loop of joins that estimate is squared in each round,
    a number of millions of digits before long, which the driver multiplies; so the rows get a plan without it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint()
    rows = out._jdf.queryExecution().analyzed().rdd()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), spark)
    # The shuffles behind the cut are of no more use; Spark removes them once the driver has dropped what refers to them.
    del df
    gc.collect()
    sc._jvm.System.gc()
    return out


class GenerationCache(dict):
    """Bounded memo of fn: when the young generation is full it becomes the old one, and what is used again moves back.

    Keys longer than ``longest`` are computed each time, so memory is bounded by 2 * limit short keys.
    """

    def __init__(self, fn, limit: int = 200_000, longest: int = 48):
        super().__init__()
        self.fn, self.limit, self.longest, self.old = fn, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 512


def sliced(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def per_row(df: DataFrame, keep: list[str], inputs: list[Column | str], ddl: str, make: Callable) -> DataFrame:
    """The columns ``keep`` and those of ``ddl`` for every row, in one pass.

    make() runs once in a task and gives a function of the inputs' lists of a batch that gives a list for each column of ddl.
    What is kept goes through as Arrow columns, so ids of any type, nulls among them, come out as they went in.
    """
    made = StructType.fromDDL(ddl)
    types = list(to_arrow_schema(made).types)
    schema = StructType([StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keep)] + [StructField(f"x{i}", f.dataType) for i, f in enumerate(made)])
    n, names = len(keep), schema.names

    def run(batches):
        of = make()
        for batch in sliced(batches):
            columns = batch.columns
            found = of(*(c.to_pylist() for c in columns[n:]))
            yield pa.RecordBatch.from_arrays([*columns[:n], *(pa.array(x, t) for x, t in zip(found, types, strict=True))], names=names)

    one = df.select(*(df[k].alias(f"k{i}") for i, k in enumerate(keep)), *((F.col(x) if isinstance(x, str) else x).alias(f"x{i}") for i, x in enumerate(inputs)))
    return one.mapInArrow(run, schema).toDF(*keep, *made.names)


def filter_rows(df: DataFrame, inputs: list[str], make: Callable) -> DataFrame:
    """The rows of df for which make()(lists of the inputs) gives true: each row is judged by itself and passes whole, so nothing is shuffled."""
    at = [df.columns.index(x) for x in inputs]

    def run(batches):
        of = make()
        for batch in sliced(batches):
            yield batch.filter(pa.array(of(*(batch.column(i).to_pylist() for i in at)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def train_in_a_task(sample: DataFrame, learn: Callable) -> bytes:
    """learn(list of rows as dicts) -> bytes, run in one task of an executor: ``sample`` is bounded by its maker, and the driver holds the result's bytes only."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([learn([r for b in batches for r in b.to_pylist()])], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").head()
    return bytes(made.model) if made else learn([])  # an empty sample may have no task


def by_hash(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """(group, key) of the ``most`` distinct keys of each group that come first by hash.

    Groups are few (languages, labels). A first pass estimates their numbers of keys; only keys whose hash is low enough for
    about twice ``most`` go on, so no task gets a large group, however large it is.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(group).agg(F.approx_count_distinct(key, 0.02)).collect()}
    low = F.lit(False)
    for name, n in sizes.items():
        part = min(1.0, 2 * (most + 50) / max(1, n))
        low = low | (F.col(group) == name) & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(part * (1 << 30)))
    drawn = rows.filter(low).select(group, key).distinct()
    order = Window.partitionBy(group).orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key)
    return drawn.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select(group, key)


#: What a Python worker keeps between tasks, of one family only: workers live through the stages of many operators, and their memory is bounded.
_OWN: dict = {}


def once(family: str, key, make):
    if _OWN.get("family") != family:
        _OWN.clear()
        _OWN["family"] = family
    if key not in _OWN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _OWN[key] = make()
    return _OWN[key]
