"""Stores of chunks as Parquet tables: contents, metadata and vectors, written and read by key; and the incremental flow over them.

A write joins what is there with what comes and writes a new version beside it; the version's name is then put into the
table's pointer file, so readers see one version or the other. The one before is kept for readers that have begun.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus

CHUNKS = "chunk_id string, content string, file_path string, language string, size_bytes long"
METADATA = "chunk_id string, file_path string, repository string, json_data string"
VECTORS = "chunk_id string, embedding array<float>"


class Table:
    """A keyed table under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "chunk_id"):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self) -> str | None:
        path, fs = self._path("CURRENT")
        return self.spark.read.text(f"{self.folder}/CURRENT").head()[0] if fs.exists(path) else None

    def read(self) -> DataFrame:
        version = self._version()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{version}") if version else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        df.select(*self.read().columns).write.option("compression", "zstd").parquet(f"{self.folder}/{version}")
        path, fs = self._path("CURRENT")
        new, _ = self._path(f".{version}")
        out = fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        if fs.exists(path):
            fs.delete(path, False)
        fs.rename(new, path)

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of their keys; of a key given twice one row stays. Returns how many came."""
        rows = rows.dropDuplicates([self.key])
        n = rows.count()
        self.write(corpus.upsert(self.read(), rows.select(*self.read().columns), self.key))
        return n

    def get(self, key: str) -> DataFrame:
        return self.read().filter(F.col(self.key) == key)

    def delete(self, condition: Column) -> int:
        """Rows that meet the condition go; returns how many."""
        rows = self.read()
        gone = rows.filter(condition).count()
        if gone:
            self.write(rows.filter(~F.coalesce(condition, F.lit(False))))
        return gone


def content_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "content", "file_path", "language", F.octet_length("content").cast("long").alias("size_bytes"))


def metadata_rows(chunks: DataFrame, without: tuple = ("content", "embedding")) -> DataFrame:
    """Path and repository as columns, the rest but content and embedding as JSON."""
    rest = [c for c in chunks.columns if c not in ("chunk_id", *without)]
    return chunks.select("chunk_id", "file_path", "repository", F.to_json(F.struct(*rest)).alias("json_data"))


def checksums(metadata: DataFrame) -> DataFrame:
    """(file_path, file_checksum): from ``location`` in the JSON, else its top level; of several the greatest."""
    found = F.coalesce(F.get_json_object("json_data", "$.location.file_checksum"), F.get_json_object("json_data", "$.file_checksum"))
    return metadata.select("file_path", found.alias("c")).filter("c is not null").groupBy("file_path").agg(F.max("c").alias("file_checksum"))


def rich_text(*columns: Column) -> Column:
    """What full-text search sees: the columns that hold something, joined by spaces."""
    return F.concat_ws(" ", *(F.when(c != "", c) for c in columns))


class Store:
    """Contents, metadata and vectors of chunks, kept in step."""

    def __init__(self, spark: SparkSession, folder: str):
        self.contents, self.metadata, self.vectors = Table(spark, f"{folder}/contents", CHUNKS), Table(spark, f"{folder}/metadata", METADATA), Table(spark, f"{folder}/vectors", VECTORS)

    def put(self, chunks: DataFrame) -> int:
        n = self.contents.upsert(content_rows(chunks))
        self.metadata.upsert(metadata_rows(chunks))
        if "embedding" in chunks.columns:
            self.vectors.upsert(chunks.filter("embedding is not null").select("chunk_id", "embedding"))
        return n

    def get(self, chunk_id: str) -> DataFrame:
        return self.hydrate(self.contents.get(chunk_id).select("chunk_id"))

    def hydrate(self, hits: DataFrame) -> DataFrame:
        """hits (chunk_id, …) with metadata and content; what has none stays."""
        return hits.join(self.metadata.read(), "chunk_id", "left").join(self.contents.read().select("chunk_id", "content", "language"), "chunk_id", "left")

    def delete_file(self, file_path: str) -> int:
        ids = self.metadata.read().filter(F.col("file_path") == file_path).select("chunk_id")
        self.vectors.write(self.vectors.read().join(ids, "chunk_id", "left_anti"))
        self.contents.delete(F.col("file_path") == file_path)
        return self.metadata.delete(F.col("file_path") == file_path)

    def plan(self, files: DataFrame, full: bool = False) -> DataFrame:
        """(file_path, status) of files (file_path, file_checksum, …) against what is stored; ``full``: all that are there count as modified."""
        now = files.select("file_path", "file_checksum")
        found = corpus.diff(checksums(self.metadata.read()), now, "file_path", "file_checksum")
        return found.withColumn("status", F.when(F.col("status") == "unchanged", "modified").otherwise(F.col("status"))) if full else found

    def refresh(self, files: DataFrame, chunk, full: bool = False) -> int:
        """Chunks of deleted and modified files go, new and modified files are chunked by ``chunk`` (files -> chunks). Returns chunks stored; 0 at once if nothing changed."""
        plan = self.plan(files, full).filter("status != 'unchanged'").cache()
        try:
            if plan.isEmpty():
                return 0
            stale = plan.filter("status in ('deleted', 'modified')").select("file_path")
            ids = self.metadata.read().join(stale, "file_path", "left_semi").select("chunk_id")
            self.vectors.write(self.vectors.read().join(ids, "chunk_id", "left_anti"))
            self.contents.write(self.contents.read().join(stale, "file_path", "left_anti"))
            self.metadata.write(self.metadata.read().join(stale, "file_path", "left_anti"))
            return self.put(chunk(files.join(plan.filter("status in ('new', 'modified')").select("file_path"), "file_path", "left_semi")))
        finally:
            plan.unpersist()
