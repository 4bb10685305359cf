"""Stores, scans and the incremental flow, on folders of their own."""

from pyspark.sql import functions as F

from strataloom.operators import chunks, store
from strataloom.sources import files
from strataloom.streaming import windows


def _rows(spark, n):
    return spark.createDataFrame([(f"sm_{i}", f"def func_{i}(): pass", "src/utils.py" if i % 2 else "src/main.py", "python", "repo", f"c{i % 2}", [float(i), 1.0]) for i in range(n)], "chunk_id string, content string, file_path string, language string, repository string, file_checksum string, embedding array<float>")


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.put(_rows(spark, 50)) == 50 and s.put(_rows(spark, 50)) == 50
    assert s.contents.read().count() == s.metadata.read().count() == s.vectors.read().count() == 50
    (one,) = s.get("sm_7").collect()
    assert one.content == "def func_7(): pass" and one.repository == "repo" and '"content"' not in one.json_data and "embedding" not in one.json_data
    assert s.delete_file("src/main.py") == 25
    assert s.contents.read().count() == s.metadata.read().count() == s.vectors.read().count() == 25
    assert store.Store(spark, str(tmp_path)).vectors.read().count() == 25
    assert s.contents.delete(F.col("chunk_id") == "none") == 0 and s.get("none").collect() == []


def test_incremental(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))

    def files_of(**texts):
        return spark.createDataFrame([(f"{k}.py", v) for k, v in texts.items()], "file_path string, content string").withColumn("file_checksum", F.sha2("content", 256))

    def chunk(df):
        sums = df.select("file_path", "file_checksum")
        return chunks.chunk_files(df).join(sums, "file_path").withColumns({"language": F.lit("python"), "repository": F.lit("r")})

    one = files_of(file1="print('hello')")
    assert s.refresh(one, chunk) == 1 and s.refresh(one, chunk) == 0 and s.refresh(one, chunk, full=True) == 1
    assert s.refresh(files_of(file1="print('modified')"), chunk) == 1
    assert s.refresh(files_of(file1="print('modified')", file2="def foo(): pass"), chunk) == 1
    assert {r.file_path for r in store.checksums(s.metadata.read()).collect()} == {"file1.py", "file2.py"}
    assert s.refresh(files_of(file1="print('modified')"), chunk) == 0
    assert {r.file_path for r in s.contents.read().collect()} == {"file1.py"}


def test_scan_strips_the_root_only(spark, tmp_path):
    root = tmp_path / "src"
    for name in ("app/src/main.py", "main.py", "out/x.py", ".git/y"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    assert sorted(r.file_path for r in files.scan(spark, str(root)).collect()) == ["app/src/main.py", "main.py"]


def test_chunks_hold_the_text():
    text = "\n".join(f"line {k} " + "word " * (k % 30) for k in range(200)) + "\n" + "x " * 3000
    parts = list(chunks.split_by_tokens(text))
    assert all(chunks.tokens_of(p) <= 1.1 * chunks.BUDGET for *_, p in parts)  # lines' estimates are rounded down one by one
    assert "".join("".join(p.split()) for *_, p in parts) == "".join(text.split())
    assert list(chunks.split_by_tokens("")) == []
    chunks.register("loud", lambda t: iter([("loud", "", 1, 1, t.upper())]), extensions=("loud",))
    assert chunks.chunk_text("a.loud", "x")[0][4] == "X"
    chunks.unregister("loud")
    assert chunks.chunk_text("a.loud", "x")[0][0] == "adaptive_paragraph"


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    assert stream.isStreaming
    q = windows.tumbling(stream, late="100 days").writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.start, r.event_type, r.n) for r in spark.table("tumbling").collect())
    assert got == sorted((r.start, r.event_type, r.n) for r in windows.tumbling(events).collect())
