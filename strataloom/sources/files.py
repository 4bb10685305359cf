"""Repository files: recursive scan, ignore rules, classification by extension."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories never read, and the size beyond which files are skipped (fixed values).
IGNORED = [".git", ".svn", ".hg", ".idea", ".vscode", "__pycache__", "node_modules", "venv", ".env", "dist", "build", "target", "out", "bin", ".DS_Store", "Thumbs.db"]
LARGEST = 10 * 1024 * 1024
#: Languages by extension (fixed values).
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "sql": "sql", "tf": "terraform", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "md": "markdown", "properties": "properties"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    out = F.when(F.lower(path).rlike(r"(^|/)dockerfile$"), "docker")
    for ext, name in LANGUAGES.items():
        out = out.when(extension(path) == ext, name)
    return out.otherwise("unknown")


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)tests?/|(^|/)test_|_test\.|test\.java$")


def ignore_rules(gitignore: str) -> list[tuple[str, bool]]:
    """(pattern of paths, whether it ignores) of each line of a .gitignore, in order; the last that matches decides."""
    out = []
    for line in gitignore.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        glob = line[keep:].lstrip("\\") if line[keep:].startswith("\\") else line[keep:]
        folder, anchored = glob.endswith("/"), "/" in glob.rstrip("/")
        body, rx, i = glob.strip("/"), "", 0
        while i < len(body):
            c = body[i]
            if body.startswith("**/", i):
                rx, i = rx + "(?:.*/)?", i + 3
                continue
            if body.startswith("**", i):
                rx, i = rx + ".*", i + 2
                continue
            rx += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
        out.append((("^" if anchored else "(?:^|/)") + rx + ("/" if folder else "(?:/|$)"), not keep))
    return out


def is_ignored(path: Column, gitignore: str = "") -> Column:
    out = path.rlike("(^|/)(" + "|".join(map(re.escape, IGNORED)) + ")(/|$)")
    for rx, ignores in ignore_rules(gitignore):
        out = F.when(path.rlike(rx), F.lit(ignores)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, gitignore: str = "") -> DataFrame:
    """(file_path, size_bytes, sha256, language, is_test, content) of files that no rule skips; skipped files' content is never read."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    rel = F.substring(path, len(base) + 2, 1 << 30)
    kept = found.withColumn("file_path", rel).filter((F.col("length") <= LARGEST) & ~is_ignored(F.col("file_path"), gitignore))
    text = F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8")
    return kept.select("file_path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), text.alias("content"), language_of(F.col("file_path")).alias("language"), is_test(F.col("file_path")).alias("is_test"))
