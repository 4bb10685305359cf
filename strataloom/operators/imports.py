"""Imports, manifests, definitions and the relations between files that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of imports by language; Python's give the top-level module.
IMPORTS = {
    "python": [r"(?m)^\s*import\s+(\w+)", r"(?m)^\s*from\s+(\w+)[\w.]*\s+import"],
    "java": [r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"],
    "javascript": [r"import\s+[^'\"\n]*?\s*from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]", r"import\s*\(\s*['\"]([^'\"]+)['\"]"],
    "go": [r"import\s+\"([^\"]+)\"", r"(?m)^\s+(?:\w+\s+)?\"([^\"]+)\"\s*$"],
    "c": [r"(?m)^\s*#include\s*[<\"]([^>\"]+)[>\"]"],
}
DEFINITIONS = {"python": r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(", "javascript": r"\bfunction\s+(\w+)\s*\(", "java": r"(?m)^\s*(?:public|private|protected)[\w<>\[\]\s]*?\s(\w+)\s*\("}
CLASSES = r"\bclass\s+(\w+)"
PARENTS = {"python": r"\bclass\s+\w+\s*\(\s*([\w.]+)", "javascript": r"\bclass\s+\w+\s+extends\s+([\w.]+)", "java": r"\bclass\s+\w+\s+extends\s+([\w.]+)"}
#: What looks like a call but isn't one.
NO_CALLS = ["if", "for", "while", "switch", "catch", "return", "def", "function", "class", "print", "super", "and", "or", "not", "in"]


def _found(content: Column, patterns: list[str]) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(p), F.lit(1)) for p in patterns)))))


def _by_language(language: Column, table: dict, of) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, value in table.items():
        out = out.when(language == name, of(value))
    return out.otherwise(F.array().cast("array<string>"))


def imports_of(language: Column, content: Column) -> Column:
    """Sorted distinct imports."""
    return _by_language(language, IMPORTS, lambda p: _found(content, p))


def definitions_of(language: Column, content: Column) -> Column:
    return _by_language(language, DEFINITIONS, lambda p: _found(content, [p]))


def parents_of(language: Column, content: Column) -> Column:
    return _by_language(language, PARENTS, lambda p: _found(content, [p]))


def calls_of(content: Column) -> Column:
    return F.filter(_found(content, [r"\b(\w+)\s*\("]), lambda x: ~x.isin(NO_CALLS))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def module_map(files: DataFrame, path: str = "file_path", ordinal: str = "ordinal") -> DataFrame:
    """(name, file_path): dotted paths below src and stems of files; of files with one name the last."""
    dotted = F.replace(F.regexp_replace(F.regexp_extract(path, r"(?:^|/)src/(.+)$", 1), r"\.[^./]+$", ""), F.lit("/"), F.lit("."))
    names = files.select(path, ordinal, F.explode(F.array_distinct(F.array(dotted, stem(F.col(path))))).alias("name")).filter("name != ''")
    return names.groupBy("name").agg(F.max_by(path, ordinal).alias(path))


def resolve(dependencies: DataFrame, modules: DataFrame, name: str = "name") -> DataFrame:
    """dependencies with the internal file of their name, null for those of others."""
    return dependencies.join(modules.withColumnRenamed("file_path", "internal"), name, "left")


def import_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, kind, weight) of chunks (chunk_id, file_path, name, imports, exports): an import's last part is another's stem, lies in it, is its name or one of its exports."""
    wanted = chunks.select(F.col("chunk_id").alias("src"), F.explode("imports").alias("import")).select("src", F.element_at(F.split("import", r"[./]"), -1).alias("base")).filter("base != ''").distinct()
    given = chunks.select(F.col("chunk_id").alias("dst"), stem(F.col("file_path")).alias("stem"), "name", "exports")
    equal = given.select("dst", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("stem", "name"), "exports")))).alias("base"))
    # The base as a part of the stem: each stem's parts of that length and more, as rows, so that this join is on equality, too.
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.transform(F.sequence(F.lit(1), F.length("stem") - i + 1), lambda n: F.substring(F.col("stem"), i, n))))
    inside = given.select("dst", F.explode(F.array_distinct(parts)).alias("base"))
    met = wanted.join(equal.unionByName(inside).distinct(), "base").filter("src != dst").select("src", "dst").distinct()
    return met.select("src", "dst", F.lit("imports").alias("kind"), F.lit(0.8).alias("weight"))


def name_edges(wanting: DataFrame, giving: DataFrame, kind: str, weight: float) -> DataFrame:
    """(src, dst, kind, weight): chunks (chunk_id, names) whose names another (chunk_id, names) gives."""
    a = wanting.select(F.col("chunk_id").alias("src"), F.explode("names").alias("n")).distinct()
    b = giving.select(F.col("chunk_id").alias("dst"), F.explode("names").alias("n")).distinct()
    return a.join(b, "n").filter("src != dst").select("src", "dst").distinct().select("src", "dst", F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))


def requirements(content: Column) -> Column:
    """array<struct(name, version, kind)> of a requirements file."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s*#.*$", ""))), lambda x: (x != "") & ~x.startswith("-"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_.-]+)", 1).alias("name"), F.regexp_replace(F.regexp_extract(x, r"^[A-Za-z0-9_.-]+(?:\[[^\]]*\])?\s*([^;]*)", 1), r"\s", "").alias("version"), F.lit("runtime").alias("kind")))


def _entry(kind: str):
    return lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(kind).alias("kind"))


def package_json(content: Column) -> Column:
    out = []
    for key, kind in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer")):
        entries = F.map_entries(F.coalesce(F.from_json(F.get_json_object(content, f"$.{key}"), "map<string,string>"), F.create_map().cast("map<string,string>")))
        out.append(F.transform(entries, _entry(kind)))
    return F.concat(*out)


def pom(content: Column) -> Column:
    bare = F.regexp_replace(content, r"\s+xmlns(?::\w+)?=\"[^\"]*\"|\s+xsi:\w+=\"[^\"]*\"", "")
    one = lambda x, tag: F.regexp_extract(x, f"<{tag}>([^<]*)</{tag}>", 1)
    blocks = F.regexp_extract_all(bare, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    return F.transform(blocks, lambda x: F.struct(F.concat_ws(":", one(x, "groupId"), one(x, "artifactId")).alias("name"), one(x, "version").alias("version"), F.when(one(x, "scope") == "test", "dev").otherwise("runtime").alias("kind")))


def gradle(content: Column) -> Column:
    found = F.regexp_extract_all(content, F.lit(r"(?m)^\s*((?:testImplementation|implementation|api|compileOnly|runtimeOnly|testRuntimeOnly)\s*\(?\s*['\"][^'\"]+['\"])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"['\"]([^:'\"]+:[^:'\"]+)", 1).alias("name"), F.regexp_extract(x, r"['\"][^:'\"]+:[^:'\"]+:([^'\"]+)", 1).alias("version"), F.when(x.startswith("test"), "dev").otherwise("runtime").alias("kind")))


def _named(content: Column, rx: str, kind: str) -> Column:
    return F.transform(F.array_distinct(F.regexp_extract_all(content, F.lit(rx), F.lit(1))), lambda x: F.struct(x.alias("name"), F.lit("").alias("version"), F.lit(kind).alias("kind")))


def sql_references(content: Column) -> Column:
    """dbt refs and sources, and qualified tables."""
    return F.concat(_named(content, r"\{\{\s*ref\(\s*['\"]([^'\"]+)['\"]", "ref"), _named(content, r"\{\{\s*source\(\s*['\"][^'\"]+['\"]\s*,\s*['\"]([^'\"]+)['\"]", "source"), _named(content, r"(?i)\b(?:from|join)\s+(\w+\.\w+)", "table"))


def terraform_references(content: Column) -> Column:
    return F.concat(_named(content, r"module\s+\"[^\"]+\"\s*\{[^}]*?source\s*=\s*\"([^\"]+)\"", "module"), _named(content, r"(?m)^\s*provider\s+\"([^\"]+)\"", "provider"))


#: Parsers by a pattern of the path; further ones can be put in.
MANIFESTS = [(r"(^|/)requirements[^/]*\.txt$", requirements), (r"(^|/)package\.json$", package_json), (r"(^|/)pom\.xml$", pom), (r"\.gradle(\.kts)?$", gradle), (r"\.sql$", sql_references), (r"\.tf$", terraform_references)]


def dependencies(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """(file_path, name, version, kind) of all manifests."""
    out = F.when(F.lit(False), F.array().cast("array<struct<name:string,version:string,kind:string>>"))
    for rx, parse in MANIFESTS:
        out = out.when(F.col(path).rlike(rx), parse(F.coalesce(F.col(content), F.lit(""))))
    return files.select(path, F.inline(out))


def siblings(files: DataFrame, path: str = "file_path") -> DataFrame:
    """(file_path, sibling, kind): tests with what they test, headers with sources, by the stem in common."""
    base = F.regexp_replace(F.regexp_replace(stem(F.col(path)), r"^test_|_test$|\.test$|\.spec$|Test$", ""), r"^$", "?")
    header = F.col(path).rlike(r"\.(h|hpp)$")
    d = files.select(path, base.alias("base"), (stem(F.col(path)) != base).alias("test"), header.alias("header"), F.regexp_extract(path, r"\.([^./]+)$", 1).alias("ext"))
    o = d.select(F.col(path).alias("sibling"), "base", F.col("test").alias("other_test"), F.col("header").alias("other_header"), F.col("ext").alias("other"))
    pairs = d.join(o, "base")
    tests = pairs.filter("test and not other_test and ext = other").select(path, "sibling", F.lit("tests").alias("kind"))
    return tests.unionByName(pairs.filter("header and not other_header and other in ('c', 'cc', 'cpp')").select(path, "sibling", F.lit("header").alias("kind")))
