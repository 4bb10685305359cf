"""Queries over small repositories: classification, chunking, parsing, imports, relations and the incremental plan. Expected rows were worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import chunks, classify, corpus, imports, similarity, store
from .registered import expected
from .sources import files

_FILES = "file_path string, content string"
_REPO = [
    ("src/services/user_service.py", "import os\nclass UserService:\n    pass\n"), ("tests/test_user.py", "def test_a():\n    assert True\n"), ("config/app.yaml", "a: 1\n"), ("README.md", "# Title\n"), ("db/migrations/001.sql", "CREATE TABLE t (a int);\n"), ("Dockerfile", "FROM python\nRUN pip install x\n"),
    ("web/components/Button.tsx", "import React from 'react'\n"), ("node_modules/lib.log", ""), ("src/api.pb.h", "// Do not edit\n"), ("src/main.py", None),
]


@expected("file_path, category, domain, purpose, technologies, importance, test, generated, vendor", [
    ("src/services/user_service.py", "source_code", "application", "service", "python", "high", False, False, False),
    ("tests/test_user.py", "test_code", "testing", "unit_test", "python", "medium", True, False, False),
    ("config/app.yaml", "configuration", "unknown", "unknown", "unknown", "medium", False, False, False),
    ("README.md", "documentation", "unknown", "unknown", "unknown", "medium", False, False, False),
    ("db/migrations/001.sql", "database", "unknown", "unknown", "unknown", "medium", False, False, False),
    ("Dockerfile", "deployment", "unknown", "unknown", "docker,python", "medium", False, False, False),
    ("web/components/Button.tsx", "unknown", "presentation", "unknown", "javascript,python,react", "medium", False, False, False),
    ("node_modules/lib.log", "log", "unknown", "unknown", "unknown", "medium", False, False, False),
    ("src/api.pb.h", "unknown", "integration", "unknown", "unknown", "medium", False, True, False),
    ("src/main.py", "source_code", "unknown", "main_entry", "python", "critical", False, False, False),
])
def file_classification(t) -> DataFrame:
    """Path patterns are held against the lower-cased path, so a pattern with a capital never matches; file names are held as they are."""
    p, c = F.col("file_path"), F.col("content")
    d = t.rows(_REPO, _FILES).select("*", classify.category(p, c).alias("category"), classify.domain(p, c).alias("domain"), classify.purpose(p, c).alias("purpose"))
    return d.select("file_path", "category", "domain", "purpose", F.array_join(classify.technologies(p, c), ",").alias("technologies"), classify.importance(p, c, F.col("category"), F.col("domain"), F.col("purpose")).alias("importance"), classify.is_test(p, c).alias("test"), classify.is_generated(p, c).alias("generated"), classify.is_vendor(p).alias("vendor"))


@expected("id, chunker", [(1, "sql"), (2, "plsql"), (3, "terraform"), (4, "docker"), (5, "yaml"), (6, "json"), (7, "xml"), (8, "generic_code"), (9, None), (10, None)])
def content_sniffing(t) -> DataFrame:
    rows = [(1, "select 1"), (2, "begin x; end;"), (3, 'resource "a" "b" {}'), (4, "FROM x"), (5, "---\na: 1"), (6, '[1, 2]'), (7, "<a/>"), (8, "def f():\n    return 1"), (9, "plain"), (10, None)]
    return t.rows(rows, "id long, content string").select("id", classify.sniff(F.col("content")).alias("chunker"))


@expected("file_path, pattern, severity, line, snippet", [
    ("a.py", "hardcoded_credentials", "critical", 1, 'password = "***"'), ("a.py", "todo", "low", 3, "# TODO: later"), ("a.py", "magic_number", "low", 4, "42"), ("b.js", "xss", "critical", 1, "innerHTML = a +"), ("b.js", "sql_injection", "critical", 2, "f'SELECT {"),
])
def code_patterns(t) -> DataFrame:
    rows = [("a.py", 'password = "hunter22"\ntoken = "your_token_here"\n# TODO: later\nx = 42\ny = 7\n'), ("b.js", "innerHTML = a + b\nq = f'SELECT {x}'\n"), ("c.py", "innerHTML = a + b\n"), ("d.py", None)]
    return classify.pattern_hits(t.rows(rows, _FILES), "file_path", "content").select("file_path", "pattern", "severity", F.col("line").cast("long").alias("line"), "snippet")


@expected("severity, n, confidence", [("critical", 2, 0.75), ("low", 3, 0.9)])
def pattern_statistics(t) -> DataFrame:
    rows = [("a.py", 'password = "hunter22"\n# TODO: a\n# FIXME: b\nx = 42\nf"SELECT {x}"\n')]
    return classify.pattern_hits(t.rows(rows, _FILES), "file_path", "content").groupBy("severity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@expected("id, score", [(1, 100.0), (2, 53.0), (3, 0.0)])
def code_quality_score(t) -> DataFrame:
    rows = [(1, 0, 0, 0, 0, 3, 2, 0.2), (2, 1, 1, 2, 1, 12, 2, 0.5), (3, 9, 0, 0, 0, 30, 9, 0.0)]
    d = t.rows(rows, "id long, c int, h int, m int, l int, cyclomatic int, nesting int, comments double")
    return d.select("id", classify.quality_score(*(F.col(x) for x in ("c", "h", "m", "l", "cyclomatic", "nesting", "comments"))).alias("score"))


_JAVA = """
    package com.example.app;

    import java.util.List;
    import java.util.ArrayList;

    public class UserService {
        private UserRepository repository;

        public UserService(UserRepository repository) {
            this.repository = repository;
        }

        public List<User> getAllUsers() {
            return repository.findAll();
        }

        public User getUserById(Long id) {
            return repository.findById(id);
        }
    }
    """
_PYTHON = '"""Doc."""\nimport os\nfrom a.b import c\n\nLIMIT = 3\n\n\n@dec\ndef f(x):\n    return x\n\n\nclass A(B):\n    def m(self):\n        pass\n'


def _chunked(t, rows) -> DataFrame:
    return chunks.chunk_files(t.rows(rows, _FILES)).select("file_path", F.col("ordinal").cast("long").alias("ordinal"), "kind", "name", F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("z"))


@expected("file_path, ordinal, kind, name, a, z", [
    ("A.java", 0, "java_header", "com.example.app", 2, 5), ("A.java", 1, "java_class_declaration", "UserService", 7, 8), ("A.java", 2, "java_constructor", "UserService.UserService", 10, 12), ("A.java", 3, "java_method", "UserService.getAllUsers", 14, 16), ("A.java", 4, "java_method", "UserService.getUserById", 18, 20),
    ("B.java", 0, "java_fallback", "", 1, 1),
    ("a.py", 0, "python_header", "", 1, 3), ("a.py", 1, "python_function", "f", 8, 10), ("a.py", 2, "python_class", "A", 13, 15), ("a.py", 3, "python_globals", "", 5, 5),
    ("b.py", 0, "python_fallback", "", 1, 2),
    ("c.ts", 0, "javascript_imports", "", 1, 1), ("c.ts", 1, "typescript_interface", "P", 2, 2), ("c.ts", 2, "javascript_hook", "useX", 3, 3), ("c.ts", 3, "javascript_class", "K", 4, 4),
    ("d.go", 0, "code_global", "", 1, 1), ("d.go", 1, "code_function", "main", 3, 4),
])
def chunk_code(t) -> DataFrame:
    rows = [
        ("A.java", _JAVA), ("B.java", "public class { invalid java code"), ("C.java", ""), ("a.py", _PYTHON), ("b.py", "def broken(:\n    pass"), ("c.ts", "import a from 'b'\nexport interface P { a: string }\nconst useX = () => { return '}' }\nclass K extends L { }\n"), ("d.go", "package main\n\nfunc main() {\n}\n"), ("n.py", None),
    ]
    return _chunked(t, rows)


@expected("file_path, ordinal, kind, name, a, z", [
    ("a.json", 0, "json_complete", "", 1, 1), ("b.jsonl", 0, "jsonl_batch", "0,1", 0, 0), ("c.yaml", 0, "yaml_k8s", "Pod", 2, 3), ("c.yaml", 1, "yaml_compose", "", 5, 7), ("d.xml", 0, "xml_complete", "r", 1, 1), ("e.ini", 0, "properties_section", "s", 1, 2), ("e.ini", 1, "properties_section", "t", 3, 4),
    ("f.properties", 0, "properties_namespace", "db", 0, 0), ("f.properties", 1, "properties_misc", "", 0, 0), ("g/Dockerfile", 0, "dockerfile_stage", "build<python:3", 2, 3), ("g/Dockerfile", 1, "dockerfile_stage", "1<build", 5, 6),
    ("h.tf", 0, "terraform_variables", "db", 1, 2), ("h.tf", 1, "terraform_variables", "general", 3, 3), ("h.tf", 2, "terraform_resources", "aws_s3_bucket", 4, 6),
    ("i/package.json", 0, "package_json_main", "p", 1, 1), ("i/package.json", 1, "package_json_dependencies", "p", 1, 1),
    ("pom.xml", 0, "maven_project_info", "app", 0, 0), ("pom.xml", 1, "maven_properties", "", 0, 0), ("pom.xml", 2, "maven_dependencies", "compile", 0, 0), ("pom.xml", 3, "maven_dependencies", "test", 0, 0), ("z.json", 0, "json_fallback", "", 1, 1),
])
def chunk_configuration(t) -> DataFrame:
    dep = lambda a, s: f"<dependency><groupId>g</groupId><artifactId>{a}</artifactId><version>1</version>{s}</dependency>"
    rows = [
        ("a.json", '{"a": 1}'), ("b.jsonl", '{"a": 1}\nbroken\n{"a": 2}'), ("c.yaml", "---\napiVersion: v1\nkind: Pod\n---\nservices:\n  a:\n    image: b"), ("d.xml", "<r><a/></r>"), ("e.ini", "[s]\na=1\n[t]\nb=2"), ("f.properties", "db.url=a\n# note\ndb.user=b\nname=x"),
        ("g/Dockerfile", "# c\nFROM python:3 AS build\nRUN a \\\n  && b\nFROM build\nCMD c"), ("h.tf", 'variable "db_a" {}\nvariable "db_b" {}\nvariable "x" {}\nresource "aws_s3_bucket" "b" {\n  a = var.x\n}'), ("i/package.json", '{"name": "p", "dependencies": {"a": "1"}}'),
        ("pom.xml", '<project xmlns="http://maven.apache.org/POM/4.0.0"><groupId>g</groupId><artifactId>app</artifactId><version>1</version><properties><a>b</a></properties><dependencies>' + dep("x", "") + dep("y", "<scope>test</scope>") + "</dependencies></project>"), ("z.json", "{broken"),
    ]
    return _chunked(t, rows)


@expected("file_path, ordinal, kind, name, a, z", [
    ("a.sql", 0, "sql_statement_group", "t", 1, 2), ("a.sql", 1, "sql_update", "u", 3, 3), ("b.pks", 0, "plsql_package_spec", "p", 1, 3), ("b.pks", 1, "plsql_trigger", "tr", 4, 5),
    ("c.log", 0, "adaptive_log", "", 1, 6), ("d.md", 0, "adaptive_markup", "A", 1, 2), ("d.md", 1, "adaptive_markup", "B", 3, 4), ("e.csv", 0, "adaptive_data", ",", 1, 100), ("e.csv", 1, "adaptive_data", ",", 101, 120), ("f.txt", 0, "adaptive_paragraph", "0,1", 0, 0),
])
def chunk_other(t) -> DataFrame:
    rows = [
        ("a.sql", "CREATE TABLE t (a int);\nINSERT INTO t VALUES (';');\nUPDATE u SET a = 1;"), ("b.pks", "CREATE OR REPLACE PACKAGE p AS\n  x NUMBER;\nEND;\nCREATE TRIGGER tr\nBEGIN NULL; END;"), ("c.log", "\n".join(f"2024-01-0{k} 10:00:00 x" for k in range(1, 7))), ("d.md", "# A\ntext\n# B\ntext"),
        ("e.csv", "\n".join("a,b" for _ in range(120))), ("f.txt", "one\n\ntwo"),
    ]
    return _chunked(t, rows)


@expected("k, a, z, tokens", [(0, 1, 4, 44), (1, 4, 6, 33)])
def chunk_overlap(t) -> DataFrame:
    """Six lines of ten words, 11 tokens each, to a budget of 45, the last line of a chunk beginning the next."""
    line = " ".join(f"word{k}" for k in range(10))
    rows = [(k, a, z, chunks.tokens_of(x)) for k, (a, z, x) in enumerate(chunks.split_by_tokens("\n".join([line] * 6), 45, 15))]
    return t.rows(rows, "k long, a long, z long, tokens long")


@expected("file_path, kind, a, z, length", [("a.py", "python_header", 1, 15, 121)])
def chunk_merge(t) -> DataFrame:
    return chunks.merged(chunks.chunk_files(t.rows([("a.py", _PYTHON)], _FILES))).select("file_path", "kind", F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("z"), F.length("content").cast("long").alias("length"))


@expected("k, type, class, tables, joins, ctes, subqueries, complexity", [(0, "select", "dml", "a,b", 1, 0, 0, 3), (1, "create_table", "ddl", "t", 0, 0, 0, 0), (2, "select", "dml", "d", 0, 1, 1, 5), (3, "grant", "dcl", "", 0, 0, 0, 0), (4, "commit", "tcl", "", 0, 0, 0, 0)])
def sql_statement_facts(t) -> DataFrame:
    text = "SELECT * FROM a JOIN b ON a.x = b.x AND a.y = 'or; x';\nCREATE TABLE IF NOT EXISTS t (a int);\nWITH c AS (SELECT 1 FROM d) SELECT * FROM c WHERE x IN (SELECT y FROM d);\nGRANT ALL TO x;\nCOMMIT;"
    found = [chunks.sql_facts(s) for _, s in chunks.sql_statements(text)]
    return t.rows([(k, f["type"], f["class"], ",".join(f["tables"]), f["joins"], len(f["ctes"]), f["subqueries"], f["complexity"]) for k, f in enumerate(found)], "k long, type string, class string, tables string, joins long, ctes long, subqueries long, complexity long")


@expected("file_path, imports", [("a.py", "a,os,re"), ("b.java", "a.b.C,d.E"), ("c.js", "./x,y,z"), ("d.go", "fmt,os"), ("e.c", "stdio.h,x.h"), ("f.txt", ""), ("g.py", "")])
def import_extraction(t) -> DataFrame:
    rows = [("a.py", "python", "import os\nfrom a.b import c\n  import re\nimport os"), ("b.java", "java", "import a.b.C;\nimport static d.E;"), ("c.js", "javascript", "import a from 'y'\nconst b = require('./x')\nimport('z')"), ("d.go", "go", 'import "os"\nimport (\n\t"fmt"\n)'), ("e.c", "c", '#include <stdio.h>\n#include "x.h"'), ("f.txt", "text", "import x"), ("g.py", "python", None)]
    return t.rows(rows, "file_path string, language string, content string").select("file_path", F.array_join(imports.imports_of(F.col("language"), F.col("content")), ",").alias("imports"))


@expected("file_path, name, version, kind", [
    ("requirements.txt", "numpy", ">=1.0", "runtime"), ("requirements.txt", "pandas", "", "runtime"), ("web/package.json", "react", "^18", "runtime"), ("web/package.json", "jest", "29", "dev"), ("pom.xml", "g:x", "1", "runtime"), ("pom.xml", "g:y", "2", "dev"),
    ("build.gradle", "a:b", "1", "runtime"), ("build.gradle", "j:u", "4", "dev"), ("m.sql", "stage", "", "ref"), ("m.sql", "raw", "", "source"), ("m.sql", "s.t", "", "table"), ("x.tf", "./net", "", "module"), ("x.tf", "aws", "", "provider"),
])
def manifest_dependencies(t) -> DataFrame:
    rows = [
        ("requirements.txt", "numpy >= 1.0  # x\n-r other.txt\n\npandas[all]\n"), ("web/package.json", '{"dependencies": {"react": "^18"}, "devDependencies": {"jest": "29"}}'), ("pom.xml", '<project xmlns="x"><dependencies><dependency><groupId>g</groupId><artifactId>x</artifactId><version>1</version></dependency><dependency><groupId>g</groupId><artifactId>y</artifactId><version>2</version><scope>test</scope></dependency></dependencies></project>'),
        ("build.gradle", "dependencies {\n  implementation 'a:b:1'\n  testImplementation(\"j:u:4\")\n}"), ("m.sql", "select * from {{ ref('stage') }} join {{ source('s', 'raw') }} join s.t"), ("x.tf", 'module "n" {\n  source = "./net"\n}\nprovider "aws" {}'), ("other.txt", "x"),
    ]
    return imports.dependencies(t.rows(rows, _FILES))


@expected("library, files", [("numpy", "a.py,b.py"), ("os", "a.py")])
def import_inverted_index(t) -> DataFrame:
    d = t.rows([("a.py", "import os\nimport numpy"), ("b.py", "import numpy")], _FILES)
    named = d.select("file_path", F.explode(imports.imports_of(F.lit("python"), F.col("content"))).alias("library"))
    return named.groupBy("library").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("files"))


@expected("name, internal", [("utils.text", "src/utils/text.py"), ("text", "lib/text.py"), ("numpy", None)])
def module_map_lookup(t) -> DataFrame:
    """Dotted paths below src and stems; of files with one name the last counts."""
    modules = imports.module_map(t.rows([(0, "src/utils/text.py"), (1, "lib/text.py")], "ordinal int, file_path string"))
    return imports.resolve(t.rows([("utils.text",), ("text",), ("numpy",)], "name string"), modules)


@expected("file_path, sibling, kind", [("test_a.py", "a.py", "tests"), ("b.h", "b.c", "header"), ("x/CTest.java", "C.java", "tests")])
def sibling_files(t) -> DataFrame:
    return imports.siblings(t.rows([(x,) for x in ("a.py", "test_a.py", "b.h", "b.c", "C.java", "x/CTest.java", "a.js")], "file_path string"))


_CHUNKS = [
    ("c1", "src/app.py", "run", "import helpers\nclass App(Base):\n  def run(self):\n    load(1)"), ("c2", "src/helpers.py", "load", "def load(x):\n  return x"), ("c3", "src/base.py", "Base", "class Base:\n  pass"), ("c4", "src/my_helpers_old.py", "old", "x = 1"),
]


@expected("src, dst, kind, weight", [("c1", "c2", "imports", 0.8), ("c1", "c4", "imports", 0.8), ("c1", "c2", "calls", 0.6), ("c1", "c3", "inherits", 1.0)])
def relation_edges(t) -> DataFrame:
    c, lang = F.col("content"), F.lit("python")
    d = t.rows(_CHUNKS, "chunk_id string, file_path string, name string, content string").select("*", imports.imports_of(lang, c).alias("imports"), F.array().cast("array<string>").alias("exports"))
    names = lambda x: d.select("chunk_id", x.alias("names"))
    classes = F.regexp_extract_all(c, F.lit(imports.CLASSES), F.lit(1))
    calls = imports.name_edges(names(F.array_except(imports.calls_of(c), imports.definitions_of(lang, c))), names(imports.definitions_of(lang, c)), "calls", 0.6)
    return imports.import_edges(d).unionByName(calls).unionByName(imports.name_edges(names(imports.parents_of(lang, c)), names(classes), "inherits", 1.0))


@expected("kind, n", [("imports", 2), ("calls", 1), ("inherits", 1)])
def relation_counts(t) -> DataFrame:
    return relation_edges(t).groupBy("kind").agg(F.count("*").alias("n"))


@expected("src, dst", [("final", "build")])
def docker_stage_links(t) -> DataFrame:
    """Stages built from an earlier one."""
    stages = [(k, name.split("<")[0], name.split("<")[1]) for k, (_, name, *_) in enumerate(chunks.docker("FROM a AS build\nRUN x\nFROM b AS other\nFROM build AS final\nFROM later AS y\nFROM z AS later"))]
    d = t.rows(stages, "k int, name string, base string")
    e = d.select(F.col("k").alias("j"), F.col("name").alias("dst"))
    return d.join(e, d.base == e.dst).filter("j < k").select(F.col("name").alias("src"), "dst")


@expected("src, dst", [("aws_s3_bucket.b", "var.x"), ("module.m", "aws_s3_bucket.b")])
def terraform_links(t) -> DataFrame:
    found = chunks.terraform_blocks('variable "x" {}\nresource "aws_s3_bucket" "b" {\n  a = var.x\n}\nmodule "m" {\n  id = aws_s3_bucket.b.id\n  n = var.missing\n}')
    address = lambda type_, label, name: f"{label}.{name}" if label else f"{ {'variable': 'var'}.get(type_, type_)}.{name}"
    blocks = t.rows([(address(*b[:3]), b[5]) for b in found], "address string, refs array<string>")
    return blocks.select(F.col("address").alias("src"), F.explode("refs").alias("ref")).join(blocks.select(F.col("address").alias("dst")), F.col("ref") == F.col("dst")).select("src", "dst")


_OLD = [("a", "src/a.py", '{"location": {"file_checksum": "1"}, "file_checksum": "9"}'), ("b", "src/b.py", '{"file_checksum": "2"}'), ("c", "src/c.py", '{"x": 1}'), ("d", "src/d.py", '{"file_checksum": "4"}')]


@expected("file_path, status", [("src/a.py", "unchanged"), ("src/b.py", "modified"), ("src/d.py", "deleted"), ("src/e.py", "new")])
def incremental_plan(t) -> DataFrame:
    stored = store.checksums(t.rows(_OLD, "chunk_id string, file_path string, json_data string"))
    now = t.rows([("src/a.py", "1"), ("src/b.py", "3"), ("src/e.py", "5")], "file_path string, file_checksum string")
    return corpus.diff(stored, now, "file_path", "file_checksum")


@expected("chunk_id, rich", [("1", "a.py r text"), ("2", "b.py text")])
def search_rich_text(t) -> DataFrame:
    d = t.rows([("1", "a.py", "r", None, "text"), ("2", "b.py", "", None, "text")], "chunk_id string, p string, r string, d string, c string")
    return d.select("chunk_id", store.rich_text(*(F.col(x) for x in "prdc")).alias("rich"))


@expected("chunk_id, rest", [("1", '{"file_path":"a.py","repository":"r","function_name":"f"}')])
def metadata_without_content(t) -> DataFrame:
    d = t.rows([("1", "a.py", "r", "f", "text", [1.0])], "chunk_id string, file_path string, repository string, function_name string, content string, embedding array<double>")
    return store.metadata_rows(d).select("chunk_id", F.col("json_data").alias("rest"))


@expected("id, exact, tokens, structure, blocks", [(1, True, 1.0, 1.0, 1.0), (2, False, 0.5, 1.0, 1.0), (3, False, 0.0, 0.0, 0.0)])
def code_similarity(t) -> DataFrame:
    rows = [(1, "x = foo", "x = foo"), (2, "aa = bb", "cc = bb"), (3, "class", "1 +")]
    d = t.rows(rows, "id long, a string, b string").withColumn("m", similarity.all_metrics(F.col("a"), F.col("b")))
    return d.select("id", "m.exact", F.round("m.tokens", 6).alias("tokens"), F.round("m.structure", 6).alias("structure"), F.round("m.blocks", 6).alias("blocks"))


@expected("file_path, ignored", [("a/b.py", False), ("node_modules/x.js", True), ("logs/a.log", True), ("logs/keep.log", False), ("build/x", True), ("docs/gen/a.md", True), ("x/docs/gen/a.md", False), ("outer/a", False)])
def ignore_rules(t) -> DataFrame:
    paths = ["a/b.py", "node_modules/x.js", "logs/a.log", "logs/keep.log", "build/x", "docs/gen/a.md", "x/docs/gen/a.md", "outer/a"]
    return t.rows([(x,) for x in paths], "file_path string").select("file_path", files.is_ignored(F.col("file_path"), "# c\n*.log\n!keep.log\n/docs/gen/\n").alias("ignored"))


@expected("file_path, name, stem, suffix", [("a/b.tar.gz", "b.tar.gz", "b.tar", ".gz"), ("c\\d.PY", "d.PY", "d", ".py"), (".env", ".env", ".env", "")])
def path_parts(t) -> DataFrame:
    p = F.col("file_path")
    d = t.rows([("a/b.tar.gz",), ("c\\d.PY",), (".env",)], "file_path string")
    name = classify.name_of(p)
    return d.select("file_path", name.alias("name"), F.when(classify.suffix_of(p) == "", name).otherwise(F.regexp_replace(name, r"\.[^.]+$", "")).alias("stem"), classify.suffix_of(p).alias("suffix"))


@expected("level, score", [("good", 0.566667)])
def chunk_quality(t) -> DataFrame:
    """Mean of 1 / (1 + variance / 10,000), mean tokens over 400 (1 at most) and 0.7."""
    d = t.rows([(100,), (300,)], "tokens long").agg(F.var_pop("tokens").alias("v"), F.avg("tokens").alias("m"))
    score = F.round((1 / (1 + F.col("v") / 10_000) + F.least(F.col("m") / 400, F.lit(1.0)) + 0.7) / 3, 6)
    return d.select(F.when(score >= 0.9, "excellent").when(score >= 0.5, "good").otherwise("fair").alias("level"), score.alias("score"))


@expected("name, ema", [("a", 0.271), ("b", 1.0)])
def strategy_moving_average(t) -> DataFrame:
    """0.9 of what was and 0.1 of what comes, in order of time."""
    rows = [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 1.0), ("a", 4, 1.0), ("b", 1, 1.0)]
    s = F.array_sort(F.collect_list(F.struct("ts", "v")))
    d = t.rows(rows, "name string, ts long, v double").groupBy("name").agg(s.alias("s"))
    ema = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.col("s")[0]["v"], lambda a, x: 0.9 * a + 0.1 * x["v"])
    return d.select("name", F.round(ema, 6).alias("ema"))


@expected("strategy, score", [("b", 0.72), ("a", 0.5)])
def strategy_scores(t) -> DataFrame:
    """Effectiveness weighted by confidence."""
    rows = [("a", 0.5, 1.0), ("a", 0.5, 0.0), ("b", 0.9, 0.8), ("b", 0.1, 0.0)]
    return t.rows(rows, "strategy string, confidence double, effect double").groupBy("strategy").agg(F.round(F.sum(F.col("confidence") * F.col("effect")) / F.sum("confidence"), 6).alias("score"))


@expected("id, text", [(1, "&lt;a b=&quot;c&quot;&gt; &amp; &apos;"), (2, "<a><b>x</b></a>")])
def xml_escape_minify(t) -> DataFrame:
    d = t.rows([(1, "<a b=\"c\"> & '"), (2, "<a>\n  <b>x</b>\n</a>")], "id long, x string")
    out = F.col("x")
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return d.select("id", F.when(F.col("id") == 1, out).otherwise(F.regexp_replace(F.trim("x"), r">\s+<", "><")).alias("text"))
