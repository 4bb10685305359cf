"""Chunking: one file in, chunks (kind, name, lines, tokens, text) out.

A chunker is a function of a text that yields (kind, name, first line, last line, text); ``CHUNKERS`` names them and further ones
can be registered. ``chunk_files`` runs the one that the path or, failing that, the content asks for, file by file in Arrow
batches, so nothing is shuffled. Where a format's own chunker can't read a text, or gives nothing for one that isn't empty,
lines are packed to the budget instead.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registered import ship_code

BUDGET, OVERLAP, FEWEST = 450, 50, 50
Piece = tuple[str, str, int, int, str]
FIELDS = "chunk_id string, file_path string, ordinal int, kind string, name string, start_line int, end_line int, tokens long, content string"


def tokens_of(text: str) -> int:
    """Half of three quarters of the words and a quarter of the characters."""
    return int((0.75 * len(text.split()) + len(text) / 4) / 2)


def split_by_tokens(text: str, budget: int = BUDGET, overlap: int = 0) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text): lines packed in order to the budget; with ``overlap`` the last lines of a chunk, up to so many tokens, begin the next. A line over the budget stands alone, cut by words."""
    held: list[str] = []
    first, size = 1, 0
    for number, line in enumerate(text.split("\n"), 1):
        n = tokens_of(line)
        if held and size + n > budget:
            yield first, number - 1, "\n".join(held)
            kept, kept_size = 0, 0
            while kept < len(held) and (more := tokens_of(held[-1 - kept])) + kept_size <= overlap and overlap and more + kept_size + n <= budget:
                kept, kept_size = kept + 1, kept_size + more
            held = held[len(held) - kept :]
            first, size = number - kept, kept_size
        if n > budget:
            words, part = line.split(" "), []
            for w in words:
                if part and tokens_of(" ".join([*part, w])) > budget:
                    yield number, number, " ".join(part)
                    part = []
                part.append(w)
            line, n = " ".join(part), tokens_of(" ".join(part))
            first = number if not held else first
        held.append(line)
        size += n
    if held and (text or size):
        yield first, first + len(held) - 1, "\n".join(held)


def merge(texts: list[str]) -> str:
    return "\n\n".join(texts)


def _lines(text: str, first: int, last: int) -> str:
    return "\n".join(text.split("\n")[first - 1 : last])


def _packed(kind: str, parts: list[tuple[str, str]], join: Callable[[list[str]], str], budget: int = BUDGET) -> Iterator[Piece]:
    """Parts (name, text) packed in order to the budget."""
    held: list[tuple[str, str]] = []
    size = 0
    for name, text in parts:
        n = tokens_of(text)
        if held and size + n > budget:
            yield kind, ",".join(k for k, _ in held), 0, 0, join([t for _, t in held])
            held, size = [], 0
        held.append((name, text))
        size += n
    if held:
        yield kind, ",".join(k for k, _ in held), 0, 0, join([t for _, t in held])


def fallback(kind: str) -> Callable[[str], Iterator[Piece]]:
    return lambda text: ((kind, "", a, z, t) for a, z, t in split_by_tokens(text))


# --- code -------------------------------------------------------------------------------------


def python(text: str) -> Iterator[Piece]:
    """Header (docstring, imports), classes (over the budget: declaration and methods), functions, globals."""
    tree = ast.parse(text)
    span = lambda n: (min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]), n.end_lineno)
    header, rest = [], []
    for k, node in enumerate(tree.body):
        docstring = k == 0 and isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)
        if docstring or isinstance(node, (ast.Import, ast.ImportFrom)):
            header.append(span(node))
        else:
            rest.append(node)
    if header:
        yield "python_header", "", header[0][0], header[-1][1], merge([_lines(text, *h) for h in header]).replace("\n\n", "\n")
    others = []
    for node in rest:
        a, z = span(node)
        if isinstance(node, ast.ClassDef):
            body = _lines(text, a, z)
            if tokens_of(body) <= BUDGET:
                yield "python_class", node.name, a, z, body
                continue
            methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            until = span(methods[0])[0] - 1 if methods else z
            yield "python_class_declaration", node.name, a, until, _lines(text, a, until)
            for m in methods:
                yield "python_method", f"{node.name}.{m.name}", *span(m), _lines(text, *span(m))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "python_function", node.name, a, z, _lines(text, a, z)
        else:
            others.append((a, z))
    if others:
        yield "python_globals", "", others[0][0], others[-1][1], "\n".join(_lines(text, *o) for o in others)


def _blank_strings(text: str, line: str = "//", block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`") -> str:
    """The text with strings and comments overwritten, so that braces in them don't count; places stay."""
    parts = [re.escape(line) + r"[^\n]*"] if line else []
    if block:
        parts.append(re.escape(block[0]) + r".*?" + re.escape(block[1]))
    parts += [q + r"(?:\\.|[^\\" + q + ("" if q == "`" else r"\n") + r"])*" + q for q in quotes]
    return re.sub("|".join(parts), lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _close(bare: str, open_at: int, pair: str = "{}") -> int:
    depth = 0
    for i in range(open_at, len(bare)):
        depth += (bare[i] == pair[0]) - (bare[i] == pair[1])
        if not depth:
            return i
    raise ValueError("no end of the block")


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _last(text: str, end: int) -> int:
    """Line of the last character before ``end`` that isn't white space."""
    return _line(text, max(0, len(text[:end].rstrip()) - 1))


_JAVA_TYPE = re.compile(r"(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*\b(class|interface|enum|record)\s+(\w+)[^;{()]*(?:\([^)]*\))?[^;{]*\{")
_JAVA_METHOD = re.compile(r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?([\w<>\[\],.? ]+?\s+)?(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?\{", re.M)


def java(text: str) -> Iterator[Piece]:
    """Header, then of each top-level type its declaration and methods and constructors; interfaces and enums whole."""
    bare = _blank_strings(text)
    imports = re.findall(r"^\s*((?:package|import)\s+[^;]+;)", bare, re.M)
    if imports:
        at = [m.start() for m in re.finditer(r"^\s*(?:package|import)\s", bare, re.M)]
        yield "java_header", (re.findall(r"package\s+([\w.]+)", bare) or [""])[0], _line(text, at[0] + len(bare[at[0] :]) - len(bare[at[0] :].lstrip())), _line(text, at[-1] + len(bare[at[-1] :]) - len(bare[at[-1] :].lstrip())), "\n".join(imports)
    at, found = 0, False
    while m := _JAVA_TYPE.search(bare, at):
        found = True
        end = _close(bare, m.end() - 1)
        what, name, body = m[1], m[2], text[m.start() : end + 1]
        if what in ("interface", "enum"):
            yield f"java_{what}", name, _line(text, m.start()), _line(text, end), body
        else:
            methods, inside = [], m.end()
            while k := _JAVA_METHOD.search(bare, inside, end):
                if k[2] in ("if", "for", "while", "switch", "catch", "synchronized", "return", "new"):
                    inside = k.end()
                    continue
                close = _close(bare, k.end() - 1)
                methods.append((k.start() + len(k[0]) - len(k[0].lstrip()), close, k[2], not (k[1] or "").strip()))
                inside = close + 1
            until = methods[0][0] if methods else end + 1
            yield "java_class_declaration", name, _line(text, m.start()), _last(text, until), text[m.start() : until].rstrip()
            for a, z, method, constructor in methods:
                yield "java_constructor" if constructor and method == name else "java_method", f"{name}.{method}", _line(text, a), _line(text, z), text[a : z + 1]
        at = end + 1
    if not found and bare.strip():
        raise ValueError("no type")


_JS = re.compile(r"^(?:export\s+(?:default\s+)?)?(?:(class)\s+(\w+)[^{]*\{|(?:async\s+)?(function)\*?\s+(\w+)\s*\([^)]*\)[^{]*\{|(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>\s*\{|(interface)\s+(\w+)[^{]*\{|(type)\s+(\w+)[^=]*=[^;\n]*;?)", re.M)


def javascript(text: str) -> Iterator[Piece]:
    bare = _blank_strings(text)
    imports = [m.group(0).strip() for m in re.finditer(r"^import\s[^;\n]*;?|^(?:const|let|var)\s+[^=\n]+=\s*require\([^)]*\);?", text, re.M)]
    if imports:
        yield "javascript_imports", "", 1, _line(text, text.index(imports[-1])), "\n".join(imports)
    at, found = 0, bool(imports)
    while m := _JS.search(bare, at):
        found = True
        end = m.end() - 1 if m[8] else _close(bare, m.end() - 1)
        name, body = next(x for x in (m[2], m[4], m[5], m[7], m[9]) if x), text[m.start() : end + 1]
        if m[1]:
            kind = "javascript_component" if re.search(r"extends\s+(?:React\.)?(?:Pure)?Component", body) else "javascript_class"
        elif m[6] or m[8]:
            kind = f"typescript_{m[6] or m[8]}"
        elif re.match(r"use[A-Z]", name):
            kind = "javascript_hook"
        else:
            kind = "javascript_component" if name[0].isupper() and re.search(r"return\s*\(?\s*<|=>\s*<", body) else "javascript_function"
        yield kind, name, _line(text, m.start()), _line(text, end), body
        at = end + 1
    if not found and bare.strip():
        raise ValueError("nothing at top level")


_BLOCK = {"class": r"^[ \t]*(?:pub |public |export )?(?:class|struct|impl|trait|module|type)\s+(\w+)", "function": r"^[ \t]*(?:pub |public |static |async )*(?:func|fn|def|function|sub)\s+(?:\([^)]*\)\s*)?(\w+)"}


def generic_code(text: str) -> Iterator[Piece]:
    """Code of other languages: a line that begins a class or function begins a chunk; what lies before is global."""
    marks = sorted((m.start(), kind, m[1]) for kind, rx in _BLOCK.items() for m in re.finditer(rx, text, re.M) if not m[0][:1].isspace())
    first = marks[0][0] if marks else len(text)
    if text[:first].strip():
        yield "code_global", "", 1, _last(text, first), text[:first].rstrip()
    for (at, kind, name), (end, *_) in zip(marks, [*marks[1:], (len(text),)], strict=True):
        yield f"code_{kind}", name, _line(text, at), _last(text, end), text[at:end].rstrip()


# --- databases --------------------------------------------------------------------------------


def sql_statements(text: str) -> list[tuple[int, str]]:
    """(place, statement): cut at semicolons outside strings, comments and BEGIN … END."""
    bare = _blank_strings(text, "--", quotes="\"'")
    out, start, depth = [], 0, 0
    for m in re.finditer(r"\bBEGIN\b(?!\s*(?:;|TRANSACTION|WORK))|\bCASE\b|\bEND\b|;", bare, re.I):
        word = m[0].upper()
        depth += word in ("BEGIN", "CASE")
        depth -= word == "END" and depth > 0
        if word == ";" and not depth:
            out.append((start, text[start : m.end()]))
            start = m.end()
    out.append((start, text[start:]))
    return [(s + len(t) - len(t.lstrip()), t.strip()) for s, t in out if _blank_strings(t, "--", quotes="").strip(" \n\t;")]


def sql_type(statement: str) -> str:
    m = re.match(r"\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*(WITH|\w+)(?:\s+(?:OR\s+REPLACE\s+)?(\w+))?", statement, re.I | re.S)
    word, second = (m[1] or "").lower(), (m[2] or "").lower() if m else ""
    return "select" if word == "with" else f"{word}_{second}" if word in ("create", "alter", "drop") else word


SQL_CLASSES = {"ddl": ["create", "alter", "drop", "truncate"], "dml": ["select", "insert", "update", "delete", "merge", "with"], "dcl": ["grant", "revoke"], "tcl": ["commit", "rollback", "savepoint", "begin", "start"]}


def sql_facts(statement: str) -> dict:
    """Type, class, tables, joins, CTEs, subqueries, functions and complexity of a statement."""
    bare = _blank_strings(statement, "--", quotes="'")
    kind = sql_type(bare)
    ctes = re.findall(r"(?:\bWITH(?:\s+RECURSIVE)?|,)\s+(\w+)\s+AS\s*\(", bare, re.I)
    tables = [t for t in re.findall(r"\b(?:FROM|JOIN|INTO|UPDATE|TABLE(?:\s+IF\s+NOT\s+EXISTS)?)\s+([\w.]+)", bare, re.I) if t.lower() not in {c.lower() for c in ctes} | {"select", "if"}]
    joins = len(re.findall(r"\bJOIN\b", bare, re.I))
    subqueries = len(re.findall(r"\(\s*SELECT\b", bare, re.I)) - len(ctes)
    conditions = len(re.findall(r"\b(?:AND|OR)\b", bare, re.I))
    functions = sorted({f.upper() for f in re.findall(r"\b(COUNT|SUM|AVG|MIN|MAX|COALESCE|ROW_NUMBER|RANK|UPPER|LOWER|ROUND)\s*\(", bare, re.I)})
    cls = next((c for c, words in SQL_CLASSES.items() if kind.split("_")[0] in words), "other")
    procedural = int(bool(re.search(r"\b(?:PROCEDURE|FUNCTION|TRIGGER)\b", bare, re.I)))
    return {"type": kind, "class": cls, "tables": sorted(set(tables)), "joins": joins, "ctes": ctes, "subqueries": max(0, subqueries), "functions": functions, "complexity": 2 * joins + 3 * max(0, subqueries) + 2 * len(ctes) + conditions + 5 * procedural}


def sql(text: str) -> Iterator[Piece]:
    """A statement a chunk; those in a row that share a table are grouped within the budget."""
    group: list[tuple[int, str, dict]] = []

    def out():
        a, z = _line(text, group[0][0]), _line(text, group[-1][0] + len(group[-1][1]) - 1)
        if len(group) == 1:
            return f"sql_{group[0][2]['type']}", ",".join(group[0][2]["tables"]), a, z, group[0][1]
        return "sql_statement_group", ",".join(sorted({t for *_, f in group for t in f["tables"]})), a, z, merge([s for _, s, _ in group])

    for at, statement in sql_statements(text):
        facts = sql_facts(statement)
        held = {t for *_, f in group for t in f["tables"]}
        if group and not (held & set(facts["tables"]) and sum(tokens_of(s) for _, s, _ in group) + tokens_of(statement) <= BUDGET):
            yield out()
            group = []
        group.append((at, statement, facts))
    if group:
        yield out()


_PLSQL = re.compile(r"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(PACKAGE\s+BODY|PACKAGE|PROCEDURE|FUNCTION|TRIGGER|TYPE\s+BODY|TYPE|VIEW)\s+([\w.]+)", re.I | re.M)
PLSQL_KINDS = {"package": "package_spec", "package body": "package_body_header", "type body": "type_body"}


def plsql(text: str) -> Iterator[Piece]:
    """Objects by their CREATE; what comes before the first is anonymous."""
    marks = [(m.start() + len(m[0]) - len(m[0].lstrip()), " ".join(m[1].lower().split()), m[2]) for m in _PLSQL.finditer(text)]
    first = marks[0][0] if marks else len(text)
    if text[:first].strip():
        yield "plsql_anonymous", "", 1, _line(text, max(0, first - 1)), text[:first].strip()
    for (at, kind, name), (end, *_) in zip(marks, [*marks[1:], (len(text),)], strict=True):
        yield f"plsql_{PLSQL_KINDS.get(kind, kind)}", name, _line(text, at), _line(text, max(at, end - 1)), text[at:end].strip().rstrip("/").rstrip()


# --- configuration and data -------------------------------------------------------------------


def json_text(text: str) -> Iterator[Piece]:
    """A small document whole, package.json by its parts, GeoJSON by features, else keys or elements packed to the budget; JSON Lines in batches."""
    try:
        value = json.loads(text)
    except ValueError:
        rows = []
        for line in text.split("\n"):
            try:
                rows.append(json.loads(line)) if line.strip() else None
            except ValueError:
                continue
        if not rows:
            raise
        yield from _packed("jsonl_batch", [(str(k), json.dumps(r)) for k, r in enumerate(rows)], "\n".join)
        return
    last = text.count("\n") + 1
    if isinstance(value, dict) and value.get("type") == "FeatureCollection":
        yield "geojson_metadata", "", 1, last, json.dumps({k: v for k, v in value.items() if k != "features"})
        yield from _packed("geojson_features", [(str(k), json.dumps(f)) for k, f in enumerate(value.get("features", []))], lambda x: "[" + ",".join(x) + "]")
    elif isinstance(value, dict) and "name" in value and ("dependencies" in value or "devDependencies" in value):
        yield "package_json_main", str(value["name"]), 1, last, json.dumps({k: v for k, v in value.items() if k not in ("dependencies", "devDependencies")})
        for key, kind in (("dependencies", "package_json_dependencies"), ("devDependencies", "package_json_dev_dependencies")):
            if value.get(key):
                yield kind, str(value["name"]), 1, last, json.dumps({key: value[key]})
    elif tokens_of(text) <= BUDGET or not isinstance(value, (dict, list)):
        yield "json_complete", "", 1, last, text
    elif isinstance(value, dict):
        yield from _packed("json_partial", [(k, json.dumps({k: v})) for k, v in value.items()], lambda x: "{" + ",".join(y[1:-1] for y in x) + "}")
    else:
        yield from _packed("json_partial", [(str(k), json.dumps(v)) for k, v in enumerate(value)], lambda x: "[" + ",".join(x) + "]")


def yaml_text(text: str) -> Iterator[Piece]:
    """Documents of a stream; of a document over the budget its top-level keys, packed. Lines alone are read, so anchors and comments stay."""
    documents, held, first = [], [], 1
    for number, line in enumerate(text.split("\n"), 1):
        if re.match(r"---(?:\s|$)", line):
            documents.append((first, held))
            held, first = [], number + 1
        else:
            held.append(line)
    documents.append((first, held))
    documents = [(a, d) for a, d in documents if any(x.strip() for x in d)]
    for a, d in documents:
        body = "\n".join(d)
        kind = (re.findall(r"^kind:\s*(\w+)", body, re.M) or [""])[0]
        label = "yaml_k8s" if kind and re.search(r"^apiVersion:", body, re.M) else "yaml_compose" if re.search(r"^services:", body, re.M) else "yaml_workflow" if re.search(r"^jobs:", body, re.M) and re.search(r"^on:", body, re.M) else "yaml_playbook" if re.search(r"^- +(?:hosts|name):", body, re.M) else "yaml_complete"
        if tokens_of(body) <= BUDGET:
            yield label, kind, a, a + len(d) - 1, body.strip("\n")
            continue
        keys, block, name = [], [], ""
        for line in d:
            if block and re.match(r"[^\s#-]", line):
                keys.append((name, "\n".join(block)))
                block = []
            if m := re.match(r"([^\s#:-][^:]*):", line):
                name = m[1]
            block.append(line)
        keys.append((name, "\n".join(block)))
        yield from _packed("yaml_chunk", keys, "\n".join)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xml_text(text: str) -> Iterator[Piece]:
    """A small document whole; else a header of the root and its children, packed."""
    root = ET.fromstring(text)
    last = text.count("\n") + 1
    if tokens_of(text) <= BUDGET:
        yield "xml_complete", _local(root.tag), 1, last, text
        return
    yield "xml_header", _local(root.tag), 1, 1, f"<{_local(root.tag)}" + "".join(f' {_local(k)}="{v}"' for k, v in root.attrib.items()) + ">"
    yield from _packed("xml_element", [(_local(c.tag), ET.tostring(c, encoding="unicode").strip()) for c in root], "\n".join)


def maven(text: str) -> Iterator[Piece]:
    root = ET.fromstring(text)
    part = lambda e, name: next((c for c in e if _local(c.tag) == name), None)
    value = lambda e, name: (part(e, name).text or "").strip() if part(e, name) is not None else ""
    shown = lambda e: re.sub(r'\s?xmlns(?::\w+)?="[^"]*"', "", re.sub(r"(</?)ns\d+:", r"\1", ET.tostring(e, encoding="unicode"))).strip()
    yield "maven_project_info", value(root, "artifactId"), 0, 0, ":".join(value(root, k) for k in ("groupId", "artifactId", "version"))
    if (p := part(root, "properties")) is not None:
        yield "maven_properties", "", 0, 0, "\n".join(f"{_local(c.tag)}={(c.text or '').strip()}" for c in p)
    if (d := part(root, "dependencies")) is not None:
        scopes: dict[str, list] = {}
        for c in d:
            scopes.setdefault(value(c, "scope") or "compile", []).append(":".join(x for x in (value(c, k) for k in ("groupId", "artifactId", "version")) if x))
        for scope, found in scopes.items():
            yield "maven_dependencies", scope, 0, 0, "\n".join(found)
    if (b := part(root, "build")) is not None and (plugins := part(b, "plugins")) is not None:
        yield "maven_build", ",".join(value(c, "artifactId") for c in plugins), 0, 0, shown(b)
    for c in (part(root, "profiles") if part(root, "profiles") is not None else []):
        yield "maven_profile", value(c, "id"), 0, 0, shown(c)
    if (r := part(root, "repositories")) is not None:
        yield "maven_repositories", ",".join(value(c, "id") for c in r), 0, 0, shown(r)


def properties(text: str) -> Iterator[Piece]:
    """Sections where there are any; else keys by their first name where several share it, the rest together."""
    sections: list[tuple[str, int, list[str]]] = [("", 1, [])]
    for number, line in enumerate(re.sub(r"\\\n\s*", lambda m: "\x00" * m[0].count("\n"), text).split("\n"), 1):
        if m := re.match(r"\s*\[([^\]]+)\]\s*$", line):
            sections.append((m[1], number, [line]))
        else:
            sections[-1][2].append(line.replace("\x00", ""))
    if len(sections) > 1:
        for name, at, lines in sections:
            if any(x.strip() for x in lines):
                yield "properties_section", name, at, at + len(lines) - 1, "\n".join(lines).strip("\n")
        return
    groups: dict[str, list[str]] = {}
    for line in sections[0][2]:
        if line.strip() and line.strip()[0] not in "#!;":
            groups.setdefault(re.split(r"[.=:\s]", line.strip(), maxsplit=1)[0] if "." in re.split(r"[=:\s]", line.strip(), maxsplit=1)[0] else "", []).append(line.strip())
    alone = [x for k, v in groups.items() if k == "" or len(v) == 1 for x in v]
    for name, lines in groups.items():
        if name and len(lines) > 1:
            yield "properties_namespace", name, 0, 0, "\n".join(lines)
    if alone:
        yield "properties_misc", "", 0, 0, "\n".join(alone)


def docker_instructions(text: str) -> list[tuple[int, str, str]]:
    """(line, instruction, arguments), continued lines joined."""
    out, held, first = [], "", 0
    for number, line in enumerate(text.split("\n"), 1):
        if not held and (not line.strip() or line.lstrip().startswith("#")):
            continue
        first = first or number
        held += line.strip()
        if held.endswith("\\"):
            held = held[:-1].rstrip() + " "
            continue
        word, _, rest = held.partition(" ")
        out.append((first, word.upper(), rest.strip()))
        held, first = "", 0
    return out


def docker(text: str) -> Iterator[Piece]:
    """A stage a chunk; the name holds the stage's and what it is from."""
    stages: list[list] = []
    for line, word, rest in docker_instructions(text):
        if word == "FROM":
            m = re.match(r"(\S+)(?:\s+AS\s+(\S+))?", rest, re.I)
            stages.append([f"{m[2] or len(stages)}<{m[1]}", line, line, []])
        elif not stages:
            stages.append(["", line, line, []])
        stages[-1][2] = line
        stages[-1][3].append(f"{word} {rest}")
    for name, a, z, lines in stages:
        yield "dockerfile_stage" if name else "dockerfile_section", name, a, z, "\n".join(lines)


_TF = re.compile(r'^(\w+)((?:\s+"[^"]*")*)\s*\{', re.M)


def terraform_blocks(text: str) -> list[tuple[str, str, str, int, int, list[str]]]:
    """(type, label, name, start, end, addresses that the block refers to)."""
    bare = _blank_strings(text, "#", quotes="")
    out, at = [], 0
    while m := _TF.search(bare, at):
        end = _close(bare, m.end() - 1)
        names = re.findall(r'"([^"]*)"', m[2])
        refs = sorted(set(re.findall(r"\b(?:var|local|module|data\.\w+|aws_\w+|google_\w+|azurerm_\w+)\.\w+", text[m.end() : end])))
        out.append((m[1], names[0] if len(names) > 1 else "", names[-1] if names else "", m.start(), end + 1, refs))
        at = end + 1
    return out


def terraform(text: str) -> Iterator[Piece]:
    """Variables and outputs together, resources by type, other blocks each."""
    groups: dict[tuple[str, str], list] = {}
    for type_, label, name, a, z, _ in terraform_blocks(text):
        kind, key = {"variable": ("terraform_variables", name.split("_")[0] if "_" in name else "general"), "output": ("terraform_outputs", ""), "resource": ("terraform_resources", label), "provider": ("terraform_providers", "")}.get(type_, (f"terraform_{type_}", name))
        groups.setdefault((kind, key), []).append((a, z))
    for (kind, key), spans in groups.items():
        yield kind, key, _line(text, spans[0][0]), _line(text, spans[-1][1] - 1), merge([text[a:z] for a, z in spans])
    if not groups and text.strip():
        raise ValueError("no block")


# --- unknown text -----------------------------------------------------------------------------


def adaptive(text: str) -> Iterator[Piece]:
    """By the commonest of log entries, markup headers, delimited rows, settings and code; else paragraphs, packed."""
    lines = text.split("\n")
    count = lambda rx: sum(bool(re.match(rx, x)) for x in lines)
    delimiter = next((d for d in "\t|;," if len({x.count(d) for x in lines if x.strip()}) == 1 and d in lines[0]), None)
    if count(r"\[?\d{4}-\d{2}-\d{2}[T ]") >= 5:
        part, size, held, first = [], 0, [], 1
        for number, line in enumerate(lines, 1):
            n = tokens_of(line)
            if held and (len(held) == 50 or size + n > 0.8 * BUDGET):
                part.append((first, number - 1, held))
                held, size, first = [], 0, number
            held.append(line)
            size += n
        yield from (("adaptive_log", "", a, z, "\n".join(h)) for a, z, h in [*part, (first, len(lines), held)] if any(x.strip() for x in h))
    elif count(r"#{1,6}\s") >= 1:
        starts = [k for k, x in enumerate(lines) if re.match(r"#{1,6}\s", x)]
        for a, z in zip([0, *starts] if starts[0] else starts, [*(starts if starts[0] else starts[1:]), len(lines)], strict=True):
            body = "\n".join(lines[a:z]).strip("\n")
            if body.strip():
                yield "adaptive_markup", re.sub(r"^#+\s*", "", lines[a]) if re.match(r"#{1,6}\s", lines[a]) else "", a + 1, z, body
    elif delimiter and len(lines) >= 10:
        for a in range(0, len(lines), 100):
            yield "adaptive_data", delimiter, a + 1, min(len(lines), a + 100), "\n".join(lines[a : a + 100])
    elif count(r"\s*[\w.-]+\s*[=:]\s*\S") >= 5:
        yield from (("adaptive_config", name, a, z, t) for _, name, a, z, t in properties(text))
    else:
        parts = [(str(k), p.strip("\n")) for k, p in enumerate(re.split(r"\n\s*\n", text)) if p.strip()]
        yield from _packed("adaptive_paragraph", parts, merge)


CHUNKERS: dict[str, Callable[[str], Iterator[Piece]]] = {
    "python": python, "java": java, "javascript": javascript, "generic_code": generic_code, "sql": sql, "plsql": plsql, "json": json_text, "yaml": yaml_text, "xml": xml_text, "maven": maven,
    "properties": properties, "docker": docker, "terraform": terraform, "adaptive": adaptive,
}
#: Which chunker a file name, else an extension asks for.
BY_NAME = {"pom.xml": "maven", "dockerfile": "docker"}
BY_EXTENSION = {"py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "sql": "sql", "pks": "plsql", "pkb": "plsql", "json": "json", "jsonl": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "properties": "properties", "ini": "properties", "env": "properties", "tf": "terraform", "go": "generic_code", "rs": "generic_code", "rb": "generic_code", "c": "generic_code"}


def register(name: str, chunker: Callable[[str], Iterator[Piece]], extensions: tuple = (), names: tuple = ()) -> None:
    """Add a chunker, or put another in a name's place."""
    CHUNKERS[name] = chunker
    BY_EXTENSION.update(dict.fromkeys(extensions, name))
    BY_NAME.update(dict.fromkeys(names, name))


def unregister(name: str) -> None:
    CHUNKERS.pop(name)
    for table in (BY_EXTENSION, BY_NAME):
        for key in [k for k, v in table.items() if v == name]:
            del table[key]


def chunker_of(path: str) -> str:
    """Name before extension before content."""
    name = path.replace("\\", "/").rpartition("/")[2].lower()
    return BY_NAME.get(name) or BY_EXTENSION.get(name.rpartition(".")[2] if "." in name else "", "adaptive")


def chunk_text(path: str, text: str | None, force: str | None = None, table: dict | None = None) -> list[Piece]:
    """An empty or null text has no chunks."""
    if not text or not text.strip():
        return []
    name = force or chunker_of(path)
    try:
        pieces = list((table or CHUNKERS)[name](text))
    except (ValueError, SyntaxError, RecursionError, ET.ParseError):
        pieces = []
    return pieces or list(fallback(f"{name}_fallback")(text))


def chunk_files(files: DataFrame, path: str = "file_path", content: str = "content", force: str | None = None) -> DataFrame:
    """The chunks of every file; a chunk's id is made of its file's path, its place and its text."""
    ship_code(files.sparkSession)
    schema = pa.schema([("chunk_id", pa.string()), ("file_path", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("tokens", pa.int64()), ("content", pa.string())])
    table = dict(CHUNKERS)

    def run(batches):
        for batch in batches:
            for p, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(hashlib.sha256(f"{p}\0{k}\0{t}".encode("utf-8", "replace")).hexdigest()[:32], p, k, kind, name, a, z, tokens_of(t), t) for k, (kind, name, a, z, t) in enumerate(chunk_text(p or "", text, force, table))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select(path, content).mapInArrow(run, FIELDS)


def merged(chunks: DataFrame, by: str = "file_path") -> DataFrame:
    """A file's chunks as one: texts joined in order, the first kind, the last end."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "kind", "start_line", "end_line", "content")))
    d = chunks.groupBy(by).agg(parts.alias("p"))
    return d.select(by, F.col("p")[0]["kind"].alias("kind"), F.col("p")[0]["start_line"].alias("start_line"), F.array_max(F.col("p.end_line")).alias("end_line"), F.array_join(F.col("p.content"), "\n\n").alias("content"))
