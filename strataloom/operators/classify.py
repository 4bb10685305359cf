"""Files by rules: category, domain, purpose, technologies, importance, flags, and what their content looks like.

Rules are tables of fixed values; each becomes one ordered CASE over path and content, so a classification is one projection.
A null content is none; paths are compared with forward slashes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules in order of precedence (fixed values): extensions, patterns of the path, file names, folders; ``not`` takes back.
CATEGORIES = {
    "source_code": {"extensions": [".py", ".js", ".java", ".cpp", ".c", ".cs", ".go", ".rs", ".rb", ".php"], "patterns": [r"\.(?:py|js|java|cpp|c|cs|go|rs|rb|php)$"], "not": [r"test", r"spec", r"_test\.", r"\.test\."]},
    "test_code": {"extensions": [".py", ".js", ".java", ".cpp", ".cs", ".go"], "patterns": [r"test_.*\.py$", r".*_test\.py$", r".*\.test\.js$", r".*\.spec\.js$", r".*Test\.java$", r".*_test\.go$"], "paths": ["/test/", "/tests/", "/spec/", "/__tests__/"]},
    "configuration": {"extensions": [".json", ".yaml", ".yml", ".ini", ".cfg", ".conf", ".properties", ".env"], "patterns": [r"\.(?:json|ya?ml|ini|cfg|conf|properties|env)$"], "filenames": ["config.json", "settings.py", "application.properties", ".env"]},
    "documentation": {"extensions": [".md", ".rst", ".txt", ".adoc"], "patterns": [r"\.(?:md|rst|txt|adoc)$"], "filenames": ["README.md", "CHANGELOG.md", "CONTRIBUTING.md", "LICENSE"]},
    "build_script": {"extensions": [".gradle", ".xml", ".yml"], "filenames": ["pom.xml", "build.gradle", "package.json", "Makefile", "setup.py"], "patterns": [r"build\.", r"setup\."]},
    "database": {"extensions": [".sql", ".ddl", ".dml"], "patterns": [r"\.(?:sql|ddl|dml)$", r"migration", r"schema"], "paths": ["/migrations/", "/db/", "/database/", "/sql/"]},
    "deployment": {"extensions": [".dockerfile", ".yml", ".yaml"], "filenames": ["Dockerfile", "docker-compose.yml", "k8s.yaml", ".gitlab-ci.yml"], "patterns": [r"Dockerfile", r"\.dockerfile$", r"deployment\.ya?ml$"]},
}
#: Layers: folders, words of the file name, extensions (fixed values).
DOMAINS = {
    "presentation": {"keywords": ["view", "template", "ui", "frontend", "component", "page", "screen"], "paths": ["/views/", "/templates/", "/frontend/", "/ui/", "/components/", "/pages/"], "extensions": [".jsx", ".tsx", ".vue", ".html", ".css", ".scss"]},
    "application": {"keywords": ["service", "controller", "handler", "manager", "processor", "business"], "paths": ["/services/", "/controllers/", "/handlers/", "/business/", "/application/"]},
    "domain": {"keywords": ["model", "entity", "domain", "core", "aggregate"], "paths": ["/models/", "/entities/", "/domain/", "/core/"]},
    "infrastructure": {"keywords": ["repository", "dao", "adapter", "gateway", "client"], "paths": ["/infrastructure/", "/repositories/", "/adapters/", "/persistence/"]},
    "testing": {"keywords": ["test", "spec", "mock", "fixture", "stub"], "paths": ["/test/", "/tests/", "/spec/", "/__tests__/"]},
    "security": {"keywords": ["auth", "security", "crypto", "permission", "role", "jwt", "oauth"], "paths": ["/auth/", "/security/", "/permissions/"]},
    "integration": {"keywords": ["api", "rest", "graphql", "grpc", "webhook", "integration"], "paths": ["/api/", "/integration/", "/webhooks/"]},
}
#: Purposes: file names, patterns of the content, two words of the content (fixed values).
PURPOSES = {
    "main_entry": {"filenames": ["main.py", "app.py", "index.js", "server.js", "Main.java", "Program.cs"], "patterns": [r"__main__", r"if __name__", r"main\s*\(", r"app\.listen"]},
    "api_endpoint": {"patterns": [r"@app\.route", r"@router\.", r"@RequestMapping", r"@GetMapping", r"@PostMapping", r"router\.get", r"router\.post"], "keywords": ["endpoint", "route", "api", "rest"]},
    "model": {"patterns": [r"class.*Model", r"@Entity", r"@Table", r"Schema\s*=", r"model\.Model"], "keywords": ["model", "entity", "schema"]},
    "service": {"patterns": [r"class.*Service", r"@Service", r"@Injectable"], "keywords": ["service", "business", "logic"]},
    "controller": {"patterns": [r"class.*Controller", r"@Controller", r"@RestController"], "keywords": ["controller", "handler"]},
    "repository": {"patterns": [r"class.*Repository", r"@Repository", r"class.*DAO"], "keywords": ["repository", "dao", "persistence"]},
    "unit_test": {"patterns": [r"test_", r"_test\.", r"\.test\.", r"\.spec\.", r"@Test", r"describe\("], "keywords": ["test", "spec", "should", "expect", "assert"]},
    "migration": {"patterns": [r"migration", r"migrate", r"upgrade\(\)", r"downgrade\(\)"], "keywords": ["migration", "upgrade", "downgrade"]},
    "component": {"patterns": [r"Component\(", r"extends Component", r"React\.Component", r"@Component"], "keywords": ["component", "widget"]},
}
#: What a file name says where its content says nothing, in order (fixed values).
PURPOSE_NAMES = [
    (["test", "spec"], "unit_test"), (["model"], "model"), (["service"], "service"), (["controller"], "controller"), (["repository", "dao"], "repository"), (["util", "helper"], "utility"), (["config", "settings"], "app_config"), (["migration"], "migration"),
    (["component"], "component"), (["interface"], "interface"), (["exception", "error"], "exception"), (["constant", "enum"], "constant"), (["middleware"], "middleware"),
]
#: Technologies (fixed values).
TECHNOLOGIES = {
    "python": {"extensions": [".py", ".pyw"], "patterns": [r"import\s+\w+", r"from\s+\w+\s+import"], "keywords": ["python", "pip", "poetry"]},
    "django": {"patterns": [r"from\s+django", r"INSTALLED_APPS", r"models\.Model"], "filenames": ["manage.py", "settings.py", "urls.py"]},
    "react": {"patterns": [r"import\s+React", r"from\s+['\"]react['\"]", r"useState", r"useEffect"], "extensions": [".jsx", ".tsx"]},
    "spring": {"patterns": [r"@SpringBootApplication", r"@Autowired", r"import\s+org\.springframework"], "filenames": ["application.properties", "application.yml"]},
    "docker": {"filenames": ["Dockerfile", "docker-compose.yml", ".dockerignore"], "patterns": [r"FROM\s+\w+", r"RUN\s+", r"COPY\s+", r"EXPOSE\s+"]},
    "kubernetes": {"patterns": [r"apiVersion:", r"kind:\s*(?:Pod|Service|Deployment|ConfigMap)"], "keywords": ["kubernetes", "k8s", "kubectl"]},
    "terraform": {"extensions": [".tf", ".tfvars"], "patterns": [r"resource\s+\"", r"provider\s+\"", r"module\s+\""]},
}
BASES = {"django": "python", "react": "javascript", "spring": "java"}
#: Scores by purpose and by file name, and the most that a category may have (fixed values).
PURPOSE_SCORES = {"main_entry": 5.0, "api_endpoint": 4.5, "model": 4.0, "service": 4.0, "controller": 3.5, "repository": 3.5, "app_config": 3.5, "migration": 3.0, "unit_test": 2.5, "component": 3.0, "utility": 2.0, "generated": 1.0, "vendor": 1.0}
NAME_SCORES = {"main.py": 5.0, "app.py": 5.0, "index.js": 5.0, "Main.java": 5.0, "settings.py": 4.0, "config.py": 4.0, "package.json": 3.5, "requirements.txt": 3.0, "README.md": 2.5}
CATEGORY_MOST = {"test_code": 2.5, "vendor": 1.5, "generated": 1.5, "documentation": 2.5, "temporary": 1.0}
#: Folders of other people's code, marks of generated files (fixed values).
VENDOR = ["/vendor/", "/node_modules/", "/bower_components/", "/lib/", "/libs/", "/third_party/", "/third-party/", "/external/", "/packages/", "/.bundle/", "/site-packages/"]
GENERATED = ["auto-generated", "autogenerated", "automatically generated", "do not edit", "do not modify", "<autogenerated />", "@generated"]
TEST_SIGNS = ["@Test", "@test", "unittest", "pytest", "describe(", "it(", "test(", "expect(", "assert", "should", "TestCase"]


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def suffix_of(path: Column) -> Column:
    """With its dot, lower case; of a name that only begins with a dot none."""
    return F.lower(F.regexp_extract(name_of(path), r"[^.](\.[^.]+)$", 1))


def _any(parts: list) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def _holds(text: Column, words: list[str]) -> Column:
    return _any([F.contains(text, F.lit(w)) for w in words])


def _matches(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def category(path: Column, content: Column) -> Column:
    low, name, ext = F.lower(slashed(path)), name_of(path), suffix_of(path)
    out = F.when(F.lit(False), "")
    for label, rule in CATEGORIES.items():
        hit = ext.isin(rule["extensions"]) | _matches(low, rule.get("patterns", []))
        if "not" in rule:
            hit = hit & ~_matches(low, rule["not"])
        out = out.when(hit | name.isin(rule.get("filenames", [""])) | _holds(low, rule.get("paths", [])), label)
    out = out.when(_holds(content, ["test_", "@Test", "describe(", "it("]), "test_code").when(_holds(F.upper(content), ["SELECT", "INSERT", "CREATE TABLE"]), "database")
    out = out.when(_holds(low, ["/vendor/", "/node_modules/", "/lib/", "/libs/"]), "vendor").when(ext.isin(".log", ".out", ".err"), "log").when(ext.isin(".bak", ".backup", ".old") | F.contains(name, F.lit("~")), "backup")
    return out.when(ext.isin(".tmp", ".temp", ".swp") | name.startswith("."), "temporary").otherwise("unknown")


def _first_best(scores: dict[str, Column]) -> Column:
    """The label of the highest score above 0, the first on a tie; else null."""
    best = F.greatest(*scores.values())
    out = F.when(best <= 0, F.lit(None).cast("string"))
    for label, score in scores.items():
        out = out.when(score == best, label)
    return out


def domain(path: Column, content: Column) -> Column:
    low, name, ext = F.lower(slashed(path)), F.lower(name_of(path)), suffix_of(path)
    out = F.when(F.lit(False), "")
    for label, rule in DOMAINS.items():
        out = out.when(_holds(low, rule["paths"]) | _holds(name, rule["keywords"]) | ext.isin(rule.get("extensions", [""])) & (ext != ""), label)
    text = F.lower(F.coalesce(content, F.lit("")))
    scores = {label: sum((F.contains(text, F.lit(w)).cast("int") for w in rule["keywords"]), F.lit(0)) for label, rule in DOMAINS.items()}
    return out.otherwise(F.coalesce(_first_best(scores), F.lit("unknown")))


def purpose(path: Column, content: Column) -> Column:
    name, text = name_of(path), F.coalesce(content, F.lit(""))
    out = F.when(F.lit(False), "")
    for label, rule in PURPOSES.items():
        out = out.when(name.isin(rule.get("filenames", [""])), label)
    for label, rule in PURPOSES.items():
        words = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in rule.get("keywords", [])), F.lit(0))
        out = out.when(_matches(text, rule["patterns"]) | (words >= 2), label)
    for words, label in PURPOSE_NAMES:
        out = out.when(_holds(F.lower(name), words), label)
    return out.otherwise("unknown")


def technologies(path: Column, content: Column) -> Column:
    """Sorted array."""
    name, ext, text = name_of(path), suffix_of(path), F.coalesce(content, F.lit(""))
    found = {}
    for label, rule in TECHNOLOGIES.items():
        found[label] = ext.isin(rule.get("extensions", ["."])) | name.isin(rule.get("filenames", [""])) | _matches(text, rule["patterns"]) | _holds(F.lower(text), rule.get("keywords", []))
    base = F.when(F.lit(False), "")
    for label, language in BASES.items():
        base = base.when(found[label], language)
    out = F.array_distinct(F.array_compact(F.array(*(F.when(hit, label) for label, hit in found.items()), base)))
    return F.when(F.size(out) == 0, F.array(F.lit("unknown"))).otherwise(F.array_sort(out))


def importance(path: Column, content: Column, category_: Column, domain_: Column, purpose_: Column) -> Column:
    """critical, high, medium, low or minimal."""
    lookup = lambda table, key, other: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), other)
    score = F.least(lookup(PURPOSE_SCORES, purpose_, F.lit(3.0)), lookup(CATEGORY_MOST, category_, F.lit(9.0)))
    score = score + F.when(domain_ == "domain", 0.5).when(domain_ == "infrastructure", -0.5).otherwise(0.0)
    score = F.greatest(score, lookup(NAME_SCORES, name_of(path), F.lit(0.0)))
    text = F.coalesce(content, F.lit(""))
    score = score + F.when(F.length(text) > 10_000, 0.5).otherwise(0.0) + F.when(F.regexp_count(text, F.lit("import |from ")) > 20, 0.5).otherwise(0.0)
    return F.when(score >= 4.5, "critical").when(score >= 3.5, "high").when(score >= 2.5, "medium").when(score >= 1.5, "low").otherwise("minimal")


def is_test(path: Column, content: Column) -> Column:
    """The name's patterns are held against its lower case, so those with a capital never meet it."""
    name = F.lower(name_of(path))
    return _holds(F.lower(slashed(path)), ["/test/", "/tests/", "/spec/", "/__tests__/", "/test_"]) | name.rlike(r"^(?:test_.*\.py|.*_test\.py|.*\.test\.\w+|.*\.spec\.\w+)$") | _holds(content, TEST_SIGNS)


def is_generated(path: Column, content: Column) -> Column:
    first = F.lower(F.array_join(F.slice(F.split(F.coalesce(content, F.lit("")), "\n"), 1, 10), "\n"))
    return F.lower(name_of(path)).rlike(r"^.*\.(?:generated|g|pb|min)\.\w+$") | _holds(first, GENERATED)


def is_vendor(path: Column) -> Column:
    return _holds(F.lower(slashed(path)), VENDOR)


def sniff(content: Column) -> Column:
    """The chunker that the content asks for, by the first of ordered signs; null without any."""
    text, up = F.coalesce(content, F.lit("")), F.upper(F.coalesce(content, F.lit("")))
    bare = F.trim(F.regexp_replace(text, r"^\s+", ""))
    out = F.when(_holds(up, ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE TABLE", "ALTER TABLE", "DROP TABLE"]), "sql")
    out = out.when(_holds(up, ["CREATE OR REPLACE PROCEDURE", "CREATE OR REPLACE FUNCTION", "CREATE PACKAGE", "DECLARE", "BEGIN", "END;"]), "plsql")
    out = out.when(_holds(text, ['resource "', 'provider "', 'module "']), "terraform").when(text.startswith("FROM ") | _holds(text, ["RUN ", "COPY "]), "docker")
    out = out.when((bare.startswith("---") | F.contains(text, F.lit(": "))) & ~bare.rlike(r"^[\[{<]"), "yaml")
    out = out.when(bare.rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull(), "json")
    out = out.when(bare.startswith("<") & F.contains(text, F.lit(">")), "xml")
    return out.when(_holds(text, ["import ", "function ", "class ", "def ", "public ", "private ", "const ", "var ", "let ", "return "]), "generic_code")


#: Patterns of code smells and risks: name, regular expression, severity, confidence, extensions or None for all (fixed values).
PATTERNS = [
    ("sql_injection", r"query\s*=\s*[\"'].*\+.*[\"']", "critical", 0.8, None),
    ("sql_injection", r"execute\([\"'].*%\s*[\"'].*%\s*\(", "critical", 0.8, None),
    ("sql_injection", r"f[\"'](?:SELECT|INSERT|UPDATE|DELETE).*\{", "critical", 0.8, None),
    ("hardcoded_credentials", r"(?i)(?:password|passwd|pwd)\s*=\s*[\"'][^\"']{6,}[\"']", "critical", 0.7, None),
    ("hardcoded_credentials", r"(?i)(?:api[_-]?key|apikey)\s*=\s*[\"'][^\"']{10,}[\"']", "critical", 0.7, None),
    ("hardcoded_credentials", r"(?i)(?:secret|token)\s*=\s*[\"'][^\"']{10,}[\"']", "critical", 0.7, None),
    ("xss", r"innerHTML\s*=.*(?:\+|`)", "critical", 0.7, [".js", ".ts"]),
    ("xss", r"document\.write\([^)]*(?:\+|`)", "critical", 0.7, [".js", ".ts"]),
    ("xss", r"eval\([^)]*(?:user|input|request)", "critical", 0.7, [".js", ".ts"]),
    ("magic_number", r"(?<![\"'])\b(?!0|1|2|10|100|1000)\d{2,}\b(?![\"'])", "low", 0.7, None),
    ("todo", r"(?:#|//|/\*)\s*(?:TODO|FIXME|HACK|XXX|BUG)[\s:]+.+", "low", 1.0, None),
]
PLACEHOLDERS = ["example", "your_", "xxx", "***", "change_me", "placeholder"]
PENALTY = {"critical": 20, "high": 10, "medium": 5, "low": 2}


def _hit(text: Column, name: str, severity: str, confidence: float):
    def hit(h: Column) -> Column:
        line = F.size(F.split(F.substring(text, F.lit(1), F.instr(text, h) - 1), "\n"))
        shown = F.regexp_replace(h, r"[\"'][^\"']+[\"']", '"***"') if name == "hardcoded_credentials" else h
        return F.struct(F.lit(name).alias("pattern"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), line.alias("line"), shown.alias("snippet"))

    return hit


def pattern_hits(df, path: str, content: str):
    """(path, pattern, severity, confidence, line, snippet) of every place where a pattern stands; credentials that are placeholders don't count, others are blotted out. Equal matches of a file have the first one's line."""
    ext, text = suffix_of(F.col(path)), F.coalesce(F.col(content), F.lit(""))
    found = []
    for name, rx, severity, confidence, extensions in PATTERNS:
        hits = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
        if extensions:
            hits = F.when(ext.isin(extensions), hits).otherwise(F.array().cast("array<string>"))
        if name == "hardcoded_credentials":
            hits = F.filter(hits, lambda h: ~F.lower(h).rlike("|".join(map(re.escape, PLACEHOLDERS))))
        found.append(F.transform(hits, _hit(text, name, severity, confidence)))
    return df.select(path, F.explode(F.concat(*found)).alias("h")).select(path, "h.*")


def quality_score(critical: Column, high: Column, medium: Column, low: Column, cyclomatic: Column, nesting: Column, comments: Column) -> Column:
    score = 100.0 - 20 * critical - 10 * high - 5 * medium - 2 * low - F.when(cyclomatic > 20, 10).when(cyclomatic > 10, 5).otherwise(0) - F.when(nesting > 5, 5).otherwise(0) + F.when(comments.between(0.1, 0.3), 5).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
