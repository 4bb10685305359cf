"""Queries of text measures, information theory and line windows, each computed in a text's row where it can be."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import information as info
from .functions import text as tx
from .operators import corpus
from .registered import expected, query

_W = "list_filter(regexp_split_to_array(lower(text), '[^0-9\\p{L}_]+'), lambda x: x <> '')"
_WORDS = "(SELECT doc_id, text, " + _W + " AS w, string_split(text, chr(10)) AS l FROM documents)"
_SIGNS = " + ".join(f"contains(text, '{s}')::INT" for s in tx.CODE_SIGNS)
_BRANCHES = "|".join(tx.BRANCHES)
_CYCLOMATIC = f"(1 + len(regexp_extract_all(text, '\\b(?:{_BRANCHES})\\b')))"


def r6(c):
    return F.round(c, 6)


def _removed(chars: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '{chars}', '', 'g')))"


@query(f"SELECT doc_id, ({_SIGNS}) >= 2 AS code FROM documents")
def doc_looks_like_code(t) -> DataFrame:
    return t("documents").select("doc_id", tx.looks_like_code(F.col("text")).alias("code"))


@query(f"SELECT doc_id, CAST({_CYCLOMATIC} AS BIGINT) AS cyclomatic, round(greatest(0.0, 100 - 0.5 * {_CYCLOMATIC} - 0.5 * greatest(0, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) - 20)), 2)::DOUBLE AS maintainability FROM documents")
def doc_maintainability(t) -> DataFrame:
    return t("documents").select("doc_id", tx.cyclomatic(F.col("text")).alias("cyclomatic"), tx.maintainability(F.col("text")).alias("maintainability"))


@query(f"""SELECT doc_id, length(text) AS chars, len(w) AS words, len(l) AS lines, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_matches(x, '\\S'))) AS paragraphs,
round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1), 6) AS word_length, round({_removed('[A-Z]')} / greatest(length(text), 1), 6) AS upper, round({_removed('[a-z]')} / greatest(length(text), 1), 6) AS lower,
round({_removed('[0-9]')} / greatest(length(text), 1), 6) AS digits, round({_removed('[!-/:-@\\[-`{-~]')} / greatest(length(text), 1), 6) AS punctuation, round({_removed('[ \\t\\n\\r]')} / greatest(length(text), 1), 6) AS spaces, round(len(list_distinct(w)) / greatest(len(w), 1), 6) AS ttr FROM {_WORDS}""")
def doc_text_statistics(t) -> DataFrame:
    x = F.col("text")
    n, w = F.greatest(F.length(x), F.lit(1)), tx.words(x)
    share = lambda chars: r6(tx.count_of(x, chars) / n)
    letters = F.length(F.regexp_replace(F.lower(x), r"[^0-9\p{L}_]+", ""))
    return t("documents").select(
        "doc_id", F.length(x).cast("long").alias("chars"), tx.word_count(x).cast("long").alias("words"), F.size(tx.lines(x)).cast("long").alias("lines"), F.size(F.filter(F.split(x, r"\n\s*\n"), lambda p: p.rlike(r"\S"))).cast("long").alias("paragraphs"),
        r6(letters / F.greatest(tx.word_count(x), F.lit(1))).alias("word_length"), share("[A-Z]").alias("upper"), share("[a-z]").alias("lower"), share("[0-9]").alias("digits"), share(tx.PUNCTUATION).alias("punctuation"), share(r"[ \t\n\r]").alias("spaces"), r6(F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))).alias("ttr"),
    )


@query("""SELECT doc_id, strlen(text) AS size, len(l) AS lines, round(list_sum(list_transform(l, lambda x: length(x))) / len(l), 6) AS avg_line, list_max(list_transform(l, lambda x: length(x))) AS longest, round(len(list_filter(l, lambda x: NOT regexp_matches(x, '\\S'))) / len(l), 6) AS empty_share,
round(CASE WHEN len(list_distinct(string_split(text, ''))) > 1 THEN list_aggregate(string_split(text, ''), 'entropy') / log2(len(list_distinct(string_split(text, '')))) ELSE 0 END, 6) AS normalised FROM """ + _WORDS)
def doc_content_features(t) -> DataFrame:
    x, lines = F.col("text"), tx.lines(F.col("text"))
    lengths = F.transform(lines, F.length)
    return t("documents").select(
        "doc_id", F.octet_length(x).cast("long").alias("size"), F.size(lines).cast("long").alias("lines"), r6((F.length(x) - F.size(lines) + 1) / F.size(lines)).alias("avg_line"), F.array_max(lengths).cast("long").alias("longest"),
        r6(F.size(F.filter(lines, lambda l: ~l.rlike(r"\S"))) / F.size(lines)).alias("empty_share"), r6(info.normalised_entropy(x)).alias("normalised"),
    )


#: Probes that both engines' regular expressions spell alike.
PROBES = {
    "header": r"(?m)^#{1,6}\s", "function_like": r"\b(def|function|func)\s+\w+", "class_like": r"\bclass\s+\w+", "import_like": r"\b(import|include|require)\b", "comment": r"(?m)^\s*(#|//|/\*|--)", "docstring": r"\"\"\"", "url": r"https?://[^\s]+",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "path": r"(/[A-Za-z0-9_.-]+){2,}", "timestamp": r"\d{4}-\d{2}-\d{2}", "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "json_ends": r"^\s*[\[{](?s:.*)[\]}]\s*$", "xml_start": r"^\s*<\?xml", "yaml_key": r"(?m)^\w+:\s", "sql_word": r"\b(SELECT|INSERT|UPDATE|DELETE|CREATE)\b", "html_tag": r"<[a-zA-Z][^>]*>",
}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{rx}') AS {name}" for name, rx in PROBES.items()) + " FROM documents")
def doc_probes(t) -> DataFrame:
    return t("documents").select("doc_id", *(F.col("text").rlike(rx).alias(name) for name, rx in PROBES.items()))


_GRAMS = "list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
_STOP = ["the", "and", "for", "that", "with", "this", "from", "are", "was", "der", "die", "und", "les", "des", "que"]


@query(f"WITH d AS (SELECT doc_id, list_filter({_W}, lambda x: length(x) > 2 AND NOT list_contains(['" + "', '".join(_STOP) + f"'], x)) AS w FROM documents), g AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest({_GRAMS}) AS gram FROM d) GROUP BY ALL) SELECT doc_id, gram, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM g) WHERE rank <= 10")
def doc_keywords(t) -> DataFrame:
    """The ten commonest words and pairs of words of each text, stop-words left out."""
    w = F.filter(tx.words(F.col("text")), lambda x: (F.length(x) > 2) & ~x.isin(_STOP))
    return corpus.top_grams(t("documents"), "doc_id", w)


def _tokens(more: str) -> str:
    return "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))" + "".join(f" + {_removed(c)}" for c in more)


@query(f"SELECT doc_id, CAST(floor(1.5 * ({_tokens('')})) AS BIGINT) AS repository, strlen(text) // 4 AS json_size, CAST({_tokens(',:')} AS BIGINT) AS json_words, CAST({_tokens('<>')} AS BIGINT) AS xml, CAST({_tokens(':')} + {_removed('-')} AS BIGINT) AS yaml FROM documents")
def doc_token_estimates(t) -> DataFrame:
    x = F.col("text")
    n = F.regexp_count(x, F.lit(r"\S+"))
    return t("documents").select("doc_id", F.floor(1.5 * n).cast("long").alias("repository"), F.floor(F.octet_length(x) / 4).cast("long").alias("json_size"), (n + tx.count_of(x, "[,:]")).cast("long").alias("json_words"), (n + tx.count_of(x, "[<>]")).cast("long").alias("xml"), (n + tx.count_of(x, "[:-]")).cast("long").alias("yaml"))


@query("SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(l)) AS BIGINT) AS total, CAST(sum(len(list_filter(l, lambda x: NOT regexp_matches(x, '\\S')))) AS BIGINT) AS blank, CAST(sum(len(list_filter(l, lambda x: regexp_matches(x, '^\\s*#')))) AS BIGINT) AS comments FROM (SELECT source, text, string_split(text, chr(10)) AS l FROM documents) GROUP BY 1")
def repo_line_totals(t) -> DataFrame:
    c = tx.line_classes(F.col("text"), "sh")
    return t("documents").select("source", F.octet_length("text").alias("b"), c.alias("c")).groupBy("source").agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), *(F.sum(F.col(f"c.{k}").cast("long")).alias(k) for k in ("total", "blank", "comments")))


_EST = "CAST(floor((len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 0.75 + length(text) / 4) / 2) AS BIGINT)"


@query(f"SELECT source, count(*) AS files, CAST(sum(greatest(1, tok // 400)) AS BIGINT) AS chunks, round(avg(greatest(1, tok // 400)), 6) AS mean FROM (SELECT source, {_EST} AS tok FROM documents) GROUP BY 1")
def chunk_estimates_by_source(t) -> DataFrame:
    n = F.greatest(F.lit(1), F.floor(tx.token_estimate(F.col("text")) / 400)).cast("long")
    return t("documents").select("source", n.alias("n")).groupBy("source").agg(F.count("*").alias("files"), F.sum("n").alias("chunks"), r6(F.avg("n")).alias("mean"))


@query(f"SELECT lang, round(least(1.0, greatest(0.0, avg(round(greatest(0.0, 100 - 0.5 * {_CYCLOMATIC} - 0.5 * greatest(0, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) - 20)), 2)) / 100)), 6) AS quality FROM documents GROUP BY 1")
def quality_rollup(t) -> DataFrame:
    return t("documents").groupBy("lang").agg(F.avg(tx.maintainability(F.col("text"))).alias("m")).select("lang", r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("m") / 100))).alias("quality"))


@query(f"SELECT doc_id, n_tokens, CASE WHEN n_tokens < 50 THEN 'few tokens' WHEN n_tokens > 450 THEN 'many tokens' ELSE '' END AS tokens_issue, CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) > 4000 THEN 'long' ELSE '' END AS length_issue, n_tokens BETWEEN 50 AND 450 AND length(text) BETWEEN 100 AND 4000 AND regexp_matches(text, '\\S') AS valid FROM (SELECT doc_id, text, {_EST} AS n_tokens FROM documents)")
def chunk_validation(t) -> DataFrame:
    n, x = F.col("n_tokens"), F.col("text")
    d = t("documents").select("doc_id", "text", tx.token_estimate(x).alias("n_tokens"))
    return d.select("doc_id", "n_tokens", F.when(n < 50, "few tokens").when(n > 450, "many tokens").otherwise("").alias("tokens_issue"), F.when(F.length(x) < 100, "short").when(F.length(x) > 4000, "long").otherwise("").alias("length_issue"), (n.between(50, 450) & F.length(x).between(100, 4000) & x.rlike(r"\S")).alias("valid"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS snippet FROM documents")
def doc_snippets(t) -> DataFrame:
    return t("documents").select("doc_id", F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("snippet"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, md5(substring(text, 1, 100)) AS prefix FROM documents")
def doc_checksums(t) -> DataFrame:
    return t("documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.md5(F.substring("text", 1, 100)).alias("prefix"))


_SECRET = r"(password|token|secret|api_key)(\s*[=:]\s*)([\x22\x27][^\x22\x27]*[\x22\x27]|[^\s]+)"


@query(f"SELECT doc_id, regexp_replace(text, '{_SECRET}', '\\1\\2***', 'g') AS redacted FROM documents WHERE regexp_matches(text, '{_SECRET}')")
def secret_redaction(t) -> DataFrame:
    return t("documents").filter(F.col("text").rlike(_SECRET)).select("doc_id", F.regexp_replace("text", _SECRET, "$1$2***").alias("redacted"))


_C = "string_split(text, '')"
_SHARES = f"list_transform(map_values(list_histogram({_C})), lambda n: n / length(text))"


_BIGRAMS = "list_transform(range(1, length(text)), lambda i: substring(text, i, 2))"
_FIRSTS = "list_transform(range(1, length(text)), lambda i: substring(text, i, 1))"


@query(f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE 1 / (1 + 100 * list_aggregate({_SHARES}, 'var_pop')) END, 6) AS uniformity, round(coalesce(list_aggregate({_BIGRAMS}, 'entropy') - list_aggregate({_FIRSTS}, 'entropy'), 0), 5) + 0.0 AS conditional FROM documents")
def doc_information(t) -> DataFrame:
    x = F.col("text")
    return t("documents").select("doc_id", r6(info.uniformity(x)).alias("uniformity"), (F.round(info.conditional_entropy(x), 5) + 0.0).alias("conditional"))


_TOTAL = "SELECT lang, c, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) GROUP BY ALL"


@query(f"WITH p AS (SELECT lang, c, n / sum(n) OVER (PARTITION BY lang) AS p FROM ({_TOTAL})), q AS (SELECT c, sum(n) / sum(sum(n)) OVER () AS q FROM ({_TOTAL}) GROUP BY c) SELECT lang, round(sum(p * log2(p / greatest(q, 1e-10))), 6) AS divergence, round(-sum(p * log2(p)), 6) AS entropy FROM p JOIN q USING (c) GROUP BY lang")
def lang_divergence(t) -> DataFrame:
    """Kullback-Leibler divergence of each language's characters from those of all texts; counts are summed in the row before they are shuffled."""
    counted = t("documents").select("lang", F.explode(F.array_distinct(info.characters(F.col("text")))).alias("c"), "text").select("lang", "c", (F.length("text") - F.length(F.replace(F.col("text"), F.col("c"), F.lit("")))).alias("n"))
    n = counted.groupBy("lang", "c").agg(F.sum("n").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    all_ = n.groupBy("c").agg(F.sum("n").alias("m"))
    total = all_.agg(F.sum("m").alias("total"))
    q = all_.join(F.broadcast(total)).select("c", (F.col("m") / F.col("total")).alias("q"))  # total: one row
    return p.join(q, "c").groupBy("lang").agg(r6(F.sum(F.col("p") * F.log2(F.col("p") / F.greatest("q", F.lit(1e-10))))).alias("divergence"), r6(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


@query("WITH a AS (SELECT doc_id, text FROM documents), j AS (SELECT x.doc_id, x.text AS s, y.text AS u FROM a x JOIN a y ON y.doc_id = x.doc_id + 1) SELECT doc_id, round(joint, 6) AS joint, round(hs + hu - joint, 6) AS mutual FROM (SELECT doc_id, list_aggregate(string_split(s || u, ''), 'entropy') AS joint, list_aggregate(string_split(s, ''), 'entropy') AS hs, list_aggregate(string_split(u, ''), 'entropy') AS hu FROM j)")
def neighbour_information(t) -> DataFrame:
    """Entropy of a text and the next one joined, and what the two have in common by it; a text's characters are counted before it is shuffled."""
    d = t("documents").select("doc_id", info.profile(F.col("text")).alias("p"))
    j = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("q")), "doc_id")
    j = j.select("doc_id", (F.col("p.bits") + F.col("q.bits")).alias("apart"), info.joint_entropy(F.col("p"), F.col("q")).alias("joint"))
    return j.select("doc_id", r6("joint").alias("joint"), r6(F.col("apart") - F.col("joint")).alias("mutual"))


_L = "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"SELECT doc_id, i, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS BIGINT) AS start FROM ({_L})")
def line_offsets(t) -> DataFrame:
    """Where each line begins."""
    d = t("documents").select("doc_id", F.posexplode(F.transform(tx.lines(F.col("text")), lambda l: F.length(l) + 1)).alias("i", "n"))
    return d.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), (F.sum("n").over(Window.partitionBy("doc_id").orderBy("i")) - F.col("n")).cast("long").alias("start"))


@query("SELECT doc_id, i, round(CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END, 6) AS entropy FROM (SELECT doc_id, i, list_aggregate(string_split(s, ''), 'entropy') AS h, len(list_distinct(string_split(s, ''))) AS k FROM (SELECT doc_id, i, array_to_string(list_slice(l, greatest(1, i - 49), i), chr(10)) AS s FROM (SELECT doc_id, l, unnest(range(25, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))")
def line_window_entropy(t) -> DataFrame:
    """Normalised entropy of the up to 50 lines that end at each line, from the 25th on."""
    return info.line_windows(t("documents"), "doc_id", "text").select("doc_id", "i", r6("entropy").alias("entropy"))


@query(f"SELECT doc_id, i, first FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, h) AS first, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS k FROM (SELECT doc_id, i, md5(line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w || chr(10) || lead(line, 3) OVER w || chr(10) || lead(line, 4) OVER w) AS h FROM ({_L}) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE h IS NOT NULL) WHERE k > 1")
def duplicate_line_blocks(t) -> DataFrame:
    """Runs of five lines that stood in the text before, with the line where they first began."""
    d = t("documents").select("doc_id", tx.lines(F.col("text")).alias("l")).filter("size(l) >= 5")
    blocks = F.transform(F.sequence(F.lit(1), F.size("l") - 4), lambda i: F.md5(F.array_join(F.slice("l", i, F.lit(5)), "\n")))
    h = d.select("doc_id", F.posexplode(blocks).alias("i", "h")).select("doc_id", (F.col("i") + 1).alias("i"), "h")
    by = Window.partitionBy("doc_id", "h")
    return h.select("doc_id", F.col("i").cast("long").alias("i"), F.min("i").over(by).cast("long").alias("first"), F.row_number().over(by.orderBy("i")).alias("k")).filter("k > 1").drop("k")


@query(f"SELECT doc_id, section, count(*) AS lines, min(i) AS first FROM (SELECT doc_id, i, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS section FROM (SELECT doc_id, i, regexp_matches(line, '^(#{{1,6}}\\s|[-=*]{{3,}}\\s*$)') OR coalesce(NOT regexp_matches(lag(line) OVER w, '\\S') AND NOT regexp_matches(lag(line, 2) OVER w, '\\S') AND regexp_matches(line, '\\S'), false) AS starts FROM ({_L}) WINDOW w AS (PARTITION BY doc_id ORDER BY i))) GROUP BY ALL")
def text_sections(t) -> DataFrame:
    """Sections: a header, a separator or two blank lines begin a new one."""
    w = Window.partitionBy("doc_id").orderBy("i")
    d = t("documents").select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("i", "line")).withColumn("i", (F.col("i") + 1).cast("long"))
    blank = lambda k: ~F.lag("line", k).over(w).rlike(r"\S")
    starts = F.col("line").rlike(r"^(#{1,6}\s|[-=*]{3,}\s*$)") | F.coalesce(blank(1) & blank(2) & F.col("line").rlike(r"\S"), F.lit(False))
    d = d.withColumn("s", starts.cast("int")).withColumn("section", F.sum("s").over(w).cast("long"))
    return d.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.min("i").alias("first"))


_CODE = [
    (1, "def f():\n    if x:\n        return {'a': {'b': 1}}\n# note\n\nimport os"), (2, "SELECT a FROM t WHERE x"), (3, ""), (4, None), (5, "plain words here"), (6, "}}{{{}"), (7, "public class A {\n  private String s;\n}"),
]


@expected("id, code, nesting, hint, blank, comments, code_lines", [(1, True, 2, "python", 1, 1, 4), (2, False, 0, "sql", 0, 0, 1), (3, False, 0, "unknown", 1, 0, 0), (4, False, 0, "unknown", 1, 0, 0), (5, False, 0, "unknown", 0, 0, 1), (6, True, 3, "unknown", 0, 0, 1), (7, True, 1, "java", 0, 0, 3)])
def code_measures(t) -> DataFrame:
    d = t.rows(_CODE, "id long, text string").select("id", tx.whole(F.col("text")).alias("text"))
    x, c = F.col("text"), tx.line_classes(F.col("text"), "py")
    return d.select("id", tx.looks_like_code(x).alias("code"), tx.max_nesting(x).cast("long").alias("nesting"), tx.language_hint(x).alias("hint"), c["blank"].cast("long").alias("blank"), c["comments"].cast("long").alias("comments"), c["code"].cast("long").alias("code_lines"))


@expected("id, readability, complexity, entropy, normalised, words", [(1, 100.0, 0.0, 0.0, 0.0, 0), (2, 100.0, 0.0, 0.0, 0.0, 0), (3, 99.0, 36.666667, 1.0, 1.0, 2), (4, 99.5, 30.833333, 0.0, 0.0, 1)])
def empty_text_measures(t) -> DataFrame:
    """Null and empty texts measure alike."""
    x = F.col("text")
    letters = F.replace(tx.whole(x), F.lit(" "), F.lit(""))
    d = t.rows([(1, None), (2, ""), (3, "abba baab"), (4, "aa")], "id long, text string")
    return d.select("id", r6(tx.readability(x)).alias("readability"), r6(tx.complexity(x)).alias("complexity"), r6(info.entropy(letters)).alias("entropy"), r6(info.normalised_entropy(letters)).alias("normalised"), tx.word_count(tx.whole(x)).cast("long").alias("words"))
