"""All queries of the engine's own operators, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import information as info
from .functions import text as tx
from .operators import corpus, graph, vectors
from .sources import files
from .registered import QUERIES as _QUERIES
from .registered import SQL as _SQL
from .registered import query as _query
from .streaming import windows

_W = "list_filter(regexp_split_to_array(lower(text), '[^0-9\\p{L}_]+'), lambda x: x <> '')"
_S = "len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ') <> ''))"
_EST = "CAST(floor((len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 0.75 + length(text) / 4) / 2) AS BIGINT)"


def r6(c):
    return F.round(c, 6)


@_query(f"SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len({_W})) AS BIGINT) AS words, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY lang")
def repo_totals_by_lang(t) -> DataFrame:
    return t("documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length(F.col("text"))).alias("chars"), F.sum(F.size(tx.words(F.col("text"))).cast("long")).alias("words"), F.sum(F.size(tx.lines(F.col("text"))).cast("long")).alias("lines"))


@_query("SELECT lang, source, count(*) AS n, grouping(lang, source) AS g FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def repo_counts_grouping_sets(t) -> DataFrame:
    return t("documents").groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source").agg(F.count("*").alias("n"), F.grouping_id("lang", "source").alias("g"))


@_query(f"SELECT doc_id, len({_W}) AS words, {_S} AS sentences, len(string_split(text, chr(10))) AS lines, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits FROM documents")
def doc_basic_stats(t) -> DataFrame:
    return t("documents").select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("words"), F.size(F.filter(F.split(F.col("text"), "[.!?]+"), lambda s: F.trim(s) != "")).cast("long").alias("sentences"), F.size(tx.lines(F.col("text"))).cast("long").alias("lines"), tx.count_of(F.col("text"), "[0-9]").cast("long").alias("digits"))


@_query(f"SELECT doc_id, {_EST} AS tokens FROM documents")
def doc_token_estimate(t) -> DataFrame:
    return t("documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@_query(f"SELECT doc_id, round(CASE WHEN len({_W}) = 0 OR {_S} = 0 THEN 100.0 ELSE least(100.0, greatest(0.0, 100 - 0.5 * len({_W}) / {_S} - 50.0 * len(list_filter({_W}, lambda x: length(x) > 6)) / len({_W}))) END, 6) AS readability FROM documents")
def doc_readability(t) -> DataFrame:
    return t("documents").select("doc_id", r6(tx.readability(F.col("text"))).alias("readability"))


@_query(f"SELECT doc_id, round(least(100.0, least(len({_W}) / greatest({_S}, 1) / 30 * 25, 25.0) + least(coalesce(list_sum(list_transform({_W}, lambda x: length(x))), 0) / greatest(len({_W}), 1) / 10 * 25, 25.0) + len(list_distinct({_W})) / greatest(len({_W}), 1) * 25 + least((length(text) - length(regexp_replace(text, '[.,!?;:]', '', 'g'))) / greatest(length(text), 1) * 100, 25.0)), 6) AS complexity FROM documents")
def doc_complexity(t) -> DataFrame:
    return t("documents").select("doc_id", r6(tx.complexity(F.col("text"))).alias("complexity"))


@_query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(t) -> DataFrame:
    return corpus.duplicate_groups(t("documents"), "doc_id", "text")


@_query("WITH o AS (SELECT doc_id, text FROM documents WHERE lang <> 'fr'), n AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text FROM documents WHERE lang <> 'es') SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.text <> n.text THEN 'modified' ELSE 'unchanged' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def diff_new_modified_deleted(t) -> DataFrame:
    docs = t("documents")
    old = docs.filter("lang <> 'fr'").select("doc_id", F.sha2("text", 256).alias("sha"))
    new = docs.filter("lang <> 'es'").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return corpus.diff(old, new, "doc_id", "sha")


@_query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def doc_labels_left(t) -> DataFrame:
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@_query("SELECT doc_id, CASE WHEN length(text) > 0 THEN round(list_aggregate(string_split(text, ''), 'entropy'), 6) + 0.0 ELSE 0.0 END AS entropy FROM documents")
def doc_entropy(t) -> DataFrame:
    return t("documents").select("doc_id", (F.round(info.entropy(F.col("text")), 6) + 0.0).alias("entropy"))


@_query(f"SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest({_W}) AS word FROM documents) GROUP BY 1) ORDER BY n DESC, word LIMIT 10")
def top_words(t) -> DataFrame:
    return t("documents").select(F.explode(tx.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


@_query("SELECT event_id, user_id, rank FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 3")
def events_last_n(t) -> DataFrame:
    return corpus.top_k(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("event_id", "user_id", F.col("rank").cast("long"))


@_query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS counter FROM events")
def events_running_counter(t) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", F.count("*").over(w).alias("counter"))


@_query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t) -> DataFrame:
    return windows.tumbling(t("events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, list_sort(list(value))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95 FROM events GROUP BY 1")
def metric_summary_index_pct(t) -> DataFrame:
    """Percentiles by index over each type's values; ranked by a window, so that no list is gathered."""
    v = t("events").filter("value is not null")
    sized = v.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    ranked = v.select("event_type", "value", F.row_number().over(Window.partitionBy("event_type").orderBy("value")).alias("k")).join(F.broadcast(sized), "event_type")
    pick = lambda p: F.max(F.when(F.col("k") == F.floor(F.col("n") * p) + 1, F.col("value")))
    return ranked.groupBy("event_type", "n", "least", "most").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"))


@_query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS tags FROM pages")
def page_links(t) -> DataFrame:
    return t("pages").select("page_id", F.regexp_count("html", F.lit('href="([^"]*)"')).cast("long").alias("links"), F.regexp_count("html", F.lit("<[a-zA-Z][^>]*>")).cast("long").alias("tags"))


@_query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def conversation_turn_lengths(t) -> DataFrame:
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@_query("SELECT doc_id, regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') AS email, regexp_matches(text, '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b') AS ip, regexp_matches(text, 'https?://') AS url FROM documents")
def content_probe_matrix(t) -> DataFrame:
    return t("documents").select("doc_id", F.col("text").rlike(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}").alias("email"), F.col("text").rlike(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b").alias("ip"), F.col("text").rlike("https?://").alias("url"))


@_query("SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id)) WHERE rank <= 10")
def knn_exact_top10(t) -> DataFrame:
    e = t("embeddings")
    return vectors.top_k(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).select("query_id", "vec_id", "rank", r6("score").alias("score"))


_BM = ["the", "idiot", "under", "license"]


@_query(f"WITH d AS (SELECT doc_id, {_W} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d), p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN ('the', 'idiot', 'under', 'license') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))), 5) AS score FROM p JOIN f USING (term), s GROUP BY doc_id")
def bm25_search(t) -> DataFrame:
    return corpus.bm25(t("documents"), "doc_id", "text", _BM).select("doc_id", F.round("score", 5).alias("score"))


@_query(f"WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda text: {_EST}) AS z FROM documents), r AS (SELECT doc_id, z, 1 AS i, 0 AS chunk, z[1] AS held FROM l UNION ALL SELECT doc_id, z, i + 1, CASE WHEN held + z[i + 1] <= 450 THEN chunk ELSE chunk + 1 END, CASE WHEN held + z[i + 1] <= 450 THEN held + z[i + 1] ELSE z[i + 1] END FROM r WHERE i < len(z)) SELECT doc_id, chunk, max(held) AS tokens FROM r GROUP BY 1, 2")
def chunk_greedy_lines(t) -> DataFrame:
    return corpus.greedy_pack(t("documents"), "doc_id", "text")


def _supply(t) -> DataFrame:
    return t("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).distinct()


_EDGES = "(SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem)"


@_query(f"SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES}) GROUP BY node")
def degree_centrality(t) -> DataFrame:
    return graph.degrees(_supply(t))


_CUSTOMS = "(SELECT n_nationkey AS src, 1000 + n_regionkey AS dst, 0.5 AS weight FROM nation UNION ALL SELECT 1000 + n_regionkey, n_nationkey, 0.5 + n_nationkey / 100.0 FROM nation)"


@_query(f"WITH e AS {_CUSTOMS}, one AS (SELECT dst AS node, max(weight) AS s FROM e WHERE src = 3 GROUP BY 1), two AS (SELECT dst AS node, max(s * weight) AS s FROM e JOIN one ON src = node WHERE dst <> 3 AND dst NOT IN (SELECT node FROM one) GROUP BY 1) SELECT node, CAST(1 AS INTEGER) AS hops, round(s, 6) AS strength FROM one UNION ALL SELECT node, 2, round(s, 6) FROM two")
def bfs_two_hops(t) -> DataFrame:
    n = t("nation")
    edges = n.selectExpr("cast(n_nationkey as long) as src", "cast(1000 + n_regionkey as long) as dst", "0.5d as weight").unionByName(n.selectExpr("cast(1000 + n_regionkey as long) as src", "cast(n_nationkey as long) as dst", "0.5d + n_nationkey / 100.0d as weight"))
    return graph.reach(edges, 3).select("node", "hops", F.round("strength", 6).alias("strength"))


_PATHS = ["src/app/main.py", "tests/test_main.py", "infra/main.tf", "Dockerfile", "web/index.ts", "docs/README.md", "src/UserTest.java"]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("file_path")
    return spark.createDataFrame([(x,) for x in _PATHS], "file_path string").select("file_path", files.language_of(p).alias("language"), files.is_test(p).alias("is_test"))


_QUERIES["file_category_rules"] = _rules
_SQL["file_category_rules"] = "SELECT * FROM (VALUES ('src/app/main.py', 'python', false), ('tests/test_main.py', 'python', true), ('infra/main.tf', 'terraform', false), ('Dockerfile', 'docker', false), ('web/index.ts', 'typescript', false), ('docs/README.md', 'markdown', false), ('src/UserTest.java', 'java', true)) AS v(file_path, language, is_test)"


from . import catalog_files, catalog_tables, catalog_text  # noqa: E402, F401  (they register their queries)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
