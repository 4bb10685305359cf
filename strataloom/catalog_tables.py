"""Queries of aggregates, series, joins, graphs, similarity and search over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import corpus, graph, similarity, vectors
from .registered import expected, query
from .streaming import windows


def r6(c):
    return F.round(c, 6)


# --- series: a user's events in order of time -------------------------------------------------

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def order():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query(f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth, round(CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END, 6) AS gradient FROM events WINDOW w AS {_W}")
def series_smooth_gradient(t) -> DataFrame:
    """Moving average of three (edges shrink), and forward, central or backward difference."""
    v, before, after = F.col("value"), F.lag("value").over(order()), F.lead("value").over(order())
    gradient = F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)
    return t("events").select("event_id", r6(F.avg("value").over(order().rowsBetween(-1, 1))).alias("smooth"), r6(gradient).alias("gradient"))


@query("SELECT event_id, kind FROM (SELECT event_id, CASE WHEN value > greatest(max(value) OVER a, max(value) OVER b) THEN 'peak' WHEN value < least(min(value) OVER a, min(value) OVER b) THEN 'valley' END AS kind, count(*) OVER a AS na, count(*) OVER b AS nb FROM events WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) WHERE kind IS NOT NULL AND na = 5 AND nb = 5")
def series_peaks_valleys(t) -> DataFrame:
    """Values above, or below, the five before and the five after."""
    a, b = order().rowsBetween(-5, -1), order().rowsBetween(1, 5)
    kind = F.when(F.col("value") > F.greatest(F.max("value").over(a), F.max("value").over(b)), "peak").when(F.col("value") < F.least(F.min("value").over(a), F.min("value").over(b)), "valley")
    full = (F.count("*").over(a) == 5) & (F.count("*").over(b) == 5)
    return t("events").select("event_id", kind.alias("kind"), full.alias("full")).filter("full and kind is not null").drop("full")


_STEP = "CASE WHEN abs(value - lag(value) OVER w) > 50 THEN 1 ELSE 0 END"


@query(f"SELECT user_id, segment, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT user_id, value, CAST(sum(jump) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM (SELECT user_id, value, ts, event_id, {_STEP} AS jump FROM events WINDOW w AS {_W})) GROUP BY ALL")
def series_segments(t) -> DataFrame:
    """Segments that begin where the value jumps by over 50."""
    jump = F.when(F.abs(F.col("value") - F.lag("value").over(order())) > 50, 1).otherwise(0)
    d = t("events").withColumn("jump", jump).withColumn("segment", F.sum("jump").over(order()).cast("long"))
    return d.groupBy("user_id", "segment").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("SELECT event_id, round(mean, 6) AS mean, round(spread, 6) AS spread FROM (SELECT event_id, avg(value) OVER w AS mean, max(value) OVER w - min(value) OVER w AS spread, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5")
def series_sliding_metrics(t) -> DataFrame:
    """Mean and spread of all full windows of five."""
    w = order().rowsBetween(-4, 0)
    d = t("events").select("event_id", r6(F.avg("value").over(w)).alias("mean"), r6(F.max("value").over(w) - F.min("value").over(w)).alias("spread"), F.count("*").over(w).alias("n"))
    return d.filter("n = 5").drop("n")


@query("SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 3) AS var, min(value) AS least, max(value) AS most, round(max(value) - min(value), 6) AS range, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1")
def series_statistics(t) -> DataFrame:
    v = F.col("value")
    quantile = lambda p: r6(F.percentile(v, F.lit(p)))
    return t("events").groupBy("user_id").agg(r6(F.avg(v)).alias("mean"), r6(F.stddev_pop(v)).alias("std"), F.round(F.var_pop(v), 3).alias("var"), F.min(v).alias("least"), F.max(v).alias("most"), r6(F.max(v) - F.min(v)).alias("range"), quantile(0.25).alias("q25"), quantile(0.5).alias("q50"), quantile(0.75).alias("q75"))


@query(f"SELECT event_id, rank() OVER v AS place, dense_rank() OVER v AS dense, round(percent_rank() OVER v, 6) AS share, ntile(4) OVER w AS quarter, first_value(event_id) OVER w AS first FROM events WINDOW v AS (PARTITION BY user_id ORDER BY round(value)), w AS {_W}")
def series_ranks(t) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy(F.round("value"))
    return t("events").select("event_id", F.rank().over(by).cast("long").alias("place"), F.dense_rank().over(by).cast("long").alias("dense"), r6(F.percent_rank().over(by)).alias("share"), F.ntile(4).over(order()).cast("long").alias("quarter"), F.first("event_id").over(order()).alias("first"))


# --- metrics ----------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, s[n2 // 2 + 1] AS p50, s[CAST(floor(0.95 * n2) AS BIGINT) + 1] AS p95, s[CAST(floor(0.99 * n2) AS BIGINT) + 1] AS p99 FROM (SELECT *, list_sort(list(value) OVER (PARTITION BY user_id)) AS s, count(*) OVER (PARTITION BY user_id) AS n2 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 1000) GROUP BY user_id, s, n2")
def metric_summary_last_1000(t) -> DataFrame:
    """Summary of each name's last 1,000 samples, with percentiles by index; the last 1,000 are kept before the shuffle."""
    last = corpus.top_k(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 1000)
    s = F.array_sort(F.collect_list("value"))
    at = lambda p: F.get("s", F.floor(F.size("s") * p).cast("int"))
    d = last.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), r6(F.avg("value")).alias("mean"), s.alias("s"))
    return d.select("user_id", "n", "total", "least", "most", "mean", at(F.lit(0.5)).alias("p50"), at(F.lit(0.95)).alias("p95"), at(F.lit(0.99)).alias("p99"))


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS gauge, round(sum(value), 4) AS counter FROM events GROUP BY 1")
def metric_gauges(t) -> DataFrame:
    """The last value of each name, and its total; both are summed before the shuffle."""
    return t("events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("gauge"), F.round(F.sum("value"), 4).alias("counter"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS counter FROM events")
def metric_running_total(t) -> DataFrame:
    return t("events").select("event_id", F.round(F.sum("value").over(order()), 4).alias("counter"))


@query("SELECT strftime(a, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS a FROM events) GROUP BY ALL")
def events_sliding(t) -> DataFrame:
    return windows.sliding(t("events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query(f"SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS {_W})) GROUP BY user_id, s")
def events_session(t) -> DataFrame:
    return windows.session(t("events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_type, CASE WHEN max(value) > 90 THEN 'critical' WHEN max(value) > 80 THEN 'warning' ELSE 'healthy' END AS status FROM events GROUP BY 1")
def health_status(t) -> DataFrame:
    most = F.max("value")
    return t("events").groupBy("event_type").agg(F.when(most > 90, "critical").when(most > 80, "warning").otherwise("healthy").alias("status"))


@query("SELECT source, count(*) AS files, CAST(sum(c) AS BIGINT) AS chunks, round(count(*) * 0.6 + sum(c) * 0.1, 4)::DOUBLE AS seconds, CAST(sum(c) AS BIGINT) AS memory_kb, CAST(6 * sum(c) AS BIGINT) AS storage_kb FROM (SELECT source, greatest(1, CAST(floor((len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 0.75 + length(text) / 4) / 2) AS BIGINT) // 400) AS c FROM documents) GROUP BY 1")
def run_estimates(t) -> DataFrame:
    """Seconds, memory and storage by the fixed rates of 0.6 s a file, 0.1 s, 1 KB and 2 + 4 KB a chunk."""
    c = F.greatest(F.lit(1), F.floor(tx.token_estimate(F.col("text")) / 400)).cast("long")
    d = t("documents").select("source", c.alias("c")).groupBy("source").agg(F.count("*").alias("files"), F.sum("c").alias("chunks"))
    return d.select("source", "files", "chunks", F.round(F.col("files") * 0.6 + F.col("chunks") * 0.1, 4).alias("seconds"), F.col("chunks").alias("memory_kb"), (F.col("chunks") * 6).alias("storage_kb"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def repo_counts_cube(t) -> DataFrame:
    return t("documents").cube("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT source, count(DISTINCT w) AS distinct_words FROM (SELECT source, unnest(list_filter(regexp_split_to_array(lower(text), '[^0-9\\p{L}_]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1")
def distinct_words(t) -> DataFrame:
    return t("documents").select("source", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("w")).groupBy("source").agg(F.countDistinct("w").alias("distinct_words"))


@query("SELECT doc_id, length(text) AS size FROM documents ORDER BY length(text) DESC, doc_id LIMIT 10")
def largest_documents(t) -> DataFrame:
    return t("documents").select("doc_id", F.length("text").cast("long").alias("size")).orderBy(F.desc("size"), "doc_id").limit(10)


# --- joins ------------------------------------------------------------------------------------


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, 0.6::DOUBLE AS strength FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def related_pairs(t) -> DataFrame:
    """Pairs of one category, the smaller first."""
    n = t("nation").select("n_nationkey", "n_regionkey")
    b = n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return n.withColumnRenamed("n_nationkey", "a").join(b, "n_regionkey").filter("a < b").select("a", "b", F.lit(0.6).alias("strength"))


@query("SELECT a, b, round(s, 6) AS score FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id) WHERE s >= 0.3) WHERE k <= 20 AND b > a")
def similarity_self_join(t) -> DataFrame:
    """Of each vector's 20 nearest at 0.3 or more those with a larger id (the reference level of 0.7 has no pair in these data)."""
    e = t("embeddings")
    found = vectors.top_k(e, e, "vec_id", "embedding", 20, least=0.3)
    return found.filter("vec_id > query_id").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), r6("score").alias("score"))


@query("SELECT q.query_id, q.vec_id, label, quality FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id)) q LEFT JOIN embeddings e ON q.vec_id = e.vec_id LEFT JOIN labels l ON q.vec_id = l.doc_id WHERE rank <= 5")
def hydrated_search(t) -> DataFrame:
    """The five nearest of each query, with their metadata; what has none stays."""
    e = t("embeddings")
    hits = vectors.top_k(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5).select("query_id", "vec_id")
    return hits.join(e.select("vec_id", "label"), "vec_id", "left").join(t("labels").select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id", "left").select("query_id", "vec_id", "label", "quality")


# --- graphs -----------------------------------------------------------------------------------


def _ring(t) -> DataFrame:
    """Nations linked to the next of their region and the first to the fourth after."""
    n = t("nation").select("n_nationkey", "n_regionkey", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("k"))
    a = n.select(F.col("n_nationkey").alias("src"), "n_regionkey", F.col("k").alias("ka"))
    b = n.select(F.col("n_nationkey").alias("dst"), "n_regionkey", F.col("k").alias("kb"))
    return a.join(b, "n_regionkey").filter("kb = ka + 1 or (ka = 1 and kb > 2) or (ka = 5 and kb = 3)").selectExpr("cast(src as long) src", "cast(dst as long) dst")


_RING = "(SELECT a.n AS src, b.n AS dst FROM (SELECT n_nationkey::BIGINT AS n, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) a JOIN (SELECT n_nationkey::BIGINT AS n, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) b ON a.r = b.r AND (b.k = a.k + 1 OR (a.k = 1 AND b.k > 2) OR (a.k = 5 AND b.k = 3)))"
_NODES = f"(SELECT src AS node FROM {_RING} UNION SELECT dst FROM {_RING})"
_REACH = f"WITH RECURSIVE e AS {_RING}, r(start, node, hops) AS (SELECT src, dst, 1 FROM e UNION SELECT start, dst, hops + 1 FROM r JOIN e ON node = src WHERE hops < 6), d AS (SELECT start, node, min(hops) AS hops FROM r WHERE start <> node GROUP BY 1, 2)"


@query("SELECT n_nationkey::BIGINT AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey)::BIGINT AS component FROM nation")
def graph_components(t) -> DataFrame:
    return graph.components(_ring(t))


def _pagerank_sql(rounds: int = 10, d: float = 0.85) -> str:
    steps = [f"WITH e AS {_RING}, v AS {_NODES}, n AS (SELECT count(*) AS n FROM v), o AS (SELECT src, count(*) AS outs FROM e GROUP BY 1), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, n)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS (SELECT v.node, (1 - {d}) / n + {d} * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node NOT IN (SELECT src FROM o)) / n) AS rank FROM n, v LEFT JOIN (SELECT dst, sum(rank / outs) AS got FROM e JOIN o USING (src) JOIN r{k} ON src = node GROUP BY 1) ON dst = v.node)")
    return ", ".join(steps) + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(_pagerank_sql())
def graph_pagerank(t) -> DataFrame:
    return graph.pagerank(_ring(t)).select("node", r6("rank").alias("rank"))


@query(f"WITH p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_RING}), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM p UNION ALL SELECT b FROM p) GROUP BY 1), t AS (SELECT x.a AS u, x.b AS v, y.b AS w FROM p x JOIN p y ON x.a = y.a AND x.b < y.b JOIN p z ON z.a = x.b AND z.b = y.b), c AS (SELECT node, count(*) AS t FROM (SELECT u AS node FROM t UNION ALL SELECT v FROM t UNION ALL SELECT w FROM t) GROUP BY 1) SELECT node, degree, coalesce(t, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS clustering FROM d LEFT JOIN c USING (node)")
def graph_triangles(t) -> DataFrame:
    return graph.triangles(_ring(t)).select("node", "degree", "triangles", r6("clustering").alias("clustering"))


@query(_REACH + " SELECT start, node, hops FROM d")
def graph_distances(t) -> DataFrame:
    return graph.distances(_ring(t))


@query(_REACH + f" SELECT node, round(count(*) / sum(hops) * count(*) / ((SELECT count(*) FROM {_NODES}) - 1), 6) AS closeness FROM d GROUP BY 1")
def graph_closeness(t) -> DataFrame:
    return graph.closeness(_ring(t)).select("node", r6("closeness").alias("closeness"))


@query(_REACH + f", m AS (SELECT x.start AS node, min(x.node) AS m FROM d x JOIN d y ON x.start = y.node AND x.node = y.start GROUP BY 1) SELECT v.node, least(v.node, coalesce(m, v.node)) AS component FROM {_NODES} v LEFT JOIN m ON v.node = m.node")
def graph_strong_components(t) -> DataFrame:
    return graph.strong_components(_ring(t))


@query(f"SELECT v AS nodes, e AS edges, round(e / (v * (v - 1)), 6) AS density, c AS components, round(2 * e / v, 6) AS avg_degree FROM (SELECT (SELECT count(*) FROM {_NODES}) AS v, (SELECT count(*) FROM {_RING}) AS e, (SELECT count(DISTINCT n_regionkey) FROM nation) AS c)")
def graph_stats(t) -> DataFrame:
    return graph.stats(_ring(t)).select("nodes", "edges", r6("density").alias("density"), "components", r6("avg_degree").alias("avg_degree"))


@query(_REACH + ", p AS (SELECT DISTINCT e.src, d.node AS dst FROM e JOIN d ON e.dst = d.start JOIN d AS back ON true WHERE false) SELECT src, dst FROM e WHERE src < dst AND NOT EXISTS (SELECT 1 FROM e f JOIN e g ON f.dst = g.src WHERE f.src = e.src AND g.dst = e.dst AND f.src < f.dst AND g.src < g.dst) AND NOT EXISTS (SELECT 1 FROM e f JOIN e g ON f.dst = g.src JOIN e h ON g.dst = h.src WHERE f.src = e.src AND h.dst = e.dst AND f.src < f.dst AND g.src < g.dst AND h.src < h.dst) AND NOT EXISTS (SELECT 1 FROM e f JOIN e g ON f.dst = g.src JOIN e h ON g.dst = h.src JOIN e i ON h.dst = i.src WHERE f.src = e.src AND i.dst = e.dst AND f.src < f.dst AND g.src < g.dst AND h.src < h.dst AND i.src < i.dst)")
def graph_transitive_reduction(t) -> DataFrame:
    return graph.transitive_reduction(_ring(t).filter("src < dst"))


_CO = "(SELECT l_orderkey AS src, l_partkey + 1000000 AS dst, max(l_quantity) / 50 AS weight FROM lineitem GROUP BY 1, 2)"


@query(f"SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM {_CO} WHERE weight >= 0.3) WHERE n <= 3")
def graph_prune(t) -> DataFrame:
    edges = t("lineitem").groupBy(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).agg((F.max("l_quantity") / 50).alias("weight"))
    return graph.prune(edges, 0.3, 3)


@query("SELECT l_orderkey AS src, l_suppkey AS dst, arg_max(l_quantity, (l_linenumber, l_quantity)) AS weight FROM lineitem GROUP BY 1, 2")
def graph_last_writer(t) -> DataFrame:
    return graph.insert_edges(t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"), F.struct("l_linenumber", "l_quantity").alias("place")), "place").select("src", "dst", "weight")


@query("SELECT o_custkey AS parent, count(*) AS children, min(o_orderkey) AS first FROM orders GROUP BY 1")
def graph_hierarchy(t) -> DataFrame:
    return t("orders").groupBy(F.col("o_custkey").alias("parent")).agg(F.count("*").alias("children"), F.min("o_orderkey").alias("first"))


_TWO = [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 5, 1.0), (5, 6, 1.0), (6, 4, 1.0), (3, 4, 1.0)]


@expected("node, label", [(1, 1), (2, 1), (3, 1), (4, 3), (5, 3), (6, 3)])
def graph_communities(t) -> DataFrame:
    """Two triangles with a bridge: labels settle by triangle."""
    return graph.label_propagation(graph.from_rows(t.spark, _TWO), 4)


@expected("modularity", [(0.357143,)])
def graph_modularity(t) -> DataFrame:
    labels = t.rows([(n, 1 if n < 4 else 4) for n in range(1, 7)], "node long, label long")
    return graph.modularity(graph.from_rows(t.spark, _TWO), labels).select(r6("modularity").alias("modularity"))


# --- similarity and search ----------------------------------------------------------------------

_PARTS = "(SELECT a.p_partkey AS id, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


@query(f"SELECT id, x = y AS exact, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS edit, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS tokens FROM (SELECT *, list_distinct(regexp_extract_all(x, '\\w\\w+')) AS a, list_distinct(regexp_extract_all(y, '\\w\\w+')) AS b FROM {_PARTS})")
def name_similarity(t) -> DataFrame:
    p = t("part").select("p_partkey", "p_name")
    pairs = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y")), "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("x"), "y")
    x, y = F.col("x"), F.col("y")
    return pairs.select("id", similarity.exact(x, y).alias("exact"), r6(similarity.edit(x, y)).alias("edit"), r6(similarity.token_jaccard(x, y)).alias("tokens"))


_TF = "SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^0-9\\p{L}_]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY ALL"


@query(f"WITH tf AS ({_TF}), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), v AS (SELECT doc_id, w, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (w), n), u AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1) SELECT a.doc_id, round(sum(a.x * b.x) / any_value(p.norm) / any_value(q.norm), 6) AS cosine FROM v a JOIN v b ON b.doc_id = a.doc_id + 1 AND a.w = b.w JOIN u p ON p.doc_id = a.doc_id JOIN u q ON q.doc_id = b.doc_id GROUP BY 1")
def neighbour_tfidf_cosine(t) -> DataFrame:
    return similarity.tfidf_of_next(t("documents"), "doc_id", "text").select("doc_id", r6("cosine").alias("cosine"))


@query("SELECT a.vec_id, round(1 / (1 + list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS euclid, round(1 / (1 + list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))), 6) AS manhattan FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distances(t) -> DataFrame:
    e = t("embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return vectors.distance_scores(pairs, "embedding", "other").select("vec_id", r6("euclid").alias("euclid"), r6("manhattan").alias("manhattan"))


@expected("how, pooled", [("mean", [2.0, 2.0]), ("max", [3.0, 4.0]), ("cls", [1.0, 4.0]), ("weighted", [1.666667, 2.666667])])
def vector_pooling(t) -> DataFrame:
    d = t.rows([([[1.0, 4.0], [3.0, 0.0]],)], "tokens array<array<double>>")
    out = None
    for how in ("mean", "max", "cls", "weighted"):
        one = vectors.pool(d, "tokens", how).select(F.lit(how).alias("how"), F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS before, CAST(1.0 AS DOUBLE) AS after FROM embeddings")
def vector_normalise(t) -> DataFrame:
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return t("embeddings").select("vec_id", F.round(square(F.col("embedding")), 4).alias("before"), F.round(square(vectors.normalise(F.col("embedding"))), 6).alias("after"))


_DOCS = "list_filter(regexp_split_to_array(lower(text), '[^0-9\\p{L}_]+'), lambda x: x <> '')"


@query(f"WITH d AS (SELECT doc_id, {_DOCS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d), p AS (SELECT doc_id, len(w) AS len, unnest(['the', 'under']) AS term, w FROM d), c AS (SELECT doc_id, len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM p), f AS (SELECT term, count(*) AS df FROM c WHERE tf > 0 GROUP BY 1), m AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS score FROM c JOIN f USING (term), s WHERE tf > 0 GROUP BY doc_id HAVING count(*) = 2) SELECT doc_id, round(score, 5) AS score FROM m ORDER BY score DESC, doc_id LIMIT 20")
def search_all_terms(t) -> DataFrame:
    """The 20 best of the texts that hold all terms."""
    found = corpus.bm25(t("documents"), "doc_id", "text", ["the", "under"], every=True)
    return found.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 5).alias("score"))


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS k FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS k FROM documents) SELECT doc_id, round(sum(1.0 / (60 + k)), 6)::DOUBLE AS score FROM (SELECT * FROM a WHERE k <= 50 UNION ALL SELECT * FROM b WHERE k <= 50) GROUP BY 1")
def hybrid_fusion(t) -> DataFrame:
    """Reciprocal ranks of two ranked lists of 50 (an extension: the two lists side by side are what is asked for)."""
    d = t("documents").select("doc_id", F.length("text").alias("n"))
    first, second = d.orderBy(F.desc("n"), "doc_id").limit(50), d.orderBy(F.desc("doc_id")).limit(50)
    a = first.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n"), "doc_id")).alias("k"))  # 50 rows each
    b = second.select("doc_id", F.row_number().over(Window.orderBy(F.desc("doc_id"))).alias("k"))
    return a.unionByName(b).groupBy("doc_id").agg(r6(F.sum(1.0 / (60 + F.col("k")))).alias("score"))
