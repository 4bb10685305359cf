"""Graph operators over edge tables (src, dst) and (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage where a folder for checkpoints is set (spark.checkpoint.dir on a cluster), else keep the plan."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    out = df.checkpoint()
    # Without the estimated size of the plan that was cut, which loops of joins square in each round.
    rows = out._jdf.queryExecution().analyzed().rdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), df.sparkSession)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds; edges weigh by ``weight`` (1 if there is none), nodes without out-edges give to all alike."""
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    nodes = settle(nodes_of(edges))
    n = nodes.count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("outs"))
    shares = settle(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("outs")).alias("share")))
    ends = settle(nodes.join(out, nodes.node == out.src, "left").select("node", F.col("outs").isNull().alias("dangles")))
    ranks = ends.select("node", "dangles", F.lit(1.0 / max(1, n)).alias("rank"))
    for _ in range(rounds):
        got = shares.join(ranks, shares.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangles"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = F.lit((1 - damping) / max(1, n)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(1, n))
        ranks = settle(ends.join(got, ends.node == got.dst, "left").join(F.broadcast(lost)).select("node", "dangles", new.alias("rank")))  # lost: one row
    return ranks.select("node", "rank")


def reach(edges: DataFrame, start: int, hops: int = 2, kinds: list | None = None) -> DataFrame:
    """(node, hops, strength) within ``hops`` steps: breadth first, strength the product of weights, the strongest way in the first hop that meets a node."""
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(kinds))
    seen = edges.sparkSession.createDataFrame([(start, 0, 1.0)], "node long, hops int, strength double")
    for hop in range(1, hops + 1):
        edge = seen.filter(F.col("hops") == hop - 1).select(F.col("node").alias("src"), "strength")
        met = edges.join(edge, "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("strength") * F.col("weight")).alias("strength"))
        new = met.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), "strength")
        seen = settle(seen.unionByName(new))
    return seen.filter(F.col("hops") > 0)


def two_hops(edges: DataFrame, start: int) -> DataFrame:
    """(node, hops) within two steps of a node, along edges."""
    return reach(edges.withColumn("weight", F.lit(1.0)), start).select("node", "hops")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each weakly connected component, by least labels and pointer jumping."""
    both = settle(both_ways(edges.select("src", "dst")).distinct())
    state = settle(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("root"), F.lit(True).alias("fell")))
    while not state.filter("fell").isEmpty():
        near = both.join(state.select(F.col("node").alias("dst"), "root"), "dst").groupBy("src").agg(F.min("root").alias("m"))
        low = state.join(near, F.col("node") == F.col("src")).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("far"))
        state = settle(low.join(jump, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("was")).alias("fell")))
    return state.select("node", F.col("root").alias("component"))


def prune(edges: DataFrame, least: float = 0.3, most: int = 50) -> DataFrame:
    """Edges of weight ``least`` or more, of each node its ``most`` strongest ones (ties to the smaller target)."""
    by = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.filter(F.col("weight") >= least).withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most).drop("_n")


def insert_edges(edges: DataFrame, order: str) -> DataFrame:
    """Of edges given several times for (src, dst) the one that comes last in ``order``."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    last = F.max_by(F.struct(*rest), F.col(order))
    return edges.groupBy("src", "dst").agg(last.alias("last")).select("src", "dst", "last.*")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of an acyclic graph but those whose target a longer path reaches, too."""
    edges = settle(edges.select("src", "dst").distinct())
    far = new = edges.select("src", "dst")
    longer = None
    while True:
        step = new.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).distinct()
        longer = settle(step if longer is None else longer.unionByName(step).distinct())
        new = settle(step.join(far, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return edges.join(longer, ["src", "dst"], "left_anti")
        far = settle(far.unionByName(new))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering) of an undirected graph; each pair of neighbours is looked up from the end of lesser degree."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a != b").distinct()
    pairs = settle(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    ranked = pairs.join(degree.withColumnsRenamed({"node": "a", "degree": "da"}), "a").join(degree.withColumnsRenamed({"node": "b", "degree": "db"}), "b")
    # From the lesser to the greater (degree, node): no node has more than about sqrt(2 * edges) such edges.
    low = F.struct("da", "a") < F.struct("db", "b")
    out = settle(ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedge = out.join(out.withColumnRenamed("v", "w"), "u").filter("v < w").select("u", "v", "w")
    found = wedge.join(pairs, (F.col("v") == F.col("a")) & (F.col("w") == F.col("b"))).select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    t, d = F.coalesce("t", F.lit(0)), F.col("degree")
    return degree.join(found, "node", "left").select("node", "degree", t.alias("triangles"), F.when(d > 1, 2.0 * t / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering"))


def distances(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, node, hops): shortest ways along edges from each start (all nodes by default), itself left out."""
    edges = settle(edges.select("src", "dst").distinct())
    starts = nodes_of(edges) if starts is None else starts.select("node")
    new = seen = settle(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")))
    hop = 0
    while True:
        hop += 1
        step = new.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = settle(step.join(seen, ["start", "node"], "left_anti").select("start", "node", F.lit(hop).alias("hops")))
        if new.isEmpty():
            return seen.filter("hops > 0")
        seen = settle(seen.unionByName(new))


def closeness(edges: DataFrame) -> DataFrame:
    """(node, closeness): of the nodes from which a node is reached, their share over their mean distance."""
    n = nodes_of(edges).agg(F.count("*").alias("n"))
    far = distances(edges).groupBy("node").agg(F.count("*").alias("r"), F.sum("hops").alias("s"))
    return far.join(F.broadcast(n)).select("node", (F.col("r") / F.col("s") * F.col("r") / (F.col("n") - 1)).alias("closeness"))  # n: one row


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): in each round every node takes its neighbours' commonest label, the least on a tie."""
    both = settle(both_ways(edges.select("src", "dst")).distinct())
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        labels = settle(votes.groupBy(F.col("src").alias("node")).agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("best")).select("node", (-F.col("best.m")).alias("label")))
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity) of labels (node, label) over an undirected graph."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    named = pairs.join(labels.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(labels.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
    inside = named.agg(F.count("*").alias("m"), F.count_if(F.col("la") == F.col("lb")).alias("within"))
    ends = named.select(F.explode(F.array("la", "lb")).alias("label")).groupBy("label").agg(F.count("*").alias("d"))
    squares = ends.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("q"))
    return inside.join(squares).select((F.col("within") / F.col("m") - F.col("q") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))  # one row each


def stats(edges: DataFrame) -> DataFrame:
    """(nodes, edges, density, components, avg_degree) of a directed graph."""
    n = nodes_of(edges).agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"))
    c = components(edges).agg(F.countDistinct("component").alias("components"))
    return n.join(m).join(c).select("nodes", "edges", (F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"), "components", (2 * F.col("edges") / F.col("nodes")).alias("avg_degree"))  # one row each


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each strongly connected component: pairs that reach each other; for graphs whose reach fits a table."""
    far = distances(edges).select(F.col("start").alias("a"), F.col("node").alias("b"))
    mutual = far.join(far.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
    least = mutual.groupBy("a").agg(F.min("b").alias("m"))
    return nodes_of(edges).join(least, F.col("node") == F.col("a"), "left").select("node", F.least("node", F.coalesce("m", "node")).alias("component"))


def from_rows(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "src long, dst long, weight double")
