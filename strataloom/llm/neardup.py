"""MinHash near-duplicate classes (operator 4) by DartMinHash signatures.

1. Every text becomes its set of five-word shingles (64-bit hashes; a shorter text is one shingle), all of weight 1 or, with
   ``weighted``, weighing as often as they stand in the text. Texts with equal sets are one node, named by a 128-bit hash.
2. Darts: each element owns hashed Poisson processes over (weight, rank), one for each dyadic band of weight; the darts under
   its weight count. Only ranks up to about k ln k / total weight are thrown, so a signature costs O(n + k log k). The earliest
   dart of each of k coordinates is kept; two signatures agree in a coordinate with probability equal to weighted Jaccard.
3. Coordinates are folded into bands. In each bucket the node with the least id, the pivot, is paired with every other member: linear in the
   bucket's size, and the same pair in most bands. Pairs between components are verified in three rounds by exact weighted
   Jaccard, pivots with many pairs being salted. (A shingle's n-th occurrence is an element of its own there: over these,
   weighted Jaccard is plain Jaccard.)
4. Components of the links. Where a bucket still holds several components, members outside its largest one are verified
   against the members of other components, but for pairs that an upper bound of their Jaccard excludes, so that no link
   between bucket members is lost; then components again.

Defined results: null is the empty text; a text without words is linked only to equal texts; texts of any length count whole.
Rows are judged by their text, whatever their id: every row gets the class of its text, and a class is named by the least
non-null id among its rows (null, if all are null). So repeated ids with different texts may lie in different classes, and the
order of rows never matters. Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GenerationCache, cut, once, per_row

_WORD = re.compile(r"\w+")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def weighted_shingles(text: str, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, and how often each stands in the text."""
    cache = once("words", "hash", lambda: GenerationCache(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "replace")), 100_000))
    found = _WORD.findall(text.lower())
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for k in range(min(words, len(h))):
        out = mix(out ^ h[k : k + n])
    return np.unique(out, return_counts=True)


def occurrences(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sorted hashes of all occurrences: of an element's n-th one a hash of both; the first is the element itself."""
    if not (weights > 1).any():
        return elements
    each = np.repeat(elements, weights)
    nth = (np.arange(len(each)) - np.repeat(np.cumsum(weights) - weights, weights)).astype(np.uint64)
    again = nth > 0
    each[again] = mix(each[again] ^ mix(nth[again]))
    each.sort()
    return each


def shingles(text: str, words: int = 5, weighted: bool = False) -> np.ndarray:
    elements, weights = weighted_shingles(text, words)
    return occurrences(elements, weights) if weighted else elements


def dart_signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = 240) -> np.ndarray:
    """The dart (as its hash) that comes earliest in each of k coordinates; weights above 0, all 1 if None."""
    if weights is None:
        keys, low, height, limit, total = elements, 0.0, 1.0, None, float(len(elements))
    else:
        weights = np.asarray(weights, np.float64)
        keys, low, height, limit, total = [], [], [], [], float(weights.sum())
        for band in range(max(1, int(np.ceil(np.log2(max(1.0, weights.max())))) + 1)):
            start, size = (0.0, 1.0) if band == 0 else (2.0 ** (band - 1), 2.0 ** (band - 1))
            under = weights > start
            keys.append(elements[under] if band == 0 else mix(elements[under] ^ _U(band << 32)))
            low.append(np.full(under.sum(), start)), height.append(np.full(under.sum(), size)), limit.append(weights[under])
        keys, low, height, limit = (np.concatenate(x) for x in (keys, low, height, limit))
    darts_wanted = k * (np.log(k) + 3)
    while True:
        most = darts_wanted / total  # highest rank thrown
        ids, ranks, alive, base, j = [], [], np.arange(len(keys)), np.zeros(len(keys)), 0
        rate = np.broadcast_to(np.asarray(height, np.float64), len(keys))
        while len(alive):
            step = int(min(64, max(1, most * float(rate[alive].max()) + 2)))
            hashed = mix(keys[alive][:, None] + mix(np.arange(j, j + step, dtype=np.uint64) * _U(2))[None, :])
            rank = base[:, None] + np.cumsum(-np.log(_unit(hashed)) / rate[alive][:, None], axis=1)
            keep = rank <= most
            if limit is not None:
                place = _unit(mix(hashed ^ _U(0xA5A5A5A5A5A5A5A5)))
                inside = np.asarray(low)[alive][:, None] + place * rate[alive][:, None] < limit[alive][:, None]
                ids.append(hashed[keep & inside]), ranks.append(rank[keep & inside])
            else:
                ids.append(hashed[keep]), ranks.append(rank[keep])
            on = rank[:, -1] <= most
            base, alive, j = rank[on, -1], alive[on], j + step
        ids, ranks = np.concatenate(ids), np.concatenate(ranks)
        late_first = ids[np.argsort(-ranks, kind="stable")]
        out = np.zeros(k, np.uint64)
        filled = np.zeros(k, bool)
        coordinate = (mix(late_first ^ _U(0x5DEECE66D)) % _U(k)).astype(np.int64)
        out[coordinate], filled[coordinate] = late_first, True  # the last one assigned, the earliest, stays
        if filled.all():
            return out
        darts_wanted *= 2


def bands_of(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = mix(out ^ rows[:, k])
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate((a, b))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(both) - same) if len(both) else 0.0


def set_key(elements: np.ndarray, text: str | None) -> bytes:
    """The node's name."""
    return hashlib.md5(elements.tobytes() if len(elements) else b"text" + (text or "").encode("utf-8", "replace")).digest()


def _signed(df: DataFrame, words: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """(id, digest, key, bands) of each row: digest of the text, its node, and the node's bands (none where there are no words)."""

    def make():
        def sign(text):
            elements, weights = weighted_shingles(text or "", words)
            if not len(elements):
                return set_key(elements, text), None
            plain = not weighted or not (weights > 1).any()
            return set_key(elements if plain else occurrences(elements, weights), text), bands_of(dart_signature(elements, None if plain else weights, bands * rows), bands)

        return lambda texts: zip(*map(sign, texts), strict=True)

    return per_row(df, ["id", "digest"], ["text"], "key binary, bands array<long>", make)


def _sets(keys: DataFrame, shown: DataFrame, texts: DataFrame, words: int, weighted: bool) -> DataFrame:
    """(key, s): the shingle occurrences of these nodes, from one text of each (shown: key, one.id, one.digest)."""
    asked = shown.join(keys, "key", "left_semi").select("key", F.col("one.id").alias("of"), F.col("one.digest").alias("held"))
    one = texts.join(asked, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("held")))

    def make():
        met: set = set()

        def of(keys, texts):
            out = []
            for key, text in zip(keys, texts, strict=True):
                out.append(None if key in met else shingles(text or "", words, weighted).tobytes())
                met.add(key)
            return (out,)

        return of

    # Rows that repeat both id and text give the set once in a task, then once at all.
    return cut(per_row(one, ["key"], ["key", "text"], "s binary", make).filter("s is not null").dropDuplicates(["key"]))


def _caps(sets: DataFrame) -> DataFrame:
    """(node, n, c, g): size of each set, how many of its shingles another set holds too, and these in 64 classes by hash."""

    def each_of(batches):
        for batch in batches:
            found = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
            places = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["key", "s"])

    each = sets.select("key", "s").mapInArrow(each_of, "key binary, s long")
    alone = each.groupBy("s").agg(F.min("key").alias("key"), F.count("*").alias("k")).filter("k = 1").groupBy("key").agg(F.collect_list("s").alias("alone"))

    def make():
        def count(s, own):
            held = np.frombuffer(s, np.uint64)
            shared = np.setdiff1d(held, np.asarray(own or [], np.int64).view(np.uint64))
            return len(held), len(shared), np.bincount((mix(shared) % _U(64)).astype(np.int64), minlength=64).astype(np.int32)

        return lambda sets, alone: zip(*map(count, sets, alone), strict=True)

    return per_row(sets.join(alone, "key", "left"), ["key"], ["s", "alone"], "n long, c long, g array<int>", make).withColumnRenamed("key", "node")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, salt_rows: int = 256) -> DataFrame:
    """(a, b) of those pairs (a, b) whose exact Jaccard over sets (key, s) meets the threshold; an a of many pairs is salted."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts"))
    left = sets.join(many.withColumnRenamed("a", "key"), "key").select(F.col("key").alias("a"), F.col("s").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    joined = salted.join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b").join(left, ["a", "salt"]).select("a", "b", "sa", "sb")
    compare = lambda sa, sb: ([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(sa, sb, strict=True)],)
    return per_row(joined, ["a", "b"], ["sa", "sb"], "linked boolean", lambda: compare).filter("linked").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): least label of the neighbours, then pointer jumping, until nothing falls."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"), F.lit(True).alias("fell")))
    while not state.filter("fell").isEmpty():
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = state.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("far"))
        state = cut(low.join(jump, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("was")).alias("fell")))
    return state.select("node", "root")


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 6, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of each row (id, digest, key), digest being the text's and key its node; and (node, root) of the nodes that are linked."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_digest(text_col).alias("digest"))
    signed = cut(_signed(texts, words, bands, rows, weighted))
    shown = signed.groupBy("key").agg(F.min(F.struct("id", "digest")).alias("one"))
    # One copy stands for all: equal nodes have equal bands.
    first = signed.filter("bands is not null").groupBy("key").agg(F.min(F.struct("id", "bands")).alias("one"))
    inside = first.select("key", "one.id", F.explode("one.bands").alias("h"))
    # Most buckets hold one node: they go before anything but their number is shuffled with them.
    several = inside.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    held = cut(inside.join(several, "h", "left_semi"))
    # The pivot is the node with the least id: where copies are made of an earlier text, all of them are near to it.
    buckets = held.groupBy("h").agg(F.min(F.struct("id", "key")).alias("least"))
    members = cut(held.join(buckets, "h").select("h", F.col("key").alias("node"), F.col("least.key").alias("pivot"), F.col("least.id").alias("pivot_id")))
    by_node = Window.partitionBy("b").orderBy("pivot_id", "a")
    pairs = members.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "pivot_id").distinct()
    pairs = cut(pairs.select("a", "b", F.row_number().over(by_node).alias("n")))
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), shown, texts, words, weighted)
    # A pair inside one component can add nothing: each node's first pair is verified, then what is still open of three more, then of all.
    links = roots = None
    for least, most in ((1, 1), (2, 4), (5, bands)):
        now = pairs.filter(F.col("n").between(least, most)).select("a", "b")
        if roots is not None:
            now = now.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            now = now.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        found = cut(_verified(cut(now), sets, threshold))
        if roots is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = components(links)
    placed = members.join(roots, "node", "left").select("h", "node", "pivot", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("h", "root").agg(F.count("*").alias("c"))
    several = sizes.groupBy("h").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1").select("h", F.col("top.root").alias("top"))
    open_ = cut(placed.join(several, "h"))
    # A shingle that no other open text holds is in no overlap; what is left bounds the Jaccard of a pair, and discards it exactly.
    caps = _caps(sets.join(open_.select(F.col("node").alias("key")).distinct(), "key", "left_semi"))
    able = cut(open_.join(caps.filter(F.col("c") >= threshold * F.col("n")), "node"))
    few = able.filter("root != top").select("h", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("c").alias("cx"), F.col("g").alias("gx"))
    all_ = able.select("h", F.col("node").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("c").alias("cy"), F.col("g").alias("gy"), "pivot")
    # At most the lesser count of each class is common.
    over, close = F.least("cx", "cy"), F.aggregate(F.zip_with("gx", "gy", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    apart = (F.col("rx") != F.col("ry")) & (F.col("x") != F.col("pivot")) & (F.col("y") != F.col("pivot"))
    able = [v >= threshold * (F.col("nx") + F.col("ny") - v) for v in (over, close)]
    rest = few.join(all_, (few.h == all_.h) & apart & able[0] & able[1])
    rest = cut(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rest.isEmpty():
        more = cut(_verified(rest, sets, threshold))
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    return signed.select("id", "digest", "key"), roots


def text_digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, class_id) of each row; class_id is the least id of the class. At the defaults a pair at 0.8 shares a bucket but for one case in 10**5."""
    rows, roots = classify(df, id_col, text_col, **how)
    nodes = rows.groupBy("key").agg(F.min("id").alias("first")).join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("root", "key").alias("class"))
    named = nodes.groupBy("class").agg(F.min("first").alias("class_id"))
    return rows.select("id", "key").join(nodes.join(named, "class").select("key", "class_id"), "key").select(F.col("id").alias(id_col), "class_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of df of each class: the one with the least id (nulls last), of equal ids the least text digest, of equal rows one."""
    rows, roots = classify(df, id_col, text_col, **how)
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "digest", "copies")).alias("first")
    nodes = rows.groupBy("key", "id", "digest").agg(F.count("*").alias("copies")).groupBy("key").agg(first)
    classes = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").groupBy(F.coalesce("root", "key").alias("class")).agg(F.min("first").alias("first"))
    own, digest, kept_digest, copies = (f"__kept_{x}" for x in ("id", "digest", "of", "copies"))
    best = classes.select(F.col("first.id").alias(own), F.col("first.digest").alias(kept_digest), F.col("first.copies").alias(copies))
    kept = df.withColumn(digest, text_digest(text_col)).join(best, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(digest) == F.col(kept_digest)))
    single = kept.filter(F.col(copies) == 1).select(df.columns)
    # Rows that share id and text: rare but in tables that repeat rows; one of each, by aggregation in the tasks first.
    return single.unionByName(kept.filter(F.col(copies) > 1).dropDuplicates([own, digest]).select(df.columns))
