"""Similarity of texts: exact, by edits, by tokens, by structure, by matching blocks, by TF-IDF."""

from __future__ import annotations

import ast
import difflib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import text as tx


def exact(a: Column, b: Column) -> Column:
    return a == b


def edit(a: Column, b: Column) -> Column:
    """1 less the share of edits; 0 when either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def code_tokens(text: Column) -> Column:
    """Distinct tokens: comments stripped, words of more than one letter and operators."""
    bare = F.regexp_replace(F.regexp_replace(text, r"/\*(?s:.*?)\*/", " "), r"(#|//)[^\n]*", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\w\w+|[-+*/=<>!&|%]"), F.lit(0)))


def token_jaccard(a: Column, b: Column) -> Column:
    return tx.jaccard(code_tokens(a), code_tokens(b))


def _labels(code: str) -> set[str] | None:
    try:
        return {type(node).__name__ for node in ast.walk(ast.parse(code or ""))}
    except (SyntaxError, ValueError, RecursionError):
        return None


@pandas_udf(DoubleType())
def structural(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard of the labels in the syntax trees of Python code; null where either has none, for token_jaccard to stand in."""
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = _labels(x), _labels(y)
        out.append(None if p is None or q is None else len(p & q) / len(p | q))
    return pd.Series(out, dtype="float64")


@pandas_udf(DoubleType())
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks once lower-case identifiers are alike."""
    plain = lambda x: re.sub(r"\s+", " ", re.sub(r"\b[a-z_][a-z0-9_]*\b", "VAR", x or "")).strip()
    return pd.Series([difflib.SequenceMatcher(None, plain(x), plain(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w, x): TF-IDF weights tf * (ln((1 + n) / (1 + df)) + 1), each text's of length 1."""
    tf = df.select(key, F.explode(tx.words(F.col(text))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("n"))
    weighed = tf.join(tf.groupBy("w").agg(F.count("*").alias("df")), "w").join(F.broadcast(n)).select(key, "w", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))  # n: one row
    norm = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return weighed.join(norm, key).select(key, "w", (F.col("x") / F.col("norm")).alias("x"))


def _bags(batches):
    """Of each text its distinct words, and how often each stands in it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            counted = [Counter(w.split(" ")) for w in part.column(1).to_pylist()]
            tf = [np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in counted]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([" ".join(c) for c in counted], pa.string()), pa.array(tf, pa.binary())], names=["id", "w", "tf"])


def _texts(batches, learn=None):
    """(g, id, own, words with their counts) of rows (g, id, own, w, tf, ...) in order, those of one id together; rows without counts go to ``learn``."""
    now, held = None, {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for g, id_, own, w, tf, *more in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if (g, id_, own) != now or tf is None:
                    if now:
                        yield *now, held
                    now = None
                if tf is None:
                    learn(g, w, *more)
                    continue
                counts = dict(zip(w.split(" "), np.frombuffer(tf, np.int32).tolist(), strict=True))
                if now is None:
                    now, held = (g, id_, own), counts
                    continue
                for word, n in counts.items():
                    held[word] = held.get(word, 0) + n
    if now:
        yield *now, held


def _vocabulary(batches):
    """In how many of a part's own texts each word stands that it needs."""
    group, texts = None, Counter()

    def told():
        words = list(texts)
        for at in range(0, len(words), 1 << 16):
            some = words[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(some), pa.int32()), pa.array(some, pa.string()), pa.array([texts[w] for w in some], pa.int64())], names=["g", "w", "n"])

    for g, _, own, counts in _texts(batches):
        if g != group:
            yield from told()
            group, texts = g, Counter()
        for word in counts:
            texts[word] += own
    yield from told()


def tfidf_of_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cosine) of each text with the one of the next key, where they share a word.

    Words are counted in a text's row, and a text goes as one row to the part of its key; the first of 64 keys goes to the
    part of those before it as well. Only a part's distinct words meet those of other parts, to sum the texts that hold them.
    """
    n = df.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 16384))
    part_of = lambda bucket: F.pmod(F.xxhash64(bucket), F.lit(parts)).cast("int")
    bucket = F.shiftright("id", 6)
    own, before = part_of(bucket), part_of(bucket - 1)
    place = lambda g, is_own: F.struct(g.alias("g"), F.lit(is_own).alias("own"))
    places = F.when((F.col("id").bitwiseAND(63) == 0) & (own != before), F.array(place(own, True), place(before, False))).otherwise(F.array(place(own, True)))
    words = df.select(F.col(key).cast("long").alias("id"), F.array_join(tx.words(F.col(text)), " ").alias("w")).filter("w <> ''")
    bags = words.mapInArrow(_bags, "id long, w string, tf binary")
    placed = bags.withColumn("place", F.explode(places)).select("place.g", "id", "place.own", "w", "tf")
    counted = placed.repartitionById(parts, F.col("g")).sortWithinPartitions("g", "id").mapInArrow(_vocabulary, "g int, w string, n long")
    # A word that a part isn't told of stands in one text.
    known = counted.groupBy("w").agg(F.sum("n").alias("df"), F.collect_list("g").alias("gs")).filter("df > 1")
    told = known.select(F.explode("gs").alias("g"), F.lit(None).cast("long").alias("id"), F.lit(True).alias("own"), "w", F.lit(None).cast("binary").alias("tf"), "df", F.lit(0).alias("side"))
    def cosines(batches):
        part, weights, least = None, {}, math.log((1 + n) / 2) + 1
        last, ids, found = (None, None, False, {}, 1.0), [], []

        def start(g):
            nonlocal part, weights
            if g != part:
                part, weights = g, {}

        def learn(g, word, df, _):
            start(g)
            weights[word] = math.log((1 + n) / (1 + df)) + 1

        def ready():
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.float64())], names=["id", "cosine"])
            ids.clear(), found.clear()
            return out

        for g, id_, own, counts in _texts(batches, learn):
            start(g)
            x = {word: tf * weights.get(word, least) for word, tf in counts.items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            if last[2] and last[0] == g and last[1] == id_ - 1 and (both := last[3].keys() & x.keys()):
                ids.append(last[1])
                found.append(sum(x[w] * last[3][w] for w in both) / last[4] / norm)
            last = (g, id_, own, x, norm)
            if len(ids) == 4096:
                yield ready()
        yield ready()

    asked = placed.filter("id is not null").withColumns({"df": F.lit(None).cast("long"), "side": F.lit(1)})
    both = told.unionByName(asked).repartitionById(parts, F.col("g")).sortWithinPartitions("g", "side", "id")
    return both.mapInArrow(cosines, "id long, cosine double").select(F.col("id").alias(key), "cosine")


def all_metrics(a: Column, b: Column) -> Column:
    """struct(exact, edit, tokens, structure, blocks)."""
    tokens = token_jaccard(a, b)
    return F.struct(exact(a, b).alias("exact"), edit(a, b).alias("edit"), tokens.alias("tokens"), F.coalesce(structural(a, b), tokens).alias("structure"), matching_blocks(a, b).alias("blocks"))
