"""Relational operators over corpora: totals, duplicates, diffs, entropy, full-text search, packing."""

from __future__ import annotations

import heapq
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def diff(old: DataFrame, new: DataFrame, key: str, checksum: str) -> DataFrame:
    """(key, status): new, modified, deleted or unchanged, by one full outer join on the key."""
    a = old.select(key, F.col(checksum).alias("was"), F.lit(True).alias("in_old"))
    b = new.select(key, F.col(checksum).alias("now"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes, and those of current whose key isn't among them."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)


def duplicate_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, copies, first): contents that several keys share; members aren't gathered."""
    return df.groupBy(F.md5(text).alias("digest")).agg(F.count("*").alias("copies"), F.min(key).alias("first")).filter("copies > 1")


def _equals(word: str):
    return lambda x: x == word


def bm25(df: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75, every: bool = False) -> DataFrame:
    """(key, score) of the rows that hold a query word (with ``every``: all of them).

    One pass keeps each text's key, length and counts of the query words; corpus statistics are one row of sums over that.
    """
    words, query = tx.words(F.col(text)), list(dict.fromkeys(query))
    doc = df.select(key, words.alias("w")).select(key, F.size("w").alias("len"), *(F.size(F.filter("w", _equals(q))).alias(f"tf{k}") for k, q in enumerate(query)))
    stats = doc.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(query))))
    holds = [F.col(f"tf{k}") > 0 for k in range(len(query))]
    some = holds[0]
    for h in holds[1:]:
        some = some & h if every else some | h

    def part(k: int):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        return F.when(holds[k], idf * F.col(f"tf{k}") * (k1 + 1) / (F.col(f"tf{k}") + k1 * (1 - b + b * F.col("len") / F.col("avg")))).otherwise(F.lit(0.0))

    return doc.filter(some).join(F.broadcast(stats)).select(key, sum((part(k) for k in range(len(query))), F.lit(0.0)).alias("score"))  # stats: one row


def greedy_pack(df: DataFrame, key: str, text: str, budget: int = 450) -> DataFrame:
    """(key, chunk, tokens): lines packed in order while their token estimates fit the budget; a fold, for the bin resets on data."""
    sizes = F.transform(tx.lines(tx.whole(F.col(text))), tx.token_estimate)
    start = F.struct(F.array().cast("array<bigint>").alias("bins"), F.lit(-1).cast("long").alias("held"))

    def step(acc, n):
        fits = (acc.held >= 0) & (acc.held + n <= budget)
        return F.struct(F.when(fits | (acc.held < 0), acc.bins).otherwise(F.array_append(acc.bins, acc.held)).alias("bins"), F.when(fits, acc.held + n).otherwise(n).alias("held"))

    bins = F.aggregate(sizes, start, step, lambda acc: F.array_append(acc.bins, acc.held))
    return df.select(key, F.posexplode(bins).alias("chunk", "tokens"))


def top_k(df: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """First k rows of each group; the rank limit is applied before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def _commonest(k: int):
    def of(batches):
        """(key, gram, n, rank) of texts whose words are joined by spaces."""
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                at, grams, counts, ranks = [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    w = text.split(" ")
                    c = Counter(w)
                    c.update(map(" ".join, zip(w, w[1:])))  # noqa: B905
                    least = heapq.nlargest(k, c.values())[-1]
                    best = heapq.nsmallest(k, ((-n, gram) for gram, n in c.items() if n >= least))
                    at += [row] * len(best)
                    grams += [gram for _, gram in best]
                    counts += [-n for n, _ in best]
                    ranks += range(1, len(best) + 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(grams, pa.string()), pa.array(counts, pa.int64()), pa.array(ranks, pa.int64())], names=["key", "gram", "n", "rank"])

    return of


def top_grams(df: DataFrame, key: str, words: Column, k: int = 10) -> DataFrame:
    """(key, gram, n, rank): the k commonest words and pairs of words of each key, ties to the smaller gram.

    A text is counted in its row. Only texts whose key others have too are exploded and shuffled.
    """
    d, kind = df.select(key, words.alias("w")), df.schema[key].dataType.simpleString()
    repeated = df.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("texts")).filter("texts > 1").select("again")
    again = repeated.count() > 0
    same = F.col(key).eqNullSafe(F.col("again"))
    once = (d.join(repeated, same, "left_anti") if again else d).filter("size(w) > 0").select(key, F.array_join("w", " ").alias("w"))
    found = once.mapInArrow(_commonest(k), f"key {kind}, gram string, n long, rank long").withColumnRenamed("key", key)
    if not again:
        return found
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    grams = d.join(repeated, same, "left_semi").select(key, F.explode(F.concat("w", pairs)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))
    return found.unionByName(top_k(grams, [key], [F.desc("n"), "gram"], k).withColumn("rank", F.col("rank").cast("long")))
