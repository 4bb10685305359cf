"""Exact vector operators: queries stream past groups of rows, a tile of each being one matrix product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task holds (bytes of their vectors); queries of a strip, and strips at most; rows and queries of a tile.
GROUP, STRIP, STRIPS, TILE, ASKED = 1 << 25, 1024, 16, 1024, 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(values) // max(1, len(column))
    if (np.asarray(pc.list_value_length(column)) != width).any():
        raise ValueError("vectors of unlike lengths")
    return values.reshape(len(column), width) if width else np.zeros((len(column), 1))


def _norms(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1)
    return np.where(n > 0, n, 1)  # the zero vector has cosine 0 with all


class _Held:
    """Rows of a group by id; of equal vectors those that can be among the k nearest of any query."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        order = order[np.isfinite(x[order]).all(1)]  # a cosine that is no number is above no other
        ids, x = ids[order], x[order]
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((ids, same))
        v, i, at = same[order], ids[order], np.arange(len(ids))
        new = np.r_[True, v[1:] != v[:-1]][: len(at)]
        other = new | np.r_[True, i[1:] != i[:-1]][: len(at)]
        begun = lambda marks: np.maximum.accumulate(np.where(marks, at, 0))
        nth = np.cumsum(other)
        # k + 1 ids, for the query's own takes no part, and k rows of each.
        kept = np.sort(order[(nth - nth[begun(new)] <= k) & (at - begun(other) < k)])
        self.ids, self.x = ids[kept], x[kept]
        self.norm = _norms(self.x)
        self.single = (self.x / self.norm[:, None]).astype(np.float32)

    def best(self, qids: np.ndarray, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, id, score) of the k rows of largest cosine, ties to the smaller id.

        Tiles are compared in single precision; what comes within its rounding of a query's floor, which rises on the way,
        is scored in double precision, summed in one order wherever a pair meets, so that equal cosines stay equal.
        """
        norm = _norms(q)
        single, floor = (q / norm[:, None]).astype(np.float32), np.full(len(q), least)
        near = np.float32((q.shape[1] + 4) * 2.0**-23)
        kept, pending, waiting = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0

        def merged():
            i, ids, score = (np.concatenate(c) for c in zip(kept, *pending, strict=True))
            order = np.lexsort((ids, -score, i))
            i, ids, score = i[order], ids[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            full = place == k - 1
            floor[i[full]] = np.maximum(floor[i[full]], score[full])
            return tuple(c[place < k] for c in (i, ids, score))

        for s in range(0, len(self.ids), TILE):
            score = single @ self.single[s : s + TILE].T
            if not s:
                score[qids[:, None] == self.ids[None, :TILE]] = -2
                if score.shape[1] > k:
                    floor = np.maximum(floor, -np.partition(-score, k - 1, axis=1)[:, k - 1].astype(np.float64) - 2 * near)
            low = floor.astype(np.float32) - near
            hit = np.flatnonzero(score.max(1) >= low)
            i, j = np.nonzero(score[hit] >= low[hit, None])
            i, j = hit[i], s + j
            other = qids[i] != self.ids[j]
            i, j = i[other], j[other]
            for c in range(0, len(i), step := 1 << 16):
                a, b = i[c : c + step], j[c : c + step]
                exact = (q[a] * self.x[b]).sum(1) / (norm[a] * self.norm[b])
                ok = exact >= floor[a]
                pending.append((a[ok], self.ids[b][ok], exact[ok]))
                waiting += int(ok.sum())
                if waiting > 8 * len(q) * max(1, k // 8):
                    kept, pending, waiting = merged(), [], 0
        return merged()


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, least: float | None = None) -> DataFrame:
    """(query_id, key, score, rank): of each query the k rows of largest cosine but itself (ties to the smaller key), those of ``least`` or more.

    Rows are dealt into groups that a task can hold and queries into strips. A task holds one group and streams one strip past
    it, so its memory depends on neither number. A row is shuffled once a strip, 16 times at most; a query once a group.
    Null vectors take no part.
    """
    floor = -1.5 if least is None else float(least)
    sized = lambda df: df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    left, right = sized(rows), sized(queries)
    size = left.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).head()
    groups = max(1, -(-size.n * max(1, size.width or 1) * 4 // GROUP))
    strips = min(STRIPS, max(1, -(-right.count() // STRIP)))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("b", deal(groups, 0)).withColumn("s", every(strips))
    right = right.withColumn("s", deal(strips, 1)).withColumn("b", every(groups))
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).select((F.col("b") * strips + F.col("s")).cast("int").alias("g"), "side", "id", "v")

    def scan(batches):
        group, parts, held = None, [], None
        for batch in batches:
            g, side = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(side) != 0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if e == s:
                    continue
                if g[s] != group:
                    group, parts, held = g[s], [], None
                ids, x = np.array(batch.column(2)[s:e]), _matrix(batch.column(3)[s:e])
                if side[s] == 0:
                    parts.append((ids, x))
                    continue
                if held is None and parts:
                    held, parts = _Held(*(np.concatenate(c) for c in zip(*parts, strict=True)), k), []
                for c in range(0, len(ids) if held else 0, ASKED):
                    some = ids[c : c + ASKED]
                    i, found, score = held.best(some, x[c : c + ASKED], k, floor)
                    yield pa.RecordBatch.from_arrays([pa.array(some[i]), pa.array(found), pa.array(score)], names=["qid", "id", "score"])

    found = both.repartitionById(groups * strips, F.col("g")).sortWithinPartitions("g", "side").mapInArrow(scan, "qid long, id long, score double")
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select(F.col("qid").alias("query_id"), F.col("id").alias(key), "score", "rank")


def distance_scores(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with euclid = 1 / (1 + distance) and manhattan = 1 / (1 + sum of differences)."""
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    total = lambda f: F.aggregate(diff, F.lit(0.0), lambda s, d: s + f(d))
    return df.withColumns({"euclid": 1 / (1 + F.sqrt(total(lambda d: d * d))), "manhattan": 1 / (1 + total(F.abs))})


def pool(df: DataFrame, tokens: str, how: str = "mean") -> DataFrame:
    """df with ``pooled``, the mean, max, first (cls) or falling-weight mean of an array of token vectors."""
    t, n = F.col(tokens), F.size(tokens)
    width = F.sequence(F.lit(0), F.size(F.element_at(tokens, 1)) - 1)
    if how == "cls":
        return df.withColumn("pooled", F.element_at(tokens, 1))
    if how == "max":
        return df.withColumn("pooled", F.transform(width, lambda d: F.array_max(F.transform(t, lambda v: F.get(v, d)))))
    weight = (lambda i: n - i) if how == "weighted" else (lambda i: F.lit(1))
    every = F.sequence(F.lit(0), n - 1)
    total = F.aggregate(F.transform(every, weight), F.lit(0.0), lambda s, w: s + w)
    return df.withColumn("pooled", F.transform(width, lambda d: F.aggregate(F.transform(every, lambda i: F.get(F.get(t, i), d) * weight(i)), F.lit(0.0), lambda s, x: s + x) / total))


def normalise(vector: F.Column, least: float = 1e-9) -> F.Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x / F.greatest(norm, F.lit(least)))
