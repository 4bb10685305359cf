"""Nearest neighbours (operator 6): an inverted file whose cells are left out by exact bounds only, so results are exact.

Unit vectors are dealt to the nearest of at most ``CELLS`` centres, fitted on a bounded sample; every row is indexed. A query's
floor is its (k + 1)-th best cosine with the sample, so no row below it can be among its nearest. A cell's narrowest cosine to
its centre bounds, by the triangle inequality on angles, the cosine of its rows with a query; a cell whose bound is under the
floor is left out. On clustered vectors that leaves few cells; on vectors near to noise none can be left out, and the work is
one comparison of every query with every row, which grows with the square.

Cells are packed into groups of rows that a task can hold (``GROUP`` bytes; larger cells are cut by a hash of the id). A task
holds one group and streams the queries that need it, ``ASKED`` at a time, so its memory depends on neither the number of rows
nor of queries. Tiles of rows are compared in single precision by one matrix product; what comes within its rounding of a
query's floor, which rises on the way, is scored in double precision from the original vectors.

Equal vectors are one entry with its k + 1 least ids, so a vector that a third of all rows share costs as much as any other.
Defined results: vectors null, empty, zero, of another length than most, or holding null or non-finite components take no part,
nor do rows with a null id; a query with fewer candidates gets all; ties go to the smaller id. Repeated rows count once, and a
repeated id with several vectors has the one whose components come first in order. Extra columns don't matter; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import cut, sliced

#: Centres at most; bytes of the vectors of a group; rows and queries of a tile.
CELLS, GROUP, TILE, ASKED = 256, 1 << 26, 1024, 512
#: By how much a bound must miss a floor; well over the rounding of angles in double precision.
SLACK = 1e-6
PARTS = "g int, side int, id long, cell int, floor double, v binary"


def _double(x: np.ndarray) -> np.ndarray:
    """x in double precision, each vector scaled by a power of two so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _double(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(x: np.ndarray) -> pa.Array:
    ends = (np.arange(len(x) + 1) * x.shape[1] * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, all of one length (the commonest, the smaller on a tie)."""
    v = F.col("v")
    kind = "float" if isinstance(getattr(df.schema[vec_col].dataType, "elementType", None), FloatType) else "double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(2).collect()
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    if len(lengths) < 2:
        return rows
    return rows.filter(F.size("v") == rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head().n)


def nearest(df: DataFrame, query: F.Column | str, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): k nearest by cosine of each row that meets ``query`` (a condition on id), itself left out."""
    spark = df.sparkSession
    rows = valid(df, id_col, vec_col)
    # Copies: the entry is the least id, and at most k + 1 ids can ever be among a query's k nearest.
    hashed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    copies = Window.partitionBy("h1", "h2")
    least = hashed.withColumn("n", F.row_number().over(copies.orderBy("id"))).filter(F.col("n") <= k + 1).withColumn("entry", F.min("id").over(copies))
    least = cut(least.select("entry", "id", F.when(F.col("n") == 1, F.col("v")).alias("v")))
    entries = least.filter("id = entry").select("id", "v")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # The first by hash; those under twice the wanted share hold them, so that the driver gets no more from any number of tasks.
    low = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 2 * (sample + 50) / n) * (1 << 30))
    picked = entries.filter(low).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    kind = "f4" if isinstance(rows.schema["v"].dataType.elementType, FloatType) else "f8"
    known = _unit(np.array([r.v for r in picked], kind))
    dim = known.shape[1]
    centres = _centres(known, int(np.clip(n // (2 * TILE), 1, CELLS)))

    def dealt(batches):
        """Of each slice ids, vectors, unit vectors and their cosines to the centres: the same whenever the same partition is read."""
        for batch in sliced(batches):
            if batch.num_rows:
                unit = _unit(x := _lists(batch.column(1)))
                yield batch.column(0), x, unit, unit @ centres.T

    def measure(batches):
        for _, _, _, near in dealt(batches):
            yield pa.RecordBatch.from_arrays([pa.array(near.argmax(1), pa.int32()), pa.array(near.max(1))], names=["cell", "narrow"])

    directory = entries.mapInArrow(measure, "cell int, narrow double").groupBy("cell").agg(F.count("*").alias("n"), F.min("narrow").alias("narrow")).collect()  # a row a cell
    most = max(1, min(GROUP // (dim * np.dtype(kind).itemsize), max(4 * TILE, -(-n // 16))))
    first, parts, groups = _grouped({r.cell: r.n for r in directory}, most)
    radius = np.zeros(len(centres))
    reach = np.zeros((len(centres), groups), bool)
    for r in directory:
        radius[r.cell] = np.arccos(np.clip(r.narrow, -1, 1))
        reach[r.cell, first[r.cell] : first[r.cell] + parts[r.cell]] = True

    def part(g, side, ids, cells, floors, x):
        columns = [pa.array(g, pa.int32()), pa.array(np.full(len(x), side), pa.int32()), ids, pa.array(cells, pa.int32()), pa.array(floors, pa.float64()), _packed(x)]
        return pa.RecordBatch.from_arrays(columns, names=["g", "side", "id", "cell", "floor", "v"])

    def held(batches):
        for ids, x, _, near in dealt(batches):
            cells = near.argmax(1)
            spread = (ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield part(first[cells] + spread % parts[cells], 0, ids, cells, np.zeros(len(x)), x)

    def asking(batches):
        for ids, x, unit, near in dealt(batches):
            floors = np.full(len(x), -2.0)
            if len(known) > k:
                floors = -np.partition(-(unit @ known.T), k, axis=1)[:, k] - 1e-9
            needs = (_bounds(near, radius) >= floors[:, None] - SLACK) @ reach
            for g in range(groups):
                at = np.flatnonzero(needs[:, g])
                if len(at):
                    yield part(np.full(len(at), g), 1, ids.take(pa.array(at)), np.zeros(len(at)), floors[at], x[at])

    def scan(batches):
        group, chunks, tiles = -1, [], None
        for batch in batches:
            g, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = [*(np.flatnonzero((np.diff(g) != 0) | (np.diff(side) != 0)) + 1).tolist(), batch.num_rows]
            at = 0
            for end in ends if batch.num_rows else []:
                if g[at] != group:
                    group, chunks, tiles = g[at], [], None
                one = batch.slice(at, end - at)
                ids, x = one.column(2).to_numpy(), _unpacked(one.column(5), kind)
                if side[at] == 0:
                    chunks.append((ids.copy(), one.column(3).to_numpy().copy(), x.copy()))
                else:
                    if tiles is None:
                        tiles, chunks = Tiles(*(np.concatenate(c) for c in zip(*chunks, strict=True))), []
                    floors = one.column(4).to_numpy()
                    for s in range(0, len(ids), ASKED):
                        i, found, score = tiles.best(x[s : s + ASKED], floors[s : s + ASKED], k + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + ASKED][i]), pa.array(found), pa.array(score)], names=["qid", "id", "score"])
                at = end

    asked = cut(hashed.filter(query))
    once = asked.groupBy("h1", "h2").agg(F.min("id").alias("qid"), F.min("v").alias("v"))
    queries = asked.select(F.col("id").alias("query_id"), "h1", "h2").join(once.select("h1", "h2", "qid"), ["h1", "h2"]).select("query_id", "qid")
    both = entries.mapInArrow(held, PARTS).unionByName(once.select("qid", "v").mapInArrow(asking, PARTS))
    found = both.repartitionById(groups, F.col("g")).sortWithinPartitions("g", "side").mapInArrow(scan, "qid long, id long, score double")
    by_query = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(by_query)).filter(F.col("n") <= k + 1).select("qid", F.col("id").alias("entry"), "score")
    pairs = queries.join(best, "qid").join(least.select("entry", F.col("id").alias("vec_id")), "entry").filter("vec_id != query_id")
    by_id = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by_id)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", F.col("score"))


def _centres(known: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Unit vectors that a few rounds of spherical k-means find; cells that lose all their rows keep their centre."""
    centres = known[:cells].copy()
    for _ in range(rounds):
        total = np.zeros_like(centres)
        np.add.at(total, (known @ centres.T).argmax(1), known)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centres)
    return centres


def _grouped(sizes: dict[int, int], most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group of each cell, groups it is cut into, groups): ``most`` rows a group, but for what a hash deals unevenly."""
    first, parts = np.zeros(max(sizes) + 1, np.int64), np.ones(max(sizes) + 1, np.int64)
    g = held = 0
    for cell, n in sorted(sizes.items()):
        if held and held + n > most:
            g, held = g + 1, 0
        first[cell], parts[cell] = g, -(-n // most)
        if parts[cell] > 1:
            g += int(parts[cell])
        else:
            held += n
    return first, parts, g + (held > 0)


def _bounds(cosines: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest cosine that vectors within ``radius`` of a centre can have with a query of that cosine to it."""
    return np.cos(np.maximum(0, np.arccos(np.clip(cosines, -1, 1)) - radius))


class Tiles:
    """The rows of a group by cell, in tiles of at most TILE rows of one cell."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, x: np.ndarray):
        order = np.argsort(cells, kind="stable")
        self.ids, self.x, cells = ids[order], x[order], cells[order]
        starts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        self.spans = [(s, min(s + TILE, end)) for begin, end in zip(starts, starts[1:], strict=False) for s in range(begin, end, TILE)]
        self.size, self.single = np.empty(len(x)), np.empty(x.shape, np.float32)
        self.score = np.empty(ASKED * TILE, np.float32)
        centres, narrow = [], []
        for s, e in self.spans:
            rows = _double(self.x[s:e])
            self.size[s:e] = np.linalg.norm(rows, axis=1)
            self.single[s:e] = unit = rows / self.size[s:e, None]
            centre = unit.sum(0)
            # The rows of a tile may cancel out; any direction will do then.
            centre = centre / norm if (norm := np.linalg.norm(centre)) > 1e-9 else unit[0]
            centres.append(centre)
            narrow.append((unit @ centre).min())
        self.centres, self.radius = np.array(centres), np.arccos(np.clip(narrow, -1, 1))

    def best(self, asked: np.ndarray, floors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in asked, id, score) of the ``most`` rows of largest cosine of each query, those at its floor or above; ties to the smaller id."""
        exact, dim = _double(asked), asked.shape[1]
        norm = np.linalg.norm(exact, axis=1)
        unit = exact / norm[:, None]
        single, floor = unit.astype(np.float32), floors.copy()
        bounds = _bounds(unit @ self.centres.T, self.radius)
        near = np.float32((dim + 4) * 2.0**-23)
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        pending, waiting = [], 0

        def merged():
            i, ids, score = (np.concatenate(c) for c in zip(kept, *pending, strict=True))
            order = np.lexsort((ids, -score, i))
            i, ids, score = i[order], ids[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            full = place == most - 1
            floor[i[full]] = np.maximum(floor[i[full]], score[full])
            return tuple(c[place < most] for c in (i, ids, score))

        for t, (s, e) in enumerate(self.spans):
            at = np.flatnonzero(bounds[:, t] >= floor - SLACK)
            if not len(at):
                continue
            score = self.score[: len(at) * (e - s)].reshape(len(at), e - s)
            np.matmul(single[at], self.single[s:e].T, out=score)
            least = floor[at].astype(np.float32) - near
            hit = np.flatnonzero(score.max(1) >= least)
            i, j = np.nonzero(score[hit] >= least[hit, None])
            if len(i) > score.size // 16:  # many rows as near as single precision can tell
                i, j = np.nonzero(unit[at[hit]] @ _unit(self.x[s:e]).T >= floor[at[hit], None] - 1e-12)
            i = at[hit][i]
            for c in range(0, len(i), step := max(1, (1 << 22) // dim)):
                # Summed in one order wherever a pair meets, so that equal cosines stay equal.
                a, b = i[c : c + step], s + j[c : c + step]
                pending.append((a, self.ids[b], (exact[a] * _double(self.x[b])).sum(1) / (norm[a] * self.size[b])))
                waiting += len(a)
                if waiting > 8 * len(asked):
                    kept, pending, waiting = merged(), [], 0
        return merged()
