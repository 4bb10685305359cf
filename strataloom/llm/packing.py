"""Packing (operator 1): token windows filled by Karmarkar-Karp multiway differencing.

Each task encodes its documents (ids, then the end id) and cuts whole windows of ``capacity`` ids off long ones. What is left
is cut into pieces of at most ``piece`` ids and gathered in blocks of a bounded number of windows. A block starts with
the fewest windows that could hold it; multiway differencing merges partial partitions, largest with smallest sums, so the
window sums end nearly equal; while one exceeds the capacity, the block gets one window more. Ids of a document that meet in
a window are laid side by side there. What a task's last block has beyond whole windows goes to powers of two, which need no
padding.

A task needs its own rows only: no shuffle, bounded memory, the same result when it runs again. Sequence ids hold the task's
number in the high bits. Defined results: a null or empty text is the end id alone; repeated rows and repeated ids are packed
each on its own; ids come out as they went in, nulls too; a text of any length is cut into whole windows and a rest; of equal
sums the older partition is merged first; extra columns don't matter; an empty table has no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import bpe_of
from .common import GenerationCache, once, ship, sliced, tokenizer_path


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in ``ways`` parts of nearly equal sums."""
    order = count()
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(ways, np.int64)
        sums[-1] = s
        heap.append((-s, next(order), sums, [None] * (ways - 1) + [(i, None)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, parts_a = heapq.heappop(heap)
        _, _, b, parts_b = heapq.heappop(heap)
        sums = a + b[::-1]  # the largest of one with the smallest of the other
        parts = [(x, y) if x and y else x or y for x, y in zip(parts_a, reversed(parts_b), strict=True)]
        rank = np.argsort(sums, kind="stable")
        sums = sums[rank]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), next(order), sums - sums[0], [parts[r] for r in rank.tolist()]))

    def flat(node) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x is None:
                continue
            if isinstance(x[0], int):
                out.append(x[0])
                todo.append(x[1])
            else:
                todo += x
        return out

    return [flat(p) for p in heap[0][3]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the lower bound up, whose sums all keep to the capacity."""
    total, ways = sum(sizes), max(1, -(-sum(sizes) // capacity))
    if not total:
        return []
    while True:
        parts = differencing(sizes, ways)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return parts
        ways += 1


class Packer:
    """Pieces of documents in, rows (document number, start, length, sequence, offset) out."""

    def __init__(self, capacity: int, block: int, first: int, piece: int):
        self.capacity, self.block, self.next, self.piece = capacity, block, first, max(1, piece)
        self.items: list[tuple[int, int, int]] = []
        self.held = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc: int, n: int):
        c = self.capacity
        whole = n // c
        for k in range(whole):
            yield doc, k * c, c, self.new(), 0
        at = whole * c
        while at < n:
            size = min(self.piece, n - at)
            self.items.append((doc, at, size))
            self.held += size
            at += size
        # A little under whole windows leaves the slack that differencing needs.
        if self.held >= self.block * c - c // 4:
            yield from self.emit(self.items)
            self.items, self.held = [], 0

    def emit(self, items):
        for part in windows([s for _, _, s in items], self.capacity):
            yield from self.lay([items[i] for i in sorted(part)])

    def lay(self, items):
        seq, offset, open_ = self.new(), 0, None
        for doc, start, size in items:
            if open_ and open_[0] == doc and open_[1] + open_[2] == start:
                open_[2] += size
            else:
                if open_:
                    yield open_[0], open_[1], open_[2], seq, offset - open_[2]
                open_ = [doc, start, size]
            offset += size
        if open_:
            yield open_[0], open_[1], open_[2], seq, offset - open_[2]

    def finish(self):
        """The rest: windows by differencing as long as a whole one is left, then sequences at powers of two.

        Differencing gets the least slack of a few with which no further window rises; what the slack leaves is laid out with the rest.
        """
        c, todo, self.items = self.capacity, self.items, []
        ways = self.held // c
        for slack in (2 * ways, c // 8, c // 4, c // 2):
            first, rest = split(todo, max(0, ways * c - slack))
            if len(windows([s for *_, s in first], c)) <= ways:
                break
        yield from self.emit(first)
        left = sum(s for *_, s in rest)
        for goal in [c] * (left // c) + [1 << k for k in range(left.bit_length(), -1, -1) if (left % c) >> k & 1]:
            now, rest = split(rest, goal)
            yield from self.lay(now)


def split(items: list[tuple[int, int, int]], goal: int) -> tuple[list, list]:
    """Items of ``goal`` ids together, the last one cut, and what is left."""
    for k, (doc, start, size) in enumerate(items):
        if goal < size:
            return [*items[:k], (doc, start, goal)] if goal else items[:k], [(doc, start + goal, size - goal), *items[k + 1 :]]
        goal -= size
    return items, []


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, capacity: int = 1024, block: int = 96, piece: int = 128) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (length of its sequence as stored)."""
    raw = ship(df.sparkSession, path or tokenizer_path("byte_bpe_50k.json"))
    end = np.array([end_id], "<u4").tobytes()
    schema = StructType([StructField("id", df.schema[id_col].dataType)] + [StructField(x, LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    types, names = list(to_arrow_schema(schema).types), schema.names

    def run(batches):
        b = bpe_of(raw)
        encode = encoder(b)
        packer = Packer(capacity, block, TaskContext.get().partitionId() << 36, piece)
        held: dict[int, list] = {}  # documents with ids still in the packer's block
        number = count()

        def rows(pieces):
            out = []
            for n, start, length, seq, offset in pieces:
                d = held[n]
                out.append((d[0], start, length, zlib.crc32(d[1][4 * start : 4 * (start + length)]), len(d[1]) // 4, seq, offset))
                d[2] -= length
                if not d[2]:
                    del held[n]
            return out

        def frame(out):
            columns = zip(*out, strict=True) if out else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

        for batch in sliced(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = next(number)
                held[n] = [doc, ids, len(ids) // 4]
                out += rows(packer.add(n, len(ids) // 4))
            yield frame(out)
        yield frame(rows(packer.finish()))

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encoder(b):
    """text -> its ids as little-endian unsigned 32-bit bytes; pre-tokens are remembered in the worker."""

    def make():
        import tiktoken

        code = {c: x for x, c in enumerate(b.chars)}
        ranks = {bytes(code[c] for c in s): i for s, i in b.vocab.items()}
        merge = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        code_of = code.__getitem__
        plain = GenerationCache(lambda p: np.array(merge(p.encode()), "<u4").tobytes())
        mapped = GenerationCache(lambda p: np.array(merge(bytes(map(code_of, p))), "<u4").tobytes(), 50_000)
        return plain, mapped

    plain, mapped = once("tokens", ("ids", id(b)), make)

    def encode(text: str) -> bytes:
        out = []
        for special, part in b.parts(text):
            if special >= 0:
                out.append(np.array([special], "<u4").tobytes())
            else:
                is_plain, pieces = b.pieces(part)
                out += map((plain if is_plain else mapped).__getitem__, pieces)
        return b"".join(out)

    return encode
