"""Token counts (operator 9): a map-side two-tier lookup without any shuffle of the texts' pre-tokens.

Tier one is a table of the pre-tokens frequent in the whole corpus, with their lengths in tokens. Each task finds its
candidates over all its texts with a Misra-Gries summary, so any pre-token that makes up 1/``tier`` of all pre-tokens is in
the table; of each task at most ``tier`` (pre-token, count) rows meet, and at most ``tier`` entries are broadcast. Pre-tokens of
texts that the fast splitter can't split are in byte characters, and keyed apart. Tier two is a bounded cache in each Python
worker for what the table lacks; a miss is encoded by the library. Tiers change speed only, never counts.

Defined results: null is the empty text, with 0 bytes and 0 tokens; special strings in a text count one token each; a text of
any length is counted whole. Among equally frequent pre-tokens the table takes the smaller. Ids come out as they went in
(nulls and repeated ones too), repeated rows are repeated, extra columns don't matter, an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import bpe_of
from .common import GenerationCache, per_row, ship, sliced, tokenizer_path


class _Counts(GenerationCache):
    def __init__(self, fn, frequent):
        super().__init__(fn)
        self.frequent = frequent
        self.update(frequent)

    def clear(self):
        super().clear()
        self.update(self.frequent)


def frequent_pieces(df: DataFrame, text_col: str, raw, tier: int) -> dict[tuple[bool, str], int]:
    """(whether in plain characters, pre-token) -> count of the at most ``tier`` most frequent pre-tokens over all texts."""

    def run(batches):
        b = bpe_of(raw)
        counts: tuple[Counter, Counter] = Counter(), Counter()  # in byte characters, plain
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                for special, part in b.parts(text or ""):
                    if special < 0:
                        plain, pieces = b.pieces(part)
                        counts[plain].update(pieces)
            if len(counts[0]) + len(counts[1]) > 16 * tier:  # Misra-Gries: take the same from all, drop what is left with nothing
                less = sorted([*counts[0].values(), *counts[1].values()], reverse=True)[8 * tier]
                counts = tuple(Counter({k: v - less for k, v in c.items() if v > less}) for c in counts)
        top = sorted(((v, p, k) for p, c in enumerate(counts) for k, v in c.items() if len(k) <= 48), reverse=True)[:tier]
        yield pa.RecordBatch.from_arrays([pa.array([bool(p) for _, p, _ in top], pa.bool_()), pa.array([k for *_, k in top], pa.string()), pa.array([v for v, *_ in top], pa.int64())], names=["plain", "piece", "n"])

    found = df.select(text_col).mapInArrow(run, "plain boolean, piece string, n long")
    top = found.groupBy("plain", "piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece", "plain").limit(tier)
    return {(r.plain, r.piece): r.n for r in top.collect()}


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2048, tier: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text."""
    spark = df.sparkSession
    raw = ship(spark, path or tokenizer_path("word_bpe_49k.json"))
    b = bpe_of(raw)
    frequent: tuple[dict, dict] = {}, {}
    for plain, piece in frequent_pieces(df, text_col, raw, tier):
        frequent[plain][piece] = len(b.encode_piece(piece) if plain else b.encode_mapped(piece))
    table = spark.sparkContext.broadcast(frequent)

    def make():
        b = bpe_of(raw)
        model = b.library.model

        def mapped(piece):
            return len(model.tokenize(piece))

        def plain(piece):
            return len(model.tokenize("".join([b.chars[x] for x in piece.encode()])))

        caches = _Counts(mapped, table.value[0]), _Counts(plain, table.value[1])

        def count(text):
            n = 0
            for special, part in b.parts(text):
                if special >= 0:
                    n += 1
                else:
                    is_plain, pieces = b.pieces(part)
                    n += sum(map(caches[is_plain].__getitem__, pieces))
            return n

        def of(texts):
            texts = [t or "" for t in texts]
            counts = [count(t) for t in texts]
            return [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts], counts, [n > limit for n in counts]

        return of

    return per_row(df, [id_col], [text_col], "n_bytes long, n_tokens long, over_limit boolean", make)
