"""Toxicity (operator 10): nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Terms are words and the first four letters of longer words. From a bounded sample of labelled texts (``per_label`` of each label, by
hash order; learned from in one task, whose result alone the driver holds) every term is kept. Every sampled text is an
example: its TF-IDF vector, where a term's idf is multiplied by how significantly it tells the labels apart (|z| of its rates,
1 at least), so common words weigh little but no term is dropped.

The index has an inverted list (example, weight) for each rare term, and for each common term (held by over a ninth of the
examples) the weights in blocks of ``BLOCK`` examples with the block's largest weight. The lists of a text's rare terms are
summed; with the common terms' block maxima they bound each block. Blocks whose bound beats the k-th best cosine are all
computed, so the k nearest are exact.

Neighbours vote by their cosine, weighted to the labels' true shares; isotonic regression over the examples' own
leave-one-out votes turns votes into probabilities. A text that shares no term with the examples gets the rate of examples
without terms. Evidence is the nearest examples and the terms shared with the first, by falling share in the cosine.

Defined results: null and empty texts get the rate of examples without terms; with no labelled text of either label the score
is 0. An id with several labels is toxic if one of them is; an id with several texts is an example with the least of them; every
row is scored by its own text, ids come out as they went in. Equal cosines go to the example that comes first in the index.
Texts and words of any length count whole; repeated rows are repeated; extra columns don't matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GenerationCache, by_hash, filter_rows, once, per_row, train_in_a_task

BLOCK = 64
#: Texts scored at once.
BATCH = 128
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> tuple[str, ...]:
    """The word (of more than 80 letters its digest, which takes less room) and, marked by a star, the first four letters of a longer one."""
    if len(word) <= 4:
        return (word,)
    return word if len(word) <= 80 else hashlib.sha256(word.encode("utf-8", "replace")).hexdigest(), word[:4] + "*"


class _Block:
    """The inverted lists of one block: term -> (places, weights)."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.terms, self.places, self.weights = terms[order], places[order], weights[order]

    def __contains__(self, t: int) -> bool:
        at = np.searchsorted(self.terms, t)
        return at < len(self.terms) and self.terms[at] == t

    def __getitem__(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.terms, [t, t + 1])
        return self.places[a:b], self.weights[a:b]


class Index:
    """Examples as unit TF-IDF vectors, in blocks."""

    def __init__(self, terms: list[str], weights: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], shares: tuple[float, float], k: int = 24):
        """terms: sorted, with a weight each; examples: (id, label, rising term numbers, counts); shares: weight of an example of label 0 and 1."""
        self.k, self.names, self.terms, self.idf = k, terms, {t: i for i, t in enumerate(terms)}, weights
        vectors = [(doc, label, t, self._unit(t, n), n) for doc, label, t, n in examples]
        empty = [(label, shares[label]) for _, label, t, *_ in vectors if not len(t)]
        weight = sum(w for _, w in empty)
        # One toxic and ten clean texts in advance keep a small sample from saying certainly.
        self.rest = (sum(label * w for label, w in empty) + shares[1] * 0.1) / (weight + shares[0] + shares[1] * 0.1) if examples else 0.0
        vectors = sorted((v for v in vectors if len(v[2])), key=lambda v: (int(v[2][np.argmax(v[3])]), v[0]))  # alike ones in one block
        self.ids = np.array([v[0] for v in vectors], np.int64)
        self.labels = np.array([v[1] for v in vectors], np.int64)
        self.weights = np.array([shares[v[1]] for v in vectors])
        self.starts = np.cumsum([0, *(len(v[2]) for v in vectors)])
        self.held = np.concatenate([v[2] for v in vectors]).astype(np.int32) if vectors else np.empty(0, np.int32)
        self.times = np.concatenate([v[4] for v in vectors]).astype(np.int32) if vectors else np.empty(0, np.int32)
        self.votes = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self._lay_out()
        self._calibrate([v[:4] for v in vectors])

    def _lay_out(self) -> None:
        """The inverted lists, from the examples' terms and counts."""
        self.own: GenerationCache | None = None
        examples = len(self.ids)
        parts = [slice(i, j) for i, j in zip(self.starts, self.starts[1:], strict=False)]
        self.values = np.concatenate([self._unit(self.held[p], self.times[p]) for p in parts]) if parts else np.empty(0)
        at = np.repeat(np.arange(examples, dtype=np.int32), np.diff(self.starts))
        often = np.bincount(self.held, minlength=len(self.names))
        common = np.flatnonzero(often * 9 > examples)
        self.column = np.full(len(self.names), -1, np.int32)
        self.column[common] = np.arange(len(common))
        full = -(-examples // BLOCK) * BLOCK
        column = self.column[self.held]
        dense = np.zeros((full, len(common)))
        dense[at[column >= 0], column[column >= 0]] = self.values[column >= 0]
        self.dense, self.most = dense, dense.reshape(full // BLOCK, BLOCK, len(common)).max(1)
        rare = np.flatnonzero(column < 0)
        rare = rare[np.argsort(self.held[rare], kind="stable")]
        self.places, self.listed = at[rare], self.values[rare]
        self.first = np.concatenate([[0], np.cumsum(np.where(self.column < 0, often, 0))]).astype(np.int64)

    def __getstate__(self):
        """What the lists are laid out from, compressed: it goes to the disk of every executor."""
        small = [self.k, "\n".join(self.names), self.idf, self.rest, self.ids, self.labels, self.weights, self.starts, np.diff(self.held, prepend=np.int32(0)), self.times, self.votes]
        return zlib.compress(pickle.dumps(small), 1)

    def __setstate__(self, state):
        self.k, names, self.idf, self.rest, self.ids, self.labels, self.weights, self.starts, steps, self.times, self.votes = pickle.loads(zlib.decompress(state))
        self.names = names.split("\n") if len(self.idf) else []
        self.terms = {t: i for i, t in enumerate(self.names)}
        self.held = np.cumsum(steps, dtype=np.int32)
        self._lay_out()

    @property
    def lists(self) -> list[_Block]:
        """All inverted lists, block by block."""
        ends = [*range(0, len(self.ids), BLOCK), len(self.ids)]
        out = []
        for i, j in zip(ends, ends[1:], strict=False):
            places = np.repeat(np.arange(j - i), np.diff(self.starts[i : j + 1]))
            out.append(_Block(self.held[self.starts[i] : self.starts[j]], places, self.values[self.starts[i] : self.starts[j]]))
        return out

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of length 1; (1 + ln tf) * idf."""
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.linalg.norm(w) if len(w) else w

    def vector(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, weights) of length 1."""
        return counts[0], self._unit(*counts)

    def nearest(self, terms: np.ndarray, values: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k nearest examples with a cosine above 0, without position ``but``; ties by position."""
        return self.nearest_all([(terms, values)], [but])[0]

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each vector."""
        n, blocks = len(self.dense), len(self.most)
        if not blocks:
            return [(np.empty(0, np.int64), np.empty(0)) for _ in vectors]
        sums, q = np.zeros((len(vectors), n)), np.zeros((len(vectors), self.dense.shape[1]))
        for i, (terms, values) in enumerate(vectors):
            column = self.column[terms]
            q[i, column[column >= 0]] = values[column >= 0]
            rare, w = terms[column < 0], values[column < 0]
            start, size = self.first[rare], self.first[rare + 1] - self.first[rare]
            ends = np.cumsum(size)
            if len(ends) and ends[-1]:
                at = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
                sums[i] = np.bincount(self.places[at], np.repeat(w, size) * self.listed[at], n)
        bounds = sums.reshape(len(vectors), blocks, BLOCK).max(2) + q @ self.most.T
        scores = np.full_like(sums, -1.0)

        def compute(chosen: np.ndarray) -> None:
            for b in np.flatnonzero(chosen.any(0)).tolist():
                rows, own = np.flatnonzero(chosen[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                scores[rows, own] = sums[rows, own] + q[rows] @ self.dense[own].T
            for i, p in enumerate(but or []):
                if p >= 0:
                    scores[i, p] = -1.0

        best = np.zeros_like(bounds, bool)
        np.put_along_axis(best, np.argsort(-bounds, axis=1, kind="stable")[:, : max(2, blocks // 8)], True, 1)
        compute(best)
        k = min(self.k, n)
        floor = np.maximum(0, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
        compute(~best & (bounds * (1 + 1e-12) + 1e-12 >= floor[:, None]))
        scores = np.round(scores, 12)  # the last bits depend on how many rows are multiplied at once
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        out = []
        for own, least in zip(scores, floor, strict=True):
            found = np.flatnonzero((own >= least) & (own > 0))
            found = found[np.argsort(-own[found], kind="stable")][: self.k]
            out.append((found, own[found]))
        return out

    def vote(self, found: np.ndarray, scores: np.ndarray) -> float:
        w = scores * self.weights[found]
        return float((w * self.labels[found]).sum() / w.sum()) if len(found) else -1.0

    def _calibrate(self, vectors) -> None:
        found = []
        for i in range(0, len(vectors), BATCH):
            part = vectors[i : i + BATCH]
            found += self.nearest_all([(t, w) for _, _, t, w in part], list(range(i, i + len(part))))
        votes = np.array([self.vote(*f) for f in found])
        keep = np.flatnonzero(votes >= 0)
        if not len(keep):
            return
        order = keep[np.argsort(votes[keep], kind="stable")]
        pools: list[list[float]] = []  # (sum of label * weight, weight, least vote, largest vote)
        for i in order:
            pools.append([self.labels[i] * self.weights[i], self.weights[i], votes[i], votes[i]])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a = pools.pop()
                pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
        prior = (self.labels * self.weights).sum() / self.weights.sum()
        at = [x for p in pools for x in (p[2], p[3])]
        self.votes = np.array(at), np.array([(p[0] + prior) / (p[1] + 1) for p in pools for _ in "ab"])

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(rising term numbers, counts) of the text's terms that examples hold."""
        self.own = self.own or GenerationCache(lambda w: [n for t in word_terms(w) if (n := self.terms.get(t)) is not None], 100_000)
        held = Counter(_WORD.findall(text.lower()))
        lists = [self.own[w] for w in held]
        flat = np.fromiter(chain.from_iterable(lists), np.int64)
        terms, place = np.unique(flat, return_inverse=True)
        return terms, np.bincount(place, np.repeat(list(held.values()), [len(x) for x in lists]), len(terms)) if len(terms) else np.empty(0)

    def score_all(self, texts) -> list[tuple[float, list[int], list[str]]]:
        """Of each text (probability, ids of the nearest examples, terms shared with the first)."""
        out = []
        for i in range(0, len(texts), BATCH):
            vectors = [self.vector(self.counts(t or "")) for t in texts[i : i + BATCH]]
            for (terms, values), (found, scores) in zip(vectors, self.nearest_all(vectors), strict=True):
                if not len(found):
                    out.append((self.rest, [], []))
                    continue
                order = np.lexsort((self.ids[found], -scores))
                # Isotonic values are a step function with interpolation between steps.
                p = float(np.interp(self.vote(found, scores), *self.votes))
                out.append((min(1.0, max(0.0, p)), self.ids[found[order[:5]]].tolist(), self._shared(terms, values, found[order[0]])))
        return out

    def _shared(self, terms: np.ndarray, values: np.ndarray, example: int) -> list[str]:
        own = slice(self.starts[example], self.starts[example + 1])
        both, i, j = np.intersect1d(terms, self.held[own], assume_unique=True, return_indices=True)
        order = np.argsort(-values[i] * self.values[own][j], kind="stable")
        return [self.names[t] for t in both[order].tolist()]


def learn(rows: list[dict]) -> Index:
    """From rows (id, label, text, share); share: texts of the label that the row stands for."""
    sizes = Counter(r["label"] for r in rows)
    if 0 not in sizes or 1 not in sizes:
        return Index([], np.empty(0), [], (1.0, 1.0))
    rows = sorted(rows, key=lambda r: (r["id"], r["label"]))
    numbers: dict[str, int] = {}
    held = []
    for r in rows:
        counts: Counter = Counter()
        for w, times in Counter(_WORD.findall((r["text"] or "").lower())).items():
            for t in word_terms(w):
                counts[numbers.setdefault(t, len(numbers))] += times
        held.append((np.fromiter(counts, np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))))
    terms = sorted(numbers)
    place = np.empty(len(terms), np.int32)
    place[np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms), dtype=np.int32)
    del numbers
    sums = np.zeros((2, len(terms)))
    examples = []
    for r, (own, times) in zip(rows, held, strict=True):
        own = place[own]
        order = np.argsort(own)
        sums[r["label"], own] += 1
        examples.append((r["id"], r["label"], own[order], times[order]))
    c, t, n = sums[0], sums[1], len(rows)
    mean = (c + t) / n
    z = (t / sizes[1] - c / sizes[0]) / np.sqrt(mean * (1 - mean) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)
    weights = (np.log((1 + n) / (1 + c + t)) + 1) * np.maximum(1, np.abs(z))
    share = [next(r["share"] for r in rows if r["label"] == y) / sizes[y] for y in (0, 1)]
    return Index(terms, weights, examples, (share[0] / min(share), share[1] / min(share)))


def fit(df: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 1500) -> bytes:
    """A dumped Index, learned from the labelled rows that ``allowed`` (a condition on the id column) admits, at most per_label of each label."""
    known = labels.filter(allowed).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    picked = by_hash(known, "label", "id", per_label).join(known.groupBy("label").agg(F.count("*").cast("double").alias("share")), "label")
    # 2 * per_label ids at most: a bounded broadcast.
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").groupBy("id", "label", "share").agg(F.min("text").alias("text"))
    return train_in_a_task(rows, lambda found: pickle.dumps(learn(found)))


def index_of(shared) -> Index:
    """The Index of a broadcast dump, laid out once in a worker."""
    return once("toxicity", (zlib.crc32(shared.value), len(shared.value)), lambda: pickle.loads(shared.value))


def toxicity(df: DataFrame, index: bytes, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score, predicted, neighbours array<long>, terms array<string> of every text."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def make():
        x = index_of(shared)

        def of(texts):
            found = x.score_all(texts)
            return [a for a, _, _ in found], [int(a >= threshold) for a, _, _ in found], [b for _, b, _ in found], [c for _, _, c in found]

        return of

    return per_row(df, [id_col], [text_col], "score double, predicted int, neighbours array<long>, terms array<string>", make)


def keep_clean(df: DataFrame, index: bytes, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of df that aren't predicted toxic."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def make():
        x = index_of(shared)
        return lambda texts: [a < threshold for a, _, _ in x.score_all(texts)]

    return filter_rows(df, [text_col], make)
