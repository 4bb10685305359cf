"""Language identification (operator 8): averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its words and their character 2- to 4-grams, hashed to ``BUCKETS`` rows; a softmax
over the average gives the languages. Embeddings and softmax are trained by minibatch gradient descent in numpy, in one task,
on a bounded sample (``per_language`` distinct labelled texts of each language, by hash order). Half of the sample, not
trained on, fits the temperature of the probabilities and the level below which a text is rejected: the probability that all
but ``reject_share`` of its rightly named texts reach (the least one's, where the slice is too small for that share).
Since averaging and the linear layer commute, a text's score is the sum of its features' score rows over their number; features
are hashed for a whole text at once, so nothing is kept from text to text.

Defined results: a null text and one without any letter is ``und`` with score 0 and rejected; with no labelled text, all are
``und``; equal probabilities go to the language that comes first in the alphabet; repeated rows and repeated ids are each
judged by their own text; texts of any length are read whole; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_hash, filter_rows, once, per_row, train_in_a_task

BUCKETS, UNKNOWN = 1 << 15, "und"
_WORD = re.compile(r"[^\W\d_]+")


_P, _K, _SHIFT = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(49)


def text_features(text: str) -> np.ndarray:
    """Buckets of all words and 2- to 4-grams of the words between brackets, as often as they occur.

    An n-gram's hash is the polynomial of its characters in P, a word's the same from its end; its high bits after a
    multiplication by K are the bucket.
    """
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.int32)
    c = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begins = np.flatnonzero(c == ord("<"))
    number = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(c)))
    place = np.arange(len(c)) - begins[number]
    powers = np.cumprod(np.full(int(place.max()) + 1, _P))
    found = [np.add.reduceat(c * powers[place], begins)]
    h = c
    for n in (2, 3, 4):
        if len(c) < n:
            break
        h = h[:-1] * _P + c[n - 1 :]
        found.append(h[number[: len(h)] == number[n - 1 :]])
    return (np.concatenate(found) * _K >> _SHIFT).astype(np.int32)


def sample_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text."""
    found = text_features(text)
    ids, counts = np.unique(found, return_counts=True)
    return ids, (counts / max(1, len(found))).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Languages, the score of each bucket and of the bias, temperature, level of rejection."""

    def __init__(self, languages: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, level: float):
        self.languages, self.scores, self.bias, self.temperature, self.level = languages, scores, bias, temperature, level

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        found = text_features(text)
        total = np.bincount(found, minlength=BUCKETS) @ self.scores
        p = _softmax(((total / max(1, len(found)) + self.bias) / self.temperature)[None])[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def rejects(self, language: str, score: float) -> bool:
        return language == UNKNOWN or score < self.level

    def dump(self) -> bytes:
        return zlib.compress(pickle.dumps((self.languages, self.scores, self.bias, self.temperature, self.level)), 1)

    @staticmethod
    def load(data: bytes) -> Model:
        return Model(*pickle.loads(zlib.decompress(data)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(examples: list[tuple[str, np.ndarray, np.ndarray]], reject_share: float = 0.0005, dim: int = 16, epochs: int = 8, rate: float = 4.0, batch: int = 32, seed: int = 5) -> Model:
    """examples: (language, buckets, shares)."""
    languages = sorted({lang for lang, _, _ in examples})
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(lang) for lang, _, _ in examples])
    order = rng.permutation(len(y))
    held = order[: len(y) // 2]
    learned = order[len(y) // 2 :]
    embed, linear, bias = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.3, (dim, len(languages))), np.zeros(len(languages))
    steps = epochs * -(-len(learned) // batch)
    step = 0
    for _ in range(epochs):
        rng.shuffle(learned)
        for at in range(0, len(learned), batch):
            chosen = learned[at : at + batch]
            ids = np.concatenate([examples[i][1] for i in chosen])
            share = np.concatenate([examples[i][2] for i in chosen])
            ends = np.cumsum([0, *(len(examples[i][1]) for i in chosen)])[:-1]
            rows = embed[ids]
            hidden = np.add.reduceat(rows * share[:, None], ends)
            error = _softmax(hidden @ linear + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            error /= len(chosen)
            now = rate * (1 - step / steps)
            back = error @ linear.T
            linear -= now * hidden.T @ error
            bias -= 0.1 * now * error.sum(0)
            doc = np.repeat(np.arange(len(chosen)), [len(examples[i][1]) for i in chosen])
            np.subtract.at(embed, ids, now * 20 * back[doc] * share[:, None])
            step += 1
    scores = embed @ linear
    temperature, level = 1.0, 0.0
    if len(held):
        logits = np.array([(scores[examples[i][1]] * examples[i][2][:, None]).sum(0) + bias for i in held])
        right = y[held]
        # Smoothed targets, for a slice of n texts can't show a rate of errors below about 1 in n.
        target = np.full(logits.shape, 1 / (len(held) + 2) / (len(languages) - 1))
        target[np.arange(len(held)), right] = 1 - 1 / (len(held) + 2)
        temperature = min(np.geomspace(0.02, 50, 120), key=lambda t: -(target * np.log(_softmax(logits / t) + 1e-300)).sum())
        p = _softmax(logits / temperature)
        sure = p.max(1)[p.argmax(1) == right]
        level = float(np.quantile(sure, reject_share, method="lower")) if len(sure) else 0.0
    return Model(languages, scores, bias, float(temperature), level)


def fit(df: DataFrame, allowed: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = 1000, reject_share: float = 0.0005) -> bytes:
    """A dumped Model, learned from the rows that ``allowed`` admits and whose text and language aren't null: at most per_language distinct texts of each language."""
    rows = df.filter(allowed).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    picked = by_hash(rows.select("lang", "h"), "lang", "h", per_language)

    def make():
        met: set = set()

        def of(langs, hashes, texts):
            out = []
            for lang, h, text in zip(langs, hashes, texts, strict=True):
                ids, shares = sample_features(text) if (lang, h) not in met else (np.empty(0, np.int32), np.empty(0, np.float32))
                met.add((lang, h))
                out.append((ids.tobytes(), shares.tobytes()))
            return tuple(zip(*out, strict=True))

        return of

    # per_language hashes for each language: a bounded broadcast. Copies of a text give their features once in a task, then once at all.
    drawn = rows.join(F.broadcast(picked), ["lang", "h"])
    sample = per_row(drawn, ["lang", "h"], ["lang", "h", "text"], "ids binary, shares binary", make).filter("length(ids) > 0").dropDuplicates(["lang", "h"])

    def learn(found: list[dict]) -> bytes:
        found = sorted(found, key=lambda r: (r["lang"], r["h"]))
        return train([(r["lang"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32).astype(np.float64)) for r in found], reject_share).dump()

    return train_in_a_task(sample, learn)


def model_of(shared) -> Model:
    """The Model of a broadcast dump, once in a worker."""
    return once("language", (zlib.crc32(shared.value), len(shared.value)), lambda: Model.load(shared.value))


def identify(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (else the id), lang_pred, score, rejected of every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = model_of(shared)

        def of(texts):
            found = [m.predict(t) for t in texts]
            return [a for a, _ in found], [b for _, b in found], [m.rejects(*x) for x in found]

        return of

    return per_row(df, keep or [id_col], [text_col], "lang_pred string, score double, rejected boolean", make)


def keep_identified(df: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """The rows of df whose text isn't rejected. A model of no language rejects only texts without a letter."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = model_of(shared)
        return lambda texts: [not m.rejects(*m.predict(t)) if m.languages else bool(t) and has_letter(t) for t in texts]

    return filter_rows(df, [text_col], make)
