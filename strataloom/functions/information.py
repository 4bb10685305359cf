"""Information measures of a text, computed in its row by its counts of characters: nothing is exploded or shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct characters and how often each stands."""
    if len(codes) and codes.max() < 1 << 13:
        n = np.bincount(codes)
        at = np.flatnonzero(n)
        return at.astype(np.uint32), n[at]
    return np.unique(codes, return_counts=True)


def _bits(n: np.ndarray) -> float:
    total = int(n.sum())
    return float(np.log2(total) - (n * np.log2(n)).sum() / total) if total else 0.0


def _normalised(n: np.ndarray) -> float:
    return _bits(n) / float(np.log2(len(n))) if len(n) > 1 else 0.0


def _uniformity(n: np.ndarray) -> float:
    if not len(n):
        return 0.0
    n = n.astype(np.float64)
    return float(1 / (1 + 100 * ((n * n).sum() / n.sum() ** 2 / len(n) - 1 / len(n) ** 2)))


def _by_counts(text: Column, measure) -> Column:
    """A measure of a text's counts of characters, in Arrow batches: one pass over the text, where expressions take one for each character."""

    @pandas_udf(DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([measure(_counted(_codes(t))[1]) for t in texts], dtype="float64")

    return of(text)


def entropy(text: Column) -> Column:
    """Bits a character; 0 for the null or empty text."""
    return _by_counts(text, _bits)


def normalised_entropy(text: Column) -> Column:
    """Entropy over the most that its alphabet allows; 0 with fewer than two distinct characters."""
    return _by_counts(text, _normalised)


def uniformity(text: Column) -> Column:
    """1 / (1 + 100 * variance of the characters' shares)."""
    return _by_counts(text, _uniformity)


def profile(text: Column) -> Column:
    """struct(bits, c, n): entropy, distinct characters and their counts, packed; null for the null text."""

    @pandas_udf("bits double, c binary, n binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = [(_bits(n), c.tobytes(), n.astype(np.int64).tobytes()) for c, n in (_counted(_codes(t)) for t in texts)]
        return pd.DataFrame(out, columns=["bits", "c", "n"])

    return F.when(text.isNotNull(), of(text))


def joint_entropy(p: Column, q: Column) -> Column:
    """Bits a character of two texts joined, by their profiles."""

    @pandas_udf(DoubleType())
    def of(c: pd.Series, n: pd.Series, d: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for a, x, b, y in zip(c, n, d, m, strict=True):
            at = np.unique(np.frombuffer((a or b"") + (b or b""), np.uint32), return_inverse=True)[1].ravel()
            out.append(_bits(np.bincount(at, np.frombuffer((x or b"") + (y or b""), np.int64)).astype(np.int64)))
        return pd.Series(out, dtype="float64")

    return F.when(p.isNotNull() & q.isNotNull(), of(p.c, p.n, q.c, q.n))


def _run_bits(codes: np.ndarray) -> float:
    n = np.unique(codes, return_counts=True)[1]
    return float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum()) if len(n) else 0.0


def conditional_entropy(text: Column, order: int = 1) -> Column:
    """Bits of a character once the ``order`` characters before it are known: H of (order + 1)-grams less H of their beginnings.

    In Arrow batches: sorting a text's n-grams in the row's expressions takes a hundred times as long.
    """

    @pandas_udf(DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            c = np.unique(np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
            n = len(c) - order
            if n < 1:
                out.append(0.0)
                continue
            codes, width = c[:n], int(c.max()) + 1
            for k in range(1, order):
                codes = np.unique(codes * width + c[k : k + n], return_inverse=True)[1]
            out.append(_run_bits(codes * width + c[order : order + n]) - _run_bits(codes))
        return pd.Series(out, dtype="float64")

    return of(text)


def _windows(text: str, least: int, most: int, cells: int) -> np.ndarray:
    """Normalised entropy of the up to ``most`` lines that end at each line, from the ``least``-th on."""
    codes = _codes(text)
    ends = np.append(np.flatnonzero(codes == 10), len(codes))
    begins = np.append(0, ends[:-1] + 1)
    out, at, step = [], least - 1, 2048
    while at < len(ends):
        first, stop = max(0, at - most + 1), min(len(ends), at + step)
        part = codes[begins[first] : ends[stop - 1]]
        distinct, c = np.unique(np.append(part, np.uint32(10)), return_inverse=True)
        if len(distinct) * (stop - first) > cells and step > most:  # a wide alphabet: fewer lines at once
            step = max(most, step // 2)
            continue
        k, c = len(distinct), c.ravel()[:-1]
        inside = part != 10
        line = np.cumsum(~inside)[inside]
        n = np.zeros((stop - first + 1, k), np.int64)
        n[1:] = np.bincount(line * k + c[inside], minlength=(stop - first) * k).reshape(-1, k)
        np.cumsum(n, axis=0, out=n)
        last = np.arange(at, stop)
        begin = np.maximum(0, last - most + 1)
        held = n[last - first + 1] - n[begin - first]
        held[:, np.searchsorted(distinct, 10)] += last - begin
        total, kinds = held.sum(1), (held > 0).sum(1)
        bits = np.log2(np.maximum(total, 1)) - (held * np.log2(np.maximum(held, 1))).sum(1) / np.maximum(total, 1)
        out.append(np.where(kinds > 1, bits / np.log2(np.maximum(kinds, 2)), 0.0))
        at = stop
    return np.concatenate(out) if out else np.empty(0)


def line_windows(df: DataFrame, key: str, text: str, least: int = 25, most: int = 50, cells: int = 1 << 21) -> DataFrame:
    """(key, i, entropy): normalised entropy of the up to ``most`` lines that end at line i, from the ``least``-th on.

    A text's lines are counted once, and a window is the difference of two running sums; a text isn't copied for each of its lines.
    """

    def of(batches):
        for batch in batches:
            for row, one in enumerate(batch.column(1)):
                h = _windows(one.as_py(), least, most, cells)
                for s in range(0, len(h), 1 << 16):
                    part = h[s : s + (1 << 16)]
                    keys = batch.column(0).take(pa.array(np.full(len(part), row)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(len(part)) + s + least), pa.array(part)], names=["key", "i", "entropy"])

    d = df.select(key, text).filter(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) >= least - 1)
    return d.mapInArrow(of, f"key {df.schema[key].dataType.simpleString()}, i long, entropy double").withColumnRenamed("key", key)
