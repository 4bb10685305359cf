"""What grows with the input: rows that are shuffled, against results worked out row by row."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from strataloom import catalog
from strataloom.functions import information as info
from strataloom.operators import similarity, vectors


def shuffled_rows(df):
    """(rows, rows shuffled) of a frame once it is collected."""
    rows = df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleRecordsWritten").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows, total


def _cosines(texts):
    bags, n = {}, len(texts)
    for key, text in texts:
        bags.setdefault(key, Counter()).update((text or "").split())
    df = Counter(w for c in bags.values() for w in c)
    x = {key: {w: tf * (math.log((1 + n) / (1 + df[w])) + 1) for w, tf in c.items()} for key, c in bags.items()}
    norm = {key: math.sqrt(sum(v * v for v in c.values())) for key, c in x.items()}
    near = [(key, key + 1) for key in x if key is not None and key + 1 in x and x[key].keys() & x[key + 1].keys()]
    return {a: sum(v * x[b].get(w, 0) for w, v in x[a].items()) / norm[a] / norm[b] for a, b in near}


def test_tfidf_of_next_shuffles_texts_not_words(spark):
    """Ids with gaps, below zero, null and repeated, at the ends of their parts and beyond them; texts null, empty and unlike."""
    ids = [*range(-200, 200), *range(300, 500, 3), None, None, 7, 7, 63, 64, 2**62]
    texts = [(i, " ".join(f"w{(k * k + j * 7) % (40 + j % 9)}" for j in range(60)) + f" only{k} two{k // 2} far{k % 150}") for k, i in enumerate(ids)]
    texts += [(1000, "a b"), (1001, "c d"), (1002, ""), (1003, None), (1004, "a"), (1005, "a")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows, shuffled = shuffled_rows(similarity.tfidf_of_next(df, "doc_id", "text"))
    want = _cosines(texts)
    assert len(rows) == len(want) and {r.doc_id: pytest.approx(r.cosine, abs=1e-12) for r in rows} == want
    assert shuffled < 10 * len(texts)  # a text has 40 to 50 distinct words


def _keywords(spark, duck, tmp_path, rows, parts):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    duck.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, shuffled = shuffled_rows(catalog.queries()["doc_keywords"](spark, str(tmp_path)).select("doc_id", "gram", "n", "rank"))
    want = duck.execute(f"SELECT doc_id, gram, n, rank FROM ({catalog.oracle_sql()['doc_keywords']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return shuffled


def test_keywords_are_counted_in_the_row(spark, tmp_path):
    duck = duckdb.connect()
    rows = [(k, " ".join(f"word{(k + j * j) % 23}" for j in range(k))) for k in range(50)] + [(60, None), (61, ""), (62, "the of"), (63, "Ünder ünder \U00010400bc ﬁve zoo"), (None, "lone lone text")]
    assert _keywords(spark, duck, tmp_path / "once", rows, 2) == 0
    again = [(7, "word1 word2 more"), (62, "more words"), (None, "text lone lone")]
    assert _keywords(spark, duck, tmp_path / "again", rows + again, 2) < 1000


def _nearest(ids, x, asked, k, least):
    norm = np.linalg.norm(x, axis=1)
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    out = {}
    for q in asked:
        s = np.round((unit * unit[q]).sum(1), 12)
        at = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q] and s[j] >= least]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in at[:k]]
    return out


@pytest.mark.parametrize("group", [1 << 25, 1 << 16])
def test_top_k_shuffles_rows_once_a_strip(spark, monkeypatch, group):
    """Copies of one vector, the zero vector and null; in one group and in several."""
    monkeypatch.setattr(vectors, "GROUP", group)
    n = 16500 if group > 1 << 20 else 1500
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, 16)).astype(np.float32).astype(np.float64)
    x[100:400] = x[50]
    x[7] = 0
    ids = rng.permutation(n) - 20
    df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)] + [(n + 5, None), (n + 6, [float("nan")] * 16)], "vec_id long, v array<float>").repartition(4).cache()
    rows, shuffled = shuffled_rows(vectors.top_k(df, df, "vec_id", "v", 6, least=0.3))
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    for q, want in _nearest(ids, x, [7, 50, 100, 399, *range(500, 700)], 6, 0.3).items():
        assert [i for i, _ in found.get(q, [])] == [i for i, _ in want]
        assert [s for _, s in found.get(q, [])] == pytest.approx([s for _, s in want], abs=1e-9)
    if group > 1 << 20:
        assert shuffled < 30 * n  # in blocks of 2,048 it was 72 n


ODD = ["", "a", "aaaa", "abab\n", "\U0001f600e\u0301\r\n", "zoë ﬁ\u4e2d\u6587", "line\n" * 60, "".join(chr(0x4E00 + k) for k in range(9000)), "x" * 300 + "\n" * 30]


@pytest.mark.parametrize("name", ["neighbour_information", "doc_entropy", "line_window_entropy", "duplicate_line_blocks"])
def test_information_of_odd_texts(spark, tmp_path, name):
    """Ids repeated and null; wide alphabets. Null neighbours have no information, as in SQL."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "again"), (None, "none"), (len(ODD) + 1, "after a gap")] + ([(len(ODD) + 2, None)] if name == "neighbour_information" else [])
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, str(tmp_path)).select(columns).collect()
    plain = lambda rows: sorted(repr(tuple(x + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(got) == plain(want.fetchall())


def test_line_windows_count_each_line_once(spark):
    """30,000 lines, which copied for each of them are some 10^9; wide alphabets are taken in smaller pieces, with the same results."""
    lines = [f"{k % 7} line {k * k % 1001}" for k in range(30000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:24])), (3, None)], "doc_id long, text string")
    got = {r.i: r.entropy for r in info.line_windows(df, "doc_id", "text").collect()}
    assert sorted(got) == list(range(25, 30001))
    for i in (25, 49, 50, 51, 2072, 2073, 30000):
        c = Counter("\n".join(lines[max(0, i - 50) : i]))
        n = sum(c.values())
        assert got[i] == pytest.approx(-sum(x / n * math.log2(x / n) for x in c.values()) / math.log2(len(c)), abs=1e-12)
    small = {r.i: r.entropy for r in info.line_windows(df, "doc_id", "text", cells=1).collect()}
    assert small == pytest.approx(got, abs=1e-12)
