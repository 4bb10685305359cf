"""The training-data operators against brute force, the libraries, exact round trips and held-out labels."""

import contextlib
import hashlib
import json
import pickle
import random
import re
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from strataloom.llm import ann, bpe, chat, langid, licenses, neardup, ogg, packing, queries, token_counts, toxicity
from strataloom.llm.common import per_row, tokenizer_path

SF = "/root/testdata/sf0.001"
#: Nulls, empty and long texts, ties, repeated rows, special strings, characters outside the fast path.
TEXTS = [None, "", " ", "A\nb", "été " * 3, "same words in this one text", "same words in this one text", "<|endoftext|> x <|startoftext|>", "漢字 \U0001f600 İstanbul ² ½ \x1c\x85 don't CAN'T", "a" * 5000, "word " * 9000, "12345 x_y__z '''re", "Café K"]
SCHEMA = "doc_id long, text string, lang string, source string, id string, bands int, start string, k1 int, w string, h int, label int"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, None, "s", "x", 1, "y", 2, "z", 3, 4) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: An id that a double can't hold beside a null and a repeated one.
BIG = 2**53 + 1
IDS = [(None, "first text here"), (BIG, "second text here"), (BIG, "other words altogether"), (BIG - 1, None)]


def test_ids_come_out_as_they_went_in(spark):
    df = spark.createDataFrame(IDS, "doc_id long, text string").coalesce(1)
    want = sorted((i for i, _ in IDS), key=str)
    model = langid.fit(df.withColumn("lang", F.lit("en")), F.lit(True))
    index = toxicity.fit(df, df.selectExpr("doc_id", "1 as toxic"), F.lit(True))
    media = ogg.ogg_media(df)
    found = [
        bpe.bpe_encode(df), bpe.bpe_decode(bpe.bpe_encode(df)), bpe.bpe_digests(df), token_counts.token_counts(df), media, ogg.ogg_features(df), ogg.ogg_packets(media), packing.pack(df),
        langid.identify(df, model), toxicity.toxicity(df, index), licenses.license_scan(df), neardup.near_duplicates(df), neardup.keep_one(df),
    ]
    for one in found:
        assert sorted((r.doc_id for r in one.select("doc_id").collect()), key=str) == want, one.columns
    chats = chat.chat_format(df.selectExpr("doc_id as conv_id", "doc_id as turn", "'user' as role", "text"))
    assert sorted((r.conv_id for r in chats.collect()), key=str) == want == sorted((r.turn for r in chats.collect()), key=str)
    named = per_row(df.selectExpr("cast(doc_id as string) as doc_id", "text"), ["doc_id"], ["text"], "n int", lambda: lambda texts: ([len(t or "") for t in texts],))
    assert sorted((r.doc_id for r in named.collect()), key=str) == sorted((None if i is None else str(i) for i, _ in IDS), key=str)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_differencing_is_near_equal_and_windows_rise():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(200)]
    parts = packing.differencing(sizes, 9)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(200)) and max(sums) - min(sums) <= 3
    assert len(packing.windows([6, 6, 6], 10)) == 3
    assert packing.windows([], 10) == []


@pytest.mark.parametrize("frame", ["edge", "docs", "nothing"])
def test_packing(frame, request):
    df = request.getfixturevalue(frame)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    tok, pieces, sequences = library("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in packing.pack(df).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(pieces[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.02 * total


@pytest.mark.parametrize("frame", ["edge", "docs", "nothing"])
def test_bpe_and_counts(frame, request):
    df = request.getfixturevalue(frame)
    tok = library("word_bpe_49k.json")
    want = {}
    for r in df.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = len((r.text or "").encode()), len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: r for r in bpe.bpe_digests(df).collect()}
    assert {k: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for k, r in got.items()} == {k: v[1:] for k, v in want.items()}
    counted = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, tier=64).collect()}
    assert counted == {k: (v[0], v[1], v[1] > 2048) for k, v in want.items()}
    if frame == "edge":
        ids = bpe.bpe_encode(df)
        assert {r.doc_id: hashlib.sha256(r.decoded.encode()).hexdigest() for r in bpe.bpe_decode(ids).collect()} == {k: v[3] for k, v in want.items()}


def _slow_crc(page):
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_pages():
    assert ogg.page_checksum(b"OggS some bytes") == _slow_crc(b"OggS some bytes")
    rng = random.Random(2)
    streams = {s: [(rng.randbytes(rng.choice([0, 1, 254, 255, 256, 510, 70000])), g) for g in range(n)] for s, n in ((7, 9), (3, 1), (5, 300))}
    media = ogg.mux(streams)
    packets, _ = ogg.demux(media)
    for s, wanted in streams.items():
        assert [p.data for p in packets if p.serial == s] == [d for d, _ in wanted]
    for damage in (media[:-1], media[:40] + bytes([media[40] ^ 1]) + media[41:], media[:100000] + media[100100:]):
        with pytest.raises(ValueError):
            ogg.demux(damage)


def _pages(media):
    at, out = 0, []
    while at < len(media):
        n = media[at + 26]
        end = at + 27 + n + sum(media[at + 27 : at + 27 + n])
        out.append(media[at:end])
        at = end
    return out


def _signed(page):
    return page[:22] + ogg.page_checksum(page[:22] + bytes(4) + page[26:]).to_bytes(4, "little") + page[26:]


def test_ogg_timestamps_are_from_granules_and_missing_pages_raise():
    media = ogg.store("some words " * 20_000)
    got = ogg.load(media)
    assert got["stamps"] == [k * ogg.PACKET / ogg.RATE for k in range(len(got["sizes"]))] and len(got["stamps"]) > 40
    pages = _pages(media)
    assert b"".join(pages) == media
    for k, page in enumerate(pages):
        with pytest.raises(ValueError):  # a page is missing
            ogg.load(b"".join(pages[:k] + pages[k + 1 :]))
        with pytest.raises(ValueError):  # another position
            ogg.load(b"".join([*pages[:k], _signed(page[:6] + (7).to_bytes(8, "little") + page[14:]), *pages[k + 1 :]]))
    small = _pages(ogg.store("short"))
    for k in range(len(small)):
        with pytest.raises(ValueError):
            ogg.load(b"".join(small[:k] + small[k + 1 :]))
    with pytest.raises(ValueError):  # another length than the payload's
        ogg.load(ogg.mux({1: [(b"U8SAMPLE" + (8000).to_bytes(4, "little"), 0), (b"x" + b" " * 191, 192)], 2: [(b"BYTES", 0), ((500).to_bytes(8, "little"), 192)]}))


def test_ogg_feature_by_brute_force():
    for text in ("", "A\nb", "été " * 3000):
        got = ogg.load(ogg.store(text))
        s = list(got["payload"])
        mean = sum(s) / len(s)
        crossings = sum((a > mean) != (b > mean) for a, b in zip(s, s[1:], strict=False))
        want = f"mean={mean:.4f};rms={(sum((x - mean) ** 2 for x in s) / len(s)) ** 0.5:.4f};range={max(s) - min(s)};crossings={crossings};seconds={len(s) / 8000:.3f};packets={-(-len(s) // 4800)};last={(len(s) - 1) // 4800 * 4800 / 8000:.3f};"
        assert ogg.feature(got).startswith(want)


@pytest.mark.parametrize("frame", ["edge", "nothing"])
def test_ogg_features(frame, request):
    df = request.getfixturevalue(frame)
    rows = {r.doc_id: r for r in ogg.ogg_features(df).collect()}
    for r in df.collect():
        data = (r.text or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        got = rows[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    for r in ogg.ogg_media(df).collect():
        assert hashlib.sha256(r.media).hexdigest() == rows[r.doc_id].media_sha256 and len(r.media) == rows[r.doc_id].media_bytes


def test_chat(spark):
    call = lambda *calls: json.dumps({"tool_calls": list(calls)})
    rows = [
        (1, 0, "user", "hi", 0), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "early"}), 0), (1, 2, "assistant", call({"id": "a", "name": "search", "arguments": {"query": "q"}}, {"id": "b", "name": "calculate", "arguments": {"expression": 3}, "depends_on": ["a"]}), 0),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": 3}), 0), (1, 4, "tool", json.dumps({"tool_call_id": "zz"}), 0), (1, 5, "assistant", call({"id": "a", "name": "nope"}), 0),
        (2, 0, "assistant", call({"id": "x", "name": "search", "arguments": '{"query": "1"}', "depends_on": ["y"]}, {"id": "y", "name": "search", "arguments": "{", "depends_on": ["x"]}), 0), (3, 0, None, None, 0), (3, 1, "assistant", "{broken", 0), (3, 1, "assistant", "{broken", 0), (None, None, "tool", "text", 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = chat.chat_format(df).collect()
    assert len(got) == 13
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.place, r.level, r.turn, r.part))
    assert [(r.turn, r.part) for r in one] == [(0, 0), (2, 0), (1, 0), (2, 1), (3, 0), (4, 0), (5, 0)]
    errors = {(r.conv_id, r.turn, r.part): r.errors for r in got}
    assert errors[1, 2, 0] == "" and errors[1, 2, 1] == "type:$.expression" and errors[1, 4, 0] == "result:no-call" and errors[1, 5, 0] == "call:repeated,tool:unknown"
    assert errors[2, 0, 0] == "call:unresolvable" and errors[2, 0, 1] == "arguments:json,call:unresolvable" and errors[None, None, 0] == "result:no-id"
    assert all(r.json == chat.canonical(json.loads(r.json)) and r.json_sha256 == hashlib.sha256(r.json.encode()).hexdigest() for r in got)
    assert chat.chat_format(df.limit(0)).collect() == []


def test_chat_odd_values():
    schema = {"t": {"type": "object", "properties": {"x": {"type": ["string", "null"]}}}}
    part = lambda role, text: chat.message_parts(role, text, schema)[0]
    for value, errors in (('"a"', []), ("null", []), ("3", ["type:$.x"])):
        assert part("assistant", '{"tool_calls": [{"id": 1, "name": "t", "arguments": {"x": %s}}]}' % value)[5] == errors
    for text in ('{"tool_call_id": NaN}', '{"tool_call_id": 1, "content": 1e999}', '{"tool_call_id": ' + "[" * 100_000):
        assert part("tool", text)[1] == "message" and "NaN" not in json.loads(part("tool", text)[6])["role"]
    lone = part("tool", '{"tool_call_id": "\\ud800", "content": "\\udfff"}')[6]
    assert lone.encode() and json.loads(lone)["content"] == "\udfff"


def test_chat_surrogate_rows(spark):
    df = spark.createDataFrame([(1, 0, "tool", '{"tool_call_id": "\\ud800", "content": "\\udfff"}')], "conv_id long, turn long, role string, text string")
    (row,) = chat.chat_format(df).collect()
    assert row.call_id == "\\ud800" and row.errors == "result:no-call"


def _brute_levels(calls):
    """calls: {(conv, id): (turn, result turn or None, needs)} -> {(conv, id): (level, place)}."""
    done = {}
    while True:
        new = {}
        for (conv, c), (turn, _, needs) in calls.items():
            before = [(conv, n) for n in needs if (conv, n) in calls]
            if (conv, c) not in done and all(b in done for b in before):
                new[conv, c] = (2 + max(done[b][0] for b in before) if before else 0, max([turn, *(x for b in before for x in (done[b][1], calls[b][1]) if x is not None)]))
        if not new:
            return done
        done |= new


def test_chat_order_of_random_graphs(spark):
    rng = random.Random(8)
    rows, calls = [], {}
    for conv in range(12):
        n = rng.randrange(2, 9)
        for k in range(n):
            needs = rng.sample(range(n), rng.randrange(3)) if conv % 3 else rng.sample(range(k), min(k, rng.randrange(3)))
            result = rng.randrange(20) if rng.random() < 0.7 else None
            calls[conv, str(k)] = (rng.randrange(20), result, [*map(str, needs), "none"])
            rows.append((conv, calls[conv, str(k)][0], "assistant", json.dumps({"tool_calls": [{"id": str(k), "name": "search", "depends_on": calls[conv, str(k)][2]}]})))
            if result is not None:
                rows.append((conv, result, "tool", json.dumps({"tool_call_id": str(k)})))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = _brute_levels(calls)
    assert 0 < len(want) < len(calls)
    for skeleton in (20_000, 3):
        got = {(r.conv_id, r.call_id): (r.level, r.place) for r in chat.chat_format(df, skeleton=skeleton).collect() if r.kind == "call" and "call:unresolvable" not in r.errors}
        assert got == want
    chain = [(1, k, "assistant", json.dumps({"tool_calls": [{"id": k, "name": "search", "depends_on": [k - 1]}]})) for k in range(1000)]
    got = chat.chat_format(spark.createDataFrame(chain, df.schema)).collect()
    assert sorted(r.level for r in got) == list(range(0, 2000, 2))


def _brute_classes(texts, weighted=False):
    """By weighted Jaccard over how often each run of five words stands in a text."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        met: Counter = Counter()
        sets[i] = set()
        for k in range(max(1, len(w) - 4)):
            run = tuple(w[k : k + 5]) if w else ("text", t or "")
            met[run] += 1
            sets[i].add(hash((run, met[run] if weighted else 1)))  # of two multisets of runs these have the same Jaccard
    total = {i: len(s) for i, s in sets.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if min(total[i], total[j]) >= 0.8 * max(total[i], total[j]):
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (total[i] + total[j] - both):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: find(i) for i in ids}


def _near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark, edge, docs, nothing):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(6)]
    # Sets of five words that differ in how often only: 0.8 by set, not by weight.
    often = [" ".join(f"a{k}" for k in range(40)), " ".join(f"a{k}" for k in range(40)) + (" " + " ".join(f"a{k}" for k in range(30))) * 3]
    texts = [r.text for r in docs.collect()] + TEXTS + often + [_near(rng, b, rng.choice([0, 1, 2, 3, 4, 5, 6])) for b in base for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weighted = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, weighted=True).collect()}
    assert weighted == _brute_classes(dict(enumerate(texts)), weighted=True)
    got = _brute_classes(dict(enumerate(texts)))
    assert got != weighted
    assert {r.doc_id for r in neardup.keep_one(df).collect()} == set(got.values())
    assert neardup.keep_one(edge).columns == edge.columns
    assert neardup.near_duplicates(nothing).collect() == []


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(100)) for x in "abc")
    rows = [(0, a + " more"), (1, a), (1, b), (3, b), (None, b), (3, b), (None, c), (None, c)]
    for turned in (rows, rows[::-1]):
        df = spark.createDataFrame(turned, "doc_id long, text string").coalesce(1)
        got = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect())
        assert got == Counter([(0, 0), (1, 0), (1, 1), (3, 1), (None, 1), (3, 1), (None, None), (None, None)])
    assert sorted(map(str, map(tuple, neardup.keep_one(df).collect()))) == sorted(map(str, [(0, a + " more"), (1, b), (None, c)]))


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    ids = neardup.mix(np.arange(300, dtype=np.uint64))
    a, b = rng.gamma(1.0, 2.0, 300) + 0.01, rng.gamma(1.0, 2.0, 300) + 0.01
    b[:200] = a[:200]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = neardup.dart_signature(ids, a, 2400) == neardup.dart_signature(ids, b, 2400)
    assert abs(same.mean() - want) < 0.05
    assert (neardup.dart_signature(ids, None, 240) == neardup.dart_signature(ids, np.ones(300), 240)).all()


def test_nearest_recall_and_edges(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    ids, m = np.array(sorted(x)), np.array([x[i] for i in sorted(x)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in ann.nearest(vectors, F.col("id") % 50 == 0, sample=512).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = m @ m[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        best = set(ids[np.argsort(-s)[:5]])
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s[np.searchsorted(ids, v)] - c) < 1e-12 for _, v, c in found)
        hits, total = hits + len(best & {v for _, v, _ in found}), total + 5
    assert hits >= 0.9 * total

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (100, None), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [None, 1.0]), (300, [inf, 1.0]), (350, [1.0]), (None, [1.0, 0.0]), (9, [-1.0, 1.0])]
    rows += [(1000 + i, [1.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, h int, key int")
    df = df.unionByName(df)  # repeated rows count once
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, k + 1, v) for k, v in enumerate([3, 7, 1000, 1001, 1002])]
    assert [v for q, _, v in got if q == 50] == [9, 0, 3, 7, 1000]
    assert ann.nearest(df.limit(0), F.lit(True)).collect() == []


def test_nearest_of_isolated_vectors(spark):
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(size=(20, 64)), 150, axis=0)
    x = np.vstack([centres + 0.01 * rng.normal(size=centres.shape), rng.normal(size=(40, 64))])
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("id") >= 3000).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in range(3000, 3040):
        s = m @ m[q]
        s[q] = -9
        hits.append(len(set(np.argsort(-s)[:5].tolist()) & got[q]))
        assert len(got[q]) == 5
    assert sum(hits) >= 0.95 * 5 * len(hits) and min(hits) >= 3


def nearest_by_force(x, q, k=5):
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = m @ m[q]
    s[q] = -9
    return np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:k].tolist()


def test_nearest_holds_little_at_a_time(spark):
    # A worker once held all buckets that a batch of queries visits, each with the query's vector.
    x = np.random.default_rng(8).normal(size=(20000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").coalesce(1)
    before, most, done = {}, {}, threading.Event()

    def look(held):
        for p in psutil.Process().children(recursive=True):
            with contextlib.suppress(psutil.Error):
                if "pyspark.daemon" in " ".join(p.cmdline()):
                    held[p.pid] = max(held.get(p.pid, 0), p.memory_info().rss)

    def watch():
        while not done.wait(0.05):
            look(most)

    look(before)  # workers that other tests have left

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = defaultdict(list)
        for r in ann.nearest(df, F.col("id") % 2 == 0).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
    finally:
        done.set()
        watcher.join()
    assert len(got) == 10000 and all(got[q] == nearest_by_force(x.astype(float), q) for q in range(0, 20000, 400))
    grown = max(n - before.get(pid, 0) for pid, n in most.items())
    assert grown < 500e6, grown


def test_nearest_is_exact_in_many_groups(spark, monkeypatch):
    # Small groups, so that a cell is cut and tight cells are left out; near copies, multiples (ties), isolated and extreme vectors.
    monkeypatch.setattr(ann, "GROUP", 16 * 8 * 150)
    monkeypatch.setattr(ann, "TILE", 50)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    tight = centres[rng.integers(0, 12, 900)] + 0.01 * rng.normal(size=(900, 16))
    x = np.vstack([tight, centres[0] + 1e-3 * rng.normal(size=(700, 16)), np.outer(2.0 ** rng.integers(-3, 4, 40), centres[1]), rng.normal(size=(100, 16))])
    scale = np.ones(len(x))
    scale[-100:-50], scale[-50:] = 2.0**600, 2.0**-600
    df = spark.createDataFrame([(i, (v * c).tolist()) for i, (v, c) in enumerate(zip(x, scale, strict=True))], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 7 == 0, sample=200).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert sorted(got) == list(range(0, len(x), 7))
    assert [q for q in got if got[q] != nearest_by_force(x, q)] == []
    first, parts, groups = ann._grouped({0: 10, 1: 260, 2: 90, 4: 20, 5: 5}, 100)
    assert (first.tolist(), parts.tolist(), groups) == ([0, 1, 4, 0, 5, 5], [1, 3, 1, 1, 1, 1], 6)


MIT, GPL = (dict(licenses.TEMPLATES)[x] for x in ("mit", "gpl"))
LICENSED = [
    "Released under the MIT License. and again UNDER the -- mit LICENSE", "apache license, version 2 cc by-nc 4.0", "x" + " y" * 300 + " licensed under the apache licence version 2 0 " + "z " * 70, "under the mit licenses",
    "x " * 75 + MIT + " y" * 200, MIT[:300], " ".join(MIT.split()[:-9]), ("x " * 130 + GPL.upper()) * 2, "under the K mit license", "Underé the mit license", "you may not use this file except in compliance with the license", None, "", "cc by nc cc by nc",
    "this tool is released under the gpl license", "the house was released under the license of the city",
]


def _brute_license(text, templates, threshold=0.8):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    best, own = 0.0, set()
    for label, t in templates:
        step, t = licenses.block_size(t), set(t.split())
        for i in range(0, max(0, len(w) - step - 1) + 1, step):
            c = len(t & set(w[i : i + 2 * step])) / len(t)
            if c >= threshold - 1e-12:
                own, best = own | {label}, max(best, c)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if base else best


def test_licenses(spark, docs, nothing):
    long = ("long", " ".join(f"t{k}" for k in range(200)))
    for templates in (licenses.TEMPLATES, [*licenses.TEMPLATES, long, ("short", "released under the mit license")]):
        texts = LICENSED + [long[1]] + [r.text for r in docs.collect()] + TEXTS
        df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, own string")
        got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.license_scan(df, templates=templates).collect()}
        want = {i: _brute_license(t, templates) for i, t in enumerate(texts)}
        assert {i: g[:6] for i, g in got.items()} == {i: w[:6] for i, w in want.items()}
        assert all(abs(got[i][6] - want[i][6]) < 1e-12 for i in got)
    labels = {i: got[i][5] for i in range(len(LICENSED) + 1)}
    assert labels[len(LICENSED)] == "long" and got[len(LICENSED)][6] == 1.0
    got = {r.doc_id: r.labels for r in licenses.license_scan(df).collect()}
    assert got[4] == got[6] == "mit" and got[7] == "gpl" and got[14] == got[15] == got[3] == ""  # whole notices; sentences that share words aren't
    same = spark.createDataFrame([(None, MIT), (1, MIT), (1, GPL)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.labels) for r in licenses.license_scan(same).collect()) == [("1", "gpl"), ("1", "mit"), ("None", "mit")]
    assert licenses.license_scan(nothing).collect() == []


def _plain_language(model, text):
    """Averaged embeddings and softmax without caches or shortcuts."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    features = []
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f"<{w}>"
        hashes = [sum(ord(c) * pow(0x100000001B3, k + 1) for k, c in enumerate(w))]
        hashes += [sum(ord(c) * pow(0x100000001B3, n - 1 - k) for k, c in enumerate(w[i : i + n])) for n in (2, 3, 4) for i in range(len(w) - n + 1)]
        features += [(h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 49 for h in hashes]
    logits = (model.scores[features].mean(0) + model.bias) / model.temperature
    p = np.exp(logits - logits.max())
    return model.languages[int(p.argmax())], float(p.max() / p.sum())


def test_language(spark, edge, nothing):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.op8_language(spark, sf).join(docs, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and sum(r.rejected for r in found) <= 0.01 * len(found)
    model = langid.Model.load(langid.fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    for r in found:
        lang, score = _plain_language(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9 and r.rejected == (lang == "und" or score < model.level)
    assert 0.25 < model.level < 1
    model = langid.fit(edge, F.lit(True))
    assert {r.lang_pred for r in langid.identify(edge, model).collect()} == {"und"}
    assert langid.identify(nothing, langid.fit(nothing, F.lit(True))).collect() == []
    assert {r.text for r in langid.keep_identified(edge, model).collect()} == {t for t in TEXTS if t and any(map(str.isalpha, t))}
    rng = random.Random(5)
    learn = [(i, " ".join(rng.choice(words) for _ in range(30)), lang) for i, (lang, words) in enumerate([("aa", ["bana", "mana", "lana"]), ("bb", ["stronk", "blork", "fnord"])] * 60)]
    model = langid.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"), F.lit(True))
    asked = spark.createDataFrame([(1, "stronk stork"), (2, "ana nana"), (3, None), (4, "123 !?"), (5, "")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(asked, model).orderBy("doc_id").collect()] == ["bb", "aa", "und", "und", "und"]


def _plain_score(index, text):
    """TF-IDF cosines with all examples, their vote and its calibrated probability, without index or blocks."""
    counts = Counter(t for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for t in toxicity.word_terms(w))
    vector = {t: (1 + np.log(n)) * index.idf[index.terms[t]] for t, n in counts.items() if t in index.terms}
    norm = sum(x * x for x in vector.values()) ** 0.5
    cosines = []
    for e in range(len(index.ids)):
        own = slice(index.starts[e], index.starts[e + 1])
        cosines.append(round(sum(vector.get(index.names[t], 0.0) * v for t, v in zip(index.held[own], index.values[own], strict=True)) / norm if norm else 0.0, 12))
    best = [e for e in sorted(range(len(cosines)), key=lambda e: (-cosines[e], e)) if cosines[e] > 0][: index.k]
    if not best:
        return index.rest, []
    weight = [cosines[e] * index.weights[e] for e in best]
    vote = sum(w * index.labels[e] for w, e in zip(weight, best, strict=True)) / sum(weight)
    return float(np.interp(vote, *index.votes)), sorted(((-cosines[e], int(index.ids[e])) for e in best))[:5]


def test_toxicity(spark, edge, nothing):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op10_toxicity(spark, sf).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    toxic, clean = [r for r in found if r.toxic == 1], [r for r in found if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    data = toxicity.fit(docs, labels, F.lit(True), per_label=60)
    index = pickle.loads(data)
    assert 0 < (index.labels == 1).sum() <= 60 and len(index.ids) <= 120
    asked = docs.limit(25).unionByName(edge.select(*docs.columns[:4], F.lit(0).cast("long").alias("n_chars")).withColumn("doc_id", -F.col("doc_id") - 1))
    texts = {r.doc_id: r.text for r in asked.collect()}
    for r in toxicity.toxicity(asked, data).collect():
        score, near = _plain_score(index, texts[r.doc_id])
        assert abs(r.score - min(1, max(0, score))) < 1e-7 and r.predicted == (r.score >= 0.3)
        assert [i for _, i in near] == r.neighbours or len({c for c, _ in near}) < len(near)  # equal cosines may change places
    kept = {r.doc_id for r in toxicity.keep_clean(asked, data).collect()}
    assert kept == {r.doc_id for r in toxicity.toxicity(asked, data).collect() if not r.predicted}
    assert toxicity.toxicity(edge, data).count() == len(TEXTS) and toxicity.toxicity(nothing, data).collect() == []
    none = toxicity.fit(edge, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.toxicity(edge, none).collect()} == {0.0}
    long = "x" * 90
    assert toxicity.word_terms(long + "a")[0] != toxicity.word_terms(long + "b")[0]


def test_toxicity_compares_every_text_over_all_terms(spark, docs):
    rows = [(i, f"plain words {chr(97 + i % 26) * 4} here", 0) for i in range(200)] + [(200 + i, "you vile creature", 1) for i in range(197)] + [(397 + i, "smrdljiva baraba", 1) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fit(df, df.select("doc_id", "toxic"), F.lit(True))
    asked = spark.createDataFrame([(1, "smrdljiva baraba"), (2, "plain words")], "doc_id long, text string")
    rare, plain = toxicity.toxicity(asked, index).orderBy("doc_id").collect()
    assert rare.predicted == 1 and rare.neighbours == [397, 398, 399] and {"smrdljiva", "baraba"} <= set(rare.terms)
    assert plain.predicted == 0 and len(plain.neighbours) == 5 and "plain" in plain.terms
    assert all(r.neighbours for r in queries.op10_toxicity(spark, SF).collect())


def test_pipeline(spark, nothing, edge):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "toxicity", "near_duplicates", "packing"]
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    crc = lambda n, r: F.crc32(F.col("doc_id").cast("string").cast("binary")) % n != r
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: {r.doc_id for r in df.collect()}
    model = langid.Model.load(langid.fit(docs, crc(3, 1)))
    index = pickle.loads(toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), crc(4, 2)))
    asked = {i: t for i, t in rows.items() if i < 120}
    want = {i for i, t in rows.items() if (x := _plain_language(model, t))[0] != "und" and x[1] >= model.level}
    assert ids(stages["language"](spark, docs, sf)) == want and len(want) > 0.99 * len(rows)
    found = ids(stages["toxicity"](spark, docs, sf))
    assert found & set(asked) == {i for i, t in asked.items() if _plain_score(index, t)[0] < 0.3} and len(found) > 0.8 * len(rows)  # few labels at this size
    small = spark.read.parquet(f"{SF}/documents.parquet")
    assert ids(stages["near_duplicates"](spark, small, SF)) == set(_brute_classes({r.doc_id: r.text for r in small.collect()}).values())
    for name in list(stages)[:2]:
        assert stages[name](spark, docs, sf).schema == docs.schema
        assert stages[name](spark, nothing, sf).count() == 0
        assert stages[name](spark, edge, sf).columns == edge.columns
    pieces = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in pieces}
    step = small
    for name in list(stages)[:-1]:
        step = spark.createDataFrame(stages[name](spark, step, SF).collect(), docs.schema)
    assert kept == ids(step) and kept
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
