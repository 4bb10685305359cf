"""License scans (operator 7), in DataFrame functions only.

Base: the places where a phrase's words stand consecutively. Method: an exact set-similarity join of text blocks with license
templates, under containment of the template's word set. A template of at most ``s`` words, s a power of two, is sought in
blocks of 2 s words that begin every s words, so any run of as many words as it has lies whole in a block. The templates'
words are ordered by their document frequency over all texts, rarest first. With o = ceil(threshold * |T|): a block and a
template that share o words share one among the first |T| - o + 1 of the template and one among the first n - o + 1 of the
block's n ordered template words (prefix); n >= o (length); and from the positions of a shared word no more than
1 + min(words left in either) can be shared (position). What passes is verified. Only template words that some text holds are
ordered: other words can't add to an overlap, so leaving them out keeps the join exact; a template with fewer than o such
words can't be met. Templates are whole notices, so texts that share common words with one don't meet the threshold.

Templates are the program's own list, hence bounded; they and the word order (one row for each template word) are broadcast.
Defined results: null is the empty text, with 0 words, no labels and score 0; the score is 1 where a phrase stands, else the
largest containment that meets the threshold, else 0; every row is labelled by its own text, whatever its id (nulls and
repeated ids too); repeated rows are repeated; words of equal frequency are ordered by the alphabet; texts of any length are
read whole; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Words of the licences' own notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0 or send a letter to creative commons"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
]
#: Between words; upper case belongs to words, as it is lower-cased first.
_GAP = r"[\x00-/:-@\[-`{-\x7f]+"
_WORD = r"[^\x00-/:-@\[-`{-\x7f]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAP), lambda w: w != "")


def _has(text: Column, phrases: list[str]) -> Column:
    """Whether the words of any of the phrases may stand in a row: Java's (?i) knows A-Z only, as it should."""
    return text.rlike("(?i)" + "|".join(_GAP.join(re.escape(w) for w in p.split()) for p in phrases))


def _starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            out = out & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return out

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def template_order(texts: DataFrame, templates) -> list[tuple[str, int]]:
    """(word, documents that hold it) of the template words that some text holds, rarest first: the global order."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    held = texts.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("w"))
    return sorted(((r.w, r.n) for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()), key=lambda x: (x[1], x[0]))


def block_size(template: str) -> int:
    """Words from one block to the next: the least power of two that holds the template."""
    return 1 << max(0, len(template.split()) - 1).bit_length()


def template_blocks(texts: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(digest, size, block, label, template, containment) of every block of (digest, text) that meets the threshold; block is its first word's index."""
    spark = texts.sparkSession
    order = template_order(texts, templates)
    rank = {w: i for i, (w, _) in enumerate(order)}
    prefix, least = [], {}
    for n, (label, t) in enumerate(templates):
        words, size = set(t.split()), block_size(t)
        o, held = math.ceil(threshold * len(words) - 1e-9), sorted(rank[w] for w in words if w in rank)
        # Words that no text holds come first in the order; they fill the prefix but can't be met.
        missing = len(words) - len(held)
        prefix += [(n, label, size, held, len(words), o, missing + i, r) for i, r in enumerate(held[: max(0, len(words) - o + 1 - missing)])]
        if len(held) >= o:
            least[size] = min(o, least.get(size, o))
    schema = "template int, label string, size int, words array<int>, m int, o int, at int, r int"
    if not prefix:
        return texts.select("digest").limit(0).selectExpr("digest", "0 as size", "0 as block", "'' as label", "0 as template", "0.0d as containment")
    rows = F.broadcast(spark.createDataFrame(prefix, schema))
    first = sorted({order[r][0] for *_, r in prefix})
    # The prefix filter on whole texts: without any template's prefix word no block can match.
    held = texts.select("digest", words_of(F.col("text")).alias("words")).filter(F.arrays_overlap("words", F.array(*map(F.lit, first))))

    def starts(size: int) -> Column:
        each = F.sequence(F.lit(0), F.greatest(F.size("words") - size - 1, F.lit(0)), F.lit(size))
        return F.transform(each, lambda i: F.struct(F.lit(size).alias("size"), i.alias("block")))

    blocks = held.select("digest", "words", F.inline(F.concat(*map(starts, sorted(least)))))
    ranks = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    inside = F.array_intersect(F.slice("words", F.col("block") + 1, F.col("size") * 2), F.array(*map(F.lit, rank)))
    fewest = F.element_at(F.create_map(*(F.lit(x) for pair in least.items() for x in pair)), F.col("size"))
    ordered = blocks.select("digest", "size", "block", F.array_sort(F.transform(inside, lambda w: ranks[w])).alias("b"), fewest.alias("fewest")).filter("size(b) >= fewest")
    probes = ordered.select("digest", "size", "block", "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - F.col("fewest") + 1)).alias("p", "r"))
    n = F.size("b")
    passed = (n >= F.col("o")) & (F.col("p") <= n - F.col("o")) & (1 + F.least(F.col("m") - F.col("at") - 1, n - F.col("p") - 1) >= F.col("o"))
    both = F.size(F.array_intersect("b", "words"))
    met = probes.join(rows, ["r", "size"]).filter(passed).withColumn("both", both).filter("both >= o")
    return met.select("digest", "size", "block", "label", "template", (F.col("both") / F.col("m")).alias("containment")).distinct()


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of every text."""
    phrases = phrases or PHRASES
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    text = F.col("text")
    some = F.when(_has(text, list(phrases)), words_of(text)).otherwise(F.array().cast("array<string>"))
    base = texts.select("id", "digest", F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), some.alias("w"))
    found = [F.when(F.size("w") > 0, _starts(F.col("w"), p)).otherwise(F.array().cast("array<int>")) for p in phrases]
    base = base.select("id", "digest", "n_words", F.array(*found).alias("at"))
    base = base.select("id", "digest", "n_words", F.flatten("at").alias("all"), F.array_compact(F.array(*(F.when(F.size(F.get("at", F.lit(k))) > 0, label) for k, label in enumerate(phrases.values())))).alias("base"))
    blocks = template_blocks(texts.select("digest", "text"), templates, threshold)
    own = blocks.groupBy("digest").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    joined = base.join(own, "digest", "left")
    labels = F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>"))))
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.size("all").cast("long").alias("n_base"), F.array_min("all").cast("long").alias("first_word"), F.array_max("all").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def license_sql(phrases=None, templates=TEMPLATES, threshold: float = 0.8) -> str:
    """The same over ``documents`` in DuckDB's SQL, with every block of every text against every template of its size."""
    phrases = phrases or PHRASES

    def words(t: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in t) + "]"

    p = ", ".join(f"('{label}', {words(x.split())})" for x, label in phrases.items())
    t = ", ".join(f"('{label}', {block_size(x)}, {words(sorted(set(x.split())))})" for label, x in templates)
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES {p}) AS v(label, words)),
t AS (SELECT * FROM (VALUES {t}) AS v(label, size, words)),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + len(words)) = words)) AS i FROM (SELECT * FROM d WHERE len(w) > 0), p),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id),
b AS (SELECT doc_id, size, list_distinct(list_slice(w, i + 1, i + 2 * size)) AS held FROM (SELECT doc_id, w, size, unnest(range(0, greatest(len(w) - size - 1, 0) + 1, size)) AS i FROM d, (SELECT DISTINCT size FROM t))),
met AS (SELECT doc_id, label, len(list_intersect(words, held)) / len(words) AS c FROM b JOIN t USING (size) WHERE len(list_intersect(words, held)) >= ceil({threshold} * len(words) - 1e-9)),
own AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, own.labels))), ','), '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN base ON d.doc_id = base.doc_id LEFT JOIN own ON d.doc_id = own.doc_id"""
