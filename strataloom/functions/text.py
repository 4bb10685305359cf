"""Text measures as native columns: words, sentences, statistics, scores, entropy and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Branch words whose count gives the cyclomatic estimate (fixed values).
BRANCHES = ["if", "else", "elif", "for", "while", "case", "catch", "switch", "try", "except", "finally"]
#: Signs of source code (fixed values).
CODE_SIGNS = ["{", "}", "if (", "for (", "def ", "class ", "import ", "return ", ";", "=>", "function", "var ", "const "]
#: Words that hint at a language, in the order in which ties go (fixed values).
LANGUAGE_HINTS = {
    "python": ["def ", "import ", "from ", "class ", "if __name__", "print("],
    "javascript": ["function", "const ", "var ", "let ", "=>", "import ", "console.log"],
    "java": ["public class", "private ", "protected ", "void ", "String ", "System.out"],
    "html": ["<html>", "<div>", "<body>", "<script>", "<style>"],
    "css": ["body {", "div {", "margin:", "padding:", "color:"],
    "sql": ["SELECT ", "FROM ", "WHERE ", "INSERT INTO", "UPDATE ", "DELETE "],
}
#: Patterns of comment lines by extension (fixed values).
COMMENT_LINES = {
    "py": r"^\s*(#|\"\"\"|\'\'\')",
    "java": r"^\s*(//|/\*|\*)",
    "js": r"^\s*(//|/\*|\*)",
    "sql": r"^\s*(--|/\*)",
    "xml": r"^\s*(<!--|-->)",
    "yaml": r"^\s*#",
    "yml": r"^\s*#",
    "sh": r"^\s*#",
}
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def count_of(text: Column, chars: str) -> Column:
    """Characters of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^0-9\p{L}_]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n\\s*\n"), lambda s: F.trim(s) != "")


def token_estimate(text: Column) -> Column:
    """Half of three quarters of the words and a quarter of the characters."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.floor((n * 0.75 + F.length(text) / 4) / 2).cast("long")


def whole(text: Column) -> Column:
    """Null is the empty text."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Words, without an array of them."""
    return F.regexp_count(text, F.lit(r"[0-9\p{L}_]+"))


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^.!?]*[^.!? ][^.!?]*"))


def readability(text: Column) -> Column:
    """100 less half the words a sentence and half the percentage of words over six letters; 100 when empty or null."""
    text = whole(text)
    n, s, long = word_count(text), sentence_count(text), F.regexp_count(text, F.lit(r"[0-9\p{L}_]{7,}"))
    value = 100 - 0.5 * n / s - 50.0 * long / n
    return F.when((n == 0) | (s == 0), F.lit(100.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)))


def complexity(text: Column) -> Column:
    """Of 25 each: words a sentence over 30, letters a word over 10, distinct over all words, and share of punctuation (of code: nesting over 5)."""
    text = whole(text)
    w, s = words(text), sentence_count(text)
    n = F.greatest(F.size(w), F.lit(1))
    letters = F.length(F.regexp_replace(F.lower(text), r"[^0-9\p{L}_]+", ""))
    last = F.when(looks_like_code(text), F.least(max_nesting(text) / 5 * 25, F.lit(25.0))).otherwise(F.least(count_of(text, r"[.,!?;:]") / F.greatest(F.length(text), F.lit(1)) * 100, F.lit(25.0)))
    score = F.least(F.size(w) / F.greatest(s, F.lit(1)) / 30 * 25, F.lit(25.0)) + F.least(letters / n / 10 * 25, F.lit(25.0)) + F.size(F.array_distinct(w)) / n * 25 + last
    return F.least(F.lit(100.0), score)


def max_nesting(text: Column) -> Column:
    """The deeper of braces (never below 0) and indentation by fours."""
    braces = F.filter(F.split(F.regexp_replace(text, "[^{}]", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, c):
        now = F.when(c == "{", acc.now + 1).otherwise(F.greatest(acc.now - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(acc.most, now).alias("most"))

    deep = F.aggregate(braces, start, step, lambda acc: acc.most)
    indents = F.transform(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(r"\S")), lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", "")))
    return F.greatest(deep, F.floor(F.coalesce(F.array_max(indents), F.lit(0)) / 4).cast("int"))


def language_hint(text: Column) -> Column:
    """The language most of whose hints the text holds, the first on a tie, ``unknown`` without any."""
    scores = {name: sum((F.contains(text, F.lit(x)).cast("int") for x in hints), F.lit(0)) for name, hints in LANGUAGE_HINTS.items()}
    best = F.greatest(*scores.values())
    out = F.when(best == 0, "unknown")
    for name, score in scores.items():
        out = out.when(score == best, name)
    return out


def line_classes(text: Column, extension: str) -> Column:
    """struct(total, blank, comments, code) of the text's lines."""
    all_, marks = lines(whole(text)), COMMENT_LINES.get(extension)
    blank = F.size(F.filter(all_, lambda x: ~x.rlike(r"\S")))
    comments = F.size(F.filter(all_, lambda x: x.rlike(r"\S") & x.rlike(marks))) if marks else F.lit(0)
    return F.struct(F.size(all_).alias("total"), blank.alias("blank"), comments.alias("comments"), (F.size(all_) - blank - comments).alias("code"))


def cyclomatic(text: Column) -> Column:
    return (1 + F.regexp_count(text, F.lit(r"\b(?:" + "|".join(BRANCHES) + r")\b"))).cast("long")


def maintainability(text: Column) -> Column:
    """100 less half the complexity and half the lines beyond 20."""
    loc = F.size(F.filter(lines(text), lambda x: x.rlike(r"\S")))
    return F.round(F.greatest(F.lit(0.0), 100 - 0.5 * cyclomatic(text) - 0.5 * F.greatest(F.lit(0), loc - 20)), 2)


def looks_like_code(text: Column) -> Column:
    return sum((F.contains(text, F.lit(s)).cast("int") for s in CODE_SIGNS), F.lit(0)) >= 2


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
