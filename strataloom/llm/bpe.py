"""Byte-pair encoding and decoding (operator 5).

A pre-token is a doubly linked list of symbols. A heap holds (merge rank, position) of every adjacent pair; the lowest
rank, leftmost first, is merged, entries whose pair has changed since are skipped, and the two new neighbours are pushed.
Decoding concatenates vocabulary strings. The result equals the tokenizers library's on every text.

Defined results: null is the empty text; an empty text has no tokens and decodes to "". A text of any length is encoded whole.
Among pairs of equal rank the leftmost is merged. Ids come out as they went in (nulls and repeated ones too), repeated rows are
repeated, extra columns don't matter, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import GenerationCache, once, per_row, ship, tokenizer_path

#: Characters on which Python's classes and the library's agree beyond doubt; a text with any other is split by the library.
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿŒœ¡¿«»–—‘’“”…]")
#: The splitting patterns of the two vocabularies, for texts of those characters only.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_BYTES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 and up in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in keep else 256 + extra))
        extra += b not in keep
    return out


class Bpe:
    """A vocabulary file of the tokenizers library, encoded by our own merge loop."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.library = Tokenizer.from_str(raw.decode())
        self.lower = spec["normalizer"] is not None
        self.pattern = _WORDS if self.lower else _BYTES
        self.chars = byte_characters()
        self.byte_level_decoder = spec["decoder"] is not None

    def merge(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # stale
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, symbols[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], symbols[h], new))
        return [s for s in symbols if s >= 0]

    def encode_mapped(self, piece: str) -> list[int]:
        """Of a pre-token in byte characters."""
        if not piece:
            return []
        vocab = self.vocab
        symbols = [vocab[c] for c in piece[:-1]]
        symbols.append(vocab[piece[-1] + self.suffix])
        return self.merge(symbols)

    def encode_piece(self, piece: str) -> list[int]:
        """Of a pre-token in plain characters."""
        chars = self.chars
        return self.encode_mapped("".join([chars[b] for b in piece.encode()]))

    def plain(self, text: str) -> bool:
        return text.isascii() and text.isprintable() or not _OTHER.search(text)

    def pieces(self, text: str) -> tuple[bool, list[str]]:
        """Pre-tokens of a text without special strings, and whether they are plain (else in byte characters)."""
        if self.plain(text):
            return True, self.pattern.findall(text.lower() if self.lower else text)
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return False, [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[int, str]]:
        """(id, "") of a special string, or (-1, ordinary text)."""
        if "<|" not in text:
            yield -1, text
            return
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                yield self.special[part], ""
            elif part:
                yield -1, part

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, part in self.parts(text):
            if special >= 0:
                out.append(special)
                continue
            plain, pieces = self.pieces(part)
            one = self.encode_piece if plain else self.encode_mapped
            for p in pieces:
                out += one(p)
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: vocabulary strings joined by a space; with the byte decoder: bytes of all characters."""
        strings = [self.strings[i] for i in ids]
        if not self.byte_level_decoder:
            return " ".join(strings)
        code = {c: b for b, c in enumerate(self.chars)}
        return bytes(code[c] for s in strings for c in s).decode("utf-8", "replace")


def bpe_of(raw) -> Bpe:
    return once("tokens", ("bpe", hash(raw.value)), lambda: Bpe(raw.value))


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every text; extra columns of df don't matter."""
    raw = ship(df.sparkSession, path or tokenizer_path("word_bpe_49k.json"))

    def make():
        b = bpe_of(raw)
        return lambda texts: ([b.encode(t or "") for t in texts],)

    return per_row(df, [id_col], [text_col], "ids array<int>", make)


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded string) of arrays of ids; null gives ""."""
    raw = ship(df.sparkSession, path or tokenizer_path("word_bpe_49k.json"))

    def make():
        b = bpe_of(raw)
        return lambda lists: ([b.decode(x or []) for x in lists],)

    return per_row(df, [id_col], [ids_col], "decoded string", make)


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode every text and keep counts and digests; one pass, no shuffle.

    Workers memo (number of ids, ids as text, vocabulary strings) of pre-tokens, so encoding and decoding a text are two joins.
    """
    raw = ship(df.sparkSession, path or tokenizer_path("word_bpe_49k.json"))

    def make():
        b = bpe_of(raw)

        def known(encode):
            def of(piece):
                ids = encode(piece)
                return len(ids), " ".join(map(str, ids)), b.decode(ids)

            return GenerationCache(of)

        plain_cache, mapped_cache = once("tokens", ("digests", id(b)), lambda: (known(b.encode_piece), known(b.encode_mapped)))

        def digest(text):
            found = []
            for special, part in b.parts(text or ""):
                if special >= 0:
                    found.append((1, str(special), b.strings[special]))
                else:
                    plain, pieces = b.pieces(part)
                    found += map((plain_cache if plain else mapped_cache).__getitem__, pieces)
            n, ids, strings = zip(*found, strict=True) if found else ((), (), ())
            return sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(strings).encode()).hexdigest()

        return lambda texts: zip(*map(digest, texts), strict=True)

    return per_row(df, [id_col], [text_col], "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
