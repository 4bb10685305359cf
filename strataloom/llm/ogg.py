"""Media columns (operator 3): Ogg pages written, verified, demultiplexed and timed.

``mux`` lays the packets of several logical streams into pages with lacing values, granule positions and checksums;
``demux`` verifies every page checksum, page number and begin and end flag, reassembles packets (also those that run over
pages) for each serial number, and gives each packet the granule position of the page on which it ends. ``starts`` derives the
packets' timestamps from the granule positions: a page's position is the end of the last packet that ends on it, earlier
packets of the page count back from there, and the first must begin where the page before left off.

Defined results: null is the empty text, whose payload is one block of spaces; a damaged, missing, repeated or misplaced page, a
wrong granule position or a length that doesn't fit the payload raises ValueError. Texts of any length are stored whole (page
and packet sizes don't grow with them). Ids come out as they went in (nulls and repeated ones too), repeated rows are repeated,
extra columns don't matter, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

RATE, BLOCK, PACKET = 8000, 192, 4800
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """The format's CRC (polynomial 04C11DB7, unreflected, from 0), by zlib's reflected one over reversed bits."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_REVERSED)[::-1], "big")


def _stream_pages(serial: int, packets: list[tuple[bytes, int]]):
    """Pages (granule, bytes) of one logical stream; packets: (bytes, granule at their end)."""
    segments: list[tuple[bytes, bool, int]] = []
    for data, granule in packets:
        cuts = [data[i : i + 255] for i in range(0, len(data), 255)]
        if len(data) % 255 == 0:
            cuts.append(b"")
        segments += [(c, k == len(cuts) - 1, granule) for k, c in enumerate(cuts)]
    at = 1 + next(k for k, (_, last, _) in enumerate(segments) if last)  # the first packet has its pages alone
    groups = [segments[i : min(i + 255, end)] for start, end in ((0, at), (at, len(segments))) for i in range(start, end, 255)]
    continued = False
    for number, group in enumerate(groups):
        ends = [g for _, last, g in group if last]
        flags = continued | 2 * (number == 0) | 4 * (number == len(groups) - 1)
        granule = ends[-1] if ends else -1
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(group))
        body = bytes(len(c) for c, _, _ in group) + b"".join(c for c, _, _ in group)
        crc = page_checksum(head + body)
        yield granule, head[:22] + crc.to_bytes(4, "little") + head[26:] + body
        continued = not group[-1][1]


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """Pages of all streams: first pages first, then in turn by granule position."""
    first, rest = [], []
    for serial, packets in sorted(streams.items()):
        last = 0
        for number, (granule, page) in enumerate(_stream_pages(serial, packets)):
            last = max(last, granule)
            (rest if number else first).append((last, serial, number, page))
    return b"".join(p[3] for p in first + sorted(rest))


@dataclass
class Packet:
    serial: int
    data: bytes
    granule: int  # of the page on which it ends
    page: int  # that page's number in its stream


def demux(media: bytes) -> tuple[list[Packet], int]:
    """(packets in the order they end, number of pages)."""
    at, pages, out = 0, 0, []
    open_: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError("cut page")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError("no page here")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if len(page) != end - at or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("wrong page checksum")
        if number != numbers.get(serial, -1) + 1 or bool(flags & 1) != bool(open_.get(serial)):
            raise ValueError("page missing")
        if bool(flags & 2) != (number == 0) or serial in ended:
            raise ValueError("wrong begin or end of stream")
        numbers[serial] = number
        if flags & 4:
            ended.add(serial)
        body, parts, done = at + 27 + n, open_.setdefault(serial, []), []
        for size in lacing:
            parts.append(media[body : body + size])
            body += size
            if size < 255:
                done.append(Packet(serial, b"".join(parts), granule, number))
                parts = open_[serial] = []
        out += done
        at, pages = end, pages + 1
    if any(open_.values()) or ended != set(numbers):
        raise ValueError("cut stream")
    return out, pages


def starts(packets: list[Packet], durations: list[int]) -> list[int]:
    """Where each packet of one stream begins, from the granule positions of the pages on which they end."""
    out, before = [0] * len(packets), 0
    for k in range(len(packets) - 1, -1, -1):
        last_on_page = k + 1 == len(packets) or packets[k + 1].page != packets[k].page
        out[k] = (packets[k].granule if last_on_page else out[k + 1]) - durations[k]
    for start, packet, k in zip(out, packets, range(len(packets)), strict=True):
        if start != before:
            raise ValueError("wrong granule position")
        before = packet.granule if k + 1 == len(packets) or packets[k + 1].page != packet.page else out[k + 1]
    return out


def padded(n_bytes: int) -> int:
    return max(1, -(-n_bytes // BLOCK)) * BLOCK


def store(text: str) -> bytes:
    """The payload as 8-bit samples in stream 1 and its unpadded length in stream 2."""
    data = text.encode("utf-8")
    payload = data + b" " * (padded(len(data)) - len(data))
    samples = [(b"U8SAMPLE" + struct.pack("<I", RATE), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    return mux({1: samples, 2: [(b"BYTES", 0), (struct.pack("<Q", len(data)), len(payload))]})


def load(media: bytes) -> dict:
    """What the stored bytes hold: payload, n_bytes, packet timestamps in seconds, pages."""
    packets, pages = demux(media)
    sound, notes = ([p for p in packets if p.serial == s] for s in (1, 2))
    if not sound or sound[0].data[:8] != b"U8SAMPLE" or len(sound[0].data) != 12 or len(notes) != 2 or notes[0].data != b"BYTES" or len(notes[1].data) != 8:
        raise ValueError("stream missing")
    rate = struct.unpack("<I", sound[0].data[8:])[0]
    (n_bytes,) = struct.unpack("<Q", notes[1].data)
    at = starts(sound, [0, *(len(p.data) for p in sound[1:])])[1:]
    payload = b"".join(p.data for p in sound[1:])
    starts(notes, [0, len(payload)])
    if len(payload) != padded(n_bytes) or payload[n_bytes:].strip(b" "):
        raise ValueError("wrong length")
    return {"payload": payload, "n_bytes": n_bytes, "stamps": [x / rate for x in at], "sizes": [len(p.data) for p in sound[1:]], "seconds": sound[-1].granule / rate, "pages": pages}


def feature(got: dict) -> str:
    """Mean, root mean square about it, peak to peak, sign changes about the mean, duration, packets, start of the last packet, pages."""
    s = np.frombuffer(got["payload"], np.uint8)
    total = int(s.sum(dtype=np.int64))
    mean = total / len(s)
    square = float(np.dot(c := np.bincount(s, minlength=256), (np.arange(256) - mean) ** 2)) / len(s)
    up = s > mean
    crossings = int(np.count_nonzero(up[1:] != up[:-1]))
    low, high = np.flatnonzero(c)[[0, -1]]
    return f"mean={mean:.4f};rms={square**0.5:.4f};range={int(high - low)};crossings={crossings};seconds={got['seconds']:.3f};packets={len(got['stamps'])};last={got['stamps'][-1]:.3f};pages={got['pages']}"


def ogg_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary) of every text."""
    return per_row(df, [id_col], [text_col], "media binary", lambda: lambda texts: ([store(t or "") for t in texts],))


def ogg_packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, packet, start, n_samples): the sound packets of stored media with their timestamps in seconds; null media has none."""

    def make():
        def packets(media):
            got = load(media) if media is not None else {"stamps": [], "sizes": []}
            return [{"packet": k, "start": s, "n_samples": n} for k, (s, n) in enumerate(zip(got["stamps"], got["sizes"], strict=True))]

        return lambda medias: (list(map(packets, medias)),)

    found = per_row(df, [id_col], [media_col], "packets array<struct<packet: int, start: double, n_samples: long>>", make)
    return found.select(id_col, F.inline("packets"))


def ogg_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back and describe both; one pass, no shuffle."""

    def make():
        def describe(text):
            media = store(text or "")
            got = load(media)
            payload = got["payload"]
            return got["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(got)

        return lambda texts: zip(*map(describe, texts), strict=True)

    return per_row(df, [id_col], [text_col], "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
