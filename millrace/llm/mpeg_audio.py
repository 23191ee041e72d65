"""Media columns: MPEG audio.

A payload is stored in the main data of MPEG-1 layer III frames (mono, 32 kHz, CRC-protected, silent side
information) of a variable-bitrate stream: an ID3v2 tag, a frame with the variable-bitrate table, then frames
of 320 kbit/s and a last one of the least bitrate that holds the rest.  Reading skips and parses tags,
resynchronises on frame headers, verifies each frame's checksum and gives exact durations and seek offsets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frame, keyed

# Fixed values of the format (ISO/IEC 11172-3, 13818-3): kbit/s and Hz by header index.
BITRATES = {3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 0: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}

PAD_TO = 64
_HEAD, _CRC, _SIDE = 4, 2, 17


class Frame(NamedTuple):
    offset: int
    length: int
    version: int
    kbit: int
    rate: int
    channels: int
    samples: int
    #: header, checksum and side information before the main data
    before: int
    crc_ok: bool | None


class Media(NamedTuple):
    frames: list[Frame]
    #: of the variable-bitrate table: frames, bytes, and the table of 100 positions; None without one
    table: tuple[int, int, bytes] | None
    tags: dict[str, str]
    #: bytes passed over before and between frames
    skipped: int


@cache
def _crc_step(byte: int) -> int:
    crc = byte << 8
    for _ in range(8):
        crc = crc << 1 ^ (0x8005 if crc & 0x8000 else 0)
    return crc & 0xFFFF


@lru_cache(maxsize=4096)  # frames of one stream often share these bytes
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ _crc_step(crc >> 8 ^ byte)
    return crc


def header(data: bytes, at: int) -> tuple[int, int, int, int, int, int, bool] | None:
    """(length, version, kbit, rate, channels, side, protected) of the layer III header at `at`, if it is one."""
    if at + _HEAD > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer, protected = b1 >> 3 & 3, b1 >> 1 & 3, not b1 & 1
    rate_index, bit_index = b2 >> 2 & 3, b2 >> 4
    if version == 1 or layer != 1 or rate_index == 3 or not 0 < bit_index < 15 or b3 & 3 == 2:
        return None
    kbit, rate, mono = BITRATES[version][bit_index - 1], RATES[version][rate_index], b3 >> 6 == 3
    length = (144 if version == 3 else 72) * kbit * 1000 // rate + (b2 >> 1 & 1)
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return length, version, kbit, rate, 1 if mono else 2, side, protected


@cache
def _lead(kbit: int) -> bytes:
    """Header, checksum and silent side information of our frames."""
    head = bytes([0xFF, 0xFA, BITRATES[3].index(kbit) + 1 << 4 | 2 << 2, 0xC4])
    side = bytes(_SIDE)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


def _room(kbit: int) -> int:
    return 144 * kbit * 1000 // 32000 - _HEAD - _CRC - _SIDE


def _frame(kbit: int, data: bytes) -> bytes:
    return _lead(kbit) + data + bytes(_room(kbit) - len(data))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of PAD_TO."""
    return data + bytes(-len(data) % PAD_TO or (0 if data else PAD_TO))


def store(payload: bytes) -> bytes:
    """The stream that holds payload (its length is kept in a tag)."""
    most = _room(320)
    full, rest = divmod(len(payload), most)
    body = [_frame(320, payload[i * most : (i + 1) * most]) for i in range(full)]
    if rest:
        body.append(_frame(next(k for k in BITRATES[3] if _room(k) >= rest), payload[full * most :]))
    size = sum(map(len, body)) + len(_frame(32, b""))
    starts, at = [], len(_frame(32, b""))
    for part in body:
        starts.append(at)
        at += len(part)
    toc = bytes(min(255, 256 * starts[i * len(starts) // 100] // size) for i in range(100)) if starts else bytes(100)
    table = b"Xing" + (15).to_bytes(4, "big") + len(body).to_bytes(4, "big") + size.to_bytes(4, "big") + toc + bytes(4)
    text = b"\x00payload\x00" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\x00\x00" + text
    return b"".join([b"ID3\x03\x00\x00", _syncsafe(len(tag)), tag, _frame(32, table), *body])


def _id3(data: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of the ID3v2 tags at the start, and their text frames (a TXXX frame by its description)."""
    at, tags = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, size = data[at + 3], sum((b & 0x7F) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        pos, end = at + 10, at + 10 + size
        if end > len(data) or max(data[at + 6 : at + 10]) > 0x7F:  # no tag after all
            break
        while pos + 10 <= end and data[pos : pos + 4].strip(b"\x00"):
            name = data[pos : pos + 4].decode("latin-1")
            raw = data[pos + 4 : pos + 8]
            length = int.from_bytes(raw, "big") if major < 4 else sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True))
            body = data[pos + 10 : min(pos + 10 + length, end)]
            if name[0] == "T" and body:
                fields = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").split("\x00")
                if name == "TXXX" and len(fields) > 1:
                    tags[fields[0]] = fields[1]
                else:
                    tags[name] = fields[0]
            pos += 10 + length
        at = end + (10 if data[at + 5] & 0x10 else 0)
    return at, tags


def read(data: bytes) -> Media:
    """Frames, table and tags of a stream; bytes that are no frame are passed over until headers follow again.

    A header counts if another one of the same version and rate, the tag at the end, or the end of the
    data follows its frame; a last frame cut short is not a frame.
    """
    at, tags = _id3(data)
    if data[-128:-125] == b"TAG":
        # such bytes may also be main data: they are a tag unless a frame that runs over them is the last
        media = _scan(data, at, len(data), tags)
        last = media.frames[-1] if media.frames else None
        if last and last.offset + last.length == len(data) and last.offset < len(data) - 128:
            return media
        end = len(data) - 128
        tags["TIT2"] = tags.get("TIT2") or data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
        return _scan(data, at, end, tags)
    return _scan(data, at, len(data), tags)


def _scan(data: bytes, at: int, end: int, tags: dict[str, str]) -> Media:
    frames: list[Frame] = []
    table, skipped = None, 0
    while at < end:
        found = header(data, at)
        if found:
            length, version, kbit, rate, channels, side, protected = found
            after = at + length
            follows = after == end or (after < end and (x := header(data, after)) and (x[1], x[3]) == (version, rate))
            if follows:
                lead = _HEAD + (_CRC if protected else 0)
                ok = crc16(data[at + 2 : at + 4] + data[at + lead : at + lead + side]).to_bytes(2, "big") == data[at + 4 : at + 6] if protected else None
                main = at + lead + side
                if not frames and table is None and data[main : main + 4] in (b"Xing", b"Info"):
                    table = _vbr(data[main:after])
                elif not frames and table is None and data[at + _HEAD + 32 : at + _HEAD + 36] == b"VBRI":
                    table = _vbri(data[at + _HEAD + 32 : after])
                else:
                    frames.append(Frame(at, length, version, kbit, rate, channels, 1152 if version == 3 else 576, lead + side, ok))
                at = after
                continue
        step = data.find(b"\xff", at + 1, end)
        step = end if step < 0 else step
        skipped += step - at
        at = step
    return Media(frames, table, tags, skipped)


def _vbr(body: bytes) -> tuple[int, int, bytes]:
    flags, at = int.from_bytes(body[4:8], "big"), 8
    frames = size = 0
    toc = b""
    if flags & 1:
        frames, at = int.from_bytes(body[at : at + 4], "big"), at + 4
    if flags & 2:
        size, at = int.from_bytes(body[at : at + 4], "big"), at + 4
    if flags & 4:
        toc = body[at : at + 100]
    return frames, size, toc


def _vbri(body: bytes) -> tuple[int, int, bytes]:
    """The other table of variable bitrates, 32 bytes after the header: frames, bytes, and its entries as they are."""
    number = lambda at, n: int.from_bytes(body[at : at + n], "big")
    entries, width = number(18, 2), number(22, 2)
    return number(14, 4), number(10, 4), body[26 : 26 + entries * width]


def payload_of(data: bytes, media: Media) -> bytes | None:
    """The payload that store() put in; None of a stream that does not say how long it is."""
    length = media.tags.get("payload", "")
    if not length.isascii() or not length.isdigit():
        return None
    return b"".join(data[f.offset + f.before : f.offset + f.length] for f in media.frames)[: int(length)]


def damaged(media: Media, payload: bytes) -> bool:
    """Whether a stream of store() is not whole: a checksum that fails, frames or payload missing.

    Bytes between frames, which reading passes over, are no damage as long as every frame is there.
    """
    counted = media.table is not None and media.table[0] != len(media.frames)
    return counted or any(f.crc_ok is False for f in media.frames) or len(payload) != int(media.tags["payload"])


def duration_us(media: Media) -> int:
    """Exact for rates that divide 1,152,000,000; else rounded down, once for all frames."""
    samples: dict[int, int] = {}
    for f in media.frames:
        samples[f.rate] = samples.get(f.rate, 0) + f.samples
    return sum(n * 1_000_000 // rate for rate, n in samples.items())


def feature(media: Media) -> str | None:
    """What the frames, the checks and the table say; None without frames."""
    if not media.frames:
        return None
    f = media.frames[0]
    checked = sum(bool(x.crc_ok) for x in media.frames)
    offsets = " ".join(str(x.offset) for x in media.frames)
    toc = zlib.crc32(media.table[2]) if media.table else 0
    return (
        f"mpeg{VERSIONS[f.version]} layer3 rate={f.rate} channels={f.channels} frames={len(media.frames)} table={media.table[0] if media.table else 0} toc={toc:08x} "
        f"kbit={min(x.kbit for x in media.frames)}-{max(x.kbit for x in media.frames)} us={duration_us(media)} crc={checked}/{len(media.frames)} skipped={media.skipped} seek={offsets}"
    )


@F.pandas_udf(T.BinaryType())
def _store(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([store(padded(t.encode("utf-8", "surrogatepass"))) for t in batch], dtype=object)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every row: the text's UTF-8 bytes, padded, as a stream.  Null texts are empty."""
    rows = keyed(docs)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _store("text").alias("media"))


_PROBE = T.StructType(
    [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
    + [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
    + [T.StructField("duration_us", T.LongType()), T.StructField("seek_offsets", T.ArrayType(T.LongType())), T.StructField("reason", T.StringType())]
)


@F.pandas_udf(_PROBE)
def _probe(streams: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in streams:
        rows = []
        for data in batch:
            if data is None:
                rows.append((*[None] * 8, "no media"))
                continue
            media = read(data)
            payload = payload_of(data, media)
            broken = payload is not None and damaged(media, payload)
            own = (None,) * 3 if payload is None or broken else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD_TO:]))
            reason = "no frames" if not media.frames else "no payload" if payload is None else "damaged" if broken else None
            rows.append((*own, len(data), hashlib.sha256(data).hexdigest(), feature(media), duration_us(media), [f.offset for f in media.frames], reason))
        yield frame(rows, _PROBE.names)


def probe(stored: DataFrame) -> DataFrame:
    """The columns of stored but media, and what reading the streams back gives.

    reason is null for streams of store(); else "no media" (null: all else is null), "no frames" (empty or foreign bytes: no
    feature, duration 0) "no payload" (another's stream of layer III) or "damaged" (a stream of store() that is not whole, see damaged()); the last two
    have no payload columns.  Bytes that are no frame are passed over.
    Layers I and II are not read.  Equal streams give equal rows, whatever their length; an empty table gives none.
    """
    rest = [c for c in stored.columns if c != "media"]
    return stored.select(*rest, _probe("media").alias("probe")).select(*rest, "probe.*")
