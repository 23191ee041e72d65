import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mpeg_audio as ma
from millrace.llm.queries import queries


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=5000), st.binary(max_size=40).filter(lambda b: b"\xff" not in b))
def test_round_trip_and_resynchronisation(data, junk):
    payload = ma.padded(data)
    stream = ma.store(payload)
    media = ma.read(stream)
    assert ma.payload_of(stream, media) == payload and media.skipped == 0 and all(f.crc_ok for f in media.frames)
    assert media.table[0] == len(media.frames) and ma.duration_us(media) == 36000 * len(media.frames)
    for f in media.frames:
        assert ma.header(stream, f.offset)[0] == f.length
    # bytes between tag and frames, and a tag at the end, are passed over
    at, _ = ma._id3(stream)
    moved = stream[:at] + junk + stream[at:] + b"TAG" + bytes(125)
    again = ma.read(moved)
    assert again.skipped == len(junk) and ma.payload_of(moved, again) == payload


def test_checksum_and_damage():
    stream = bytearray(ma.store(ma.padded(b"x" * 9000)))
    frames = ma.read(bytes(stream)).frames
    stream[frames[2].offset + 10] ^= 1
    assert [f.crc_ok for f in ma.read(bytes(stream)).frames] == [True, True, False] + [True] * (len(frames) - 3)
    del stream[frames[3].offset : frames[3].offset + 5]
    assert len(ma.read(bytes(stream)).frames) == len(frames) - 2  # the torn frame and the one before it, which nothing follows
    assert ma.crc16(b"123456789") == 0xAEE7
    assert ma.read(b"").frames == [] and ma.read(b"no audio \xff\xfb").skipped == 11


def test_headers_of_other_streams():
    assert ma.header(bytes([0xFF, 0xFB, 0x90, 0x00]), 0) == (417, 3, 128, 44100, 2, 32, False)
    assert ma.header(bytes([0xFF, 0xFB, 0x92, 0x00]), 0)[0] == 418
    assert ma.header(bytes([0xFF, 0xF3, 0x80, 0xC0]), 0) == (208, 2, 64, 22050, 1, 9, False)
    assert ma.header(bytes([0xFF, 0xFD, 0x90, 0x00]), 0) is None


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries()["op5_mpeg_audio"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        data, r = ma.padded(d.text.encode()), rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(d.text.encode()), len(data), hashlib.sha256(data).hexdigest())
        assert r.tail_crc32 == zlib.crc32(data[-64:]) and r.media_bytes > len(data) and "skipped=0" in r.feature


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None, b""), (1, "", b""), (1, "", b""), (2, "é" * 100000, b"")], "doc_id long, text string, media binary")
    rows = ma.probe(ma.store_texts(df)).collect()
    assert sorted(r.payload_bytes for r in rows) == [64, 64, 64, 200000]
    assert len({r.media_sha256 for r in rows}) == 2 and ma.probe(ma.store_texts(df.limit(0))).collect() == []


def test_tag_marks_within_the_payload_are_no_tag():
    for n in (*range(64, 129), 960, 1417, 1418, 1500, 2900, 4000):
        stream = bytearray(ma.store(ma.padded(b"x" * n)))
        payload = bytearray(ma.padded(b"x" * n))
        plain = ma.read(bytes(stream))
        last = plain.frames[-1]
        at = len(stream) - 128 - last.offset - last.before
        if at < 0 or at + 3 > last.length - last.before:
            continue
        at += sum(f.length - f.before for f in plain.frames[:-1])
        if at + 3 > len(payload):
            continue
        payload[at : at + 3] = b"TAG"
        stream = ma.store(bytes(payload))
        assert stream[-128:-125] == b"TAG"
        media = ma.read(stream)
        assert media.frames == plain.frames and "TIT2" not in media.tags and ma.payload_of(stream, media) == payload
        # a real tag after it is still one
        tagged = stream + b"TAG" + b"title".ljust(125, b"\0")
        media = ma.read(tagged)
        assert media.frames == plain.frames and media.tags["TIT2"] == "title" and ma.payload_of(tagged, media) == payload
    text = b"x" * 29 + b"TAG" + b"x" * 60
    stream = ma.store(ma.padded(text))
    assert ma.payload_of(stream, ma.read(stream)) == ma.padded(text) and ma.feature(ma.read(stream))


def test_foreign_empty_null_and_damaged_media(spark):
    own = ma.store(ma.padded(b"abc" * 900))
    plain = b"".join(own[f.offset : f.offset + f.length] for f in ma.read(own).frames)  # frames without tags
    rows = [(1, None), (2, b""), (3, b"no audio at all" * 50), (4, plain), (5, own[:300] + b"\x00" * 9 + own[300:]), (6, own)]
    out = {r.doc_id: r for r in ma.probe(spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, m in rows], "doc_id long, media binary")).collect()}
    assert [out[i].reason for i in range(1, 7)] == ["no media", "no frames", "no frames", "no payload", "damaged", None]  # a frame is lost in the fifth
    assert out[2].feature is None and out[2].duration_us == 0 and out[4].feature and out[4].payload_sha256 is None and out[6].payload_bytes == 2752


def test_vbri_table():
    body = b"VBRI" + bytes([0, 1, 0, 0, 0, 75]) + (5000).to_bytes(4, "big") + (12).to_bytes(4, "big") + (3).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (4).to_bytes(2, "big") + b"aabbcc"
    assert ma._vbri(body) == (12, 5000, b"aabbcc")


def test_damaged_streams_have_no_payload(spark):
    """A header overwritten, a checksum that fails, the end cut off, bytes between frames."""
    data = ma.store(ma.padded(b"x" * 47_000))
    frames = ma.read(data).frames
    at = frames[5].offset
    cases = [data, data[:at] + b"\0\0\0\0" + data[at + 4 :], data[: at + 8] + bytes([data[at + 8] ^ 1]) + data[at + 9 :], data[: frames[-1].offset], data[:at] + b"junk" + data[at:]]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "doc_id long, media binary")
    got = {r.doc_id: (r.reason, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in ma.probe(df).collect()}
    assert got[0][0] is None and got[0][1] == len(ma.padded(b"x" * 47_000))
    assert all(got[i] == ("damaged", None, None, None) for i in range(1, 5))
