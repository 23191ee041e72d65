import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing

ENCODER = packing.Encoder()
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=60) | st.text("a 'st\n\t<|>é1.", max_size=40))
def test_ids_are_those_of_the_tokenizer(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)[:-1]


def test_special_token_text():
    text = "a <|endoftext|> b"
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)[:-1] and 50256 in ids_of(text)


def check(rows, docs):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.tkey].append(r)
        sequences[r.sequence_id].append(r)
    for seq in sequences.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t in docs)
    return pieces, sequences


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    rows = packing.pack(df).collect()
    pieces, sequences = check(rows, docs)
    by_id = {d: sorted(v, key=lambda r: r.piece) for (d, _), v in pieces.items()}
    for doc_id, text in docs:
        ids, at = np.array(ids_of(text), dtype="<u4"), 0
        for i, r in enumerate(by_id[doc_id]):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == 2048 or i == 0
            at += r.length
        assert at == len(ids) and len(by_id[doc_id]) == -(-len(ids) // 2048)
    assert len(sequences) <= 1.02 * sum(len(ids_of(t)) for _, t in docs) / 2048 + 1


def test_edge_rows(spark):
    docs = [(None, None), (None, None), (1, ""), (2, "x " * 9000), (2, "x"), (2, "x")]
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, piece int, length int")
    rows = packing.pack(df).collect()
    check(rows, docs)
    assert sorted(r.length for r in rows if r.doc_id is None) == [1, 1]
    assert packing.pack(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_covers_every_piece(lengths):
    counts = np.bincount(np.array(lengths, dtype=int), minlength=65)
    plan = packing.plan_bins(counts, 64)
    got = np.zeros(65, dtype=int)
    for times, bin_ in plan:
        assert sum(bin_) <= 64 and times > 0
        for n in bin_:
            got[n] += times
    assert (got == counts).all()
    bins = sum(t for t, _ in plan)
    assert bins <= 11 / 9 * -(-sum(lengths) // 64) + len(lengths) * 0 + 4 or bins <= len(lengths)


def test_pair_replaces_the_smallest():
    # 60 + 35 leaves 5 open; 25 and 15 fill 40 exactly
    counts = np.zeros(101, dtype=int)
    counts[[60, 35, 25, 15]] = 1
    assert packing.plan_bins(counts, 100)[0] == (1, [60, 25, 15])
