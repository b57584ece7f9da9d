from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridledger.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def plain_best_fit(lengths, capacity):
    """Number of sequences when every piece, longest first, goes to the tightest that holds it, by looking at all."""
    room = []
    for need in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= need]
        if fits:
            room[min(fits)[1]] -= need
        else:
            room.append(capacity - need)
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_best_fit_against_looking_at_all(case):
    capacity, lengths = case
    sequence, offset, room = packing.best_fit(np.array(lengths, np.int64), capacity)
    assert sorted(room.tolist()) == plain_best_fit(lengths, capacity)
    at = {}
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths, strict=True)):
        assert at.get(s, 0) == o
        at[s] = o + n
    assert all(v == capacity - room[s] for s, v in at.items())


def test_encoder_equals_whole_texts(spark, tokenizer):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    texts += ["", " ", "'s't'VE 'LL we're", "it''s 'sun' ''''s", "a_b-c--d!!e", "1²¾ 12,34", "İstanbul ΣΑΣ", "été É", "a\x1cb\x85c\xa0d",
              "<|endoftext|> x", "a<|startoftext|>b < >", "日本語 テスト", "ß ſ ŉ Ÿ µ ª", "x" * 5000, "\t\n mixed\r\n", "“quoted” — it’s", "\x00\x01"]
    encoder = packing.Encoder(packing.default_tokenizer(), remembered=500)
    assert encoder.cut
    for at in range(0, len(texts), 50):
        for text, got in zip(texts[at:at + 50], encoder.batch(texts[at:at + 50]), strict=True):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def check(tokenizer, docs, got, capacity):
    """Pieces are those of the texts; sequences are gapless and within capacity."""
    want = []
    for doc_id, text in docs:
        ids = ids_of(tokenizer, text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            want.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values(), default=0) <= capacity
    return fill


def test_query_against_whole_packing(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.op11(spark, FOLDER).collect()
    fill = check(tokenizer, docs, got, packing.CAPACITY)
    assert len(fill) == len(plain_best_fit([r.length for r in got], packing.CAPACITY))


def test_groups_and_rounds_lose_next_to_nothing(spark):
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 4096).tolist()
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(7)
    from gridledger.llm import common
    got = packing.pack(common.checkpointed(rows), group=500).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    least = len(plain_best_fit(lengths, 4096))
    assert max(fill.values()) <= 4096 and len(fill) <= 1.002 * least + 1


def test_edges(spark, tokenizer):
    rows = [(None, None, 1), (None, "", 2), (1, "same words here", 3), (1, "same words here", 3), (2, "long word " * 400, 4), (3, "\t \n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    found = packing.pieces(df, ["doc_id", "piece"], capacity=64)
    assert found.columns == ["doc_id", "piece", "_piece", "start", "length", "ids_crc32"]
    got = packing.pack(found.drop("piece").withColumnRenamed("_piece", "piece"), capacity=64).collect()
    check(tokenizer, [(r[0], r[1]) for r in rows], got, 64)
    assert packing.pack(packing.pieces(df.limit(0), ["doc_id"])).count() == 0


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = [f"text number {i} " * (i % 40) for i in range(60)] + [None]
    df = spark.createDataFrame([(t,) for t in docs], "text string")
    want = sorted(tuple(ids_of(tokenizer, t)) for t in docs)
    got = []
    for r in packing.sequences(df).collect():
        assert len(r.ids) <= packing.CAPACITY
        cuts = [*r.starts, len(r.ids)]
        got += [tuple(r.ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert sorted(got) == want
