"""Byte-level BPE against the tiktoken library and a plain merge loop."""

import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from quadrille.llm import bpe
from quadrille.llm.bpe import Encoder, decode_documents, encode_documents, merge, read_ranks
from quadrille.llm.queries import op12_bpe

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        got = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if got is None:
            return [ranks[p] for p in parts]
        parts[got[1] : got[1] + 2] = [parts[got[1]] + parts[got[1] + 1]]


def test_random_vocabularies_in_any_rank_order():
    rng = random.Random(1)
    for _ in range(300):
        tokens = {bytes([b]) for b in range(97, 101)}
        while len(tokens) < 40:
            tokens.add(bytes(rng.randrange(97, 101) for _ in range(rng.randrange(2, 6))))
        order = sorted(tokens)
        rng.shuffle(order)  # a joined pair may have a lower rank than the pairs it came from
        ranks = {t: i * rng.choice((1, 7, 300)) * 1000 + i for i, t in enumerate(order)}
        piece = bytes(rng.choice((97, 97, 98, 99, 100)) for _ in range(rng.randrange(0, 60)))
        assert merge(piece, ranks) == plain_merge(piece, ranks)


TEXTS = [
    "", " ", "\n\n  x", "Hello, world's  end\t\t 12345!!", "I'll don't 'S 'RE", "é ñ ü   x\u0085y", "漢字かな交じり文" * 50, "🙂🙂 zwj👩‍👩‍👧", "<|endoftext|>",
    "a" * 3000, "ab" * 5000, "x" * 400 + " " + "9" * 700, "\x00\x01\x1c \x1f\x7f", "  lead and trail  ", "٣٤٥ ⅷ ²",
]


def test_equals_the_library(ranks, library):
    encoder = Encoder(ranks, PATTERN)
    rng = random.Random(2)
    texts = TEXTS + ["".join(chr(rng.choice((32, 32, 10, 65, 97, 98, 101, 116, 48, 33, 39, 233, 0x4E00, 0x1F642))) for _ in range(rng.randrange(400))) for _ in range(200)]
    for text in texts:
        assert [i for some in encoder.ids(text) for i in some] == library.encode_ordinary(text)


def test_long_texts_are_cut_without_a_trace(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 11)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = Encoder(ranks, PATTERN)
    for text in [*TEXTS, "a  b \n c's\t\t d" * 40, "x1" * 200, " \n" * 90 + "end"]:
        assert [i for some in encoder.ids(text) for i in some] == library.encode_ordinary(text)


def test_one_very_long_pre_token(ranks, library):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgt") for _ in range(60_000))
    assert merge(text.encode(), ranks) == library.encode_ordinary(text)


def test_round_trip_and_edges(spark, edge_docs, ranks, library):
    coded = encode_documents(edge_docs, ranks, PATTERN)
    assert coded.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    rows = decode_documents(coded, ranks).collect()
    key = lambda x: (str(x[0]), x[1] or "")
    want = sorted(((r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()), key=key)
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in rows), key=key) == [(d, t or "") for d, t in want]
    for r in rows:
        assert r.ids == library.encode_ordinary(bytes(r.decoded).decode())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decode_documents(encode_documents(empty, ranks, PATTERN), ranks).count() == 0
    assert decode_documents(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), ranks).where("length(decoded) = 0").count() == 2
    with pytest.raises(ValueError):
        Encoder({b"a": 0}, PATTERN)


def test_query_digests(spark, tmp_path, library):
    texts = [(i, t) for i, t in enumerate([*TEXTS, None]) if "\x00" not in (t or "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op12_bpe(spark, str(tmp_path)).collect()}
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_short_pre_tokens_are_merged_on_a_plain_list(ranks, monkeypatch):
    rng = random.Random(5)
    pieces = [bytes(rng.choices(b"etaoinshr ", k=rng.randint(1, 12))) for _ in range(4000)] + [bytes(rng.choices(b"ab\xc3\xa9", k=n)) for n in range(60, 70)]
    took, ids = {}, {}
    for most in (0, bpe.SHORT_BYTES):
        monkeypatch.setattr(bpe, "SHORT_BYTES", most)
        began = time.process_time()
        ids[most] = [merge(p, ranks) for p in pieces]
        took[most] = time.process_time() - began
    assert ids[0] == ids[bpe.SHORT_BYTES] and ids[0][:500] == [plain_merge(p, ranks) for p in pieces[:500]] and ids[0][-10:] == [plain_merge(p, ranks) for p in pieces[-10:]]
    assert took[bpe.SHORT_BYTES] < 0.8 * took[0]
