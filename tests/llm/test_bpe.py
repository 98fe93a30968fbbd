import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from gridloom.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")))


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={}).encode_ordinary


def odd_texts():
    rng = random.Random(1)
    some = ["".join(rng.choice("abeth  \n\t\xa0ABé漢字🙂0123456789's!!--²") for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*some, "", " ", "a" * 300, " " * 500, "the" * 200, "end ", "\nline\r\n x", "<|endoftext|>"]


def test_same_ids_as_the_library(vocabulary, reference):
    encoder = bpe.TextEncoder(vocabulary, P.PATTERN)
    for text in odd_texts() * 2:
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference(text), text
        assert bpe.decode_ids(vocabulary.bytes, ids) == text.encode()


def test_append_and_splice_are_exact(vocabulary):
    rng = random.Random(2)
    for _ in range(60):
        data = bytearray(rng.choices(b" theandingrsa,", k=30))
        encoder = bpe.PrefixEncoder(vocabulary, bytes(data[:11])).append(bytes(data[11:]))
        assert encoder.tokens() == bpe.PrefixEncoder(vocabulary, bytes(data)).tokens()
        at, end = sorted(rng.sample(range(31), 2))
        data[at:end] = b"enth"
        assert encoder.splice(at, end, b"enth").tokens() == bpe.PrefixEncoder(vocabulary, bytes(data)).tokens()


def test_frames(spark, reference):
    rows = [(1, None, 5), (2, "", 5), (3, "The end of it.", 5), (3, "The end of it.", 5), (None, "x  y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.roundtrip(spark, docs).collect())
    want = []
    for i, t, _ in rows:
        ids = reference(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.roundtrip(spark, docs.limit(0)).count() == 0


def test_one_python_pass(spark, vocabulary):
    """Each pass over the rows has a Python process for each running task, with a vocabulary of its own."""
    rows = [(1, None, "x", "y", 0), (2, "", "x", "y", 0), (3, "The end of it, é 漢.", None, "y", 0), (3, "a" * 300, "x", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for out in (bpe.roundtrip(spark, docs.select("doc_id", "text")), bpe.stage(spark, docs, "")):
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert bpe.stage(spark, docs, "").where("round_trip").count() == len(rows)

    shared = spark.sparkContext.broadcast(vocabulary)
    both = bpe.encode(docs, shared, P.PATTERN, decoded="decoded")
    apart = bpe.decode(bpe.encode(docs, shared, P.PATTERN), shared)
    assert both.columns == apart.columns and sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))


def test_many_and_very_long_texts_together(vocabulary, reference):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéßн漢") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    some = [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(60)]
    some += ["x" * 30_000, "ab" * 40_000 + " end", ("word " * 50_000).strip(), "\n\n".join(words) + "  two", "a\nb \nc"]
    encoder = bpe.TextEncoder(vocabulary, P.PATTERN)
    for part in (some[:40], some[20:], some):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(part)] == [reference(t) for t in part]


def test_memories_are_emptied(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_STRETCHES", 20)
    monkeypatch.setattr(bpe, "CACHE_MATCHES", 3)
    encoder = bpe.TextEncoder(vocabulary, P.PATTERN)
    for text in [*odd_texts()[:60], *(f"qz{k}zq wq{k % 7}wq" for k in range(60))]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference(text)
        assert len(encoder.stretches) <= 20 and len(encoder.matches) <= 3


def test_prefixes_together_are_those_of_one(vocabulary):
    rng = random.Random(4)
    pieces = [bytes(rng.choices(b" theandingrsaxQ\xc3\xa9", k=rng.randrange(1, 40))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary.tables.encode(pieces)] == [bpe.PrefixEncoder(vocabulary, p).tokens() for p in pieces]


def test_a_token_that_no_merge_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    own = bpe.Vocabulary(ranks)
    assert own.unreached == {b"xyz"}
    encoder = bpe.TextEncoder(own, P.PATTERN)
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for text in ("xyz", "xyzab", "ab xyz", "abab"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(text)
