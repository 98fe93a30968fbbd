import random
import re

import public_tokenizers as P
import pytest
import regex
from tokenizers import Tokenizer

from gridloom.llm import token_counts as tc


@pytest.fixture(scope="module")
def counter():
    return tc.TokenCounter(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_proved_strings_are_single_tokens(counter, library):
    whole = sorted(counter.whole)
    # alone, without the pattern: the library's model itself
    assert all(len(library.model.tokenize("".join(tc.byte_letters()[b] for b in w.encode()))) == 1 for w in whole[::7])
    assert " the" in counter.whole and len(whole) > 49_000


def test_strings_left_unproved_take_several_tokens_or_are_no_text(counter, library):
    value = {c: b for b, c in enumerate(tc.byte_letters())}
    for string in library.get_vocab(with_added_tokens=False):
        data = bytes(value[c] for c in string)
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        if text not in counter.whole:
            assert len(library.model.tokenize(string)) > 1


def test_engine_and_library_cut_agreed_characters_alike(library):
    agreed, pieces, cut = re.compile(f"[{tc.AGREED}]"), library.pre_tokenizer.pre_tokenize_str, regex.compile(P.PATTERN).finditer
    own = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and agreed.match(c)]
    assert len(own) > 30_000
    for k in range(0, len(own), 64):
        text = "".join(f"a{c}1!{c}? {c}\n" for c in own[k : k + 64])
        assert [x[1] for x in pieces(text)] == [m.span() for m in cut(text)]


def test_same_counts_as_the_library(counter, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "eth", " ", "  ", "\n", "\xa0", "é", "漢字", "🙂", "\U0001fae0", "՘", "7", "'s", "!!", "--", "²", "<|endoftext|>", "<|end"]) for _ in range(rng.randrange(80))) for _ in range(1500)]
    assert tc.TextCounter(counter, P.PATTERN).count_all(texts) == wanted(library, texts)


@pytest.mark.parametrize("room", [0, 3, 500_000])
def test_very_long_texts_and_small_memories(counter, library, monkeypatch, room):
    monkeypatch.setattr(tc, "RUN_CHARS", 1000)
    monkeypatch.setattr(tc, "CACHE_PIECES", room)
    texts = ["the end's 12 of  it\n\n" * 700, "a" * 30_000, "ab" * 5000 + "<|endoftext|>" * 3, " " * 5000, "漢字かな" * 900, "x" * 47 + " " + "y" * 48 + " " + "z" * 49, "", "<|endoftext|>"]
    assert tc.TextCounter(counter, P.PATTERN).count_all(texts) == wanted(library, texts)


def test_frames(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "The end of it, é.", 5), (3, "The end of it, é.", 5), (None, "x  y" * 600, None), (4, "word " * 512, 1), (5, "word " * 510, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in tc.token_counts(docs).collect()), key=str)
    sizes = wanted(library, [t for _, t, _ in rows])
    assert got == sorted(((i, len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, sizes)), key=str)
    assert {r[3] for r in got} == {True, False}
    assert tc.token_counts(docs.limit(0)).count() == 0


def test_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in tc.op12_token_counts(spark, sf).collect()}
    assert got == dict(zip([d.doc_id for d in docs], wanted(library, [d.text for d in docs])))


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    with pytest.raises(ValueError):
        tc.TokenCounter(P.path("word_bpe_49k.json"))
