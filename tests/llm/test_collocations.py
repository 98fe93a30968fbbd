import random
import re
from collections import Counter

import pytest

from gridloom.llm import collocations as co
from gridloom.llm import word_arrays


def by_definition(rows, longest=3, least=10, top=2000, within=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    frequent = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in frequent.items():
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(
            g == lang and len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in frequent.items()
        )
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    rank, done = Counter(), []
    for lang, score, a, phrase, l, r, all_words in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            done.append((lang, rank[lang], phrase.decode(), -a, l, r, all_words, -score))
    return done


def texts(seed, size=300):
    rng = random.Random(seed)
    words = ["The", "the", "of", "new", "York", "Äpfel", "äpfel", "x-y", "a\x00b", "漢字", "to", "be", "or", "not"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "de", None, ""])) for _ in range(size)]
    return [*rows, *[("to be or not to be " * 9, "en")] * 4, (None, "en"), ("", "de"), (" \t ", "fr"), ("...", "en"), ("alone", "nl")]


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (2, 3, 5), (4, 5, 40)])
def test_same_as_the_definition(spark, monkeypatch, longest, least, top):
    monkeypatch.setattr(co, "RUN_BYTES", 2000)
    rows = texts(longest)
    docs = spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, lang string, n int")
    got = [tuple(r) for r in co.collocations(docs.repartition(3), longest, least, top).collect()]
    assert sorted(got) == sorted(by_definition(rows, longest, least, top))
    assert got


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    rows = texts(9)
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(word_arrays, "LEAST_BITS", 15)
    monkeypatch.setattr(co, "bitmap", lambda *a: word_arrays.bitmap(*a, most_bits=15))
    monkeypatch.setattr(word_arrays.Bitmap, "has", lambda self, values: values == values)
    assert sorted(tuple(r) for r in co.collocations(docs).collect()) == sorted(by_definition(rows))


def test_bitmap_misses_no_member(spark):
    words = spark.range(5000).selectExpr("'en' AS lang", "concat('w', id) AS phrase")
    known = word_arrays.bitmap(words, co._members, 5000)
    import numpy as np
    import pyarrow as pa

    word = lambda names: word_arrays.chained(np.repeat(word_arrays.hashes(pa.array([b"en"])), len(names)), word_arrays.hashes(pa.array(names)))
    assert known.has(word([f"w{i}".encode() for i in range(5000)])).all()
    assert known.has(word([f"other{i}".encode() for i in range(5000)])).mean() < 0.02


def test_one_language_and_one_phrase_hold_nearly_all(spark):
    rows = [("so it is " * 400, "en")] * 30 + [("ein haus am see " * 12, "de")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in co.collocations(docs).collect()) == sorted(by_definition(rows))


def test_large_counts_are_exact(spark):
    big = 3_000_000_007
    level = lambda rows: spark.createDataFrame([("en", p, f) for p, f in rows], "lang string, phrase string, f long")
    got = co.scored([level([("a", big + 11), ("b", big + 2), (None, 1)]), level([("a b", big)])]).collect()
    assert [tuple(r) for r in got] == [("en", "a b", big, big + 11, big + 2, 1_000_000 * big * big // ((big + 11) * (big + 2)))]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(docs).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0
