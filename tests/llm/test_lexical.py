import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_definition(docs, items, top=20):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    N, L = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(found)[:top], start=1)]
    return out


def corpus(seed, size=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Äpfel", "漢字", "x-1", "The"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(80)))) for k in range(size)]
    docs += [(None, "w1 w2 w3"), (None, "W1"), (7, docs[8][1]), (8, docs[8][1]), (size, None), (size + 1, ""), (size + 2, " .-! "), (size + 3, "w0 " * 5000)]
    docs += [(1000 + k, "w9 w30 w31 w32") for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(25)]
    return docs, [*items, (3, "w0 w0 w1"), (30, None), (31, "..."), (32, "unknown"), (33, "w0"), (34, "w9 w30 w31"), (None, "w1 the")]


def ranked(spark, docs, items, top=20):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in ls.rank_documents(d, q, top).collect()), key=str)


@pytest.mark.parametrize("shard", [300, 5000, 1 << 24])
def test_same_as_the_definition(spark, monkeypatch, shard):
    monkeypatch.setattr(ls, "SHARD_BYTES", shard)
    monkeypatch.setattr(ls, "FIRST", 4)
    docs, items = corpus(shard)
    assert ranked(spark, docs, items) == sorted(by_definition(docs, items), key=str)


def test_items_in_several_passes_and_other_tops(spark, monkeypatch):
    docs, items = corpus(5)
    monkeypatch.setattr(ls, "ITEMS", 7)
    assert ranked(spark, docs, items, 3) == sorted(by_definition(docs, items, 3), key=str)


def least_cost(values, longest, cost):
    best = [0]
    for j in range(1, len(values) + 1):
        best.append(min(best[j - w] + int(values[j - w : j].max()) * w + cost for w in range(1, min(longest, j) + 1)))
    return best[-1]


@pytest.mark.parametrize(("longest", "cost"), [(5, 30), (64, 200), (1, 3), (300, 1000)])
def test_blocks_have_the_least_bound_error(monkeypatch, longest, cost):
    monkeypatch.setattr(ls, "CELLS", 100)
    rng = np.random.default_rng(1)
    begins = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 20))])
    values = rng.integers(1, 100, begins[-1])
    starts = ls.block_starts(values, begins, longest, cost)
    for a, b in zip(begins, begins[1:]):
        own = [s for s in starts if a <= s < b] + [b]
        sizes = np.diff(own)
        assert not len(sizes) or own[0] == a and sizes.max() <= longest
        assert sum(int(values[s:e].max()) * (e - s) + cost for s, e in zip(own, own[1:])) == least_cost(values[a:b], longest, cost)


def test_blocks_that_cannot_reach_the_threshold_stay_closed(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(20, 400)))) for k in range(6000)]
    docs += [(10_000 + k, "w5 w6 w7 w8 w9 " * 6) for k in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    parts = ls.shards(d)
    documents, words, df = ls.statistics(parts)
    weight = {r.term: r.w for r in ls.weights(df, documents).collect()}
    rows = ls.index(parts, documents, words).toArrow().to_batches()
    searcher = ls.Searcher([(0, [(f"w{k}", weight[f"w{k}"]) for k in range(5, 10)])], 20)
    for batch in rows:
        for k in range(batch.num_rows):
            ids, found, *arrays = (batch.column(c)[k].values for c in range(1, 8))
            searcher.read(ids, found, *(a.to_numpy().astype(np.int64) for a in arrays))
    assert searcher.best[0][1].tolist() == list(range(10_000, 10_020))
    assert searcher.opened < searcher.held / 5


def test_empty_tables(spark):
    docs, items = corpus(6, 20)
    assert ranked(spark, [], items) == ranked(spark, docs, []) == ranked(spark, [(1, None)], items) == []
