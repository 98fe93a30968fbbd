import hashlib
import random
from collections import defaultdict

import pandas as pd
import pytest

from gridloom.llm import mixing as mx


def brute(cells, targets, budget):
    """Raking by dictionaries, and the common scale by bisection."""
    total = sum(cells.values())
    w = dict(cells)
    for _ in range(400):
        for k in range(3):
            have, names = defaultdict(float), {c[k] for c in cells}
            for c, x in w.items():
                have[c[k]] += x
            norm = sum(targets[k].get(n, 0) for n in names)
            w = {c: x * (targets[k].get(c[k], 0) / norm * total / have[c[k]] if have[c[k]] else 0) for c, x in w.items()}
    f = {c: w[c] / cells[c] for c in cells}
    low, high = 0.0, 1e9
    for _ in range(300):
        s = (low + high) / 2
        if sum(cells[c] * min(1, s * f[c]) for c in cells) < budget * total:
            low = s
        else:
            high = s
    return {c: min(1, high * f[c]) for c in cells}


def make(n=1500, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["hot", "a", "b", None], [60, 20, 10, 10])[0]
        lang = rng.choices(["en", "fr", None], [7, 2, 1])[0]
        form = rng.choice(["word " * 10, "word " * 300, "a | b | c", "BIG!! WORDS!! ", "a License here"])
        rows.append((i, form * rng.randrange(1, 4), lang, source))
    return [*rows, (5, rows[5][1], rows[5][2], rows[5][3]), (None, "no id", "en", "a"), (None, None, "en", "a"), (9999, "", None, None)]


def cells_of(rows_out):
    cells = defaultdict(float)
    for r in rows_out:
        cells[r.source or "", r.lang or "", r.mix_topic] += r.mix_tokens
    return dict(cells)


def check(spark, monkeypatch, targets, here):
    if not here:
        monkeypatch.setattr(mx, "DRIVER_CELLS", 0)
        monkeypatch.setattr(mx, "SWEEPS", 40)
    rows = make()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as kept", "2 as tokens", "3 as topic")
    got = mx.mix(spark, df, targets, budget=0.6).collect()
    assert len(got) == len(rows)
    cells = cells_of(got)
    margins = [{c[k] for c in cells} for k in range(3)]
    goals = []
    for k, m in enumerate(mx.MARGINS):
        own = {x: sum(v for c, v in cells.items() if c[k] == x) ** mx.TEMPER for x in margins[k]}
        goals.append((targets or {}).get(m, own))
    want = brute(cells, goals, 0.6)
    for r in got:
        assert abs(r.probability - want[r.source or "", r.lang or "", r.mix_topic]) < 1e-5
        if r.doc_id is not None:
            u = int(hashlib.md5(f"{mx.SEED}:{r.doc_id}".encode()).hexdigest()[:12], 16) / (1 << 48)
            assert r.kept == (u < r.probability)
    share = sum(r.mix_tokens * r.probability for r in got) / sum(r.mix_tokens for r in got)
    assert abs(share - 0.6) < 1e-6


def test_driver_path(spark, monkeypatch):
    check(spark, monkeypatch, None, True)
    check(spark, monkeypatch, {"source": {"hot": 0.2, "a": 0.5, "b": 0.3, "gone": 1.0}, "lang": {"en": 0.5, "fr": 0.4, "": 0.1}}, True)


def test_cluster_path_agrees(spark, monkeypatch):
    check(spark, monkeypatch, None, False)


def test_empty(spark):
    assert mx.mix(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_contradicting_margins_warn():
    cells = pd.DataFrame({"source": ["a", "b"], "lang": ["en", "fr"], "topic": ["x", "x"], "tokens": [50, 50]})
    goals = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "fr": 0.9}, "topic": {"x": 1.0}}
    with pytest.warns(UserWarning, match="margins still differ"):
        p = mx._rake_here(cells, goals, 0.5)
    assert abs(50 * p.sum() - 50) < 1e-9


def test_topic_is_the_form(spark):
    rows = [("",), (None,), ("word " * 10,), ("word " * 300,), ("word " * 900,), ("12 | 34 | 56",)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(mx.topic_of()).collect()]
    assert got == ["short", "short", "short", "medium", "long", "listing"]
