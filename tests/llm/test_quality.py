import math
import random
from collections import Counter, defaultdict

from gridloom.llm import quality as q


def brute_model(texts):
    """Interpolated modified Kneser-Ney by definition, one language; returns p(char | history)."""
    grams = {q.ORDER: Counter()}
    for t in texts:
        s = "￿" * (q.ORDER - 1) + t
        for i in range(q.ORDER - 1, len(s)):
            grams[q.ORDER][s[i - q.ORDER + 1 : i + 1]] += 1
    for k in range(q.ORDER - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cuts = {}
    for k, g in grams.items():
        c = [sum(n == j for n in g.values()) for j in range(1, 5)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] + 2 * c[1] else 0.5
        cuts[k] = [min(max(j + 1 - (j + 2) * y * c[j + 1] / c[j], 0.05), 0.95 * (j + 1)) if c[j] else 0.5 * (j + 1) for j in range(3)]
    total, mass = defaultdict(int), defaultdict(float)
    for k, g in grams.items():
        for x, n in g.items():
            total[k, x[:-1]] += n
            mass[k, x[:-1]] += cuts[k][min(n, 3) - 1]

    def p(char, history, k):
        if k == 0:
            return 1 / (len(grams[1]) + 1)
        h = history[len(history) - k + 1 :] if k > 1 else ""
        if (k, h) not in total:
            return p(char, history, k - 1)
        n = grams[k].get(h + char, 0)
        own = (n - cuts[k][min(n, 3) - 1]) / total[k, h] if n else 0
        return own + mass[k, h] / total[k, h] * p(char, history, k - 1)

    return p


def make(seed=0):
    rng = random.Random(seed)
    syllables = ["the", "an", "re", "on", "ti", "er", "é", "st", " ", " ", "\n", "🙂"]
    docs, labels = [], []
    for i in range(80):
        lang = ["en", "fr", None][i % 3]
        t = "".join(rng.choices(syllables, k=rng.randrange(1, 60)))
        good = i % 5 > 0
        docs.append((i, t if good else "%#&".join(t), lang))
        if i % 2:
            labels.append((i, int(good)))
    return docs + [(100, None, "en"), (101, "", "fr"), (102, "x", "de"), (None, "the an", "en"), (3, docs[3][1], docs[3][2])], labels


def test_perplexity_matches_definition(spark):
    docs, labels = make()
    trusted = {i for i, y in labels if y}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as logp", "2 as keep")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    whole = q.judge(spark, df, lab).collect()
    assert len(whole) == len(docs)
    models, means = {}, {}
    for lang in ("en", "fr", ""):
        good = [t or "" for i, t, x in docs if (x or "") == lang and i in trusted]
        p = models[lang] = brute_model(good)
        logs = lambda t: sum(math.log(p(c, ("￿" * 3 + t)[: k + 3], 4)) for k, c in enumerate(t))  # noqa: B023, E731
        means[lang] = -sum(map(logs, good)) / sum(map(len, good))
        got = sorted(r.perplexity for r in whole if r.lang == lang)
        want = sorted(math.exp((-logs(t or "") + q.WEIGHT * means[lang]) / (len(t or "") + q.WEIGHT)) for i, t, x in docs if (x or "") == lang)
        assert all(abs(a - b) < 1e-6 * b for a, b in zip(got, want)), lang
    assert [r for r in whole if r.lang == "de"][0].keep
    # cut into shards, the model says the same
    parts = {(r.doc_id, r.text_hash): r.perplexity for r in q.judge(spark, df, lab, shard_rows=150).collect()}
    assert all(abs((parts[r.doc_id, r.text_hash] or 0) - (r.perplexity or 0)) < 1e-9 for r in whole)


def test_nothing_trusted_and_empty(spark):
    docs = spark.createDataFrame(make()[0], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.keep for r in q.judge(spark, docs, none).collect())
    assert q.judge(spark, docs.limit(0), none).count() == 0


def test_clean_stays_and_junk_goes(spark, sf):
    got = q.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r.keep for r in got if r.quality == 1]
    junk = [r.keep for r in got if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.5 * len(junk)
