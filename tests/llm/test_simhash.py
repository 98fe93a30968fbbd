import random

import numpy as np
import xxhash

from gridloom.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def brute(rows):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted((-1 if d is None else d, f"{prints[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows))


def test_matches_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}É" for i in range(300)]
    rows = []
    for i in range(60):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 4, 60, 400]))
        rows.append((1000 - i, " ".join(base)))
        for k in range(rng.randrange(3)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((2000 + 10 * i + k, "\t".join(near).upper().replace("É", "É")))
    rows += [(7, None), (8, ""), (9, " \n"), (None, "a b c d"), (None, "a b c d"), (11, "x y z"), (11, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "1 as fp", "'q' as component")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_links_of_close_prints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(8):
            prints.add(int(np.int64(b) ^ np.int64(1) << np.int64(rng.integers(62)) ^ np.int64(1) << np.int64(rng.integers(62))))
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    got = simhash.components(spark, spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ((rows[i][1] ^ rows[j][1]) & (1 << 64) - 1).bit_count() <= 2 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert sorted((r.fp, r.component) for r in got) == sorted((p, root[i]) for i, p in rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(spark, docs).count() == 0


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(5, long, "x"), (9, long, "y"), (5, long, "z"), (5, "another text altogether", "x"), (None, "no id here", "a"), (None, "no id here", "b"), (None, None, "c"), (3, "", "d"), (None, "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h2 string").withColumnRenamed("_h2", "component")
    got = sorted((r.doc_id or 0, r.text or "", r.component or "") for r in simhash.representatives(spark, docs).collect())
    assert got == sorted([(5, long, "x"), (5, "another text altogether", "x"), (0, "no id here", "a"), (3, "", "d"), (0, "alone", "")])


def test_width_and_radius(spark):
    words = [f"w{i}" for i in range(3000)]
    near = [*words[:100], "other", *words[101:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    apart = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, docs, radius=0).collect()}
    assert apart == {1: 1, 2: 2}
    found = simhash.near_duplicates(spark, docs, width=5, radius=4).collect()
    assert {r.component_id for r in found} == {1}


def test_very_long_text():
    text = " ".join(f"w{i % 977} v{i % 31}" for i in range(60_000))
    assert simhash.text_fingerprint(text.encode()) == plain(text)
