import hashlib
import random
from collections import defaultdict

from gridloom.llm import substring_dedup as sd


def brute(rows, window=sd.WINDOW):
    words = [(t or "").encode().split() for _, t in rows]
    places = defaultdict(set)
    for d, w in enumerate(words):
        for s in range(len(w) - window + 1):
            places[tuple(w[s : s + window])].add((d, s))
    out = []
    for d, w in enumerate(words):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if len(places[tuple(w[s : s + window])]) > 1:
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((-1 if rows[d][0] is None else rows[d][0], len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def make(seed=0):
    rng = random.Random(seed)
    some = [f"w{i}é" for i in range(500)]
    passages = [rng.choices(some, k=n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(60):
        body = rng.choices(some, k=rng.choice([0, 3, 34, 35, 80, 300]))
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "\t \v"]).join(body)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 20, 4)]
    near = rows[7][1].split()
    rows += [(200, " ".join([*near[:50], "changed", *near[51:]])), (201, "same " * 36), (202, "same " * 35), (203, "a b " * 60), (300, None), (301, ""), (None, rows[3][1]), (8, rows[8][1]), (8, rows[8][1])]
    return rows


def run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tk", "2 as n_words", "3 as pos")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.op4_substring_dedup(spark, str(tmp_path)).collect())


def test_matches_brute_force(spark, tmp_path):
    rows = make()
    assert run(spark, rows, tmp_path) == brute(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("gridloom_run")]


def test_hot_passage_in_small_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, f"x{i} " + "hot passage " * 2 + " ".join(f"p{k}" for k in range(40)) + f" y{i}") for i in range(50)] + make(3)
        assert run(spark, rows, tmp_path) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.deduplicate(spark, docs).count() == 0


def judge_all(spark, index, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = sd.judged(spark, docs, index).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in done)


def anchors(spark, rows):
    return sd.anchors_of(sd.keyed(spark.createDataFrame(rows, "doc_id long, text string")))


def test_a_batch_added_to_a_reopened_index(spark, tmp_path):
    rows, root = make(5), f"file:{tmp_path}/index"
    index = sd.FingerprintIndex(spark, root, most_runs=3)
    index.add(anchors(spark, rows[:20]))
    index.add(anchors(spark, rows[20:45]))
    for name in index.runs:
        spark.sql(f"DROP TABLE {name}")  # as in another session, which knows of no table
    index = sd.FingerprintIndex.open(spark, root)
    assert len(index.runs) == 2
    assert judge_all(spark, index, rows[:45]) == brute(rows[:45])
    index.add(anchors(spark, rows[45:60]))
    index.add(anchors(spark, rows[60:]))
    assert len(index.runs) == 1  # compacted
    index = sd.FingerprintIndex.open(spark, root)
    assert judge_all(spark, index, rows) == brute(rows)
    index.clear()
    assert not (tmp_path / "index").exists()


def test_a_batch_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    rows, root = make(6), f"file:{tmp_path}/index"
    index = sd.FingerprintIndex(spark, root)
    index.add(anchors(spark, rows[:30]))
    monkeypatch.setattr(sd.FingerprintIndex, "_commit", lambda *a: 1 / 0)
    try:
        index.add(anchors(spark, rows[30:]))
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    index = sd.FingerprintIndex.open(spark, root)
    assert judge_all(spark, index, rows[:30]) == brute(rows[:30])
    index.add(anchors(spark, rows[30:]))
    assert judge_all(spark, index, rows) == brute(rows)
    index.clear()


def test_small_memories_of_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sd, "HELD", 300)
    monkeypatch.setattr(sd, "KNOWN", 40)
    combiner, out = sd.Combiner(), []
    rng = random.Random(8)
    rows = [(rng.randrange(60) if rng.random() < 0.8 else 1000 + k, rng.randrange(3), k // 5, k % 5) for k in range(4000)]
    column = lambda part, i: sd.np.array([r[i] for r in part], sd.np.int64)
    for at in range(0, len(rows), 50):
        part = rows[at : at + 50]
        b = (column(part, 1) << 32) | column(part, 3)
        out += combiner.add(column(part, 0).view(sd.np.uint64), b, column(part, 2), column(part, 2).astype(sd.np.int32))
        assert len(combiner.known[0]) <= 340
    out.append(combiner.settle())
    settled, asks, stands = set(), [], set()
    for batch in out:
        for r in batch.to_pylist():
            place = (r["tk"], r["b"] & 0xFFFFFFFF)
            if r["kind"] == sd.SETTLED:
                settled.add((place, r["b"] >> 32))
            elif r["kind"] == sd.ASKS:
                asks.append((r["a"], r["b"] >> 32, place))
            else:
                stands.add((r["a"], r["b"] >> 32))
    groups = defaultdict(set)
    for a, high, k, p in rows:
        groups[a, high].add((k, p))
    again = {(p, key[1]) for key, ps in groups.items() if len(ps) > 1 for p in ps}
    asked = defaultdict(set)
    for a, high, p in asks:
        asked[a, high].add(p)
    assert settled <= again
    assert again == settled | {(p, key[1]) for key, ps in asked.items() if len(ps) > 1 or key in stands for p in ps}


def test_very_long_text(spark):
    rows = [(1, " ".join(f"w{i % 30011}" for i in range(90_000))), (2, "w7 " * 50_000), (3, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in sd.deduplicate(spark, docs).collect())
    assert got == brute(rows)
