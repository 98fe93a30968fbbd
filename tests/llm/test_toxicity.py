import random
import zlib

from gridloom.llm import toxicity as tx


def rows(n=900, seed=0):
    rng = random.Random(seed)
    common = ["".join(rng.choices("aeioustrnl", k=rng.randrange(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        words = rng.choices(common, k=60)
        bad = rng.random() < 0.25
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = "gwyzzoc" + rng.choice(["", "er", "ing", "ful", "ed", "y"])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_held_out_accuracy_and_unseen_forms():
    data = rows()
    model = tx.fit([(t, y) for _, t, y in data[:600]])
    assert sum((model.score(t) >= 0.5) == (y == 1) for _, t, y in data[600:]) >= 280
    clean = next(t for _, t, y in data[600:] if y == 0).split()
    assert model.score(" ".join(clean)) < 0.5
    clean[5:50:10] = ["gwyzzocs", "xgwyzzoc", "gwyzzokk", "gwyzzocz", "gwyzzocism"]
    assert model.score(" ".join(clean)) >= 0.5


def test_frames_and_folds(spark, tmp_path):
    data = rows(400)
    docs = [(i, t, "en") for i, t, _ in data] + [(1000, None, None), (1001, "", "x"), (None, "a b", "x"), (3, data[3][1], "en")]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, y) for i, _, y in data] + [(1000, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = tx.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    # the held-out labels never matter
    flipped = [(i, q, y if zlib.crc32(str(i).encode()) % 5 else 1 - (y or 0)) for i, q, y in labels]
    spark.createDataFrame(flipped, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    again = tx.op5_toxicity(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tx.score(spark, docs, tx.train(docs, none)).collect()] == [0.0, 0.0]


def invented(n, share, seed, insults):
    """Texts of 300 invented words, of which the toxic ones hold three insults out of ten."""
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt"]
    out = []
    for _ in range(n):
        words = ["".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(300)]
        bad = rng.random() < share
        for _ in range(3 if bad else 0):
            words[rng.randrange(300)] = rng.choice(insults)
        out.append((" ".join(words), int(bad)))
    return out


def test_few_labelled_rows_are_enough():
    insults = "gwyzzo blurk skrott pathum vlimp zorbel krazzik mudge dwixen fompty".split()
    model = tx.fit(invented(330, 0.14, 1, insults))
    held_out = invented(600, 0.14, 2, insults)
    caught = sum(model.score(t) >= 0.5 for t, y in held_out if y) / sum(y for _, y in held_out)
    flagged = sum(model.score(t) >= 0.5 for t, y in held_out if not y) / sum(1 - y for _, y in held_out)
    assert caught >= 0.7 and flagged <= 0.03, (caught, flagged)
    # better than the class that most rows have
    right = sum((model.score(t) >= 0.5) == (y == 1) for t, y in held_out)
    assert right > sum(1 - y for _, y in held_out)
    clean = next(t for t, y in held_out if not y)
    long = " ".join([clean] * 700) + " gwyzzo blurk skrott vlimp gwyzzo mudge"
    assert model.score(long) >= 0.5 > model.score(" ".join([clean] * 700))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert tx.op5_toxicity(spark, str(tmp_path)).count() == 0


def test_texts_of_one_id_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    seen = []
    original = tx.fit
    tx.fit = lambda rows: seen.append(len(rows)) or original(rows)
    try:
        tx.train(docs, labels, sample=5)
    finally:
        tx.fit = original
    assert seen == [5]
