"""The stages against plain Python on a small table, each on its own input."""

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from gridloom.llm import bpe, mixing, quality, secret_scan, simhash
from tests.llm.test_simhash import brute as brute_simhash


def test_stages_in_turn(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frames[-1].columns == columns, name
    rows = [[r.asDict() for r in f.collect()] for f in frames]
    by_id = [{r["doc_id"]: r for r in x} for x in rows]

    judged = {r.doc_id: r.keep for r in quality.judge(spark, docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(by_id[1]) == {d for d, keep in judged.items() if keep}

    groups = brute_simhash([(r["doc_id"], r["text"]) for r in rows[1]])
    assert set(by_id[2]) == {d for d, _, c in groups if d == c}
    assert all(by_id[2][d] == by_id[0][d] for d in by_id[2])

    assert set(by_id[3]) == set(by_id[2])
    forest = secret_scan.train()
    for d, r in by_id[2].items():
        text = r["text"] or ""
        for b, e in reversed(secret_scan.candidates(text)):
            x = np.array([secret_scan.features(text[b:e], text[max(0, b - 60) : b], text[e : e + 10], r["source"] or "")])
            if forest.predict(x)[0] >= 0.5:
                text = text[:b] + secret_scan.MARK + text[e:]
        assert by_id[3][d]["text"] == text and by_id[3][d]["n_chars"] == len(text)

    drawn = {r.doc_id: r.kept for r in mixing.mix(spark, frames[3]).collect()}
    assert set(by_id[4]) == {d for d, kept in drawn.items() if kept} and len(by_id[4]) < len(by_id[3])

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    assert set(by_id[5]) == set(by_id[4])
    for d, r in by_id[5].items():
        assert np.frombuffer(r["ids"], "<u4").tolist() == encode(by_id[4][d]["text"]) and r["round_trip"]

    whole = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((d, r["n_tokens"]) for d, r in by_id[5].items())


def test_empty_and_null_documents(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= len(rows)
