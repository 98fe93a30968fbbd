"""Operator 3: quality by an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, ``ORDER`` of them, one for each language. Documents are dealt to chunks of bounded
size; the n-grams of a chunk are gathered once, with their counts in its trusted documents. The counts of all
chunks are added up; counts, continuation counts, context totals and lower orders meet in joins sharded by (language,
n-gram), which give each n-gram its interpolated probability and each context its back-off weight. More such joins
score every n-gram that occurs in any document and bring the scores to the chunks that need them, whose documents
stream past them and add up their log-probabilities. Neither the driver nor a broadcast holds the model. A document
is rejected if its perplexity is over a limit for its language, an upper quantile of the trusted documents', widened
by a margin. Short texts are drawn towards the language's mean by ``WEIGHT`` characters.

A null or empty text has the language's mean perplexity and is kept; a null language is one of its own (''). A
language without trusted text keeps all its documents (null perplexity and limit). Repeated rows are judged
alike; repeated labels of an id trust it if one does. Other columns ride along in ``judge``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gridloom.llm.common import read_table, slices
from gridloom.plans.scratch import Scratch

ORDER = 4
#: Characters are 16-bit codes: what lies beyond the basic plane is one character, and the border before a text another.
BORDER, BEYOND = 0xFFFF, 0xFFFE
#: N-grams that a task holds at most before it passes them on, and the bytes of text that a chunk has for each.
SHARD_ROWS, SHARD_BYTES = 1_500_000, 32
QUANTILE, MARGIN, WEIGHT = 0.995, 0.06, 40
#: Perplexities are told apart to a thousandth of a nat.
GRAIN = 1000


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters' codes, with borders in front of each text, and where each text begins (and the end)."""
    pad = chr(BORDER) * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4") if texts else np.zeros(0, "<u4")
    sizes = np.fromiter((len(t) + ORDER - 1 for t in texts), np.int64, len(texts))
    flat = np.where(points > 0xFFFF, BEYOND, points).astype(np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def windows(flat: np.ndarray) -> np.ndarray:
    """The ``ORDER`` characters that end at each position from ``ORDER - 1`` on, the last one lowest."""
    n = len(flat) - ORDER + 1
    code = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER):
        code = (code << np.uint64(16)) | flat[k : k + n]
    return code


def ends(starts: np.ndarray, n: int) -> np.ndarray:
    """Which windows end at a text's own characters."""
    own = np.ones(n, bool)
    for k in range(ORDER - 1):
        border = starts[:-1] + k - (ORDER - 1)
        own[border[(border >= 0) & (border < n)]] = False
    return own


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def _mask(order: int) -> int:
    return (1 << 16 * order) - 1 if order < 4 else -1


def kneser_ney(scratch: Scratch, counts: DataFrame, order: int = ORDER) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """For each order from 1 on ``(lang, gram, p)`` and ``(lang, gram, backoff)``.

    ``p`` is the interpolated probability of a seen n-gram's last character; ``backoff`` is the weight of the next
    lower order after ``gram``, the n-gram's context (one character shorter than the order).
    """
    level = {order: counts}
    for k in range(order - 1, 0, -1):
        # how many different characters stand before
        level[k] = scratch.save(level[k + 1].groupBy("lang", F.col("gram").bitwiseAND(_mask(k)).alias("gram")).agg(F.count("*").alias("n")), f"level{k}")
    tables: dict[int, DataFrame] = {}
    weights: dict[int, DataFrame] = {}
    lower = None
    for k in range(1, order + 1):
        spread = [F.coalesce(F.sum(F.when(F.col("n") == c, 1)), F.lit(0)).cast("double").alias(f"c{c}") for c in range(1, 5)]
        c1, c2, c3, c4 = (F.col(f"c{c}") for c in range(1, 5))
        y = F.when(c1 + 2 * c2 > 0, c1 / (c1 + 2 * c2)).otherwise(0.5)
        cut = lambda c, low, high: F.when(low > 0, F.least(F.greatest(c - (c + 1) * y * high / low, F.lit(0.05)), F.lit(c * 0.95))).otherwise(c * 0.5)
        # one row for each language
        discount = F.broadcast(level[k].groupBy("lang").agg(*spread).select("lang", cut(1, c1, c2).alias("d1"), cut(2, c2, c3).alias("d2"), cut(3, c3, c4).alias("d3")))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        with_cut = level[k].join(discount, "lang").select("lang", "gram", "n", d.alias("d"), F.shiftrightunsigned("gram", 16).alias("context"))
        context = scratch.save(with_cut.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("cut")).select("lang", "context", "total", (F.col("cut") / F.col("total")).alias("weight")), f"context{k}")
        own = with_cut.join(context, ["lang", "context"])
        if k == 1:
            sizes = F.broadcast(level[1].groupBy("lang").agg(F.count("*").alias("v")))
            p = own.join(sizes, "lang").select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") / (F.col("v") + 1)).alias("p"))
        else:
            p = own.withColumn("tail", F.col("gram").bitwiseAND(_mask(k - 1))).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q")), ["lang", "tail"])
            p = p.select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("q")).alias("p"))
        lower = scratch.save(p, f"p{k}")
        tables[k], weights[k] = lower, context.select("lang", F.col("context").alias("gram"), F.col("weight").alias("backoff"))
    return tables, weights


def score_ngrams(grams: DataFrame, tables: dict[int, DataFrame], weights: dict[int, DataFrame]) -> DataFrame:
    """``(lang, gram, logp)`` for distinct ``(lang, gram)``: longest n-gram seen, less what backing off to it costs.

    Null where a language has no model. Orders are joined one after the other, on the n-gram's end and its context.
    """
    out = grams.select("lang", "gram")
    # one row for each language: what is left for characters that were never seen
    unseen = weights[1].select("lang", F.ln("backoff").alias("_left")).join(tables[1].groupBy("lang").agg(F.ln(F.count("*") + 1).alias("_v")), "lang")
    out = out.join(F.broadcast(unseen.select("lang", (F.col("_left") - F.col("_v")).alias("_0"))), "lang", "left")
    for k in range(1, ORDER + 1):
        end = F.col("gram").bitwiseAND(_mask(k))
        # an order of one has no more rows than characters of 16 bits
        small = F.broadcast if k == 1 else lambda table: table
        p = small(tables[k].select("lang", F.col("gram").alias("_end"), F.ln("p").alias("_p")))
        out = out.withColumn("_end", end).join(p, ["lang", "_end"], "left")
        if k == 1:
            logp = F.coalesce("_p", "_0")
        else:
            small = F.broadcast if k == 2 else lambda table: table
            w = small(weights[k].select("lang", F.col("gram").alias("_context"), F.ln("backoff").alias("_w")))
            out = out.withColumn("_context", F.shiftrightunsigned(end, 16)).join(w, ["lang", "_context"], "left")
            logp = F.coalesce("_p", F.coalesce("_w", F.lit(0.0)) + F.col("logp"))
        out = out.select("lang", "gram", "_0", logp.alias("logp"))
    return out.drop("_0")


def _runs(batches):
    """The batches in slices that have one chunk and one kind of row: ``(chunk, kind, rows)``."""
    for whole in batches:
        for batch in slices(whole):
            chunk, kind = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("chunk", "kind"))
            edges = np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                yield int(chunk[begin]), int(kind[begin]), batch.slice(begin, end - begin)


def _chunked(rows: DataFrame, chunks: int) -> DataFrame:
    """Each chunk in a partition of its own, what its documents need (kind 0) before the documents (kind 1)."""
    return rows.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "kind")


def chunk_ngrams(docs: DataFrame, trusted: DataFrame, chunks: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(chunk, lang, gram, n)``: the n-grams of each chunk, and how often they are in its trusted documents (0: never).

    ``docs(chunk, key, lang, text)`` stream past the chunk's keys in ``trusted(chunk, key)``. An n-gram is in several
    rows of a chunk if that has more than ``shard_rows`` of them.
    """

    def run(batches):
        here, keys, held = None, set(), {}
        for chunk, kind, part in _runs(batches):
            if chunk != here:
                for name in held:
                    yield _counted(here, name, *held[name])
                here, keys, held = chunk, set(), {}
            ids = part.column(part.schema.get_field_index("key")).to_pylist()
            if kind == 0:
                keys.update(ids)
                continue
            langs, body = strings(part, "lang"), strings(part, "text")
            for name, good in {(x, i in keys) for x, i in zip(langs, ids)}:
                flat, starts = codes([t for t, x, i in zip(body, langs, ids) if x == name and (i in keys) == good])
                code = windows(flat)
                g, n = np.unique(code[ends(starts, len(code))], return_counts=True)
                n = n.astype(np.int64) * good
                if name in held:
                    g, back = np.unique(np.concatenate([held[name][0], g]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([held[name][1], n]), len(g)).astype(np.int64)
                held[name] = g, n
                if len(g) > shard_rows:
                    yield _counted(here, name, *held.pop(name))
        for name in held:
            yield _counted(here, name, *held[name])

    rows = docs.withColumn("kind", F.lit(1)).unionByName(trusted.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return _chunked(rows, chunks).mapInArrow(run, "chunk int, lang string, gram long, n long")


def _counted(chunk: int, name: str, g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), chunk, np.int32)), pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["chunk", "lang", "gram", "n"])


def log_probabilities(docs: DataFrame, scores: DataFrame, chunks: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``logp`` (sum of log-probabilities; null if the language has no model) and ``length`` (characters).

    ``docs(chunk, lang, text, ...)`` stream past their chunk's n-grams, ``scores(chunk, lang, gram, logp)``.
    """
    names = [c for c in docs.columns if c not in ("chunk", *drop)]
    schema = StructType([*(docs.schema[c] for c in names), StructField("logp", DoubleType()), StructField("length", LongType())])

    def run(batches):
        here, parts, tables = None, [], {}
        for chunk, kind, part in _runs(batches):
            if chunk != here:
                here, parts, tables = chunk, [], {}
            if kind == 0:
                parts.append(pa.table([part.column(part.schema.get_field_index(c)) for c in ("lang", "gram", "score")], names=["lang", "gram", "score"]))
                continue
            if parts:
                tables, parts = _tables(pa.concat_tables(parts)), []
            langs, body = strings(part, "lang"), strings(part, "text")
            sums = np.zeros(len(body))
            for name in set(langs) & tables.keys():
                rows = np.flatnonzero(np.array([x == name for x in langs]))
                flat, starts = codes([body[r] for r in rows])
                code = windows(flat)
                use = ends(starts, len(code))
                grams, logp = tables[name]
                at = np.minimum(np.searchsorted(grams, code[use]), len(grams) - 1)
                if (grams[at] != code[use]).any():
                    raise RuntimeError("an n-gram of a document isn't among those of its chunk: the documents changed between two reads")
                value = np.zeros(len(code))
                value[use] = logp[at]
                total = np.concatenate([[0.0], np.cumsum(value)])
                begin, end = starts[:-1], np.maximum(starts[1:] - ORDER + 1, starts[:-1])
                sums[rows] = total[np.minimum(end, len(value))] - total[np.minimum(begin, len(value))]
            columns = [part.column(part.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, mask=np.isnan(sums)), pa.array([len(t) for t in body], pa.int64())], names=[*names, "logp", "length"])

    needs = scores.select("chunk", F.lit(0).alias("kind"), "lang", "gram", F.col("logp").alias("score"))
    rows = docs.withColumn("kind", F.lit(1)).unionByName(needs, allowMissingColumns=True)
    return _chunked(rows, chunks).mapInArrow(run, schema)


def _tables(scored: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each language's n-grams in order, and their log-probabilities (not a number without a model)."""
    langs = scored.column("lang").combine_chunks().dictionary_encode()
    code = langs.indices.to_numpy()
    grams = scored.column("gram").to_numpy().view(np.uint64)
    logp = scored.column("score").to_numpy()
    out = {}
    for k, name in enumerate(langs.dictionary.to_pylist()):
        g, p = grams[code == k], logp[code == k]
        at = np.argsort(g, kind="stable")
        out[name] = g[at], p[at]
    return out


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, keep)``, a hash of the text and the columns in ``carry``, for each row of ``docs``.

    A chunk has texts of about ``SHARD_BYTES`` times ``shard_rows`` bytes.
    """
    scratch = Scratch(spark, "perplexity")
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / (SHARD_BYTES * shard_rows)))
    # rows without an id are dealt by text; an id's rows meet its label
    key = F.col("doc_id").cast("string")
    place = lambda by: F.pmod(F.xxhash64(by), F.lit(chunks)).cast("int").alias("chunk")
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    dealt = place(F.coalesce(key, "text", F.lit("")))
    grams = scratch.save(chunk_ngrams(docs.select(dealt, key.alias("key"), lang, "text"), trusted.select(place(key), key.alias("key")), chunks, shard_rows), "grams")
    every = scratch.save(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "every")
    scores = scratch.save(score_ngrams(every, *kneser_ney(scratch, every.where("n > 0"))), "scores")
    scratch.drop(*[name for name in scratch._paths if name not in ("grams", "scores")])
    inner = [c for c in carry if c != "text"]
    body = docs.select(dealt, "doc_id", lang, F.struct(*[F.col(c) for c in inner] or [F.lit(0).alias("_")]).alias("_row"), "text", F.xxhash64("text").alias("text_hash"))
    scored = log_probabilities(body, grams.select("chunk", "lang", "gram").join(scores, ["lang", "gram"]), chunks, drop=() if "text" in carry else ("text",))
    scored = scratch.save(scored, "scored")
    scratch.drop("grams", "scores")
    known = scored.select("doc_id", "lang", "logp", "length").join(trusted, "doc_id", "left_semi").where("logp IS NOT NULL AND length > 0")
    # one row for each language
    means = F.broadcast(known.groupBy("lang").agg((-F.sum("logp") / F.sum("length")).alias("mean")))
    entropy = ((-F.col("logp") + WEIGHT * F.col("mean")) / (F.col("length") + WEIGHT)).alias("entropy")
    bins = known.join(means, "lang").select("lang", F.round(entropy * GRAIN).cast("long").alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n"))
    # at most a few ten thousand bins for each language, whatever the number of documents
    ranked = bins.selectExpr("lang", "bin", "sum(n) OVER (PARTITION BY lang ORDER BY bin) AS below", "sum(n) OVER (PARTITION BY lang) AS total")
    limits = ranked.where(F.col("below") >= QUANTILE * F.col("total")).groupBy("lang").agg(((F.min("bin") + 1) / GRAIN + MARGIN).alias("cut"))
    limits = scratch.save(means.join(limits, "lang"), "limits")
    out = scored.join(F.broadcast(limits), "lang", "left")
    own = [F.col(c if c == "text" else f"_row.{c}").alias(f"carried_{c}") for c in carry]
    return out.select("doc_id", "lang", F.exp(entropy).alias("perplexity"), F.exp("cut").alias("threshold"), F.coalesce(entropy <= F.col("cut"), F.lit(True)).alias("keep"), "text_hash", *own)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("text_hash")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents over their language's limit go. Texts ride along with their scores, and meet no join."""
    # whole rows are sorted and written chunk by chunk: chunks are smaller here
    judged = judge(spark, docs, read_table(spark, sf_dir, "labels"), SHARD_ROWS // 4, carry=tuple(docs.columns))
    return judged.where("keep").select(*[F.col(f"carried_{c}").alias(c) for c in docs.columns])


QUERIES = {"op3_quality": op3_quality}
ORACLE_SQL: dict[str, str] = {}
