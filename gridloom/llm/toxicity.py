"""Operator 5: toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams and of itself, a text the average of its words; a
linear softmax over that decides. Vectors and softmax are trained together by gradient descent on a bounded
sample of labelled rows. Unseen misspellings and inflections get the vectors of the n-grams they share.

Only n-grams have vectors whose share of texts differs between the classes by more than chance explains, so that few
rows aren't learned by heart; words without one are left out of the average, so that long texts hide nothing.

A null text is an empty one and scores the class prior; a text of which no n-gram is known scores the bias alone.
Labels that are null are not learned from; of several labels of one id each counts. With no labels, those of one class
only, or no n-gram that tells the classes apart, every score is 0 and nothing is toxic. Rows are independent: repeated
rows get repeated results, an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from gridloom.llm.common import read_table, texts, with_columns

#: Labelled rows that the model is fitted on, at most; those with the smallest hash of their id.
SAMPLE = 10_000
SIZES, DIM, EPOCHS, RATE, DECAY, SEED = (3, 4, 5), 4, 12, 2.0, 1e-4, 3
#: An n-gram needs so many documents of the sample, and one in so many of them.
LEAST, ONE_IN = 4, 200
#: And its share of one class's texts must be so many standard deviations from the other's. By chance alone one n-gram
#: in 15,000 is that far off.
CLEAR = 4.0
FOLDS, HELD_OUT = 5, 0
PLACES = 1 << 22
CACHE_WORDS = 400_000
WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[str]:
    """The word with its borders, and its n-grams."""
    marked = f"<{word}>"
    return [marked, *(marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1) if n < len(marked))]


class Model:
    """``score`` of a text is the softmax's share of class 1; each n-gram comes down to one number."""

    def __init__(self, weight: dict[str, float] | None = None, bias: float = 0.0, prior: float = 0.0):
        self.weight, self.bias, self.prior = weight or {}, bias, prior
        self.words: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.weight, self.bias, self.prior)

    def word(self, word: str) -> float | None:
        """Its average, none if no n-gram of it is known."""
        weight = self.weight
        known = [weight[g] for g in grams(word) if g in weight]
        value = sum(known) / len(known) if known else None
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = value
        return value

    def score(self, text: str) -> float:
        found = WORD.findall(text.lower())
        if not found or not self.weight:
            return self.prior
        known = self.words
        try:
            values = [v for w in found if (v := known[w]) is not None]
        except KeyError:
            values = [v for w in found if (v := known[w] if w in known else self.word(w)) is not None]
        return float(1 / (1 + np.exp(-(self.bias + sum(values) / max(1, len(values))))))


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, batch: int = 64) -> Model:
    """Gradient descent on the vectors of all n-grams and the softmax together."""
    labels = np.array([y for _, y in rows], int)
    if len(set(labels.tolist())) < 2:
        return Model()
    index: dict[str, int] = {}
    docs, holders = [], Counter()
    for text, _ in rows:
        count = Counter(WORD.findall(text.lower()))
        docs.append((np.array([index.setdefault(w, len(index)) for w in count], np.int32), np.array(list(count.values()), np.int32)))
        holders.update(count.keys())
    # n-grams by the documents that hold a word with them (counted once a word), in a table of fixed size; n-grams
    # that share a place there pass together
    frequency = np.zeros(PLACES, np.int64)
    for w in index:
        places = {crc32(g.encode()) % PLACES for g in grams(w)}
        frequency[list(places)] += holders[w]
    often = frequency >= max(LEAST, len(rows) / ONE_IN)
    del frequency, holders
    gram: dict[str, int] = {}
    lists = []
    for w in index:
        lists.append(np.array([gram.setdefault(g, len(gram)) for g in grams(w) if often[crc32(g.encode()) % PLACES]], np.int32))
    if not gram:
        return Model()
    # of these, those that stand in more, or fewer, texts of one class than chance explains
    holds = np.zeros((2, len(gram)))
    for (words, _), y in zip(docs, labels.tolist()):
        if len(words):
            holds[y, np.unique(np.concatenate([lists[w] for w in words]))] += 1
    texts_of = np.bincount(labels, minlength=2)
    both = holds.sum(axis=0) / len(labels)
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / texts_of).sum())
    tells = np.abs(holds[1] / texts_of[1] - holds[0] / texts_of[0]) >= CLEAR * spread
    place = np.where(tells, np.cumsum(tells) - 1, -1)
    gram = {g: int(place[k]) for g, k in gram.items() if tells[k]}
    if not gram:
        return Model()
    lists = [place[x][tells[x]].astype(np.int32) for x in lists]
    bags = []
    for words, count in docs:
        ids = [lists[w] for w in words]
        size = np.array([len(x) for x in ids], np.int64)
        share = np.repeat(count / max(1.0, count[size > 0].sum()) / np.maximum(size, 1), size)
        g, inverse = np.unique(np.concatenate(ids) if ids else np.zeros(0, np.int32), return_inverse=True)
        bags.append((g.astype(np.int32), np.bincount(inverse, share, len(g)).astype(np.float32)))
    del lists, docs, index
    rng = np.random.default_rng(SEED)
    vector = rng.normal(scale=0.1, size=(len(gram), dim))
    softmax = rng.normal(scale=0.5, size=(dim, 2))
    softmax[:, 0] = -softmax[:, 1]
    bias = np.log(np.array([np.mean(labels == 0), np.mean(labels == 1)]))
    seen_v, seen_s, seen_b = np.full((len(gram), 1), 1e-8), np.full((dim, 2), 1e-8), np.full(2, 1e-8)
    for epoch in range(epochs):
        step = rate * (1 - epoch / (epochs + 1))
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            g = np.concatenate([bags[k][0] for k in pick])
            part = np.concatenate([bags[k][1] for k in pick])
            row = np.repeat(np.arange(len(pick)), [len(bags[k][0]) for k in pick])
            mean = np.stack([np.bincount(row, part * vector[g, d], len(pick)) for d in range(dim)], axis=1)
            z = mean @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            back = p @ softmax.T
            grad = np.stack([np.bincount(g, part * back[row, d], len(gram)) for d in range(dim)], axis=1)
            seen_v += (grad**2).mean(axis=1, keepdims=True)
            vector -= step * grad / np.sqrt(seen_v) + DECAY * step * vector
            for value, seen, gradient in ((softmax, seen_s, mean.T @ p / len(pick)), (bias, seen_b, p.mean(axis=0))):
                seen += gradient**2
                value -= 0.1 * step * gradient / np.sqrt(seen)
    side = softmax[:, 1] - softmax[:, 0]
    return Model(dict(zip(gram, (vector @ side).tolist())), float(bias[1] - bias[0]), float(labels.mean()))


def fold(id: str):
    return F.crc32(F.col(id).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold. Only the drawn texts reach the driver."""
    drawn = labels.where((fold(id) != HELD_OUT) & F.col(label).isNotNull()).select(id, F.col(label).cast("int").alias("_y"))
    drawn = drawn.orderBy(F.xxhash64(id), id, "_y").limit(sample)
    # at most ``sample`` ids of 12 bytes
    met = docs.select(id, text).join(F.broadcast(drawn), id).select(text, "_y", id)
    # an id may have several texts: again at most ``sample`` rows
    rows = met.orderBy(F.xxhash64(id), id, "_y", F.xxhash64(text)).limit(sample).collect()
    return fit([(r[0] or "", int(r[1] > 0)) for r in sorted(rows, key=lambda r: (r[2], r[1], r[0] or ""))])


def score(spark: SparkSession, df: DataFrame, model: Model, text: str = "text", out: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``out``, the share of class 1."""
    shared = spark.sparkContext.broadcast(model)  # n-grams of a bounded sample

    def make():
        own = shared.value
        return lambda batch: [pa.array([own.score(t.decode()) for t in texts(batch, text)], pa.float64())]

    return with_columns(df, [StructField(out, DoubleType())], make, drop)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored = score(spark, docs, model, drop=("text",))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
