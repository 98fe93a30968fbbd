"""Operator 2: near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; its hash is the signed axis nearest to
the rotated vector. Tables join ``HASHES`` of these. A vector stands in its own bucket of every table and probes
the next likely buckets; whoever stands in a bucket is compared in double precision with the others and with the
probes. A pair is counted in the first table in which it meets, so that no pair list is ever made: tasks send
sums of links by vector and links that span their groups. Equal vectors are one item with a count of copies, and
large buckets are cut into tiles and runs. Tables, hashes and probes are the same whatever the number of vectors, so
that whether a pair is found depends on its two vectors alone.

Vectors that are null, zero, hold a null or non-finite component, have no id or another length than most have
link with nothing: no links, their own component, kept (an id of null: component null). Rows that repeat an id
each get a result row. Vectors of so many components that buckets have no number (beyond 2 ** 26 by default) raise an
error. The measured recall of the default tables is in the README; the tests measure it too.
"""

from __future__ import annotations

import warnings
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gridloom.llm.common import read_table, slices, spanning_labels
from gridloom.operators.components import connected_components
from gridloom.plans.scratch import Scratch

THRESHOLD = 0.9
TABLES, HASHES, PROBES, SEED = 10, 2, 4, 17
#: Tables of more hashes, whose buckets fill later, with the probes that keep the recall: for a caller to name, never chosen
#: by size. Beyond so many vectors a warning says that they exist.
MANY, MANY_TABLES, MANY_HASHES, MANY_PROBES = 1 << 24, 20, 3, 8
TILE, RUN = 1024, 8192
BLOCK = 1 << 20
#: A bucket's number has its table above so many bits.
CELL_BITS = 56
#: Rows of small groups that are compared together, and pairs of a group up to which it is small.
CHUNK, FEW = 1 << 14, 1 << 12
#: More than two ways to add up a cosine differ by.
ROUNDING = 1e-9


class CrossPolytope:
    """Buckets of vectors of one length in every table."""

    def __init__(self, dim: int, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED):
        self.width = 1 << max(2, (dim - 1).bit_length())
        self.tables, self.hashes, self.probes = tables, hashes, probes
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, hashes, 3, self.width))
        self.steps = np.array(sorted(product(range(3), repeat=hashes), key=lambda r: (sum(r), r)))

    def _rotated(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for row in signs:
            x = x * row
            half = 1
            while half < self.width:
                y = x.reshape(len(x), -1, 2, half)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), self.width)
                half *= 2
            x = x / np.sqrt(self.width)
        return x

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): each row's own bucket and the next likely ones, for rows of length 1."""
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        out = np.empty((len(x), self.tables, self.probes), np.int64)
        rows = np.arange(len(x))[:, None]
        for t in range(self.tables):
            code = np.zeros((len(x), len(self.steps)), np.int64)
            cost = np.zeros((len(x), len(self.steps)))
            for h in range(self.hashes):
                y = self._rotated(x, self.signs[t, h])
                top = np.argpartition(-np.abs(y), 2, axis=1)[:, :3]
                top = top[rows, np.argsort(-np.abs(y[rows, top]), axis=1, kind="stable")]
                value = y[rows, top]
                symbol, size = top * 2 + (value < 0), np.abs(value)
                code = code * (2 * self.width) + symbol[:, self.steps[:, h]]
                cost += (size[:, :1] - size)[:, self.steps[:, h]] ** 2
            order = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
            out[:, t] = code[rows, order]
        return out


def clean_vectors(df: DataFrame, id: str, vector: str, dim: int | None = None) -> tuple[DataFrame, int, str]:
    """``(id, vec)`` of usable rows with their components as bytes; the length (the commonest unless given) and numpy type of these."""
    kind = "<f4" if isinstance(df.schema[vector].dataType, ArrayType) and isinstance(df.schema[vector].dataType.elementType, FloatType) else "<f8"
    if dim is None:
        common = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = common.d if common else 0
    wanted = df.where(_fits(id, vector, dim)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>" if kind == "<f8" else "array<float>").alias("v"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                ids, lists = batch.column(0), batch.column(1)
                flat = lists.flatten()
                x = np.array(flat.to_numpy(zero_copy_only=False), dtype=kind).reshape(-1, dim)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                vectors = [(r + 0.0).tobytes() if ok else None for r, ok in zip(x, good.tolist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(vectors, pa.binary())], names=["id", "vec"])

    return wanted.mapInArrow(run, "id long, vec binary"), dim, kind


def _fits(id: str, vector: str, dim: int) -> Column:
    return F.coalesce((F.size(vector) == dim) & F.col(id).isNotNull() & F.lit(dim > 0), F.lit(False))


def as_matrix(values: np.ndarray, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.tolist()), dtype=kind).reshape(-1, dim).astype(np.float64)


def _meet(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether two vectors meet in a table, given each one's own bucket and probes."""
    return (mine[:, :1] == other).any(axis=1) | (other[:, :1] == mine).any(axis=1)


def _candidates(group: dict[str, np.ndarray], begins: np.ndarray, x: np.ndarray, threshold: float):
    """``(i, j)`` by steps: rows of one group (one tile of a bucket, one run of what it is compared with), near enough.

    Rows are sorted by group, first those that are compared with, then the tile.
    """
    stops = np.append(begins[1:], len(x))
    middles = begins + np.add.reduceat(group["own"] == 0, begins)
    size = (middles - begins) * (stops - middles)
    ids, asks = group["id"], group["stands"] == 0

    def fresh(i, j):
        # a pair in which both stand in the bucket is seen from both sides; one of a probe only from the tile
        new = (ids[i] != ids[j]) & (asks[j] | (ids[i] < ids[j]))
        return i[new], j[new]

    few = np.flatnonzero((size > 0) & (size <= FEW))
    ends = np.cumsum(size[few])
    at = 0
    while at < len(few):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[few[at]] + BLOCK // 4, "right")))
        part = few[at:to]
        count = size[part]
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        wide = np.repeat(middles[part] - begins[part], count)
        i, j = fresh(np.repeat(middles[part], count) + k // wide, np.repeat(begins[part], count) + k % wide)
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        yield i[near], j[near]
        at = to
    for g in np.flatnonzero(size > FEW).tolist():
        b = np.arange(begins[g], middles[g])
        step = max(1, BLOCK // len(b))
        for at in range(middles[g], stops[g], step):
            rows = np.arange(at, min(at + step, stops[g]))
            score = x[rows] @ x[b].T
            i, j = np.nonzero(score >= threshold - ROUNDING)
            value, i, j = score[i, j], rows[i], b[j]
            # a product of matrices rounds by its shape: at the threshold the sum of small groups decides
            at_edge = np.flatnonzero(value < threshold + ROUNDING)
            value[at_edge] = np.einsum("ij,ij->i", x[i[at_edge]], x[j[at_edge]])
            yield fresh(i[value >= threshold], j[value >= threshold])


def _linked(group: dict[str, np.ndarray], hasher: CrossPolytope, kind: str, dim: int, threshold: float):
    """``(u, v, links)`` of whole groups."""
    table = group["g"] >> CELL_BITS
    begins = np.flatnonzero(np.concatenate([[True], (group["g"][1:] != group["g"][:-1]) | (group["h"][1:] != group["h"][:-1])]))
    ids, copies = group["id"], group["copies"]
    x = as_matrix(group["vec"], kind, dim)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    labels, add = np.arange(len(x)), np.zeros(len(x), np.int64)
    known, codes = np.full(len(x), -1), np.zeros((0, hasher.tables, hasher.probes), np.int64)
    for i, j in _candidates(group, begins, x, threshold):
        if not len(i):
            continue
        new = np.unique(np.concatenate([i, j]))
        new = new[known[new] < 0]
        if len(new):
            known[new] = len(codes) + np.arange(len(new))
            codes = np.concatenate([codes, hasher.buckets(x[new])])
        a, b, own = codes[known[i]], codes[known[j]], table[i]
        first = np.ones(len(i), bool)
        for t in range(int(own.max())):
            first &= (own <= t) | ~_meet(a[:, t], b[:, t])
        # where each probes the other's bucket, the pair counts in the bucket of the smaller id
        each = np.arange(len(i))
        mine, other = a[each, own], b[each, own]
        both = (mine[:, :1] == other).any(axis=1) & (other[:, :1] == mine).any(axis=1)
        first &= (group["stands"][j] == 1) | ~both | (ids[i] < ids[j])
        i, j = i[first], j[first]
        np.add.at(add, i, copies[j])
        np.add.at(add, j, copies[i])
        labels = spanning_labels(len(x), i, j, labels)
    out = np.flatnonzero(add)
    return ids[out], ids[labels[out]], add[out]


def _whole_groups(batches):
    """Rows of whole groups by ``g`` and ``h``, of about ``CHUNK`` rows."""
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        held.append(columns)
        size += batch.num_rows
        if size >= CHUNK:
            rows = {n: np.concatenate([h[n] for h in held]) for n in columns}
            change = np.flatnonzero((rows["g"][1:] != rows["g"][:-1]) | (rows["h"][1:] != rows["h"][:-1]))
            if len(change):
                cut = int(change[-1]) + 1
                yield {n: v[:cut] for n, v in rows.items()}
                rows = {n: v[cut:] for n, v in rows.items()}
            held, size = [rows], len(rows["g"])
    if size:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def near_duplicate_links(spark: SparkSession, items: DataFrame, dim: int, kind: str, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """``(u, v, links)``: for ``items(id, copies, vec)``, sums of links by vector and a spanning link of each."""
    hasher = CrossPolytope(dim, tables, hashes, probes)
    if (2 * hasher.width) ** hashes > 1 << CELL_BITS or tables > 64:
        raise ValueError("too many buckets or tables")

    def hashed(batches):
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                x = as_matrix(batch.column(2).to_numpy(zero_copy_only=False), kind, dim)
                code = hasher.buckets(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None])
                cell = (code + (np.arange(tables)[None, :, None] << CELL_BITS)).reshape(-1)
                rows = pa.array(np.repeat(np.arange(len(x)), tables * probes))
                stands = np.tile((np.arange(probes) == 0).astype(np.int8), len(x) * tables)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(stands), *(batch.column(k).take(rows) for k in range(3))], names=["cell", "stands", "id", "copies", "vec"])

    placed = items.select("id", "copies", "vec").mapInArrow(hashed, "cell long, stands tinyint, id long, copies long, vec binary")
    light = items.select("id", "copies", "vec").mapInArrow(hashed, placed.schema).select("cell", "stands")
    sizes = light.groupBy("cell").agg(F.sum("stands").alias("n"), F.count("*").alias("m"))
    plan = sizes.where((F.col("n") > 0) & (F.col("m") > 1)).select("cell", F.ceil(F.col("n") / TILE).alias("tiles"), F.ceil(F.col("m") / RUN).alias("runs"))
    joined = placed.join(plan, "cell")
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    key = lambda i, m: F.shiftleft(i, 32) + m
    tile, run = F.pmod(F.xxhash64("id"), F.col("tiles")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("runs"))
    # each row goes to the runs of its tile if it stands in the bucket, and to its run of every tile
    sides = F.concat(
        F.when(F.col("stands") == 1, F.transform(spread("runs"), lambda m: F.struct(key(tile, m).alias("h"), F.lit(1).cast("tinyint").alias("own")))).otherwise(F.array().cast("array<struct<h:bigint,own:tinyint>>")),
        F.transform(spread("tiles"), lambda i: F.struct(key(i, run).alias("h"), F.lit(0).cast("tinyint").alias("own"))),
    )
    tasks = joined.select(F.explode(sides).alias("s"), F.col("cell").alias("g"), "stands", "id", "copies", "vec").select("g", "s.h", "s.own", "stands", "id", "copies", "vec")

    def compare(batches):
        for group in _whole_groups(batches):
            u, v, w = _linked(group, hasher, kind, dim, threshold)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(w)], names=["u", "v", "links"])

    return tasks.repartition("g", "h").sortWithinPartitions("g", "h", "own").mapInArrow(compare, "u long, v long, links long")


def near_duplicates(spark: SparkSession, df: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, **tables) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``df``."""
    scratch = Scratch(spark, "vectors")
    rows, dim, kind = clean_vectors(df, id, vector)
    if dim == 0:
        return df.select(id, F.lit(0).cast("long").alias("n_links"), F.col(id).cast("long").alias("component_id"), F.col(id).isNotNull().alias("kept"))
    rows = scratch.save(rows, "rows")
    items = scratch.save(rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "items")
    if not tables and items.count() > MANY:
        warnings.warn(f"more than {MANY} vectors fill the default buckets; tables={MANY_TABLES}, hashes={MANY_HASHES}, probes={MANY_PROBES} make smaller ones", stacklevel=2)
    found = scratch.save(near_duplicate_links(spark, items, dim, kind, threshold, **tables), "links")
    sums = found.groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    group = connected_components(spark, found.where("u <> v")).withColumnRenamed("node", "id")
    classes = items.join(sums, "id", "left").join(group, "id", "left").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    usable = rows.where("vec IS NOT NULL").join(classes, "vec").select("id", "n_links", "component_id")
    alone = lambda ids: ids.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    others = alone(rows.where("vec IS NULL")).unionByName(alone(df.where(~_fits(id, vector, dim)).select(F.col(id).cast("long").alias("id"))))
    return usable.unionByName(others).select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
 link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
 reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
 least AS (SELECT x, min(y) AS m FROM reach GROUP BY x), n AS (SELECT x, count(*) AS c FROM link GROUP BY x)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.x = vec_id LEFT JOIN n ON n.x = vec_id"""
}
