"""Operator 9: approximate nearest neighbours by inner product over balanced posting lists.

Lists are by direction: centroids come from balanced k-means over the directions of a bounded sample, and every vector of
the table is put in the list of its nearest centroid and, near a boundary, in the next one too. How near is fitted, so
that about ``REPLICATED`` of the vectors are in two lists. Centroids are searched by best-first walks over an in-memory
neighbour graph. A query reads the lists whose centroid is at most ``1 + ratio`` times as far as its nearest ``BASE``
centroids are on average: few where the data have structure, about half where they have none, never a fixed number. The
ratio is fitted, in the same way at every size of the table: the least at which lists hold 0.98 of the neighbours of sampled
vectors, or, where that reads too much, a smaller share of them down to 0.91.
Where a query's lists hold fewer than ``AMPLE`` times as many ids as wanted, the next lists are read too, so that it gets
``top`` neighbours, or all other ids if there are fewer.

Equal vectors are one posting with their smallest ids, one more than a query can return, so that copies cost
nothing and lose nothing. Scores are computed in double precision on the original vectors. Vectors that are null,
zero, hold a null or non-finite component, have no id or another length than most rows take no part, as queries either.
Ties go to the smaller id; a repeated id is one candidate, and its own query never returns it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.llm.common import read_table, slices, sorted_groups
from gridloom.llm.neardup_vectors import as_matrix, clean_vectors
from gridloom.plans.scratch import Scratch

TOP, EVERY = 20, 20
#: Vectors that the index is fitted on; all vectors are indexed. Of a larger table's sample ``HELD`` of it only measures.
#: There are ``LISTS`` times the root of the rows lists, at most a quarter of the sample.
SAMPLE, HELD, LISTS = 20_000, 0.2, 4
REPLICATED, BASE = 0.05, 8
#: Ids that the lists of every query hold, as a multiple of those wanted, if there are so many.
AMPLE = 10
#: Shares of the neighbours of so many vectors of the sample that their lists hold: the largest for which a query reads
#: ``PART`` of the vectors at most, or the last.
SHARES, PART, TRIED = (0.98, 0.97, 0.96, 0.95, 0.94, 0.93, 0.92, 0.91), 0.4, 512
TILE, RUN = 1024, 8192
#: Vectors that are compared with all centroids at a time.
ROWS = 512


class CentroidGraph:
    """Centroids and links to their nearest others; ``search`` walks from query to near centroids."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, seed: int = 5):
        self.centroids = centroids
        n = len(centroids)
        self.square = np.einsum("ij,ij->i", centroids, centroids)
        near = np.zeros((n, min(degree, n - 1)), int)
        for at in range(0, n, ROWS):
            far = self.square[at : at + ROWS, None] - 2 * centroids[at : at + ROWS] @ centroids.T + self.square
            far[np.arange(len(far)), np.arange(at, at + len(far))] = -np.inf
            near[at : at + ROWS] = np.argsort(far, axis=1, kind="stable")[:, 1 : degree + 1]
        more = np.random.default_rng(seed).integers(0, n, (n, 4))
        # a ring through all keeps the graph connected
        self.links = np.concatenate([near, more, (np.arange(n)[:, None] + 1) % n], axis=1)

    def base(self, far: np.ndarray) -> np.ndarray:
        """Each row's mean distance to its nearest centroids, from squared distances."""
        n = min(BASE, far.shape[1])
        return np.sqrt(np.maximum(np.partition(far, n - 1, axis=1)[:, :n], 0)).mean(axis=1)

    def search(self, x: np.ndarray, ratio: float, least: int = 2, width: int = 12) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(row, list) pairs with distance at most ``1 + ratio`` times the row's base, and squared distances (inf: not seen).

        Each step opens the nearest ``width`` centroids of a row that are within its reach, and looks at their neighbours.
        """
        n, k = len(x), len(self.centroids)
        own = np.einsum("ij,ij->i", x, x)
        far = np.full((n, k), np.inf)
        opened = np.zeros((n, k), bool)
        starts = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))
        far[:, starts] = own[:, None] - 2 * x @ self.centroids[starts].T + self.square[starts]
        rows, done, width = np.arange(n), 0, min(width, k)
        while len(rows):
            seen = far[rows]
            reach = np.maximum(self.base(seen) * (1 + ratio), 0) ** 2
            waiting = np.where(opened[rows], np.inf, seen)
            best = np.argpartition(waiting, width - 1, axis=1)[:, :width]
            value = np.take_along_axis(waiting, best, axis=1)
            go = np.isfinite(value) & ((value <= reach[:, None]) | (done < least))
            i, j = np.nonzero(go)
            at, node = rows[i], best[i, j]
            opened[at, node] = True
            new = np.zeros((len(rows), k), bool)
            new[i[:, None], self.links[node]] = True
            i, to = np.nonzero(new & np.isinf(seen))
            at = rows[i]
            far[at, to] = own[at] - 2 * np.einsum("ij,ij->i", x[at], self.centroids[to]) + self.square[to]
            rows = rows[go.any(axis=1)]
            done += 1
        far = np.maximum(far, 0)
        return np.nonzero(far <= (self.base(far) * (1 + ratio))[:, None] ** 2), far


def ample(graph: CentroidGraph, x: np.ndarray, i: np.ndarray, j: np.ndarray, counts: np.ndarray, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """The (row, list) pairs, and the next lists by distance for each row whose lists hold less than ``enough`` by ``counts``."""
    short = np.flatnonzero(np.bincount(i, counts[j], len(x)) < enough)
    if not len(short):
        return i, j
    chosen = np.zeros((len(x), len(counts)), bool)
    chosen[i, j] = True
    for at in range(0, len(short), 256):
        rows = short[at : at + 256]
        order = np.argsort(graph.square - 2 * x[rows] @ graph.centroids.T, axis=1, kind="stable")
        held = counts[order]
        r, c = np.nonzero(np.cumsum(held, axis=1) - held < enough)
        chosen[rows[r], order[r, c]] = True
    return np.nonzero(chosen)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means in which a crowded cluster is as far as its surplus makes it, so that lists come out even."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    burden = np.zeros(k)
    own, to, near = np.einsum("ij,ij->i", x, x), np.zeros(len(x), int), np.zeros(len(x))
    for _ in range(rounds):
        square = np.einsum("ij,ij->i", centre, centre)
        for at in range(0, len(x), ROWS):
            far = square - 2 * x[at : at + ROWS] @ centre.T
            best = (far + burden).argmin(axis=1)
            to[at : at + ROWS], near[at : at + ROWS] = best, far[np.arange(len(best)), best]
        count = np.bincount(to, minlength=k)
        spread = max(1e-12, float(np.mean(own + near)))
        burden += 0.1 * spread * (count - len(x) / k) / (len(x) / k)
        total = np.zeros_like(centre)
        np.add.at(total, to, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Index:
    """Centroids with their graph, the boundary within which vectors are in two lists, and the ratio of a query's reach."""

    def __init__(self, x: np.ndarray, total: int, top: int = TOP, ratio: float | None = None):
        """From a sample ``x`` of ``total`` vectors."""
        unit = directions(x)
        held = round(HELD * len(x)) if total > len(x) else 0
        k = max(1, min((len(x) - held) // 4, round(LISTS * total**0.5)))
        centre = balanced_centroids(unit[held:], k)
        size = np.sqrt(np.einsum("ij,ij->i", centre, centre))[:, None]
        self.graph = CentroidGraph(centre / np.where(size > 0, size, 1))
        measured = held or len(x)
        self.boundary = self._boundary(unit[:measured][:4096])
        self.ratio = self._ratio(x[:measured], unit[:measured], total, top) if ratio is None else ratio

    def _boundary(self, unit: np.ndarray) -> float:
        if len(self.graph.centroids) < 2:
            return 0.0
        far = np.sqrt(np.maximum(np.partition(self._far(unit), 1, axis=1)[:, :2], 1e-12))
        return float(np.quantile(far[:, 1] / far[:, 0], REPLICATED)) - 1

    def _far(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(1 - 2 * unit @ self.graph.centroids.T + self.graph.square, 0)

    def _ratio(self, x: np.ndarray, unit: np.ndarray, total: int, top: int) -> float:
        """The ratio at which lists hold one of ``SHARES`` of the neighbours, of which the sample has its part."""
        count = min(max(1, round(top * len(x) / total)), len(x) - 1)
        if count < 1:
            return 0.0
        asked = np.unique(np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int))
        needed, reads = [], []
        i, j, _ = self.lists_of(x)
        sizes = np.bincount(j, minlength=len(self.graph.centroids))
        for begin in range(0, len(asked), 128):
            at = asked[begin : begin + 128]
            each = np.arange(len(at))
            score = x[at] @ x.T
            score[each, at] = -np.inf
            best, pair = np.unique(np.argpartition(-score, count - 1, axis=1)[:, :count], return_inverse=True)
            pair, rows = pair.reshape(-1), np.repeat(each, count)
            stands = np.zeros((len(best), len(self.graph.centroids)), bool)
            i, j, _ = self.lists_of(x[best])
            stands[i, j] = True
            far = self._far(unit[at])
            reads.append((np.sqrt(far) / np.maximum(self.graph.base(far), 1e-9)[:, None] - 1).astype(np.float32))
            needed.append(np.sqrt(np.where(stands[pair], far[rows], np.inf).min(axis=1)) / np.maximum(self.graph.base(far)[rows], 1e-9) - 1)
        every, reads = np.concatenate(needed), np.concatenate(reads)
        for share in SHARES:
            ratio = float(np.quantile(every, share, method="higher")) + 1e-9
            if ((reads <= ratio) @ sizes).mean() <= PART * len(x):
                break
        return ratio

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, whether it is the nearest) for the lists that vectors stand in."""
        found = []
        for at in range(0, len(x), ROWS):
            _, far = self.graph.search(directions(x[at : at + ROWS]), 0.0)
            near = np.argsort(far, axis=1, kind="stable")[:, :2]
            value = np.take_along_axis(far, near, axis=1)
            i, j = np.nonzero((value <= value[:, :1] * (1 + self.boundary) ** 2) & np.isfinite(value))
            found.append((at + i, near[i, j], j == 0))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))

    def opened(self, x: np.ndarray, counts: np.ndarray, enough: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for the lists that queries read."""
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for at in range(0, len(x), ROWS):
            unit = directions(x[at : at + ROWS])
            i, j = ample(self.graph, unit, *self.graph.search(unit, self.ratio)[0], counts, enough)
            found.append((at + i, j))
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def fitted(items: DataFrame, dim: int, kind: str, top: int, ratio: float | None, sample: int = SAMPLE) -> Index:
    """The index of ``items(vec)``, from a bounded sample in the order of a hash."""
    drawn = items.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).collect()
    return Index(as_matrix(np.array([r.vec for r in drawn], object), kind, dim), items.count(), top, ratio)


def search(spark: SparkSession, df: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", top: int = TOP, ratio: float | None = None) -> DataFrame:
    """``(query_id, rank, id, score)``: the nearest rows of ``df`` found for each row of ``queries(id, vector)``.

    A ``ratio`` of the caller's takes the place of the fitted one.
    """
    empty = "query_id long, rank int, vec_id long, score double"
    scratch = Scratch(spark, "search")
    rows, dim, kind = clean_vectors(df, id, vector)
    if dim == 0:
        return spark.createDataFrame([], empty)
    rows = scratch.save(rows.where("vec IS NOT NULL"), "rows")
    # queries of another length than the rows take no part
    asked, _, own_kind = clean_vectors(queries, id, vector, dim)
    asked = asked.where("vec IS NOT NULL")
    if rows.isEmpty():
        return spark.createDataFrame([], empty)
    first = Window.partitionBy("vec").orderBy("id")
    items = rows.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= top + 1)
    items = scratch.save(items.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "items")
    index = fitted(items, dim, kind, top, ratio)
    shared = spark.sparkContext.broadcast(index)  # at most SAMPLE / 4 centroids

    def placed(batches):
        own = shared.value
        for whole in batches:
            for batch in slices(whole, 1 << 19):
                i, lists, home = own.lists_of(as_matrix(batch.column(0).to_numpy(zero_copy_only=False), kind, dim))
                pick = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(home), batch.column(0).take(pick), batch.column(1).take(pick)], names=["list", "home", "vec", "ids"])

    def aimed(batches):
        own = shared.value
        for whole in batches:
            for batch in slices(whole, 1 << 18):
                i, j = own.opened(as_matrix(batch.column(1).to_numpy(zero_copy_only=False), own_kind, dim), counts, enough)
                pick = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(j), batch.column(0).take(pick), batch.column(1).take(pick)], names=["list", "query", "vec"])

    postings = scratch.save(items.mapInArrow(placed, "list long, home boolean, vec binary, ids array<long>"), "postings")
    # each id counts in one list, so that lists hold at least the sum of their counts; one row for each list
    homes = postings.where("home").select("list", F.explode("ids").alias("id")).groupBy("id").agg(F.min("list").alias("list"))
    counts = np.zeros(len(index.graph.centroids))
    for r in homes.groupBy("list").agg(F.count("*").alias("n")).collect():
        counts[r.list] = r.n
    enough = AMPLE * top + 1
    wanted = scratch.save(asked.distinct().mapInArrow(aimed, "list long, query long, vec binary"), "wanted")
    # one row for each list, so at most SAMPLE / 4
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / RUN).alias("runs")).join(wanted.groupBy("list").agg(F.ceil(F.count("*") / TILE).alias("tiles")), "list")
    sizes = F.broadcast(sizes)
    key = lambda i, m: F.shiftleft("list", 40) + F.shiftleft(i, 20) + m
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    ones = wanted.join(sizes, "list").withColumn("m", F.explode(spread("runs"))).select(key(F.pmod(F.xxhash64("query"), "tiles"), F.col("m")).alias("g"), F.col("query").alias("q"), "vec", F.array().cast("array<long>").alias("ids"))
    many = postings.join(sizes, "list").withColumn("i", F.explode(spread("tiles"))).select(key(F.col("i"), F.pmod(F.xxhash64("vec"), "runs")).alias("g"), F.lit(-1).cast("long").alias("q"), "vec", "ids")

    def best(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        order = np.lexsort((ids, -scores))
        _, once = np.unique(ids[order], return_index=True)
        return order[np.sort(once)[:top]]

    def compare(batches):
        for group in sorted_groups(batches, "g"):
            asks = np.array([not len(x) for x in group["ids"]])
            at, have = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(at) or not len(have):
                continue
            q, v = as_matrix(group["vec"][at], own_kind, dim), as_matrix(group["vec"][have], kind, dim)
            out_q, out_ids, out_scores = [], [], []
            for begin in range(0, len(at), 128):
                score = q[begin : begin + 128] @ v.T
                cut = min(top + 1, score.shape[1])
                floors = np.partition(score, -cut, axis=1)[:, -cut]
                for r, row in enumerate(score):
                    floor, wide = floors[r], cut
                    while True:
                        near = np.flatnonzero(row >= floor - 1e-12 * max(1.0, abs(floor)))
                        exact = np.einsum("j,ij->i", q[begin + r], v[near])
                        lists = [group["ids"][have[c]] for c in near]
                        ids = np.concatenate(lists)
                        scores = np.repeat(exact, [len(x) for x in lists])
                        query = group["q"][at[begin + r]]
                        ids, scores = ids[ids != query], scores[ids != query]
                        pick = best(ids, scores)
                        if len(pick) >= top or len(near) == len(row):
                            break
                        # the nearest vectors repeat few ids
                        wide = min(4 * wide, len(row))
                        floor = np.partition(row, -wide)[-wide]
                    out_q.append(query)
                    out_ids.append(ids[pick])
                    out_scores.append(scores[pick])
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    def merge(batches):
        for group in sorted_groups(batches, "query_id"):
            ids, scores = np.concatenate(group["ids"]).astype(np.int64), np.concatenate(group["scores"]).astype(float)
            pick = best(ids, scores)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), group["query_id"][0])), pa.array(np.arange(1, len(pick) + 1, dtype=np.int32)), pa.array(ids[pick]), pa.array(scores[pick])], names=["query_id", "rank", "vec_id", "score"])

    tasks = ones.unionByName(many).repartition("g").sortWithinPartitions("g")
    found = tasks.mapInArrow(compare, "query_id long, ids array<long>, scores array<double>")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, empty)


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(spark, rows, rows.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op9_vector_search": op9_vector_search}
ORACLE_SQL: dict[str, str] = {}
