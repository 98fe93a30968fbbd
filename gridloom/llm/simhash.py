"""Operator 7: SimHash near-duplicates by tiled exact comparison of the fingerprints.

Fingerprints are laid out in cells by the population counts of their four 16-bit sections. The sections' counts
differ, together, by no more than the Hamming distance, so a cell is compared only with the cells within the
radius of it; all other pairs of tiles are skipped unseen. Within a task a tile of the cell is compared with a
run of its neighbourhood by exclusive-or and bit counts, and only links that span the task's groups leave it.

Equal fingerprints are one item, so copies make no pairs. A null text counts as one without words: its
fingerprint is zero, linked like any other. Rows without an id get the component of their fingerprint (null if
no row of that component has an id). Rows that repeat an id each get a result row. Other columns are ignored.
``representatives`` keeps one row of each group, whether ids are null or repeated; its other columns ride along.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from gridloom.llm.common import read_table, sorted_groups, spanning_labels, texts, with_columns
from gridloom.operators.components import connected_components
from gridloom.plans.scratch import Scratch

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Rows of a cell in one tile, and of a neighbourhood in one run: a task compares the product of the two at most.
TILE, RUN = 2048, 16384
#: Pairs compared at once.
BLOCK = 1 << 19


def text_fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of the text's word shingles as an unsigned integer, 0 if it has no word."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [h(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        begins = (ends - sizes)[: len(words) - width + 1].tolist()
        hashes = [h(line[b:e], SEED) for b, e in zip(begins, ends[width - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    bits = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(bits), 1 << 16):
        ones += np.unpackbits(bits[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(df: DataFrame, text: str = "text", out: str = "fp", drop: tuple[str, ...] = (), width: int = SHINGLE) -> DataFrame:
    """``df`` with ``out``: the fingerprint as a signed 64-bit integer."""

    def make():
        def run(batch):
            values = np.fromiter((text_fingerprint(t, width) for t in texts(batch, text)), np.uint64, batch.num_rows)
            return [pa.array(values.view(np.int64))]

        return run

    return with_columns(df, [StructField(out, LongType())], make, drop)


def _compare(group: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (two arrays of ids) of one tile and one run of its neighbourhood."""
    own = group["own"].astype(bool)
    fps, ids = group["fp"].view(np.uint64), group["id"]
    a, b = np.flatnonzero(own), np.flatnonzero(~own)
    labels = np.arange(len(fps))
    if len(a) and len(b):
        step = max(1, BLOCK // len(b))
        for at in range(0, len(a), step):
            rows = a[at : at + step]
            near = np.bitwise_count(fps[rows][:, None] ^ fps[b][None, :]) <= radius
            i, j = np.nonzero(near)
            labels = spanning_labels(len(fps), rows[i], b[j], labels)
    linked = np.flatnonzero(ids[labels] != ids)
    return ids[linked], ids[labels[linked]]


def links(spark: SparkSession, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)``: links that span the groups of ``items(id, fp)`` (distinct, not null) at ``radius`` bits or less."""
    count = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)).cast("long") for k in range(4)]
    placed = items.withColumn("cell", sum((c * 17**k for k, c in enumerate(count)), F.lit(0)))
    #: At most 17 ** 4 cells, 24 bytes each, whatever the number of rows.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    near = [o for o in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, o)) <= radius and o >= (0, 0, 0, 0)]
    moves = F.array(*[F.struct(*[F.lit(int(x)).alias(f"d{k}") for k, x in enumerate(o)]) for o in near])

    def moved(df: DataFrame) -> DataFrame:
        at = [F.pmod(F.floor(F.col("cell") / 17**k), F.lit(17)) for k in range(4)]
        df = df.withColumn("o", F.explode(moves))
        inside = [(at[k] + F.col(f"o.d{k}")).between(0, 16) for k in range(4)]
        to = F.col("cell") + sum((F.col(f"o.d{k}") * 17**k for k in range(4)), F.lit(0))
        return df.where(inside[0] & inside[1] & inside[2] & inside[3]).withColumn("to", to.cast("long")).drop("o")

    around = moved(sizes).groupBy("to").agg(F.sum("n").alias("m"))
    plan = sizes.join(around, F.col("cell") == F.col("to")).select(
        F.col("cell").alias("to"),
        F.ceil(F.col("n") / TILE).alias("tiles"),
        F.ceil(F.col("m") / RUN).alias("runs"),
    )
    plan = F.broadcast(plan)
    tile, run = F.pmod(F.xxhash64("fp"), F.col("tiles")), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("runs"))
    key = lambda i, m: F.col("to") * (1 << 44) + i * (1 << 22) + m
    mine = placed.withColumnRenamed("cell", "to").join(plan, "to").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
    mine = mine.select(key(tile, F.col("t")).alias("g"), F.lit(1).cast("tinyint").alias("own"), "id", "fp")
    other = moved(placed).join(plan, "to").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    other = other.select(key(F.col("t"), run).alias("g"), F.lit(0).cast("tinyint").alias("own"), "id", "fp")

    def compare(batches):
        for group in sorted_groups(batches, "g"):
            u, v = _compare(group, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return mine.unionByName(other).repartition("g").sortWithinPartitions("g").mapInArrow(compare, "u long, v long")


def components(spark: SparkSession, prints: DataFrame, id: str = "doc_id", fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """``(fp, component, root)`` for every fingerprint of ``prints``: the smallest id reachable by links, and a fingerprint that names the group."""
    scratch = Scratch(spark, "simhash")
    # a fingerprint is known by itself in the graph, so that rows without an id take part
    items = scratch.save(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(id).alias("first")), "items")
    found = connected_components(spark, links(spark, items.select(F.col("fp").alias("id"), "fp"), radius))
    rooted = items.join(found, items.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return rooted.join(least, "root").select("fp", "component", "root")


def _key(id: str, text: str) -> list[Column]:
    """What tells rows apart: the id (null: empty) and a hash of the text."""
    return [F.coalesce(F.col(id).cast("string"), F.lit("")).alias("_i"), F.xxhash64(F.col(text).isNull(), F.col(text)).alias("_h")]


def near_duplicates(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id, root, _i, _h)`` for every row of ``docs``; ``root`` names the group, ``_i`` and ``_h`` the row."""
    scratch = Scratch(spark, "fingerprints")
    prints = scratch.save(fingerprint(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), *_key(id, text)), "_text", "fp", ("_text",), width), "prints")
    return prints.join(components(spark, prints, "_id", radius=radius), "fp").select(F.col("_id").alias(id), "fp", F.col("component").alias("component_id"), "root", "_i", "_h")


def representatives(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group of ``docs``: the one with the smallest id (null after all others), of these the smallest hash."""
    found = near_duplicates(spark, docs, id, text, width, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), "_i", "_h")).alias("f"))
    # merged at every size: the kept rows grow with the corpus
    kept = first.select("f._i", "f._h").hint("merge")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *_key(id, text)).join(kept, ["_i", "_h"], "left_semi")
    # copies of the kept row itself, with its id, are one row too; the join has sorted them
    return rows.groupBy("_i", "_h").agg(F.min("_row").alias("_row")).select("_row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group stays, the one with the smallest id."""
    return representatives(spark, docs)


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}
