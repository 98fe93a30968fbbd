"""Metrics of segmentations, from the table of overlaps ``(a, b, count)``: a the segmentation, b the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def measures(found: DataFrame) -> DataFrame:
    """``(vi_split, vi_merge, adapted_rand_error, rand_index)``; entropies in bits, three aggregates and no window."""
    plogp = lambda c: -F.sum(F.col(c) * F.log2(c))
    pairs = found.agg(F.sum("count").alias("n"), plogp("count").alias("hab"), F.sum(F.col("count") * F.col("count").cast("double")).alias("sab"))
    ends = [found.groupBy(k).agg(F.sum("count").alias("c")).agg(plogp("c").alias(f"h{k}"), F.sum(F.col("c") * F.col("c").cast("double")).alias(f"s{k}")) for k in ("a", "b")]
    one = pairs.crossJoin(F.broadcast(ends[0])).crossJoin(F.broadcast(ends[1]))  # one row each
    n = F.col("n")
    # with sums of c * log2(c), the conditional entropies are differences of joint and marginal sums over n
    precision, recall = F.col("sab") / F.col("sa"), F.col("sab") / F.col("sb")
    total = n * (n - 1) / 2
    agree = total + (F.col("sab") - (F.col("sa") + F.col("sb")) / 2)
    return one.select(
        ((F.col("hab") - F.col("hb")) / n).alias("vi_split"),
        ((F.col("hab") - F.col("ha")) / n).alias("vi_merge"),
        (1 - 2 * precision * recall / (precision + recall)).alias("adapted_rand_error"),
        (agree / total).alias("rand_index"),
    )


def object_vi(found: DataFrame) -> DataFrame:
    """``(b, vi_split, vi_merge)`` by true object, in bits: how its voxels split, and what its segments hold besides."""
    w = Window.partitionBy
    t = found.withColumns({"nb": F.sum("count").over(w("b")), "na": F.sum("count").over(w("a"))})
    p = F.col("count") / F.col("nb")
    q = F.col("count") / F.col("na")
    return t.groupBy("b").agg((-F.sum(p * F.log2(p))).alias("vi_split"), (-F.sum(p * F.log2(q))).alias("vi_merge"))


def object_iou(found: DataFrame, threshold: float = 0.5, ignore_label: int | None = 0) -> DataFrame:
    """``(b, iou)`` by true object: of the segment that overlaps by at least the threshold, else 0.

    A segment and an object with more than half of their union in common have no other such partner, so that the
    best assignment is that of each pair; ties at a half go to the smaller segment.
    """
    w = Window.partitionBy
    t = found.withColumns({"nb": F.sum("count").over(w("b")), "na": F.sum("count").over(w("a"))})
    if ignore_label is not None:
        t = t.where((F.col("b") != ignore_label) & (F.col("a") != ignore_label))
    iou = F.col("count") / (F.col("na") + F.col("nb") - F.col("count"))
    return t.groupBy("b").agg(F.max(F.when(iou >= threshold, iou).otherwise(0.0)).alias("iou"))


def mean_average_precision(found: DataFrame, thresholds=tuple(t / 100 for t in range(50, 100, 5)), ignore_label: int = 0) -> DataFrame:
    """``(threshold, precision)``: matches over matches, missed objects and unmatched segments, at each threshold."""
    objects = found.where(F.col("b") != ignore_label).select("b").distinct().agg(F.count("*").alias("n_b"))
    segments = found.where(F.col("a") != ignore_label).select("a").distinct().agg(F.count("*").alias("n_a"))
    iou = object_iou(found, 0.5, ignore_label)
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    hits = iou.select(levels.alias("threshold"), "iou").groupBy("threshold").agg(F.sum((F.col("iou") >= F.col("threshold")).cast("long")).alias("tp"))
    return hits.crossJoin(F.broadcast(objects)).crossJoin(F.broadcast(segments)).select("threshold", (F.col("tp") / (F.col("n_a") + F.col("n_b") - F.col("tp"))).alias("precision"))


def skeleton_evaluation(nodes: DataFrame, edges: DataFrame, vox: DataFrame, label: str) -> DataFrame:
    """``(correct, split, merge, n_merges)``: shares of skeleton edges within one label, between labels, and in labels
    that hold nodes of several skeletons; ``nodes(skeleton, node, z, y, x)``, ``edges(skeleton, u, v)``."""
    at = nodes.join(vox.select("z", "y", "x", F.col(label).alias("label")).hint("merge"), ["z", "y", "x"], "left").fillna(0, ["label"])
    merged = at.where("label <> 0").groupBy("label").agg(F.count_distinct("skeleton").alias("k")).where("k > 1").select("label", F.lit(True).alias("merged"))
    end = lambda n, name: at.select("skeleton", F.col("node").alias(n), F.col("label").alias(name))
    e = edges.join(end("u", "lu"), ["skeleton", "u"]).join(end("v", "lv"), ["skeleton", "v"])
    e = e.join(merged.withColumnRenamed("label", "lu").withColumnRenamed("merged", "mu"), "lu", "left").join(merged.withColumnRenamed("label", "lv").withColumnRenamed("merged", "mv"), "lv", "left")
    merge = F.coalesce("mu", F.lit(False)) | F.coalesce("mv", F.lit(False))
    kinds = e.select((~merge & (F.col("lu") == F.col("lv"))).alias("c"), (~merge & (F.col("lu") != F.col("lv"))).alias("s"), merge.alias("m"))
    shares = kinds.agg(*[F.avg(F.col(k).cast("double")).alias(n) for k, n in (("c", "correct"), ("s", "split"), ("m", "merge"))])
    return shares.crossJoin(F.broadcast(merged.agg(F.count("*").alias("n_merges"))))
