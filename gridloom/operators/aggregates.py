"""Aggregations by block, label and edge. Spark merges partial results, so a block's part needs no table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import normalized
from gridloom.model import AXES, lower_pairs

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def statistics(vox: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """mean, max, min, std, var (of the population) and size, by block or of the whole."""
    parts = [F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("var"), F.count(value).alias("size")]
    return (vox.groupBy(by) if by else vox).agg(*parts)


def merge_statistics(blocks: DataFrame) -> DataFrame:
    """Statistics of the whole from those of parts, by the parallel variance formula."""
    n = F.sum("size")
    mean = F.sum(F.col("size") * F.col("mean")) / n
    var = F.sum(F.col("size") * (F.col("var") + F.col("mean") ** 2)) / n - mean**2
    return blocks.agg(mean.alias("mean"), F.max("max").alias("max"), F.min("min").alias("min"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), F.greatest(var, F.lit(0.0)).alias("var"), n.alias("size"))


def region_features(vox: DataFrame, label: str, value: str, ignore_label: int | None = 0, by_block: bool = False, normalize: bool = False) -> DataFrame:
    """``(id, count, mean, min, max)`` of the values of each label."""
    if normalize:
        vox = vox.withColumn(value, normalized(value, "block_id"))
    if ignore_label is not None:
        vox = vox.where(F.col(label) != ignore_label)
    keys = (["block_id"] if by_block else []) + [F.col(label).alias("id")]
    return vox.groupBy(*keys).agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def merge_region_features(parts: DataFrame, number_of_labels: int | None = None) -> DataFrame:
    """Counts added, means weighted; with a number of labels a row of zeros for each that is missing."""
    n = F.sum("count")
    out = parts.groupBy("id").agg(n.alias("count"), (F.sum(F.col("count") * F.col("mean")) / n).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))
    return dense(out, number_of_labels) if number_of_labels else out


def dense(table: DataFrame, number_of_labels: int) -> DataFrame:
    """A row for each id below the number of labels, 0 where there was none."""
    ids = table.sparkSession.range(number_of_labels)
    return ids.join(table, "id", "left").fillna(0)


def morphology(vox: DataFrame, label: str, number_of_labels: int | None = None, by_block: bool = False) -> DataFrame:
    """``(id, size, com_*, bbmin_*, bbmax_*)``, bounds inclusive."""
    keys = (["block_id"] if by_block else []) + [F.col(label).alias("id")]
    parts = [F.count("*").alias("size"), *(f(c).alias(f"{n}_{c}") for n, f in (("com", F.avg), ("bbmin", F.min), ("bbmax", F.max)) for c in AXES)]
    out = vox.groupBy(*keys).agg(*parts)
    return dense(out, number_of_labels) if number_of_labels else out


def merge_morphology(parts: DataFrame, number_of_labels: int | None = None) -> DataFrame:
    n = F.sum("size")
    com = [(F.sum(F.col("size") * F.col(f"com_{c}")) / n).alias(f"com_{c}") for c in AXES]
    out = parts.groupBy("id").agg(n.alias("size"), *com, *(f(f"{m}_{c}").alias(f"{m}_{c}") for m, f in (("bbmin", F.min), ("bbmax", F.max)) for c in AXES))
    return dense(out, number_of_labels) if number_of_labels else out


def size_filter(sizes: DataFrame, *, size_threshold: int | None = None, target_number: int | None = None) -> DataFrame:
    """Ids to discard from ``(id, count)`` parts: those below the threshold, or all but the largest."""
    if (size_threshold is None) == (target_number is None):
        raise ValueError("exactly one of size_threshold and target_number")
    total = sizes.groupBy("id").agg(F.sum("count").alias("count"))
    if size_threshold is not None:
        return total.where(F.col("count") < size_threshold).select("id")
    largest = total.orderBy(F.desc("count"), "id").limit(target_number).select("id")
    return total.join(largest, "id", "left_anti").select("id")


def edge_pairs(vox: DataFrame, label: str, value: str | None = None, ignore_label: bool = False, by_block: bool = False) -> DataFrame:
    """``(u, v, value)`` of each pair of neighbours with different labels; the value is the larger of the two.

    ``by_block`` adds the ``block_id`` of the first.
    """
    pairs = lower_pairs(vox, [label, *([value] if value else []), *(["block_id"] if by_block else [])])
    pairs = pairs.where(F.col(f"{label}_a") != F.col(f"{label}_b"))
    if ignore_label:
        pairs = pairs.where((F.col(f"{label}_a") != 0) & (F.col(f"{label}_b") != 0))
    ends = [F.least(f"{label}_a", f"{label}_b").alias("u"), F.greatest(f"{label}_a", f"{label}_b").alias("v")]
    home = [F.col("block_id_a").alias("block_id")] if by_block else []
    return pairs.select(*home, *ends, *([F.greatest(f"{value}_a", f"{value}_b").alias("value")] if value else []))


def affinity_pairs(vox: DataFrame, label: str, affinities: DataFrame, offsets: list[tuple[int, int, int]], value: str = "v") -> DataFrame:
    """The same from ``affinities(c, z, y, x, value)``, with the pair at each channel's offset."""
    moves = F.array(*[F.struct(F.lit(c).cast("long").alias("c"), *[F.lit(int(d)).alias(a) for a, d in zip(AXES, o)]) for c, o in enumerate(offsets)])
    there = vox.select(*AXES, F.col(label).alias("_b"), F.explode(moves).alias("m")).select(*[(F.col(a) - F.col(f"m.{a}")).alias(a) for a in AXES], F.col("m.c").alias("c"), "_b")
    pairs = affinities.select("c", *AXES, value).join(there.hint("merge"), ["c", *AXES]).join(vox.select(*AXES, F.col(label).alias("_a")).hint("merge"), list(AXES)).where("_a <> _b")
    return pairs.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"), F.col(value).alias("value"))


def edge_features(pairs: DataFrame, exact: bool = True) -> DataFrame:
    """Ten features by edge: mean, var, min, five quantiles, max, size. Approximate quantiles keep no values."""
    if exact:
        q = F.percentile("value", list(QUANTILES))
    else:
        q = F.percentile_approx("value", list(QUANTILES), 10_000)
    out = pairs.groupBy("u", "v").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.min("value").alias("min"), q.alias("_q"), F.max("value").alias("max"), F.count("*").alias("size"))
    return out.select("u", "v", "mean", "var", "min", *[F.col("_q")[k].alias(f"q{int(p * 100)}") for k, p in enumerate(QUANTILES)], "max", "size")


def edge_histograms(pairs: DataFrame, low: float, high: float, bins: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """``(…, u, v, bin, n, mean, var, min, max)`` of ``(u, v, value)``: counts and moments of each edge's values by bin.

    Bins are of one width over ``low`` to ``high``; what lies outside counts in the first or last. An edge has ``bins`` rows
    at most, however many values, and those of parts (``by``, such as blocks) merge.
    """
    at = F.floor((F.col("value") - low) / ((high - low) / bins))
    placed = pairs.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("long"))
    return placed.groupBy(*by, "u", "v", "bin").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.min("value").alias("min"), F.max("value").alias("max"))


def merge_edge_histograms(parts: DataFrame, by: tuple[str, ...] = ("u", "v", "bin")) -> DataFrame:
    """Histograms of parts added up: counts, and moments by the parallel variance formula."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    var = F.sum(F.col("n") * (F.col("var") + F.col("mean") ** 2)) / n - mean**2
    return parts.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), F.greatest(var, F.lit(0.0)).alias("var"), F.min("min").alias("min"), F.max("max").alias("max"))


def histogram_features(histograms: DataFrame, low: float, high: float, bins: int = 64) -> DataFrame:
    """The features of ``edge_features`` from histograms: quantiles lie within their bin in proportion to the count below
    them, and between the edge's least and largest value. No values are held, only bins."""
    along = Window.partitionBy("u", "v").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    width = (high - low) / bins
    below = histograms.withColumn("_cum", F.sum("n").over(along)).withColumn("_all", F.sum("n").over(Window.partitionBy("u", "v")))
    q = []
    for p in QUANTILES:
        rank = p * F.col("_all")
        before = F.col("_cum") - F.col("n")
        q.append(F.max(F.when((before < rank) & (F.col("_cum") >= rank), low + width * (F.col("bin") + (rank - before) / F.col("n")))).alias(f"q{int(p * 100)}"))
    found = below.groupBy("u", "v").agg(*q)
    whole = merge_edge_histograms(histograms, ("u", "v"))
    names = [f"q{int(p * 100)}" for p in QUANTILES]
    clipped = [F.greatest("min", F.least("max", n)).alias(n) for n in names]
    return whole.join(found, ["u", "v"]).select("u", "v", "mean", "var", "min", *clipped, "max", F.col("n").alias("size"))


def create_multiset(vox: DataFrame, label: str, ignore: int = (1 << 63) - 1) -> DataFrame:
    """Each voxel's histogram of one label; the ignore label is background."""
    own = F.when(F.col(label) == ignore, 0).otherwise(F.col(label)).cast("long")
    return vox.select(*AXES, F.array(F.struct(own.alias("id"), F.lit(1).cast("long").alias("count"))).alias("hist"))


def downscale_multiset(hist: DataFrame, factor: tuple[int, int, int], restrict_set: int = -1) -> DataFrame:
    """Histograms added up by cell, most frequent first (then smaller id), at most ``restrict_set`` of them."""
    cell = [F.floor(F.col(c) / f).cast("long").alias(c) for c, f in zip(AXES, factor)]
    counts = hist.select(*cell, F.explode("hist").alias("e")).groupBy(*AXES, F.col("e.id").alias("id")).agg(F.sum("e.count").alias("count"))
    if restrict_set >= 0:
        w = Window.partitionBy(*AXES).orderBy(F.desc("count"), "id")
        counts = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= restrict_set).drop("_r")
    entry = F.struct((-F.col("count")).alias("n"), F.col("id"))
    listed = counts.groupBy(*AXES).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return listed.select(*AXES, F.transform("e", lambda e: F.struct(e["id"].alias("id"), (-e["n"]).alias("count"))).alias("hist"))


def multiset_argmax(hist: DataFrame) -> DataFrame:
    return hist.select(*AXES, F.col("hist")[0]["id"].alias("label"))


def filtered_edge_features(vox: DataFrame, label: str, value: str, blocking, filters: dict[str, list[float]], halo: tuple[int, int, int] = (4, 8, 8), in_2d: bool = False, ignore_label: bool = False, exact: bool = True) -> DataFrame:
    """``(u, v, filter, sigma, mean, var, …)``: features of each edge under each filter response at each sigma.

    Responses are computed on blocks read with ``halo``; a table with a channel ``c`` has its channels filtered one by
    one, and ``c`` in its result.
    """
    from gridloom.operators.stencils import image_filter

    channels = [r.c for r in vox.select("c").distinct().orderBy("c").collect()] if "c" in vox.columns else [None]
    out = None
    for c in channels:
        own = (vox if c is None else vox.where(F.col("c") == c)).select(*AXES, label, value)
        for name, sigmas in filters.items():
            for sigma in sigmas:
                response = image_filter(own.select(*AXES, value), value, blocking, name, float(sigma), halo, in_2d)
                found = edge_features(edge_pairs(response.select(*AXES, value).join(own.select(*AXES, label).hint("merge"), list(AXES)), label, value, ignore_label), exact)
                tags = [F.lit(name).alias("filter"), F.lit(float(sigma)).alias("sigma")] + ([] if c is None else [F.lit(int(c)).cast("long").alias("c")])
                found = found.select("u", "v", *tags, *found.columns[2:])
                out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no filter")
    return out
