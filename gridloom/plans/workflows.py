"""Compositions of operators: lazily chained frames, written only where a loop needs its lineage cut."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import AXES, Blocking
from gridloom.operators import aggregates as agg
from gridloom.operators import checks, evaluation, filters, graph, models, objects, overlaps, relabel, resample, segmentation, solvers, voxelwise


@dataclass
class Problem:
    """A region graph with its features and costs."""

    nodes: DataFrame
    edges: DataFrame
    features: DataFrame
    costs: DataFrame
    grid: tuple[int, int, int] = field(default=(1, 1, 1))


def graph_workflow(vox: DataFrame, label: str, ignore_label: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes by block, and edges with ids."""
    nodes, edges = graph.sub_graphs(vox, label, ignore_label)
    return nodes, graph.edge_ids(graph.merge_sub_graphs(edges))


def edge_features_workflow(vox: DataFrame, label: str, value: str, offsets=None, affinities: DataFrame | None = None) -> DataFrame:
    pairs = agg.affinity_pairs(vox, label, affinities, offsets) if affinities is not None else agg.edge_pairs(vox, label, value)
    return agg.edge_features(pairs)


def edge_costs_workflow(features: DataFrame, model=None, node_labels: dict[str, DataFrame] | None = None, **costs) -> DataFrame:
    names = [c for c in features.columns if c not in ("u", "v", "edge_id")]
    rows = models.predict_edges(model, features) if model is not None else features.withColumn("p", F.col(names[0]))
    return voxelwise.probs_to_costs(rows, node_labels=node_labels, **costs)


def problem_workflow(vox: DataFrame, label: str, value: str, blocking: Blocking, model=None, node_labels=None, sanity_checks: bool = False, **costs) -> Problem:
    nodes, edges = graph_workflow(vox, label)
    if sanity_checks and not checks.check_sub_graphs(vox.where(F.col(label) != 0), label, nodes).isEmpty():
        raise ValueError("blocks whose sub-graph isn't that of their voxels")
    features = edge_features_workflow(vox, label, value)
    return Problem(nodes, edges, features, edge_costs_workflow(features, model, node_labels, **costs), blocking.grid)


def watershed_workflow(vox: DataFrame, value: str, blocking: Blocking, *, two_pass: bool = False, agglomeration: bool = False, **config) -> DataFrame:
    """Voxels with consecutive ``ws``."""
    run = segmentation.two_pass_watershed if two_pass else segmentation.watershed
    found = run(vox, value, blocking, **config)
    whole = vox.join(found.select(*AXES, "ws").hint("merge"), list(AXES)) if "ws" not in vox.columns else vox.drop("ws").join(found.select(*AXES, "ws").hint("merge"), list(AXES))
    if agglomeration:
        merged = segmentation.agglomerate(whole, "ws", value, blocking).select(*AXES, "ws")
        whole = whole.drop("ws").join(merged.hint("merge"), list(AXES))
    return relabel_workflow(whole, "ws")


def relabel_workflow(vox: DataFrame, label: str) -> DataFrame:
    return voxelwise.write_labels(vox, label, relabel.find_labeling(vox, label))


def multicut_segmentation_workflow(spark: SparkSession, vox: DataFrame, value: str, blocking: Blocking, *, label: str = "ws", skip_ws: bool = False, scales: int = 1, watershed: dict | None = None, **problem) -> DataFrame:
    """Watershed, region graph, features, costs, hierarchical multicut, and the labels on the voxels as ``segment``."""
    if not skip_ws:
        vox = watershed_workflow(vox, value, blocking, **(watershed or {}))
    found = problem_workflow(vox, label, value, blocking, **problem)
    labels = solvers.multicut(spark, found.nodes, found.costs, found.grid, scales)
    return _on_voxels(vox, label, labels)


def lifted_multicut_segmentation_workflow(spark: SparkSession, vox: DataFrame, value: str, blocking: Blocking, lifted_labels: str, *, label: str = "ws", depth: int = 4, mode: str = "all", overlap_threshold: float | None = None, clear_labels: str | None = None, scales: int = 1, **problem) -> DataFrame:
    """The same with lifted edges between labelled fragments."""
    found = problem_workflow(vox, label, value, blocking, **problem)
    lifted = lifted_features_workflow(vox, label, lifted_labels, found.edges, depth, mode, overlap_threshold, clear_labels)
    return _on_voxels(vox, label, solvers.multicut(spark, found.nodes, found.costs, found.grid, scales, lifted=lifted))


def _on_voxels(vox: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    lut = labels.select(F.col("node").alias("label"), F.col("label").alias("new_label"))
    return voxelwise.write_labels(vox.withColumn("segment", F.col(label)), "segment", lut, allow_missing=True)


def lifted_features_workflow(vox: DataFrame, label: str, other: str, edges: DataFrame, depth: int = 4, mode: str = "all", overlap_threshold: float | None = None, clear_labels: str | None = None) -> DataFrame:
    labels = node_label_workflow(vox, label, other, threshold=overlap_threshold)
    lifted = graph.lifted_neighborhood(edges, labels, depth, mode)
    if clear_labels:
        lifted = filters.clear_lifted_edges(lifted, node_label_workflow(vox, label, clear_labels))
    return voxelwise.costs_from_node_labels(lifted, labels)


def node_label_workflow(vox: DataFrame, label: str, other: str, threshold: float | None = None, ignore_label: int | None = None) -> DataFrame:
    """``(node, label)``: the best partner of each label in the other volume."""
    found = overlaps.overlaps(vox, label, other, ignore_label)
    best = overlaps.max_overlap(found) if threshold is None else overlaps.thresholded_labels(found, threshold)
    return best.select(F.col("a").alias("node"), F.col("b").alias("label"))


def agglomerative_clustering_workflow(spark: SparkSession, vox: DataFrame, label: str, value: str, threshold: float) -> DataFrame:
    nodes, _ = graph_workflow(vox, label)
    features = agg.edge_features(agg.edge_pairs(vox, label, value))
    return _on_voxels(vox, label, solvers.agglomerative_clustering(spark, nodes, features, threshold))


def simple_stitching_workflow(spark: SparkSession, vox: DataFrame, label: str, value: str, edge_size_threshold: int = 0) -> DataFrame:
    features = agg.edge_features(agg.edge_pairs(vox, label, value))
    labels = overlaps.stitch_assignments(spark, overlaps.stitch_edges(vox, label, features), edge_size_threshold)
    merged = relabel.uniques(vox, label).withColumnRenamed("label", "node").join(labels, "node", "left")
    top = F.broadcast(labels.agg(F.coalesce(F.max("label"), F.lit(0)).alias("_top")))
    return _on_voxels(vox, label, merged.crossJoin(top).select("node", F.coalesce("label", F.col("node") + F.col("_top")).alias("label")))


def multicut_stitching_workflow(spark: SparkSession, vox: DataFrame, label: str, value: str, beta1: float = 0.5, beta2: float = 0.75) -> DataFrame:
    nodes, _ = graph_workflow(vox, label)
    edges = overlaps.stitch_edges(vox, label, agg.edge_features(agg.edge_pairs(vox, label, value, ignore_label=True)))
    return _on_voxels(vox, label, solvers.stitching_multicut(spark, nodes.select("node").distinct(), edges, beta1, beta2))


def connected_components_workflow(spark: SparkSession, vox: DataFrame, value: str, blocking: Blocking, watershed: bool = False, **how) -> DataFrame:
    """Components of the thresholded volume; with ``watershed`` they flood what lies between them."""
    found = segmentation.connected_components(spark, vox, value, blocking, **how)
    if not watershed:
        return found
    seeded = vox.join(found.select(*AXES, "component").hint("merge"), list(AXES))
    return segmentation.watershed_from_seeds(seeded, value, "component", blocking)


def mutex_watershed_workflow(spark: SparkSession, affinities: DataFrame, offsets, blocking: Blocking, two_pass: bool = False, overlap_threshold: float = 0.5, **how) -> DataFrame:
    """Labels over the volume, numbered from 1: blocks are stitched over faces, or two passes are joined."""
    if two_pass:
        vox, pairs = segmentation.two_pass_mutex_watershed(affinities, offsets, blocking, **how)
    else:
        vox = segmentation.mutex_watershed(affinities, offsets, blocking, **how)
        from gridloom.model import lower_pairs

        over = lower_pairs(vox, ["ws", "block_id"]).where("block_id_a <> block_id_b AND ws_a <> 0 AND ws_b <> 0")
        found = over.groupBy(F.col("ws_a").alias("a"), F.col("ws_b").alias("b")).agg(F.count("*").alias("count"))
        pairs = overlaps.stitch_faces(found, overlap_threshold)
    lut = graph.merge_assignments(spark, vox.select(F.col("ws").alias("label")).distinct(), pairs)
    return voxelwise.write_labels(vox, "ws", lut.select(F.col("node").alias("label"), F.col("label").alias("new_label")))


def size_filter_workflow(vox: DataFrame, label: str, size_threshold: int, blocking: Blocking | None = None, height: str | None = None, relabel_result: bool = True, preserve_zeros: bool = False) -> DataFrame:
    """Small labels become background, or are flooded by their neighbours on a height map."""
    sizes = vox.groupBy(F.col(label).alias("id")).agg(F.count("*").alias("count"))
    discard = agg.size_filter(sizes, size_threshold=size_threshold)
    if height is None:
        out = filters.filter_blocks(vox, label, discard)
    else:
        out = segmentation.filling_size_filter(vox, label, height, discard, blocking, preserve_zeros)
    return relabel_workflow(out, label) if relabel_result else out


def size_filter_and_graph_watershed_workflow(spark: SparkSession, vox: DataFrame, fragments: str, assignments: DataFrame, features: DataFrame, size_threshold: int | None = None, target_number: int | None = None, from_costs: bool = False, weight: str = "mean") -> DataFrame:
    sizes = vox.groupBy(F.col(fragments).alias("node")).agg(F.count("*").alias("count")).join(assignments, "node").select(F.col("label").alias("id"), "count")
    discard = agg.size_filter(sizes, size_threshold=size_threshold, target_number=target_number)
    return solvers.graph_watershed_assignments(spark, features, assignments, discard, weight, from_costs, relabel=True)


def filter_labels_workflow(vox: DataFrame, label: str, other: str, labels: list[int]) -> DataFrame:
    discard = filters.id_filter(node_label_workflow(vox, label, other), labels).withColumnRenamed("node", "id")
    return filters.filter_blocks(vox, label, discard)


def filter_by_threshold_workflow(vox: DataFrame, label: str, value: str, threshold: float, mode: str = "less", relabel_result: bool = False) -> DataFrame:
    ids = filters.apply_threshold(agg.region_features(vox, label, value), "mean", threshold, mode)
    out = filters.filter_blocks(vox, label, ids)
    return relabel_workflow(out, label) if relabel_result else out


def filter_orphans_workflow(vox: DataFrame, label: str, assignments: DataFrame) -> DataFrame:
    _, edges = graph_workflow(vox, label)
    return graph.orphan_assignments(edges, assignments)


def evaluation_workflow(vox: DataFrame, segmentation_label: str, truth: str, ignore_label: bool = True) -> DataFrame:
    return evaluation.measures(overlaps.overlaps(vox, segmentation_label, truth, 0 if ignore_label else None))


def morphology_workflow(vox: DataFrame, label: str, number_of_labels: int | None = None) -> DataFrame:
    return agg.morphology(vox, label, number_of_labels)


def pairwise_distance_workflow(vox: DataFrame, label: str, max_distance: float, resolution=(1.0, 1.0, 1.0), max_size: int | None = None) -> DataFrame:
    return overlaps.object_distances(vox, label, max_distance, resolution, max_size)


def label_multiset_workflow(vox: DataFrame, label: str, scales: list[tuple[int, int, int]], restrict_sets: list[int]) -> list[DataFrame]:
    levels = [agg.create_multiset(vox, label)]
    for scale, most in zip(scales, restrict_sets, strict=True):
        levels.append(agg.downscale_multiset(levels[-1], scale, most))
    return levels


def downscaling_workflow(vox: DataFrame, value: str, scales: list, mode: str = "mean", path: str | None = None, blocking: Blocking | None = None, metadata: dict | None = None) -> list[DataFrame]:
    """The pyramid; with a path each level is written to ``path/s0``, ``path/s1``, … with its factors beside it."""
    levels = resample.pyramid(vox, value, scales, mode)
    if path is None:
        return levels
    from gridloom.sources.volumes import read_volume, write_volume

    spark, done, factor, shape = vox.sparkSession, [], [1, 1, 1], blocking.shape
    for k in range(len(scales) + 1):
        if k:
            step = [scales[k - 1]] * 3 if isinstance(scales[k - 1], int) else list(scales[k - 1])
            factor = [a * b for a, b in zip(factor, step)]
            shape = tuple(-(-s // f) for s, f in zip(shape, step))
        level = levels[0] if k == 0 else resample.downscale(done[-1], value, scales[k - 1], mode)
        write_volume(level, f"{path}/s{k}", Blocking(shape, blocking.block), {"downsamplingFactors": factor, **(metadata or {})})
        done.append(read_volume(spark, f"{path}/s{k}").select(*AXES, value))
    return done


def copy_channels_workflow(spark: SparkSession, pattern: str, path: str, blocking: Blocking, scales: list, mode: str = "mean") -> dict[tuple[str, int], list[DataFrame]]:
    """Array files to written pyramids: ``(file, channel)`` to its levels, each in ``path/<k>`` if there are several."""
    from gridloom.sources.volumes import read_arrays

    arrays = read_arrays(spark, pattern)
    parts = sorted((r.file, r.c) for r in arrays.select("file", "c").distinct().collect())  # a row for each file and channel
    out = {}
    for k, (name, c) in enumerate(parts):
        own = arrays.where((F.col("file") == name) & (F.col("c") == c)).select(*AXES, "v")
        out[name, c] = downscaling_workflow(own, "v", scales, mode, path if len(parts) == 1 else f"{path}/{k}", blocking)
    return out


def copy_chunks_workflow(spark: SparkSession, source: str, target: str, blocking: Blocking, scales: list, mode: str = "mean", layout: str = "zarr", **how) -> list[DataFrame]:
    """A chunked store to another one of other chunks, with its pyramid in ``target/s0``, ``target/s1`` and so on."""
    from gridloom.operators.resample import downscale
    from gridloom.sources.chunks import open_chunks, read_chunks, write_chunks

    shape, level, levels = open_chunks(spark, source).blocking.shape, read_chunks(spark, source), []
    for k, scale in enumerate([1, *scales]):
        factor = (scale,) * 3 if isinstance(scale, int) else tuple(scale)
        shape = tuple(-(-s // f) for s, f in zip(shape, factor))
        level = level if k == 0 else downscale(level, "v", factor, mode)
        write_chunks(level, "v", f"{target}/s{k}", Blocking(shape, tuple(min(b, s) for b, s in zip(blocking.block, shape))), layout=layout, **how)
        level = read_chunks(spark, f"{target}/s{k}")
        levels.append(level)
    return levels


def copy_sources_workflow(spark: SparkSession, pattern: str, path: str, blocking: Blocking, scales: list, mode: str = "mean") -> list[DataFrame]:
    """A file of one channel to a written pyramid; several files or channels are for ``copy_channels_workflow``."""
    done = copy_channels_workflow(spark, pattern, path, blocking, scales, mode)
    if len(done) != 1:
        raise ValueError(f"{len(done)} files and channels")
    return next(iter(done.values()))


def learning_workflow(inputs: list[tuple[DataFrame, str, str, str]], trees: int = 100):
    """A forest on the features of several volumes ``(voxels, fragments, value, truth)``."""
    rows = None
    for vox, label, value, truth in inputs:
        features = agg.edge_features(agg.edge_pairs(vox, label, value))
        own = voxelwise.edge_labels(features, node_label_workflow(vox, label, truth), ignore_label=True)
        rows = own if rows is None else rows.unionByName(own)
    names = [c for c in rows.columns if c not in ("u", "v", "edge_label")]
    return models.learn_forest(rows, names, trees=trees)


def skeleton_workflow(vox: DataFrame, label: str, resolution=(1.0, 1.0, 1.0), size_threshold: int | None = None) -> DataFrame:
    return objects.skeletonize(vox, label, resolution, size_threshold)


def mesh_workflow(vox: DataFrame, label: str, resolution=(1.0, 1.0, 1.0), size_threshold: int | None = None, as_text: bool = False) -> DataFrame:
    found = objects.meshes(vox, label, resolution, size_threshold)
    return objects.as_obj(found) if as_text else found


def label_tables_workflow(vox: DataFrame, label: str, assignments: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a viewer needs of a label volume: labels by block, blocks by label, fragments by segment, the largest id."""
    found = {"unique_labels": relabel.block_labels(vox, label), "label_blocks": relabel.label_blocks(vox, label), "max_id": vox.agg(F.max(label).alias("max_id"))}
    if assignments is not None:
        found["fragment_segment"] = relabel.fragment_segment_assignment(assignments)
    return found
