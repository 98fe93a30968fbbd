"""Every registered query of the volume and graph operators, with its SQL where SQL can express it.

All read the raster view of ``events`` (see ``sources.volumes.raster``), or a table of the star schema as a
contingency table or look-up table, whole. Floating results are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import expr
from gridloom.model import AXES, Blocking
from gridloom.operators import aggregates as agg
from gridloom.operators import checks, distances, evaluation, filters, graph, models, objects, overlaps, relabel, resample, segmentation, solvers, stencils, surfaces, voxelwise
from gridloom.plans.scratch import Scratch
from gridloom.sources import chunks
from gridloom.sources.volumes import raster

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

VX = """vx AS (SELECT z, y, x, v, gt, CAST(1 + floor(z/2)*40 + floor(y/5)*8 + floor(x/5) AS BIGINT) AS ws,
  CAST(floor(z/5)*4 + floor(y/13)*2 + floor(x/20) AS BIGINT) AS block_id FROM (SELECT CAST(floor(event_id/1000) AS BIGINT) AS z,
  CAST(floor((event_id%1000)/40) AS BIGINT) AS y, event_id%40 AS x, value AS v, user_id%10 AS gt FROM events))"""
PAIRS = """pairs AS (SELECT a.ws AS wa, b.ws AS wb, a.gt AS ga, b.gt AS gb, a.v AS va, b.v AS vb, a.block_id AS ba, b.block_id AS bb
  FROM vx a JOIN (SELECT 1 AS dz, 0 AS dy, 0 AS dx UNION ALL SELECT 0,1,0 UNION ALL SELECT 0,0,1) o ON TRUE
  JOIN vx b ON b.z=a.z+o.dz AND b.y=a.y+o.dy AND b.x=a.x+o.dx)"""
EDGES = "edges AS (SELECT DISTINCT least(wa,wb) AS u, greatest(wa,wb) AS v FROM pairs WHERE wa<>wb)"
FEATS = """feats AS (SELECT least(wa,wb) AS u, greatest(wa,wb) AS v, avg(greatest(va,vb)) AS mean, var_pop(greatest(va,vb)) AS var, min(greatest(va,vb)) AS mn,
  max(greatest(va,vb)) AS mx, count(*) AS size FROM pairs WHERE wa<>wb GROUP BY ALL)"""
NODE_LABEL = "lab AS (SELECT ws AS node, gt AS label FROM (SELECT ws, gt, row_number() OVER (PARTITION BY ws ORDER BY count(*) DESC, gt) AS r FROM vx GROUP BY ws, gt) WHERE r=1)"
OV = "ov AS (SELECT ws AS a, gt AS b, count(*) AS c FROM vx GROUP BY ws, gt)"
MARG = "t AS (SELECT a, b, c, sum(c) OVER (PARTITION BY a) AS na, sum(c) OVER (PARTITION BY b) AS nb, sum(c) OVER () AS n FROM ov)"


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    """Register the function below by its name; its SQL runs with the common tables ``ctes``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def edges_of(vox: DataFrame) -> DataFrame:
    return graph.region_graph(vox, "ws", ignore_label=False)


def features_of(vox: DataFrame) -> DataFrame:
    return agg.edge_features(agg.edge_pairs(vox, "ws", "v"))


def cheap_features(vox: DataFrame) -> DataFrame:
    """Mean and size alone, without quantiles."""
    return agg.edge_pairs(vox, "ws", "v").groupBy("u", "v").agg(F.avg("value").alias("mean"), F.count("*").alias("size"))


def node_labels(vox: DataFrame) -> DataFrame:
    best = overlaps.max_overlap(overlaps.overlaps(vox, "ws", "gt"))
    return best.select(F.col("a").alias("node"), F.col("b").alias("label"))


# ---- scans, copies and element-wise expressions


def _chunked(spark, sf_dir, value: str, **how) -> str:
    """The raster as a chunked store in the shared folder; chunks don't divide the shape."""
    path = f"{Scratch(spark, 'store').root}/{value}"
    chunks.write_chunks(raster(spark, sf_dir), value, path, Blocking(_blocking(spark, sf_dir).shape, (4, 9, 16)), **how)
    return path


@query("SELECT z, y, x, v FROM vx", VX)
def copy_chunks(spark, sf_dir):
    """Values through a zarr store and from there through an N5 store."""
    shape = _blocking(spark, sf_dir).shape
    there = f"{Scratch(spark, 'store').root}/n5"
    chunks.write_chunks(chunks.read_chunks(spark, _chunked(spark, sf_dir, "v")), "v", there, Blocking(shape, (3, 13, 11)), compression="gzip", layout="n5")
    return chunks.read_chunks(spark, there)


@query("SELECT z, y, x, ws FROM vx WHERE y >= 3 AND y < 17 AND x >= 5 AND x < 33", VX)
def read_chunks_roi(spark, sf_dir):
    """A region of a store of labels: other chunks' files are never opened."""
    path = _chunked(spark, sf_dir, "ws", dtype="<i8")
    return chunks.read_chunks(spark, path, (0, 3, 5), (chunks.open_chunks(spark, path).shape[0], 17, 33), "ws")


@query("SELECT z, y, x, v FROM vx WHERE y >= 3 AND y < 17 AND x >= 5 AND x < 33 AND z >= 0 AND z < 4", VX)
def voxel_scan_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxelwise.copy_volume(raster(spark, sf_dir).select(*AXES, "v"), "v", begin=(0, 3, 5), end=(4, 17, 33))


@query("SELECT z, y, x, CASE WHEN gt IN (1,4,7) THEN gt + 100 ELSE 0 END AS gt FROM vx", VX)
def copy_value_list_offset(spark, sf_dir):
    return voxelwise.copy_volume(raster(spark, sf_dir).select(*AXES, "gt"), "gt", value_list=[1, 4, 7], offset=100, dtype="long")


@query("SELECT n.z, n.y, n.x, COALESCE(NULLIF(CASE WHEN n.gt IN (2,3) THEN n.gt ELSE 0 END, 0), n.ws) AS gt FROM vx n", VX)
def copy_insert_mode(spark, sf_dir):
    vox = raster(spark, sf_dir)
    return voxelwise.copy_volume(vox.select(*AXES, "gt"), "gt", value_list=[2, 3], previous=vox.select(*AXES, F.col("ws").alias("gt")), dtype="long")


@query("SELECT z, y, x, CASE WHEN min(q) OVER (PARTITION BY block_id) = max(q) OVER (PARTITION BY block_id) THEN 0 ELSE q END AS q FROM (SELECT *, CAST(floor(z/5) AS BIGINT) * (CASE WHEN x < 20 THEN 1 ELSE gt END) AS q FROM vx)", VX)
def copy_uniform_to_background(spark, sf_dir):
    vox = raster(spark, sf_dir).withColumn("q", F.floor(F.col("z") / 5) * F.when(F.col("x") < 20, 1).otherwise(F.col("gt")))
    return voxelwise.copy_volume(vox, "q", uniform_to_background=True, dtype="long").select(*AXES, "q")


@query("SELECT c, z, y, x, round(v, 6) AS v FROM (SELECT CAST(0 AS BIGINT) AS c, z, y, x, v FROM vx UNION ALL SELECT CAST(1 AS BIGINT), z, y, x, v/2 FROM vx UNION ALL SELECT CAST(2 AS BIGINT), z, y, x, CAST(gt AS DOUBLE) FROM vx)", VX)
def stack_predictions(spark, sf_dir):
    vox = raster(spark, sf_dir)
    pred = vox.select(F.lit(0).cast("long").alias("c"), *AXES, (F.col("v") / 2).alias("v")).unionByName(vox.select(F.lit(1).cast("long").alias("c"), *AXES, F.col("gt").cast("double").alias("v")))
    return rounded(voxelwise.stack_predictions(vox.select(*AXES, "v"), pred), "v")


@query("SELECT z, y, x, COALESCE(r_regionkey + 50, gt) AS gt FROM vx LEFT JOIN region ON gt = r_regionkey", VX)
def write_assignments(spark, sf_dir):
    lut = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("label"), (F.col("r_regionkey") + 50).cast("long").alias("new_label"))
    return voxelwise.write_labels(raster(spark, sf_dir), "gt", lut, allow_missing=True).select(*AXES, "gt")


@query("SELECT z, y, x, round(CASE WHEN hi > lo THEN (v-lo)/(hi-lo) ELSE v-lo END, 6) AS v FROM (SELECT *, min(v) OVER (PARTITION BY block_id) AS lo, max(v) OVER (PARTITION BY block_id) AS hi FROM vx)", VX)
def normalize_block(spark, sf_dir):
    return rounded(raster(spark, sf_dir).withColumn("v", expr.normalized("v", "block_id")), "v").select(*AXES, "v")


def _threshold(mode: str, sign: str):
    @query(f"SELECT z, y, x, CAST((v-lo)/(hi-lo) {sign} 0.25 AS INTEGER) AS v FROM (SELECT *, min(v) OVER (PARTITION BY block_id) AS lo, max(v) OVER (PARTITION BY block_id) AS hi FROM vx)", VX)
    def f(spark, sf_dir):
        return voxelwise.threshold(raster(spark, sf_dir), "v", 0.25, mode).select(*AXES, "v")

    QUERIES[f"threshold_{mode}"], ORACLE_SQL[f"threshold_{mode}"] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


for _m, _s in (("greater", ">"), ("less", "<"), ("equal", "=")):
    _threshold(_m, _s)


@query("SELECT z, y, x, round(CASE WHEN gt > 2 THEN 2.5*v - 1 ELSE v END, 6) AS v FROM vx", VX)
def linear_global(spark, sf_dir):
    vox = raster(spark, sf_dir).withColumn("m", F.col("gt") > 2)
    return rounded(voxelwise.linear(vox, "v", (2.5, -1.0), mask="m"), "v").select(*AXES, "v")


@query("SELECT z, y, x, round((1 + z*0.5)*v + z, 6) AS v FROM vx", VX)
def linear_per_slice(spark, sf_dir):
    vox = raster(spark, sf_dir)
    table = vox.select("z").distinct().select("z", (1 + F.col("z") * 0.5).alias("a"), F.col("z").cast("double").alias("b"))
    return rounded(voxelwise.linear(vox, "v", table), "v").select(*AXES, "v")


def _channels(vox: DataFrame) -> DataFrame:
    three = F.array(*[F.struct(F.lit(c).cast("long").alias("c"), (F.col("v") * f).alias("v")) for c, f in enumerate((1.0, 0.5, 2.0))])
    return vox.select(*AXES, F.explode(three).alias("p")).select("p.c", *AXES, "p.v")


@query("SELECT z, y, x, round((v*0.5 + v*2.0)/2, 6) AS v FROM vx", VX)
def channel_reduce_mean(spark, sf_dir):
    return rounded(voxelwise.to_boundaries(_channels(raster(spark, sf_dir)), "mean", 1, 3), "v")


@query("SELECT z, y, x, round(greatest(v, v*0.5), 6) AS v FROM vx", VX)
def channel_reduce_max(spark, sf_dir):
    return rounded(voxelwise.to_boundaries(_channels(raster(spark, sf_dir)), "max", 0, 2), "v")


@query("SELECT z, y, x, CAST(least(greatest(round(v/490*255), 0), 255) AS INTEGER) AS v FROM vx", VX)
def quantize_uint8(spark, sf_dir):
    return raster(spark, sf_dir).select(*AXES, expr.to_uint8(F.col("v") / 490).alias("v"))


# ---- aggregations


@query("SELECT block_id, round(avg(v),6) AS mean, max(v) AS max, min(v) AS min, round(stddev_pop(v),6) AS std, round(var_pop(v),4) AS var, count(v) AS size FROM vx GROUP BY block_id", VX)
def block_statistics(spark, sf_dir):
    out = agg.statistics(raster(spark, sf_dir), "v", "block_id")
    return rounded(out, "mean", "std").withColumn("var", F.round("var", 4))


@query("SELECT max(v) AS max, min(v) AS min, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(var_pop(v),4) AS var, CAST(count(v) AS BIGINT) AS size FROM vx", VX)
def merge_statistics(spark, sf_dir):
    out = agg.merge_statistics(agg.statistics(raster(spark, sf_dir), "v", "block_id"))
    return rounded(out, "mean", "std").withColumn("var", F.round("var", 4))


@query("SELECT gt AS id, count(*) AS count, round(avg(v),6) AS mean, min(v) AS min, max(v) AS max FROM vx WHERE gt<>0 GROUP BY gt", VX)
def region_features(spark, sf_dir):
    parts = agg.region_features(raster(spark, sf_dir), "gt", "v", by_block=True)
    return rounded(agg.merge_region_features(parts), "mean")


@query("SELECT CAST(id AS BIGINT) AS id, COALESCE(size, 0) AS size, " + ", ".join(f"round(COALESCE(com_{c}, 0), 6) AS com_{c}, COALESCE(bbmin_{c}, 0) AS bbmin_{c}, COALESCE(bbmax_{c}, 0) AS bbmax_{c}" for c in AXES) + " FROM (SELECT unnest(range((SELECT max(ws) + 1 FROM vx))) AS id) LEFT JOIN (SELECT ws AS id, count(*) AS size, " + ", ".join(f"avg({c}) AS com_{c}, min({c}) AS bbmin_{c}, max({c}) AS bbmax_{c}" for c in AXES) + " FROM vx GROUP BY ws) m USING (id)", VX)
def morphology(spark, sf_dir):
    """A row for each label up to the table's largest, of zeros where there is no voxel."""
    vox = raster(spark, sf_dir)
    labels = (vox.agg(F.max("ws")).first()[0] or 0) + 1
    return rounded(agg.merge_morphology(agg.morphology(vox, "ws", by_block=True), labels), "com_z", "com_y", "com_x")


@query("SELECT l_suppkey AS id FROM lineitem GROUP BY l_suppkey HAVING count(*) < 600")
def size_filter_threshold(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("id")).count()
    return agg.size_filter(sizes, size_threshold=600)


@query("SELECT id FROM (SELECT l_suppkey AS id, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS r FROM lineitem GROUP BY l_suppkey) WHERE r > 7")
def size_filter_target_number(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("id")).count()
    return agg.size_filter(sizes, target_number=7)


@query("SELECT z, y, x, CASE WHEN c < 1000 THEN 0 ELSE gt END AS gt FROM (SELECT *, count(*) OVER (PARTITION BY gt) AS c FROM vx)", VX)
def background_size_filter(spark, sf_dir):
    vox = raster(spark, sf_dir)
    sizes = vox.groupBy(F.col("gt").alias("id")).count()
    return filters.filter_blocks(vox, "gt", agg.size_filter(sizes, size_threshold=1000)).select(*AXES, "gt")


# ---- distinct and relabel


@query("SELECT DISTINCT ws AS label FROM vx", VX)
def unique_labels(spark, sf_dir):
    vox = raster(spark, sf_dir)
    return relabel.merge_uniques(relabel.uniques(vox.where("y < 13"), "ws"), relabel.uniques(vox.where("y >= 13"), "ws"))


@query("SELECT ws AS label, count(*) AS count FROM vx GROUP BY ws", VX)
def label_counts(spark, sf_dir):
    return relabel.uniques(raster(spark, sf_dir), "ws", counts=True)


@query("SELECT z, y, x, new_label AS q FROM (SELECT z, y, x, ws*7 AS q FROM vx) JOIN (SELECT q AS label, row_number() OVER (ORDER BY q) AS new_label FROM (SELECT DISTINCT ws*7 AS q FROM vx)) ON q = label", VX)
def relabel_consecutive(spark, sf_dir):
    vox = raster(spark, sf_dir).select(*AXES, (F.col("ws") * 7).alias("q"))
    return voxelwise.write_labels(vox, "q", relabel.find_labeling(vox, "q")).select(*AXES, "q")


@query("SELECT block_id, list_sort(list(DISTINCT gt)) AS labels FROM vx GROUP BY block_id", VX)
def block_unique_labels(spark, sf_dir):
    return relabel.block_labels(raster(spark, sf_dir), "gt")


@query("SELECT ws AS label, list_sort(list(DISTINCT block_id)) AS blocks FROM vx GROUP BY ws", VX)
def label_block_mapping(spark, sf_dir):
    return relabel.label_blocks(raster(spark, sf_dir), "ws")


@query("SELECT ws AS label, block_id // 4 AS part, list_sort(list(DISTINCT block_id)) AS blocks FROM vx GROUP BY ALL", VX)
def label_block_ranges(spark, sf_dir):
    return relabel.label_block_ranges(raster(spark, sf_dir), "ws", 4)


@query(
    "SELECT block_id, CAST(coalesce(sum(n) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM (SELECT block_id, count(*) AS n FROM vx GROUP BY block_id)",
    VX,
)
def sub_volume_offsets(spark, sf_dir):
    return resample.sub_volume_offsets(raster(spark, sf_dir).groupBy("block_id").agg(F.count("*").alias("n")))


@query("SELECT node, label + 1000 AS segment FROM lab WHERE label<>0 AND label IN (SELECT label FROM lab GROUP BY label HAVING count(*) > 1)", VX, NODE_LABEL)
def fragment_segments(spark, sf_dir):
    return relabel.fragment_segment_assignment(node_labels(raster(spark, sf_dir)), 1000)


# ---- overlaps, filters and evaluation


@query("SELECT l_suppkey AS a, l_linenumber AS b, count(*) AS count FROM lineitem GROUP BY ALL")
def contingency_lineitem(spark, sf_dir):
    return overlaps.overlaps(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_linenumber")


@query("SELECT a, b, c AS count FROM ov WHERE b <> 0", VX, OV)
def overlaps_ignoring_zero(spark, sf_dir):
    found = overlaps.block_overlaps(raster(spark, sf_dir), "ws", "gt", ignore_label=0)
    return found.groupBy("a", "b").agg(F.sum("count").alias("count"))


@query("SELECT node AS a, label AS b FROM lab", VX, NODE_LABEL)
def max_overlap(spark, sf_dir):
    return overlaps.max_overlap(overlaps.overlaps(raster(spark, sf_dir), "ws", "gt"))


@query("SELECT a, CASE WHEN s > 0.2 THEN b ELSE 0 END AS b FROM (SELECT a, b, c/sum(c) OVER (PARTITION BY a) AS s, row_number() OVER (PARTITION BY a ORDER BY CASE WHEN b<>0 THEN 0 ELSE 1 END, c DESC, b) AS r FROM ov) WHERE r = 1", VX, OV)
def overlap_fraction_threshold(spark, sf_dir):
    return overlaps.thresholded_labels(overlaps.overlaps(raster(spark, sf_dir), "ws", "gt"), 0.2)


@query("SELECT node FROM lab WHERE label IN (1, 2)", VX, NODE_LABEL)
def id_filter(spark, sf_dir):
    return filters.id_filter(node_labels(raster(spark, sf_dir)), [1, 2])


@query("SELECT z, y, x, CASE WHEN ws IN (SELECT node FROM lab WHERE label IN (1,2)) THEN 0 ELSE ws END AS ws FROM vx", VX, NODE_LABEL)
def filter_labels_by_overlap(spark, sf_dir):
    vox = raster(spark, sf_dir)
    discard = filters.id_filter(node_labels(vox), [1, 2]).withColumnRenamed("node", "id")
    return filters.filter_blocks(vox, "ws", discard).select(*AXES, "ws")


@query("SELECT ws AS id FROM vx GROUP BY ws HAVING avg(v) < 48", VX)
def filter_by_feature_threshold(spark, sf_dir):
    return filters.apply_threshold(agg.region_features(raster(spark, sf_dir), "ws", "v"), "mean", 48, "less")


@query("SELECT DISTINCT block_id FROM vx WHERE v > 300", VX)
def blocks_from_mask(spark, sf_dir):
    return filters.blocks_from_mask(raster(spark, sf_dir).withColumn("m", F.col("v") > 300), "m")


@query("SELECT round(sum(-c/n*log2(c/nb)),6) AS vi_split, round(sum(-c/n*log2(c/na)),6) AS vi_merge FROM t", VX, OV, MARG)
def vi_split_merge(spark, sf_dir):
    return rounded(evaluation.measures(overlaps.overlaps(raster(spark, sf_dir), "ws", "gt")).select("vi_split", "vi_merge"), "vi_split", "vi_merge")


@query("""SELECT round(1 - 2*(sab/sa)*(sab/sb)/((sab/sa)+(sab/sb)),6) AS adapted_rand_error, round((n*(n-1)/2 + sab - (sa+sb)/2)/(n*(n-1)/2),6) AS rand_index FROM
 (SELECT CAST(sum(c*c) AS DOUBLE) AS sab, CAST(sum(c) AS DOUBLE) AS n FROM ov), (SELECT CAST(sum(s*s) AS DOUBLE) AS sa FROM (SELECT sum(c) AS s FROM ov GROUP BY a)), (SELECT CAST(sum(s*s) AS DOUBLE) AS sb FROM (SELECT sum(c) AS s FROM ov GROUP BY b))""", VX, OV)
def rand_index(spark, sf_dir):
    return rounded(evaluation.measures(overlaps.overlaps(raster(spark, sf_dir), "ws", "gt")).select("adapted_rand_error", "rand_index"), "adapted_rand_error", "rand_index")


@query("SELECT b, round(sum(-c/nb*log2(c/nb)),6) AS vi_split, round(sum(-c/nb*log2(c/na)),6) AS vi_merge FROM t GROUP BY b", VX, OV, MARG)
def object_vi(spark, sf_dir):
    return rounded(evaluation.object_vi(overlaps.overlaps(raster(spark, sf_dir), "ws", "gt")), "vi_split", "vi_merge")


BLOCK_OV = "ov AS (SELECT ws AS a, z*100 + CAST(floor(y/5) AS BIGINT)*10 + CAST(floor((x+1)/5) AS BIGINT) + 1 AS b, count(*) AS c FROM vx GROUP BY ALL)"


def _shifted_overlaps(vox: DataFrame) -> DataFrame:
    other = (F.col("z") * 100 + F.floor(F.col("y") / 5) * 10 + F.floor((F.col("x") + 1) / 5) + 1).cast("long")
    return overlaps.overlaps(vox.withColumn("o", other), "ws", "o")


@query("SELECT b, round(max(CASE WHEN c/(na+nb-c) >= 0.35 THEN c/(na+nb-c) ELSE 0 END),6) AS iou FROM t GROUP BY b", VX, BLOCK_OV, MARG)
def object_iou(spark, sf_dir):
    return rounded(evaluation.object_iou(_shifted_overlaps(raster(spark, sf_dir)), 0.35), "iou")


@query("SELECT level AS threshold, round(tp/(a+b-tp),6) AS precision FROM (SELECT level, sum(CASE WHEN iou >= level THEN 1 ELSE 0 END) AS tp FROM (SELECT b, max(c/(na+nb-c)) AS iou FROM t GROUP BY b), (SELECT unnest([0.35, 0.5]) AS level) GROUP BY level), (SELECT count(DISTINCT a) AS a, count(DISTINCT b) AS b FROM ov)", VX, BLOCK_OV, MARG)
def mean_average_precision(spark, sf_dir):
    found = _shifted_overlaps(raster(spark, sf_dir))
    iou = evaluation.object_iou(found, 0.35)
    one = lambda t: iou.agg(F.sum((F.col("iou") >= t).cast("long")).alias("tp"))
    ends = found.agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b"))
    out = None
    for t in (0.35, 0.5):
        row = one(t).crossJoin(F.broadcast(ends)).select(F.lit(t).alias("threshold"), (F.col("tp") / (F.col("a") + F.col("b") - F.col("tp"))).alias("precision"))
        out = row if out is None else out.unionByName(row)
    return rounded(out, "precision")


# ---- graphs


@query("SELECT u, v FROM edges", VX, PAIRS, EDGES)
def rag_edges(spark, sf_dir):
    return edges_of(raster(spark, sf_dir))


@query("SELECT DISTINCT ba AS block_id, least(wa,wb) AS u, greatest(wa,wb) AS v FROM pairs WHERE wa<>wb", VX, PAIRS)
def rag_block_edges(spark, sf_dir):
    return graph.sub_graphs(raster(spark, sf_dir), "ws")[1]


@query("SELECT DISTINCT CAST(floor(ba/4/2)*1 AS BIGINT) AS block_id, least(wa,wb) AS u, greatest(wa,wb) AS v FROM pairs WHERE wa<>wb", VX, PAIRS)
def rag_coarse_edges(spark, sf_dir):
    return graph.merge_sub_graphs(graph.sub_graphs(raster(spark, sf_dir), "ws")[1], (1000, 2, 2), 1)


@query("SELECT row_number() OVER (ORDER BY u, v) - 1 AS edge_id, u, v FROM edges", VX, PAIRS, EDGES)
def edge_ids(spark, sf_dir):
    return graph.edge_ids(edges_of(raster(spark, sf_dir)))


@query("SELECT b.block_id, e.edge_id, b.u, b.v FROM (SELECT DISTINCT ba AS block_id, least(wa,wb) AS u, greatest(wa,wb) AS v FROM pairs WHERE wa<>wb) b JOIN (SELECT row_number() OVER (ORDER BY u, v) - 1 AS edge_id, u, v FROM edges) e ON b.u=e.u AND b.v=e.v", VX, PAIRS, EDGES)
def map_edge_ids(spark, sf_dir):
    vox = raster(spark, sf_dir)
    return graph.map_edge_ids(graph.sub_graphs(vox, "ws")[1], graph.edge_ids(edges_of(vox)))


_Q = ", ".join(f"round(quantile_cont(greatest(va,vb), {q}),6) AS q{int(q * 100)}" for q in agg.QUANTILES)


@query(f"SELECT least(wa,wb) AS u, greatest(wa,wb) AS v, round(avg(greatest(va,vb)),6) AS mean, round(var_pop(greatest(va,vb)),4) AS var, min(greatest(va,vb)) AS min, {_Q}, max(greatest(va,vb)) AS max, count(*) AS size FROM pairs WHERE wa<>wb GROUP BY 1, 2", VX, PAIRS)
def edge_features(spark, sf_dir):
    out = features_of(raster(spark, sf_dir))
    return rounded(out, "mean", *[f"q{int(q * 100)}" for q in agg.QUANTILES]).withColumn("var", F.round("var", 4))


@query("SELECT least(a.ws,b.ws) AS u, greatest(a.ws,b.ws) AS v, round(avg(a.v),6) AS mean, min(a.v) AS min, max(a.v) AS max, count(*) AS size FROM vx a JOIN (SELECT 1 AS dz, 0 AS dy, 0 AS dx UNION ALL SELECT 0,2,0 UNION ALL SELECT 0,0,3) o ON TRUE JOIN vx b ON b.z=a.z+o.dz AND b.y=a.y+o.dy AND b.x=a.x+o.dx WHERE a.ws<>b.ws GROUP BY 1, 2", VX)
def edge_features_affinity(spark, sf_dir):
    vox = raster(spark, sf_dir)
    aff = vox.select(F.explode(F.array(*[F.lit(c).cast("long") for c in range(3)])).alias("c"), *AXES, "v")
    pairs = agg.affinity_pairs(vox, "ws", aff, [(1, 0, 0), (0, 2, 0), (0, 0, 3)])
    out = pairs.groupBy("u", "v").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("size"))
    return rounded(out, "mean")


@query("SELECT u, v, CASE WHEN a.label=0 OR b.label=0 THEN -1 WHEN a.label<>b.label THEN 1 ELSE 0 END AS edge_label FROM edges JOIN lab a ON u=a.node JOIN lab b ON v=b.node", VX, PAIRS, EDGES, NODE_LABEL)
def edge_labels(spark, sf_dir):
    vox = raster(spark, sf_dir)
    return voxelwise.edge_labels(edges_of(vox), node_labels(vox), ignore_label=True).select("u", "v", "edge_label")


_COST = "ln((1-p)/p) + ln((1-0.4)/0.4)"


@query(f"SELECT u, v, round(({_COST})*(size/max(size) OVER ()),6) AS cost FROM (SELECT *, least(greatest(mean/500, 0.001), 0.999) AS p FROM feats)", VX, PAIRS, FEATS)
def edge_costs(spark, sf_dir):
    feats = cheap_features(raster(spark, sf_dir)).withColumn("p", F.col("mean") / 500)
    return rounded(voxelwise.probs_to_costs(feats, size="size", beta=0.4), "cost").select("u", "v", "cost")


@query("SELECT u, v, round(CASE WHEN la<>0 AND lb<>0 THEN 5*max(c) OVER () WHEN la<>0 OR lb<>0 THEN 5*min(c) OVER () ELSE c END,6) AS cost FROM (SELECT u, v, ln((1-p)/p) AS c, CASE WHEN a.label IN (1,2) THEN a.label ELSE 0 END AS la, CASE WHEN b.label IN (1,2) THEN b.label ELSE 0 END AS lb FROM (SELECT *, least(greatest(mean/500, 0.001), 0.999) AS p FROM feats) JOIN lab a ON u=a.node JOIN lab b ON v=b.node)", VX, PAIRS, FEATS, NODE_LABEL)
def edge_costs_isolate(spark, sf_dir):
    vox = raster(spark, sf_dir)
    feats = cheap_features(vox).withColumn("p", F.col("mean") / 500)
    marks = node_labels(vox).where("label IN (1, 2)")
    return rounded(voxelwise.probs_to_costs(feats, node_labels={"isolate": marks}), "cost").select("u", "v", "cost")


@query("SELECT DISTINCT e1.v AS u, e2.v AS v FROM bi e1 JOIN bi e2 ON e1.u=e2.u WHERE e1.v<e2.v AND NOT EXISTS (SELECT 1 FROM edges WHERE edges.u=e1.v AND edges.v=e2.v)", VX, PAIRS, EDGES, "bi AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges)")
def lifted_neighborhood_depth2(spark, sf_dir):
    vox = raster(spark, sf_dir)
    everyone = vox.select(F.col("ws").alias("node"), F.lit(1).alias("label")).distinct()
    return graph.lifted_neighborhood(edges_of(vox), everyone, depth=2)


@query("SELECT u, v, CASE WHEN a.label=b.label THEN 6.0 ELSE -6.0 END::DOUBLE AS cost FROM edges JOIN lab a ON u=a.node JOIN lab b ON v=b.node", VX, PAIRS, EDGES, NODE_LABEL)
def lifted_costs(spark, sf_dir):
    vox = raster(spark, sf_dir)
    return voxelwise.costs_from_node_labels(edges_of(vox), node_labels(vox)).select("u", "v", "cost")


@query("SELECT u, v FROM edges JOIN lab a ON u=a.node JOIN lab b ON v=b.node WHERE a.label=b.label", VX, PAIRS, EDGES, NODE_LABEL)
def clear_lifted_edges(spark, sf_dir):
    vox = raster(spark, sf_dir)
    return filters.clear_lifted_edges(edges_of(vox), node_labels(vox)).select("u", "v")


@query("SELECT u, v, 1.0::DOUBLE AS cost FROM edges UNION ALL SELECT u, v, -2.0::DOUBLE FROM edges", VX, PAIRS, EDGES)
def merge_lifted_problems(spark, sf_dir):
    edges = edges_of(raster(spark, sf_dir))
    return graph.merge_lifted(edges.withColumn("cost", F.lit(1.0)), edges.withColumn("cost", F.lit(-2.0)))


@query("SELECT least(wa,wb) AS u, greatest(wa,wb) AS v, bool_or(ba<>bb) AS stitch FROM pairs WHERE wa<>wb GROUP BY 1, 2", VX, PAIRS)
def boundary_crossing_edges(spark, sf_dir):
    vox = raster(spark, sf_dir)
    return overlaps.stitch_edges(vox, "ws", edges_of(vox))


@query("SELECT DISTINCT ga AS a, gb AS b FROM pairs WHERE ba<>bb AND ga<>0 AND gb<>0", VX, PAIRS)
def face_pairs(spark, sf_dir):
    return overlaps.face_pairs(raster(spark, sf_dir), "gt")


@query("SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY c DESC, a) AS rb FROM t) WHERE ra=1 AND rb=1 AND (c/na + c/nb)/2 > 0.3", VX, BLOCK_OV, MARG)
def stitch_mutual_best(spark, sf_dir):
    return overlaps.stitch_faces(_shifted_overlaps(raster(spark, sf_dir)), 0.3)


@query("""SELECT node, dense_rank() OVER (ORDER BY root) AS label FROM (SELECT node, min(r) AS root FROM (SELECT node, node AS r FROM lab WHERE label<>0 UNION ALL SELECT x, y FROM reach) GROUP BY node)
 UNION ALL SELECT node, 0 FROM lab WHERE label=0""", VX, PAIRS, EDGES, NODE_LABEL, "same AS (SELECT u, v FROM edges JOIN lab a ON u=a.node JOIN lab b ON v=b.node WHERE a.label=b.label AND a.label<>0)", "links AS (SELECT u AS x, v AS y FROM same UNION ALL SELECT v, u FROM same)", "reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y=l.x)", recursive=True)
def graph_connected_components(spark, sf_dir):
    vox = raster(spark, sf_dir)
    return graph.label_components(spark, node_labels(vox), edges_of(vox))


_NEAR = "(SELECT 1 AS dz, 0 AS dy, 0 AS dx UNION ALL SELECT -1,0,0 UNION ALL SELECT 0,1,0 UNION ALL SELECT 0,-1,0 UNION ALL SELECT 0,0,1 UNION ALL SELECT 0,0,-1)"
# the least id reachable in ``link(a, b)``, both ways, for the ids of ``item(id)``
REACH = """least(id, low) USING KEY (id) AS (SELECT id, id FROM item UNION
  SELECT l.b, min(t.low) FROM least t JOIN link l ON l.a = t.id JOIN recurring.least r ON r.id = l.b WHERE t.low < r.low GROUP BY l.b)"""


@query(
    "SELECT vx.z, vx.y, vx.x, CAST(coalesce(low, 0) AS BIGINT) AS component FROM vx LEFT JOIN least ON id = vx.z*1000 + vx.y*40 + vx.x",
    VX,
    "item AS (SELECT z*1000 + y*40 + x AS id, z, y, x FROM vx WHERE v > 40)",
    f"link AS (SELECT a.id AS a, b.id AS b FROM item a JOIN {_NEAR} o ON TRUE JOIN item b ON b.z=a.z+o.dz AND b.y=a.y+o.dy AND b.x=a.x+o.dx)",
    REACH,
    recursive=True,
)
def voxel_connected_components(spark, sf_dir):
    vox = raster(spark, sf_dir).withColumn("voxel", F.col("z") * 1000 + F.col("y") * 40 + F.col("x")).withColumn("m", (F.col("v") > 40).cast("long"))
    return graph.voxel_components(spark, vox.select(*AXES, "m", "voxel"), "m").select(*AXES, "component")


@query("SELECT least(a.label,b.label) AS u, greatest(a.label,b.label) AS v, round(sum(mean),4) AS cost FROM feats JOIN lab a ON u=a.node JOIN lab b ON v=b.node WHERE a.label<>b.label GROUP BY 1, 2", VX, PAIRS, FEATS, NODE_LABEL)
def contract_graph(spark, sf_dir):
    vox = raster(spark, sf_dir)
    out = graph.contract(cheap_features(vox).withColumnRenamed("mean", "cost"), node_labels(vox))
    return out.withColumn("cost", F.round("cost", 4))


_SEG = "seg AS (SELECT DISTINCT ws AS node, CASE WHEN ws <= 16 THEN CASE WHEN ws <= 8 THEN 1 ELSE 2 END ELSE ws END AS label FROM vx)"


@query("""SELECT node, CASE WHEN t.to IS NOT NULL THEN t.to ELSE label END AS label FROM seg LEFT JOIN (SELECT l.u, l.to FROM lonely l LEFT JOIN lonely k ON l.to = k.u WHERE k.u IS NULL OR l.u > l.to) t ON seg.label = t.u""", VX, PAIRS, EDGES, _SEG,
 "con AS (SELECT DISTINCT least(a.label,b.label) AS u, greatest(a.label,b.label) AS v FROM edges JOIN seg a ON u=a.node JOIN seg b ON v=b.node WHERE a.label<>b.label)", "lonely AS (SELECT u, min(v) AS to FROM (SELECT u, v FROM con UNION ALL SELECT v, u FROM con) GROUP BY u HAVING count(*) = 1)")
def orphans(spark, sf_dir):
    vox = raster(spark, sf_dir)
    seg = vox.select(F.col("ws").alias("node")).distinct().withColumn("label", F.when(F.col("node") <= 8, 1).when(F.col("node") <= 16, 2).otherwise(F.col("node")).cast("long"))
    return graph.orphan_assignments(edges_of(vox), seg)


# ---- stencils


@query("""SELECT z, y, x, min(m) OVER (PARTITION BY y, x ORDER BY z RANGE BETWEEN 1 PRECEDING AND 0 FOLLOWING) AS v FROM (SELECT z, y, x, min(m) OVER (PARTITION BY z, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM
 (SELECT z, y, x, min(v) OVER (PARTITION BY z, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS m FROM vx))""", VX)
def min_filter(spark, sf_dir):
    return stencils.min_filter(raster(spark, sf_dir).select(*AXES, "v"), "v", (2, 5, 6))


_G = " + ".join(f"CASE WHEN lag(v) OVER w{c} IS NOT NULL AND lead(v) OVER w{c} IS NOT NULL THEN (lead(v) OVER w{c} - lag(v) OVER w{c})/2 WHEN lead(v) OVER w{c} IS NOT NULL THEN lead(v) OVER w{c} - v WHEN lag(v) OVER w{c} IS NOT NULL THEN v - lag(v) OVER w{c} ELSE 0 END" for c in AXES)


@query(f"SELECT z, y, x, round(({_G})/3,6) AS v FROM vx WINDOW wz AS (PARTITION BY y, x ORDER BY z), wy AS (PARTITION BY z, x ORDER BY y), wx AS (PARTITION BY z, y ORDER BY x)", VX)
def gradient(spark, sf_dir):
    return rounded(stencils.gradient(raster(spark, sf_dir).select(*AXES, "v"), "v"), "v")


@query("SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_distance_l2(spark, sf_dir):
    return _embedding_distance(spark, sf_dir, "l2")


@query("SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_distance_cosine(spark, sf_dir):
    return _embedding_distance(spark, sf_dir, "cosine")


def _embedding_distance(spark, sf_dir, norm):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z"), F.col("embedding").cast("array<double>").alias("e"))
    return stencils.embedding_distances(rows, "e", [(0, 0, 1)], norm).select(F.col("x").alias("vec_id"), F.round("v", 6).alias("d"))


@query("SELECT c, a.z, a.y, a.x, CAST(a.gt=b.gt AND a.gt<>0 AS DOUBLE) AS v FROM vx a JOIN (SELECT CAST(0 AS BIGINT) AS c, 0 AS dy, 1 AS dx UNION ALL SELECT 1, 3, 0) o ON TRUE JOIN vx b ON b.z=a.z AND b.y=a.y+o.dy AND b.x=a.x+o.dx", VX)
def object_affinities(spark, sf_dir):
    return stencils.object_affinities(raster(spark, sf_dir), "gt", [(0, 0, 1), (0, 3, 0)])


# ---- resampling and multisets

_CELL = "CAST(floor(z/2) AS BIGINT) AS z, CAST(floor(y/3) AS BIGINT) AS y, CAST(floor(x/3) AS BIGINT) AS x"


@query(f"SELECT {_CELL}, round(avg(v),6) AS v FROM vx GROUP BY 1,2,3", VX)
def downscale_mean(spark, sf_dir):
    return rounded(resample.downscale(raster(spark, sf_dir), "v", (2, 3, 3), "mean"), "v")


@query(f"SELECT {_CELL}, max(v) AS v FROM vx GROUP BY 1,2,3", VX)
def downscale_max(spark, sf_dir):
    return resample.downscale(raster(spark, sf_dir), "v", (2, 3, 3), "max")


@query(f"SELECT z, y, x, gt FROM (SELECT {_CELL}, gt, row_number() OVER (PARTITION BY CAST(floor(z/2) AS BIGINT), CAST(floor(y/3) AS BIGINT), CAST(floor(x/3) AS BIGINT) ORDER BY count(*) DESC, gt) AS r FROM vx GROUP BY 1,2,3,4, floor(z/2), floor(y/3), floor(x/3)) WHERE r = 1", VX)
def downscale_mode(spark, sf_dir):
    return resample.downscale(raster(spark, sf_dir), "gt", (2, 3, 3), "mode")


ORACLE_SQL["downscale_mode"] = f"WITH {VX}, k AS (SELECT {_CELL}, gt, count(*) AS n FROM vx GROUP BY 1,2,3,4) SELECT z, y, x, gt FROM (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY n DESC, gt) AS r FROM k) WHERE r = 1"


@query("SELECT CAST(a.z*2+i AS BIGINT) AS z, CAST(a.y*2+j AS BIGINT) AS y, CAST(a.x*2+k AS BIGINT) AS x, v FROM vx a, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j), (SELECT unnest(range(2)) AS k) WHERE a.x*2+k < 75", VX)
def upscale_nearest(spark, sf_dir):
    return resample.upscale(raster(spark, sf_dir), "v", 2, (1 << 40, 50, 75))


@query("""SELECT o.z, o.y, o.x, round(COALESCE((1-f)*a.v,0) + COALESCE(f*b.v,0),6) AS v FROM (SELECT z, y, x, floor(x*0.5+1) AS q, x*0.5+1-floor(x*0.5+1) AS f FROM vx) o
 LEFT JOIN vx a ON a.z=o.z AND a.y=o.y+2 AND a.x=o.q LEFT JOIN vx b ON b.z=o.z AND b.y=o.y+2 AND b.x=o.q+1""", VX)
def affine_linear(spark, sf_dir):
    return rounded(resample.affine(raster(spark, sf_dir), "v", [[1, 0, 0, 0], [0, 1, 0, 2], [0, 0, 0.5, 1]], _blocking(spark, sf_dir).shape), "v")


def _mirrored(at: str, n: str) -> str:
    """SQL for the place that a volume mirrored at its borders shows."""
    return f"(CASE WHEN {n} = 1 THEN 0 ELSE {n} - 1 - abs({n} - 1 - abs({at}) % (2*{n} - 2)) END)"


def _coefficients(axis: str, before: str, n: str) -> str:
    """SQL for one pass of the inverse of the sampled spline, 30 voxels either way."""
    others = " AND ".join(f"b.{c} = a.{c}" for c in AXES if c != axis)
    return f"c{axis} AS (SELECT a.z, a.y, a.x, sum(h * b.v) AS v FROM vx a CROSS JOIN tap CROSS JOIN dim JOIN {before} b ON {others} AND b.{axis} = {_mirrored(f'(a.{axis} + j)', n)} GROUP BY ALL)"


def _taps(axis: str, size: str, at: str, n: str) -> str:
    """SQL for the four coefficients that an output coordinate takes along an axis."""
    t = f"({at} - floor({at}))"
    weights = (f"(1-{t})**3", f"3*{t}**3 - 6*{t}**2 + 4", f"-3*{t}**3 + 3*{t}**2 + 3*{t} + 1", f"{t}**3")
    each = " UNION ALL ".join(f"SELECT o, {_mirrored(f'(floor({at})::BIGINT + {k - 1})', n)} AS i, ({w})/6 AS w FROM (SELECT unnest(range({size})) AS o, {n} FROM dim) WHERE {at} BETWEEN 0 AND {n} - 1" for k, w in enumerate(weights))
    return f"w{axis} AS ({each})"


@query(
    "SELECT a.z, a.y, a.x, round(COALESCE(f.v, 0), 6) AS v FROM vx a LEFT JOIN found f USING (z, y, x)",
    VX,
    "dim AS (SELECT max(z) + 1 AS nz, 25 AS ny, 40 AS nx FROM vx)",
    "tap AS (SELECT j, -6*p/(1 - p*p) * p**abs(j) AS h FROM (SELECT unnest(range(-30, 31)) AS j, sqrt(3) - 2 AS p))",
    _coefficients("x", "vx", "nx"), _coefficients("y", "cx", "ny"), _coefficients("z", "cy", "nz"),
    _taps("z", "(SELECT nz FROM dim)", "(o * 0.75)", "nz"), _taps("y", "25", "(o + 0.5)", "ny"), _taps("x", "40", "(o * 0.5 + 1)", "nx"),
    "found AS (SELECT wz.o AS z, wy.o AS y, wx.o AS x, sum(wz.w * wy.w * wx.w * c.v) AS v FROM wz, wy, wx, cz c WHERE c.z = wz.i AND c.y = wy.i AND c.x = wx.i GROUP BY ALL)",
)
def affine_cubic(spark, sf_dir):
    shape = _blocking(spark, sf_dir).shape
    return rounded(resample.affine(raster(spark, sf_dir), "v", [[0.75, 0, 0, 0], [0, 1, 0, 0.5], [0, 0, 0.5, 1]], shape, 3, source=shape, block=(4, 13, 20)), "v")


_HIST = f"h AS (SELECT {_CELL}, gt AS id, count(*) AS n FROM vx GROUP BY 1,2,3,4)"


@query("SELECT z, y, x, to_json(list({'id': id, 'count': n} ORDER BY n DESC, id)) AS hist FROM h GROUP BY z, y, x", VX, _HIST)
def label_multiset(spark, sf_dir):
    vox = agg.create_multiset(raster(spark, sf_dir), "gt")
    return agg.downscale_multiset(vox, (2, 3, 3)).withColumn("hist", F.to_json("hist"))


@query("SELECT z, y, x, to_json(list({'id': id, 'count': n} ORDER BY n DESC, id)) AS hist FROM (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY n DESC, id) AS r FROM h) WHERE r <= 3 GROUP BY z, y, x", VX, _HIST)
def label_multiset_restrict(spark, sf_dir):
    vox = agg.create_multiset(raster(spark, sf_dir), "gt")
    return agg.downscale_multiset(vox, (2, 3, 3), 3).withColumn("hist", F.to_json("hist"))


# ---- distances and checks


_BLOBS = "o AS (SELECT z, y, x, CASE WHEN v > 150 THEN CAST(floor(z/2)*64 + floor(y/5)*8 + floor(x/5) AS BIGINT) + 1 ELSE 0 END AS id FROM vx)"


@query("SELECT a.id AS a, b.id AS b, round(min(sqrt(((a.z-b.z)*2.0)**2 + (a.y-b.y)**2 + (a.x-b.x)**2)),6) AS distance FROM o a JOIN o b ON a.id < b.id AND a.id > 0 AND abs(a.z-b.z) <= 2 AND abs(a.y-b.y) <= 3 AND abs(a.x-b.x) <= 3 WHERE sqrt(((a.z-b.z)*2.0)**2 + (a.y-b.y)**2 + (a.x-b.x)**2) < 3 GROUP BY 1, 2", VX, _BLOBS)
def object_distances(spark, sf_dir):
    vox = raster(spark, sf_dir).withColumn("id", F.when(F.col("v") > 150, F.floor(F.col("z") / 2) * 64 + F.floor(F.col("y") / 5) * 8 + F.floor(F.col("x") / 5) + 1).otherwise(0).cast("long"))
    return rounded(overlaps.object_distances(vox, "id", 3.0, (2.0, 1.0, 1.0)), "distance")


@query("SELECT ws AS label, count(DISTINCT block_id) AS n_blocks FROM vx GROUP BY ws HAVING count(DISTINCT block_id) > 1", VX)
def check_components(spark, sf_dir):
    return checks.check_components(raster(spark, sf_dir), "ws", 1)


@query("SELECT DISTINCT block_id FROM vx WHERE gt = 0", VX)
def check_sub_graphs(spark, sf_dir):
    """Graphs stored without the ignore label, against all labels: blocks that hold it differ."""
    vox = raster(spark, sf_dir)
    return checks.check_sub_graphs(vox, "gt", graph.sub_graphs(vox, "gt")[0])


# ---- kernels on blocks, solvers and models: tested by brute force and invariants


def _blocking(spark, sf_dir, block=(5, 13, 20)) -> Blocking:
    depth = raster(spark, sf_dir).agg(F.max("z")).first()[0]
    return Blocking(((depth or 0) + 1, 25, 40), block)


@query()
def watershed_blocks(spark, sf_dir):
    return segmentation.watershed(raster(spark, sf_dir), "v", _blocking(spark, sf_dir), halo=(1, 2, 2), size_filter=5)


@query()
def two_pass_watershed(spark, sf_dir):
    return segmentation.two_pass_watershed(raster(spark, sf_dir), "v", _blocking(spark, sf_dir), size_filter=5)


@query()
def watershed_from_seeds(spark, sf_dir):
    vox = raster(spark, sf_dir).withColumn("seed", F.when((F.col("y") % 5 == 2) & (F.col("x") % 5 == 2), F.col("ws")).otherwise(0))
    return segmentation.watershed_from_seeds(vox, "v", "seed", _blocking(spark, sf_dir))


@query()
def filling_size_filter(spark, sf_dir):
    vox = raster(spark, sf_dir)
    sizes = vox.groupBy(F.col("gt").alias("id")).count()
    return segmentation.filling_size_filter(vox, "gt", "v", agg.size_filter(sizes, target_number=5), _blocking(spark, sf_dir))


OFFSETS = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, -3, 0), (0, 0, -3)]


def _affinities(vox: DataFrame) -> DataFrame:
    return vox.select(F.explode(F.array(*[F.lit(c).cast("long") for c in range(len(OFFSETS))])).alias("c"), *AXES, (1 - F.col("v") / 500).alias("v"))


@query()
def mutex_watershed_blocks(spark, sf_dir):
    return segmentation.mutex_watershed(_affinities(raster(spark, sf_dir)), OFFSETS, _blocking(spark, sf_dir), size_filter=0)


@query()
def two_pass_mutex_watershed(spark, sf_dir):
    vox, pairs = segmentation.two_pass_mutex_watershed(_affinities(raster(spark, sf_dir)), OFFSETS, _blocking(spark, sf_dir))
    lut = graph.merge_assignments(spark, vox.select(F.col("ws").alias("label")).distinct(), pairs)
    return voxelwise.write_labels(vox, "ws", lut.select(F.col("node").alias("label"), F.col("label").alias("new_label"))).select(*AXES, "ws")


@query(
    "SELECT n.z, n.y, n.x, n.block_id, CAST(coalesce(dense_rank() OVER (PARTITION BY low IS NULL ORDER BY low) * (low IS NOT NULL)::INT, 0) AS BIGINT) AS component FROM n LEFT JOIN least ON least.id = n.id",
    VX,
    "n AS (SELECT *, block_id*10000 + ((z%5)*13 + y%13)*20 + x%20 AS id, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) > 0.2 AS m FROM vx WINDOW w AS (PARTITION BY block_id))",
    "item AS (SELECT * FROM n WHERE m)",
    f"link AS (SELECT a.id AS a, b.id AS b FROM item a JOIN {_NEAR} o ON TRUE JOIN item b ON b.z=a.z+o.dz AND b.y=a.y+o.dy AND b.x=a.x+o.dx)",
    REACH,
    recursive=True,
)
def connected_component_blocks(spark, sf_dir):
    return segmentation.connected_components(spark, raster(spark, sf_dir), "v", _blocking(spark, sf_dir), threshold=0.2)


@query()
def agglomerate_blocks(spark, sf_dir):
    return segmentation.agglomerate(raster(spark, sf_dir), "ws", "v", _blocking(spark, sf_dir), threshold=0.2)


@query()
def slice_agglomeration(spark, sf_dir):
    blocking = _blocking(spark, sf_dir)
    return segmentation.slice_agglomeration(raster(spark, sf_dir), "ws", "v", blocking.shape, blocking)


#: Least and greatest value of each block with a halo.
_BOX = lambda hz, hy, hx: f"box AS (SELECT o.block_id, min(v) AS low, max(v) AS high FROM (SELECT DISTINCT block_id, floor(z/5) AS i, floor(y/13) AS j, floor(x/20) AS k FROM vx) o JOIN vx ON z BETWEEN i*5-{hz} AND i*5+{4 + hz} AND y BETWEEN j*13-{hy} AND j*13+{12 + hy} AND x BETWEEN k*20-{hx} AND k*20+{19 + hx} GROUP BY o.block_id)"


def _smooth(name: str, of: str, axis: str) -> str:
    """Weighted sums along an axis, mirrored at the ends."""
    rest = " AND ".join(f"b.{c} = a.{c}" for c in AXES if c != axis)
    j = f"(((a.{axis} + g.t) % (2 * n{axis}) + 2 * n{axis}) % (2 * n{axis}))"
    return f"{name} AS (SELECT a.z, a.y, a.x, sum(g.w * b.v) AS v FROM {of} a CROSS JOIN g CROSS JOIN dim JOIN {of} b ON {rest} AND b.{axis} = least({j}, 2 * n{axis} - 1 - {j}) GROUP BY ALL)"


@query(
    "SELECT z, y, x, block_id, round((sx.v - low) / (high - low), 6) AS v FROM sx JOIN (SELECT z, y, x, block_id FROM vx) USING (z, y, x) JOIN box USING (block_id)",
    VX, _BOX(3, 4, 4),
    "dim AS (SELECT max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM vx)",
    "g AS (SELECT t, exp(-0.5 * t * t) / sum(exp(-0.5 * t * t)) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS t))",
    _smooth("sz", "vx", "z"), _smooth("sy", "sz", "y"), _smooth("sx", "sy", "x"),
)
def image_filter_gaussian(spark, sf_dir):
    return rounded(stencils.image_filter(raster(spark, sf_dir), "v", _blocking(spark, sf_dir), "gaussianSmoothing", 1.0, (3, 4, 4)), "v")


@query(
    "SELECT a.c, a.z, a.y, a.x, round(least(1.0, greatest(0.0, a.v + coalesce(o.o, 0))), 6) AS v FROM (SELECT c, z, y, x, 1 - v/500 AS v FROM vx, (SELECT unnest(range(3)) AS c)) a LEFT JOIN o USING (c, z, y, x)",
    VX,
    "b AS (SELECT o.c, a.z, a.y, a.x, CASE WHEN a.ws = b.ws AND a.ws <> 0 THEN 0.0 ELSE 1.0 END AS v FROM vx a, (SELECT 0 AS c, 1 AS dz, 0 AS dy, 0 AS dx UNION ALL SELECT 1,0,1,0 UNION ALL SELECT 2,0,0,1) o JOIN vx b ON b.z=a.z-o.dz AND b.y=a.y-o.dy AND b.x=a.x-o.dx)",
    "wy AS (SELECT c, z, y, x, max(v) OVER (PARTITION BY c, z, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM b)",
    "wx AS (SELECT c, z, y, x, max(v) OVER (PARTITION BY c, z, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM wy)",
    "p AS (SELECT z, y, x, avg(v) AS p FROM wx WHERE c IN (1, 2) GROUP BY ALL)",
    "o AS (SELECT c, z, y, x, CASE WHEN c = 0 THEN v + coalesce(p, 0) ELSE v END AS o FROM wx LEFT JOIN p USING (z, y, x))",
)
def insert_affinities(spark, sf_dir):
    vox = raster(spark, sf_dir)
    return rounded(_inserted(vox), "v")


def _inserted(vox: DataFrame) -> DataFrame:
    return stencils.insert_affinities(_affinities(vox).where("c < 3"), vox, "ws", OFFSETS[:3], dilate_by=1)


@query()
def scale_to_boundaries(spark, sf_dir):
    return stencils.scale_to_boundaries(raster(spark, sf_dir), "ws", "v", _blocking(spark, sf_dir), erode_by=2, offset=10_000, halo=(1, 2, 2))


def _problem(spark, sf_dir):
    vox = raster(spark, sf_dir)
    costs = voxelwise.probs_to_costs(cheap_features(vox).withColumn("p", F.col("mean") / 150), size="size")
    return vox, graph.sub_graphs(vox, "ws")[0], costs


@query()
def multicut_subproblems(spark, sf_dir):
    _, nodes, costs = _problem(spark, sf_dir)
    return solvers.solve_subproblems(nodes, costs)


@query()
def multicut_labels(spark, sf_dir):
    vox, nodes, costs = _problem(spark, sf_dir)
    return solvers.multicut(spark, nodes, costs, _blocking(spark, sf_dir).grid)


@query()
def multicut_sub_solutions(spark, sf_dir):
    _, nodes, costs = _problem(spark, sf_dir)
    return solvers.sub_solutions(solvers.solve_subproblems(nodes, costs), nodes, costs, spark)


@query()
def lifted_multicut_labels(spark, sf_dir):
    vox, nodes, costs = _problem(spark, sf_dir)
    labels = node_labels(vox)
    lifted = voxelwise.costs_from_node_labels(graph.lifted_neighborhood(costs, labels, 2), labels, 0.5, -0.5)
    return solvers.multicut(spark, nodes, costs, _blocking(spark, sf_dir).grid, lifted=lifted.select("u", "v", "cost"))


@query()
def reduced_problem(spark, sf_dir):
    _, nodes, costs = _problem(spark, sf_dir)
    return graph.reduce_problem(spark, nodes.select("node").distinct(), costs, solvers.solve_subproblems(nodes, costs))[1]


@query()
def stitching_multicut(spark, sf_dir):
    vox, nodes, costs = _problem(spark, sf_dir)
    edges = overlaps.stitch_edges(vox, "ws", costs.withColumn("mean", F.col("p")))
    return solvers.stitching_multicut(spark, nodes.select("node").distinct(), edges)


@query(
    "SELECT id AS node, dense_rank() OVER (ORDER BY low) AS label FROM least",
    VX, PAIRS, FEATS,
    "item AS (SELECT DISTINCT ws AS id FROM vx)",
    "cross_ AS (SELECT DISTINCT least(wa,wb) AS u, greatest(wa,wb) AS v FROM pairs WHERE wa<>wb AND ba<>bb)",
    "merge_ AS (SELECT u, v FROM feats JOIN cross_ USING (u, v) WHERE size > 5)",
    "link AS (SELECT u AS a, v AS b FROM merge_ UNION ALL SELECT v, u FROM merge_)",
    REACH,
    recursive=True,
)
def stitch_assignments(spark, sf_dir):
    """Every node, also those on no edge between blocks."""
    vox, nodes, costs = _problem(spark, sf_dir)
    return overlaps.stitch_assignments(spark, overlaps.stitch_edges(vox, "ws", costs), 5, nodes=nodes)


@query()
def agglomerative_clustering(spark, sf_dir):
    vox, nodes, costs = _problem(spark, sf_dir)
    return solvers.agglomerative_clustering(spark, nodes, costs.select("u", "v", "mean", "size"), 65.0)


@query(
    "SELECT node, greatest(coalesce(s.seed, t.seed, 0), 0) AS label FROM lab LEFT JOIN seeds s USING (node) LEFT JOIN ends USING (node) LEFT JOIN seeds t ON t.node = ends.goal",
    VX, PAIRS, FEATS, NODE_LABEL,
    "kept AS (SELECT label FROM lab GROUP BY label ORDER BY count(*) DESC, label LIMIT 5)",
    "seeds AS (SELECT node, CASE WHEN label = 0 THEN -1 ELSE label END AS seed FROM lab JOIN kept USING (label))",
    "e AS (SELECT u, v, row_number() OVER (ORDER BY round(mean, 6), u, v) AS r FROM feats)",
    "link AS (SELECT u AS a, v AS b, r FROM e UNION ALL SELECT v, u, r FROM e)",
    # the heaviest edge on the way from a seed, over all ways; the lightest of those is where the node's part meets another
    "reach AS (SELECT node, CAST(0 AS BIGINT) AS r FROM seeds UNION SELECT b, greatest(reach.r, link.r) FROM reach JOIN link ON a = node WHERE b NOT IN (SELECT node FROM seeds))",
    "near AS (SELECT node, min(r) AS r FROM reach GROUP BY node)",
    "step AS (SELECT n.node, CASE WHEN nu.r < nv.r THEN e.u ELSE e.v END AS goal FROM near n JOIN e USING (r) JOIN near nu ON nu.node = e.u JOIN near nv ON nv.node = e.v)",
    "follow AS (SELECT node, goal FROM step UNION ALL SELECT follow.node, step.goal FROM follow JOIN step ON step.node = follow.goal)",
    "ends AS (SELECT node, goal FROM follow WHERE goal IN (SELECT node FROM seeds))",
    recursive=True,
)
def graph_watershed_assignments(spark, sf_dir):
    vox, nodes, costs = _problem(spark, sf_dir)
    labels = node_labels(vox)
    discard = agg.size_filter(labels.groupBy(F.col("label").alias("id")).count(), target_number=5)
    return solvers.graph_watershed_assignments(spark, rounded(costs, "mean"), labels, discard)


FAR = (
    "bb AS (SELECT ws, min(z) - 1 AS z0, max(z) + 1 AS z1, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM vx GROUP BY ws)",
    "box AS (SELECT ws, z, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT ws, z, x0, x1, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(z0, z1 + 1)) AS z FROM bb)))",
    "free AS (SELECT ws, z, y, x FROM box ANTI JOIN vx USING (ws, z, y, x))",
    "far AS (SELECT a.ws AS id, a.z, a.y, a.x, min((a.z-f.z)**2 + (a.y-f.y)**2 + (a.x-f.x)**2) AS d FROM vx a JOIN free f ON a.ws = f.ws GROUP BY ALL)",
)


@query("SELECT id, z, y, x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC, z, y, x) AS r FROM far) WHERE r = 1", VX, *FAR)
def region_centers(spark, sf_dir):
    return objects.region_centers(raster(spark, sf_dir), "ws")


@query("SELECT z, y, x, id AS ws, round(sqrt(d), 6) AS distance FROM far", VX, *FAR)
def distance_transform(spark, sf_dir):
    return rounded(distances.distance_transform(raster(spark, sf_dir), "ws"), "distance")


@query(
    """SELECT id, vertices, CAST(faces * 3 // 2 AS BIGINT) AS edges, faces, CAST(0 AS BIGINT) AS open_edges, CAST(vertices - faces // 2 AS BIGINT) AS euler, round(volume, 6) AS volume
  FROM cut JOIN ends USING (id)""",
    VX,
    "own AS (SELECT gt AS id, z, y, x FROM vx WHERE gt <> 0)",
    # eight voxel centres make a cell, six tetrahedra fill it: ways from corner 0 to corner 7 over p and q
    "cell AS (SELECT id, z - k // 4 AS z, y - k // 2 % 2 AS y, x - k % 2 AS x, sum(1 << k) AS code FROM own, (SELECT unnest(range(8))::INT AS k) GROUP BY ALL)",
    "way AS (SELECT * FROM (VALUES (4, 6), (4, 5), (2, 6), (2, 3), (1, 5), (1, 3)) w(p, q))",
    "tet AS (SELECT id, (code::INT & 1) + (code::INT >> p & 1) + (code::INT >> q & 1) + (code::INT >> 7 & 1) AS n FROM cell, way)",
    # one corner of four cut off takes an eighth of a tetrahedron, two of them half
    "cut AS (SELECT id, CAST(sum(CASE n WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END) AS BIGINT) AS faces, sum(CASE n WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 7 WHEN 4 THEN 8 ELSE 0 END) / 48 AS volume FROM tet GROUP BY id)",
    # a vertex for each voxel of the object and each end, outside of it, of an edge of a tetrahedron
    "step AS (SELECT s * (k // 4) AS dz, s * (k // 2 % 2) AS dy, s * (k % 2) AS dx FROM (SELECT unnest(range(1, 8)) AS k), (SELECT unnest([-1, 1]) AS s))",
    "ends AS (SELECT id, count(*) AS vertices FROM (SELECT id, z + dz AS z, y + dy AS y, x + dx AS x FROM own, step) ANTI JOIN own USING (id, z, y, x) GROUP BY id)",
)
def surface_measures(spark, sf_dir):
    """True labels as objects, each of many parts: their surfaces by blocks, welded, closed and measured."""
    own = raster(spark, sf_dir).where("gt <> 0").select(*AXES, F.col("gt").alias("id"))
    return rounded(surfaces.object_measures(own, (4, 13, 20)), "volume").drop("area")


@query()
def skeletons(spark, sf_dir):
    return objects.skeletonize(raster(spark, sf_dir), "ws")


@query()
def surface_meshes(spark, sf_dir):
    return objects.meshes(raster(spark, sf_dir), "ws", size_threshold=10)


@query()
def rf_edge_probability(spark, sf_dir):
    vox = raster(spark, sf_dir)
    feats = features_of(vox)
    labelled = voxelwise.edge_labels(feats, node_labels(vox))
    names = ["mean", "var", "min", "max", "size"]
    model = models.learn_forest(labelled, names, trees=20)
    return models.predict_edges(model, feats.select("u", "v", *names)).select("u", "v", F.round("p", 6).alias("p"))


@query(
    "SELECT c, z, y, x, round(CASE WHEN c = 0 THEN n ELSE 1 - n END, 6) AS v FROM (SELECT z, y, x, (v - low) / (high - low) AS n FROM vx JOIN box USING (block_id)), (SELECT unnest([CAST(0 AS BIGINT), 1]) AS c)",
    VX, _BOX(1, 2, 2),
)
def block_inference(spark, sf_dir):
    found = models.inference(raster(spark, sf_dir), "v", _blocking(spark, sf_dir), _two_channels, {"out": (0, 2)}, (1, 2, 2), preprocess="normalize")
    return rounded(found["out"], "v")


def _two_channels(data):
    import numpy as np

    return np.stack([data, 1 - data])


# ---- the same operators where SQL can say what must come out: given cuts, given pairs, and what every solution must keep


_CUT = "cut AS (SELECT u, v FROM feats WHERE mean >= 70)"
_KEPT = "kept AS (SELECT u, v FROM feats ANTI JOIN cut USING (u, v))"
_KEPT_LINK = "link AS (SELECT u AS a, v AS b FROM kept UNION ALL SELECT v, u FROM kept)"
_NODES = "item AS (SELECT DISTINCT ws AS id FROM vx)"
_LABELING = "labeling AS (SELECT id AS node, dense_rank() OVER (ORDER BY low) AS label FROM least)"


def _given_cut(spark, sf_dir):
    vox = raster(spark, sf_dir)
    edges = cheap_features(vox).withColumn("cost", 70 - F.col("mean"))
    return vox, vox.select(F.col("ws").alias("node")).distinct(), edges, edges.where("mean >= 70").select("u", "v")


@query(
    "SELECT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, round(sum(70 - mean), 4) AS cost FROM feats JOIN labeling a ON u = a.node JOIN labeling b ON v = b.node WHERE a.label <> b.label GROUP BY 1, 2",
    VX, PAIRS, FEATS, _CUT, _KEPT, _NODES, _KEPT_LINK, REACH, _LABELING,
    recursive=True,
)
def reduced_problem_of_cut(spark, sf_dir):
    _, nodes, edges, cut = _given_cut(spark, sf_dir)
    return graph.reduce_problem(spark, nodes, edges.select("u", "v", "cost"), cut)[1].withColumn("cost", F.round("cost", 4))


@query(
    "SELECT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, CAST(sum(c) AS BIGINT) AS cost FROM (SELECT p.id AS u, q.id AS v, p.id % 5 - 2 AS c FROM item p JOIN item q ON q.id = p.id + 2) JOIN labeling a ON u = a.node JOIN labeling b ON v = b.node WHERE a.label <> b.label GROUP BY 1, 2",
    VX, PAIRS, FEATS, _CUT, _KEPT, _NODES, _KEPT_LINK, REACH, _LABELING,
    recursive=True,
)
def reduced_lifted_problem_of_cut(spark, sf_dir):
    _, nodes, edges, cut = _given_cut(spark, sf_dir)
    lifted = nodes.select(F.col("node").alias("u"), (F.col("node") + 2).alias("v")).join(nodes.select(F.col("node").alias("v")), "v").select("u", "v", (F.col("u") % 5 - 2).alias("cost"))
    return graph.reduce_problem(spark, nodes, edges.select("u", "v", "cost"), cut, lifted=lifted)[2].withColumn("cost", F.col("cost").cast("long"))


@query(
    "SELECT block_id, node, dense_rank() OVER (ORDER BY block_id, low) AS label FROM (SELECT DISTINCT block_id, ws AS node FROM vx) JOIN least ON node = id",
    VX, PAIRS, FEATS, _CUT, _KEPT, _NODES, _KEPT_LINK, REACH,
    recursive=True,
)
def sub_solutions_of_cut(spark, sf_dir):
    vox, _, edges, cut = _given_cut(spark, sf_dir)
    return solvers.sub_solutions(cut, graph.sub_graphs(vox, "ws")[0], edges, spark)


_FACES = "faces AS (SELECT DISTINCT wa AS a, wb AS b FROM pairs WHERE ba <> bb AND wa <> wb)"


@query(
    "SELECT id AS node, dense_rank() OVER (ORDER BY low) AS label FROM least UNION ALL SELECT 0, 0",
    VX, PAIRS, _FACES, _NODES, "picked AS (SELECT a, b FROM faces WHERE a % 2 = 0)", "link AS (SELECT a, b FROM picked UNION ALL SELECT b, a FROM picked)", REACH,
    recursive=True,
)
def merge_assignments(spark, sf_dir):
    vox = raster(spark, sf_dir)
    labels = vox.select(F.col("ws").alias("label")).distinct().unionByName(spark.range(1).select(F.col("id").alias("label")))
    return graph.merge_assignments(spark, labels, overlaps.face_pairs(vox, "ws").where("a % 2 = 0 AND a <> b"))


@query(
    "SELECT id AS node, dense_rank() OVER (ORDER BY low) AS label FROM least",
    VX, PAIRS, _FACES, "item AS (SELECT DISTINCT ws + 1000 AS id FROM vx)", "picked AS (SELECT a + 1000 AS a, b + 1000 AS b FROM faces WHERE a % 3 <> 0)", "link AS (SELECT a, b FROM picked UNION ALL SELECT b, a FROM picked)", REACH,
    recursive=True,
)
def two_pass_assignments(spark, sf_dir):
    """Seeds of the second pass in old labels; the relabelling moves all by 1000."""
    vox = raster(spark, sf_dir)
    relabel_ = vox.select(F.col("ws").alias("label"), (F.col("ws") + 1000).alias("new_label")).distinct()
    labels = relabel_.select(F.col("new_label").alias("label"))
    return graph.two_pass_assignments(spark, overlaps.face_pairs(vox, "ws").where("a % 3 <> 0 AND a <> b"), relabel_, labels)


@query("SELECT DISTINCT a.z, a.y, a.x, a.ws AS id FROM vx a JOIN (SELECT ws, z, y, x + 3 AS x FROM vx WHERE z % 2 = 0 AND (y + x) % 7 = 0) n USING (ws, z, y, x)", VX)
def upsample_skeletons(spark, sf_dir):
    """Nodes on a grid half as deep, some outside their object."""
    vox = raster(spark, sf_dir)
    node = F.array(F.col("z") / 2, F.col("y").cast("double"), (F.col("x") + 3).cast("double"))
    coarse = vox.where("z % 2 = 0 AND (y + x) % 7 = 0").groupBy(F.col("ws").alias("id")).agg(F.collect_list(node).alias("nodes"))
    return objects.upsample_skeletons(coarse, vox, "ws", (2, 1, 1))


@query(
    "SELECT round(avg((NOT m AND la = lb)::INT), 6) AS correct, round(avg((NOT m AND la <> lb)::INT), 6) AS split, round(avg(m::INT), 6) AS merge, (SELECT count(*) FROM merged) AS n_merges FROM e",
    VX,
    "n AS (SELECT floor(z/2)*5 + floor(y/5) AS s, x, CASE WHEN ws % 7 = 0 THEN 7 WHEN ws % 11 = 0 THEN 0 ELSE ws END AS l FROM vx WHERE z % 2 = 0 AND y % 5 = 0)",
    "merged AS (SELECT l FROM n WHERE l <> 0 GROUP BY l HAVING count(DISTINCT s) > 1)",
    "e AS (SELECT a.l AS la, b.l AS lb, a.l IN (SELECT l FROM merged) OR b.l IN (SELECT l FROM merged) AS m FROM n a JOIN n b ON a.s = b.s AND b.x = a.x + 1)",
)
def skeleton_evaluation(spark, sf_dir):
    """Lines along x as skeletons; some labels are shared by several, some lost."""
    vox = raster(spark, sf_dir).withColumn("l", F.expr("CASE WHEN ws % 7 = 0 THEN 7 WHEN ws % 11 = 0 THEN 0 ELSE ws END").cast("long"))
    nodes = vox.where("z % 2 = 0 AND y % 5 = 0").select((F.floor(F.col("z") / 2) * 5 + F.floor(F.col("y") / 5)).alias("skeleton"), F.col("x").alias("node"), *AXES)
    edges = nodes.where("x < 39").select("skeleton", F.col("node").alias("u"), (F.col("node") + 1).alias("v"))
    return rounded(evaluation.skeleton_evaluation(nodes, edges, vox, "l"), "correct", "split", "merge")


@query("SELECT CAST(ws AS BIGINT) AS id, count(*) AS size, " + ", ".join(f"round(avg({c}), 6) AS com_{c}, min({c}) AS bbmin_{c}, max({c}) AS bbmax_{c}" for c in AXES) + " FROM vx GROUP BY ws", VX)
def morphology_every_label(spark, sf_dir):
    """All labels of the table, whatever their number."""
    return rounded(agg.merge_morphology(agg.morphology(raster(spark, sf_dir), "ws", by_block=True)), "com_z", "com_y", "com_x")


def _kept(spark, name: str, labels: DataFrame, nodes: DataFrame, edges: DataFrame, costs: bool = True) -> DataFrame:
    """What a partition of a graph must keep, as one row."""
    scratch = Scratch(spark, "invariants")
    labels = scratch.save(labels.select("node", "label"), "labels")
    missing = nodes.select("node").distinct().join(labels, "node", "left_anti").agg(F.count("*").alias("missing"))
    # clusters that edges between their own nodes don't connect
    parts = graph.label_components(spark, labels, edges.select("u", "v"), ignore_label=False)
    split = parts.agg(F.count_distinct("label").alias("parts")).crossJoin(labels.agg(F.count_distinct("label").alias("labels"), F.count("*").alias("nodes")))
    energy = voxelwise.with_ends(edges, labels).agg(F.coalesce(F.sum(F.when(F.col("lu") != F.col("lv"), F.col("cost"))), F.lit(0.0)).alias("energy"), F.sum("cost").alias("apart"))
    fine = (F.col("energy") <= F.least(F.lit(0.0), F.col("apart")) + 1e-9) if costs else F.lit(True)
    row = split.crossJoin(missing).crossJoin(energy)  # one row each
    return row.select(F.lit(name).alias("solver"), "nodes", "missing", (F.col("parts") - F.col("labels")).alias("split"), fine.alias("no_worse_than_trivial"))


def _expected(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS solver, (SELECT count(DISTINCT ws) FROM vx) AS nodes, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS split, TRUE AS no_worse_than_trivial" for n in names)


@query(_expected(["multicut in rounds", "average linkage in rounds"]), VX)
def contraction_invariants(spark, sf_dir):
    """The same of what rounds of contraction alone make, without a kernel for the remainder."""
    vox, nodes, costs = _problem(spark, sf_dir)
    scratch = Scratch(spark, "problem")
    nodes, costs = scratch.save(nodes, "nodes"), scratch.save(costs, "costs")
    linked = solvers.agglomerative_clustering(spark, nodes, costs.select("u", "v", "mean", "size"), 65.0, largest=0)
    return _kept(spark, "multicut in rounds", solvers.solve_global(spark, nodes, costs, largest=0), nodes, costs).unionByName(_kept(spark, "average linkage in rounds", linked, nodes, costs, False))


@query(_expected(["multicut", "global multicut", "stitching multicut", "agglomerative clustering"]), VX)
def solver_invariants(spark, sf_dir):
    """Every node has a label, clusters are connected, and no solution costs more than one cluster or all nodes apart."""
    vox, nodes, costs = _problem(spark, sf_dir)
    scratch = Scratch(spark, "problem")
    nodes, costs = scratch.save(nodes, "nodes"), scratch.save(costs, "costs")
    stitch = overlaps.stitch_edges(vox, "ws", costs.withColumn("mean", F.col("p")))
    rows = [
        _kept(spark, "multicut", solvers.multicut(spark, nodes, costs, _blocking(spark, sf_dir).grid), nodes, costs),
        _kept(spark, "global multicut", solvers.solve_global(spark, nodes, costs), nodes, costs),
        _kept(spark, "stitching multicut", solvers.stitching_multicut(spark, nodes.select("node").distinct(), stitch), nodes, costs, False),
        _kept(spark, "agglomerative clustering", solvers.agglomerative_clustering(spark, nodes, costs.select("u", "v", "mean", "size"), 65.0), nodes, costs, False),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


_SEGMENTATIONS = ["watershed", "two pass watershed", "watershed from seeds", "mutex watershed", "agglomeration"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS segmentation, (SELECT count(*) FROM vx) AS voxels, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS split" for n in _SEGMENTATIONS), VX)
def segmentation_invariants(spark, sf_dir):
    """Every voxel has a label, and each label's voxels are connected."""
    vox, blocking = raster(spark, sf_dir), _blocking(spark, sf_dir)
    seeded = vox.withColumn("seed", F.when((F.col("y") % 5 == 2) & (F.col("x") % 5 == 2), F.col("ws")).otherwise(0))
    in_block = F.col("block_id") * (blocking.shape[0] * blocking.shape[1] * blocking.shape[2])  # no label is greater than that
    made = [
        segmentation.watershed(vox, "v", blocking),
        segmentation.two_pass_watershed(vox, "v", blocking),
        segmentation.watershed_from_seeds(seeded.withColumn("seed", F.when(F.col("seed") > 0, in_block + F.col("seed")).otherwise(0)), "v", "seed", blocking),
        segmentation.mutex_watershed(_affinities(vox), OFFSETS, blocking, size_filter=0),
        # fragments of one block each, as a watershed gives them
        segmentation.agglomerate(vox.withColumn("ws", in_block + F.col("ws")), "ws", "v", blocking, threshold=0.2),
    ]
    out = None
    for name, found in zip(_SEGMENTATIONS, made):
        labelled = found.select(*AXES, F.col("ws").cast("long").alias("ws"), (F.col("z") * 1000 + F.col("y") * 40 + F.col("x")).alias("voxel"))
        parts = graph.voxel_components(spark, Scratch(spark, "segments").save(labelled, "labels"), "ws")
        row = parts.agg(F.count("*").alias("voxels"), F.count_if(F.col("ws") == 0).alias("uncovered"), (F.count_distinct("ws", "component") - F.count_distinct("ws")).alias("split"))
        row = row.select(F.lit(name).alias("segmentation"), "voxels", "uncovered", "split")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def filtered_edge_features(spark, sf_dir):
    found = agg.filtered_edge_features(raster(spark, sf_dir), "ws", "v", _blocking(spark, sf_dir), {"gaussianSmoothing": [1.0], "laplacianOfGaussian": [1.0]}, (3, 4, 4))
    return rounded(found, "mean", "var", "min", "max")


@query("SELECT z, y, x, block_id, round(v - avg(v) OVER (PARTITION BY z, floor(y/5), floor(x/5)), 6) AS v FROM vx", VX)
def multiscale_inference(spark, sf_dir):
    vox = raster(spark, sf_dir).select(*AXES, "v")
    found = models.multiscale_inference([vox, resample.downscale(vox, "v", (1, 5, 5), "mean")], "v", [(1, 5, 5)], _blocking(spark, sf_dir), _fine_less_coarse, [(0, 2, 2), (0, 1, 1)])
    return rounded(found, "v")


def _fine_less_coarse(data):
    return data[0] - data[1]


_RANK = ", ".join(f"max(CASE WHEN cum - n < {q} * total AND cum >= {q} * total THEN 500.0 / 64 * (bin + ({q} * total - (cum - n)) / n) END) AS q{int(q * 100)}" for q in agg.QUANTILES)


@query(
    "SELECT m.u, m.v, round(mean, 6) AS mean, round(var, 4) AS var, mn AS min, " + ", ".join(f"round(greatest(mn, least(mx, q{int(q * 100)})), 6) AS q{int(q * 100)}" for q in agg.QUANTILES) + ", mx AS max, size FROM m JOIN r USING (u, v)",
    VX, PAIRS,
    "h AS (SELECT least(wa, wb) AS u, greatest(wa, wb) AS v, greatest(va, vb) AS x FROM pairs WHERE wa <> wb)",
    "b AS (SELECT u, v, CAST(greatest(0, least(63, floor(x / (500.0::DOUBLE / 64)))) AS BIGINT) AS bin, count(*) AS n FROM h GROUP BY ALL)",
    "c AS (SELECT *, sum(n) OVER (PARTITION BY u, v ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY u, v) AS total FROM b)",
    "r AS (SELECT u, v, " + _RANK.replace("500.0", "500.0::DOUBLE") + " FROM c GROUP BY u, v)",
    "m AS (SELECT u, v, avg(x) AS mean, var_pop(x) AS var, min(x) AS mn, max(x) AS mx, count(*) AS size FROM h GROUP BY u, v)",
)
def edge_features_by_histogram(spark, sf_dir):
    """Histograms of each block's edges, merged; the SQL has them of the whole at once."""
    parts = agg.edge_histograms(agg.edge_pairs(raster(spark, sf_dir), "ws", "v", by_block=True), 0.0, 500.0, by=("block_id",))
    found = agg.histogram_features(agg.merge_edge_histograms(parts), 0.0, 500.0)
    return rounded(found, "mean", *[f"q{int(q * 100)}" for q in agg.QUANTILES]).withColumn("var", F.round("var", 4))
