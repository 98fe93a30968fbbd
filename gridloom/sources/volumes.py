"""Reading and writing of volumes, label tables and files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import AXES, Blocking, region

SLICE, ROW = 1000, 40


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a volume of slices of 25 x 40 voxels, with values, supervoxels and true labels."""
    at = F.col("event_id")
    z, y, x = F.floor(at / SLICE).cast("long"), F.floor((at % SLICE) / ROW).cast("long"), (at % ROW).cast("long")
    vox = spark.read.parquet(f"{sf_dir}/events.parquet").select(z.alias("z"), y.alias("y"), x.alias("x"), F.col("value").alias("v"), (F.col("user_id") % 10).alias("gt"))
    ws = (1 + F.floor(F.col("z") / 2) * 40 + F.floor(F.col("y") / 5) * 8 + F.floor(F.col("x") / 5)).cast("long")
    block = (F.floor(F.col("z") / 5) * 4 + F.floor(F.col("y") / 13) * 2 + F.floor(F.col("x") / 20)).cast("long")
    return vox.withColumns({"ws": ws, "block_id": block})


def write_volume(vox: DataFrame, path: str, blocking: Blocking, attributes: dict | None = None, mode: str = "overwrite") -> None:
    """A voxel table partitioned by block layer and sorted, so that a region prunes files; attributes go beside it."""
    placed = vox.withColumn("block_id", blocking.block_id())
    layer = F.floor(F.col("z") / blocking.block[0]).cast("long")
    out = placed.withColumn("bz", layer).repartition("bz", "block_id").sortWithinPartitions("block_id", *AXES)
    out.write.mode(mode).partitionBy("bz").parquet(path)
    meta = {"shape": list(blocking.shape), "block": list(blocking.block), **(attributes or {})}
    spark = vox.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.attributes")


def read_attributes(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.attributes").first()[0])


def read_volume(spark: SparkSession, path: str, begin=None, end=None) -> DataFrame:
    """The voxels of a written volume, or those of a region; whole layers of blocks are skipped."""
    vox = spark.read.parquet(path)
    if begin is None:
        return vox.drop("bz")
    depth = read_attributes(spark, path)["block"][0]
    layers = (F.col("bz") >= begin[0] // depth) & (F.col("bz") <= (end[0] - 1) // depth)
    return region(vox.where(layers), begin, end).drop("bz")


def read_arrays(spark: SparkSession, pattern: str, value: str = "v") -> DataFrame:
    """``(file, c, z, y, x, value)`` of .npy files of up to four dimensions, each decoded by one task."""

    def decode(batches):
        import io

        import numpy as np
        import pandas as pd

        for frame in batches:
            for name, content in zip(frame["path"], frame["content"]):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                if data.ndim > 4:
                    raise ValueError(f"{name}: {data.ndim} dimensions")
                data = data.reshape((1,) * (4 - data.ndim) + data.shape)
                for c, channel in enumerate(data):
                    for z, plane in enumerate(channel):
                        y, x = np.indices(plane.shape)
                        yield pd.DataFrame({"file": name, "c": c, "z": z, "y": y.ravel(), "x": x.ravel(), value: plane.ravel().astype(float)})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(decode, f"file string, c long, z long, y long, x long, {value} double")


def block_list(blocks: DataFrame, path: str) -> None:
    blocks.select(F.to_json(F.struct("block_id"))).coalesce(1).write.mode("overwrite").text(path)
