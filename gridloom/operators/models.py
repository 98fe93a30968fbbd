"""Models: random forests on edge features, and prediction of voxels by any callable on blocks with a halo."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import AXES, Blocking
from gridloom.operators import kernels
from gridloom.operators.blockwise import map_blocks


def learn_forest(features: DataFrame, names: list[str], label: str = "edge_label", trees: int = 100, seed: int = 7) -> PipelineModel:
    """A forest on labelled rows; a label of -1 is none."""
    rows = VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="keep").transform(features.where(F.col(label) != -1))
    return PipelineModel([VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="keep"), RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, seed=seed).fit(rows)])


def predict_edges(model: PipelineModel, features: DataFrame, out: str = "p") -> DataFrame:
    """The probability of label 1."""
    done = model.transform(features)
    return done.withColumn(out, vector_to_array("probability")[1]).select(*features.columns, out)


#: Ways to prepare a block before prediction.
PREPROCESS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "none": lambda d: d,
    "normalize": kernels.normalize,
    "zero_mean_unit_variance": lambda d: (d - d.mean()) / max(float(d.std()), 1e-6),
    "scale": lambda d: d / 255.0,
}
#: Frameworks: name to a function that makes a predictor (array to channels) of a checkpoint.
FRAMEWORKS: dict[str, Callable[[object], Callable[[np.ndarray], np.ndarray]]] = {"callable": lambda checkpoint: checkpoint}


def register_framework(name: str, load: Callable[[object], Callable[[np.ndarray], np.ndarray]]) -> None:
    FRAMEWORKS[name] = load


def to_uint8(data: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    scale = np.floor(255 / (high - low))
    return np.clip(np.round(data * scale + (255 - scale * high)), 0, 255)


def inference(vox: DataFrame, value: str, blocking: Blocking, checkpoint, outputs: dict[str, tuple[int, int]], halo=(0, 0, 0), *, framework: str = "callable", preprocess: str = "zero_mean_unit_variance", mask: str | None = None, accumulate: str | None = None, dtype: str = "float32") -> dict[str, DataFrame]:
    """A table ``(c, z, y, x, v)`` (without ``c`` if accumulated) for each output and its range of channels.

    Blocks at the border are read with their content mirrored, blocks without a voxel of the mask are left out.
    """
    top = max(end for _, end in outputs.values())
    if mask:
        vox = vox.join(vox.where(mask).withColumn("_b", blocking.block_id()).select("_b").distinct(), blocking.block_id() == F.col("_b"), "left_semi")

    def run(block: dict) -> dict:
        predictor = FRAMEWORKS[framework](checkpoint)
        begin, _ = blocking.box(block["block_id"])
        data = block[value]
        missing = [max(0, h - (b - int(a))) for h, b, a in zip(halo, begin, block["begin"])]
        want = [b + 2 * h for b, h in zip(blocking.block, halo)]
        after = [max(0, w - n - m) for w, n, m in zip(want, data.shape, missing)]
        mode = "reflect" if all(n > max(m, a) for n, m, a in zip(data.shape, missing, after)) else "edge"
        padded = np.pad(data, list(zip(missing, after)), mode=mode)
        made = np.asarray(predictor(PREPROCESS[preprocess](padded)), float)
        made = made[None] if made.ndim == 3 else made
        cut = tuple(slice(m, m + n) for m, n in zip(missing, data.shape))
        made = made[(slice(None), *cut)]
        return {f"c{k}": (to_uint8(made[k]) if dtype == "uint8" else made[k]) for k in range(top)}

    every = map_blocks(vox, blocking, run, {value: "double"}, {f"c{k}": "double" for k in range(top)}, halo)
    found = {}
    for name, (begin, end) in outputs.items():
        pairs = F.array(*[F.struct(F.lit(k - begin).cast("long").alias("c"), F.col(f"c{k}").alias("v")) for k in range(begin, end)])
        one = every.select(*AXES, F.explode(pairs).alias("p")).select("p.c", *AXES, "p.v")
        if accumulate:
            from gridloom.operators.voxelwise import to_boundaries

            one = to_boundaries(one, accumulate)
        found[name] = one
    return found


def multiscale_inference(volumes: list[DataFrame], value: str, factors: list[tuple[int, int, int]], blocking: Blocking, checkpoint: Callable[[list[np.ndarray]], np.ndarray], halos: list[tuple[int, int, int]]) -> DataFrame:
    """``(z, y, x, v)`` from several resolutions: coarser inputs reach the finest grid, are read with the largest halo
    in its voxels, and go to the callable as a list of arrays of one shape."""
    if len(factors) != len(volumes) - 1 or len(halos) != len(volumes):
        raise ValueError("a factor for each input but the first, a halo for each")
    from gridloom.operators.resample import upscale

    joined = volumes[0].select(*AXES, F.col(value).alias("s0"))
    for k, (vox, f) in enumerate(zip(volumes[1:], factors), 1):
        joined = joined.join(upscale(vox, value, f).withColumnRenamed(value, f"s{k}").hint("merge"), list(AXES), "left")
    names = [f"s{k}" for k in range(len(volumes))]
    halo = tuple(max(h[a] * (f[a] if f else 1) for h, f in zip(halos, [None, *factors])) for a in range(3))

    def run(block: dict) -> dict:
        return {"v": np.asarray(checkpoint([block[n] for n in names]), float)}

    return map_blocks(joined.fillna(0.0, names), blocking, run, dict.fromkeys(names, "double"), {"v": "double"}, halo)


def pixel_classification(vox: DataFrame, value: str, blocking: Blocking, model: PipelineModel, sigmas: tuple[float, ...] = (1.0, 2.0), halo=(4, 8, 8), out_channels: list[int] | None = None) -> DataFrame:
    """``(c, z, y, x, v)``: class probabilities of a forest on filter responses of each voxel."""
    stack = filter_stack(vox, value, blocking, sigmas, halo)
    done = model.transform(stack).withColumn("_p", vector_to_array("probability"))
    every = done.select(*AXES, F.posexplode("_p").alias("c", "v")).select(F.col("c").cast("long").alias("c"), *AXES, "v")
    return every.where(F.col("c").isin(list(out_channels))) if out_channels else every


def filter_stack(vox: DataFrame, value: str, blocking: Blocking, sigmas: tuple[float, ...] = (1.0, 2.0), halo=(4, 8, 8)) -> DataFrame:
    """``(z, y, x, f0, f1, …)``: three filters at each sigma."""
    kinds = ("gaussianSmoothing", "gaussianGradientMagnitude", "laplacianOfGaussian")
    names = [f"f{k}" for k in range(len(kinds) * len(sigmas))]

    def run(block: dict) -> dict:
        made = [kernels.named_filter(block[value], kind, s) for s in sigmas for kind in kinds]
        return dict(zip(names, made))

    return map_blocks(vox, blocking, run, {value: "double"}, dict.fromkeys(names, "double"), halo)
