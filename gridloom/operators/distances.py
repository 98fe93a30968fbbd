"""Exact Euclidean distances to the border of each object, one pass an axis over runs of voxels.

A run is a row of touching voxels of one object along an axis. Just past its ends the object is left, so the distance
there is zero and nothing beyond an end can be nearer than the end: runs are independent, and neither an object nor a
block with a halo is ever one group, however large the object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import AXES


def spread(square: np.ndarray | None, begin: np.ndarray, end: np.ndarray, pitch: float) -> np.ndarray:
    """The least of ``square[j] + ((i - j) * pitch)**2`` over i's run, and of the ends of the run, where it is zero.

    Runs lie one after another in the array; ``begin`` and ``end`` are those of each voxel's run. Without ``square`` the
    ends alone count. Voxels look one step further at a time and stop at their own distance.
    """
    at = np.arange(len(begin))
    out = (np.minimum(at - begin + 1, end - at) * pitch) ** 2
    if square is None:
        return out
    out = np.minimum(out, square)
    step, active = 0, at
    while len(active):
        step += 1
        reach = (step * pitch) ** 2
        active = active[out[active] > reach]
        for other in (active - step, active + step):
            inside = (other >= begin[active]) & (other < end[active])
            own = active[inside]
            out[own] = np.minimum(out[own], square[other[inside]] + reach)
    return out


def _along(vox: DataFrame, axis: str, pitch: float) -> DataFrame:
    """One pass: lines meet in a shuffle and stream past in order; a task holds a batch and the run at its end."""
    across = [c for c in AXES if c != axis]
    columns = [*across, "id"]

    def finish(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        lengths = np.diff(np.append(starts, len(frame)))
        begin = np.repeat(starts, lengths)
        before = frame["square"].to_numpy() if "square" in frame else None
        return frame.assign(square=spread(before, begin, begin + np.repeat(lengths, lengths), pitch))[[*AXES, "id", "square"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in batches:
            if not len(frame):
                continue
            if held and _follows(held[-1].iloc[-1], frame.iloc[0], columns, axis) and not len(_starts(frame, columns, axis)) > 1:
                held.append(frame)
                continue
            frame = pd.concat([*held, frame], ignore_index=True) if held else frame.reset_index(drop=True)
            starts = _starts(frame, columns, axis)
            held = [frame.iloc[starts[-1] :]]
            if len(starts) > 1:
                yield finish(frame.iloc[: starts[-1]], starts[:-1])
        if held:
            frame = pd.concat(held, ignore_index=True)
            yield finish(frame, _starts(frame, columns, axis))

    placed = vox.repartition(*across).sortWithinPartitions(*across, axis)
    return placed.mapInPandas(run, "z long, y long, x long, id long, square double")


def _follows(a: pd.Series, b: pd.Series, same: list[str], axis: str) -> bool:
    return all(a[c] == b[c] for c in same) and b[axis] == a[axis] + 1


def _starts(frame: pd.DataFrame, same: list[str], axis: str) -> np.ndarray:
    """Positions where a run begins."""
    new = np.ones(len(frame), bool)
    new[1:] = np.diff(frame[axis].to_numpy()) != 1
    for c in same:
        new[1:] |= np.diff(frame[c].to_numpy()) != 0
    return np.flatnonzero(new)


def squared_distances(own: DataFrame, resolution=(1.0, 1.0, 1.0)) -> DataFrame:
    """``(z, y, x, id, square)`` of ``own(z, y, x, id)``, one row a voxel: squared distance to the nearest voxel not of its object."""
    for axis, pitch in reversed(list(zip(AXES, resolution))):
        own = _along(own, axis, float(pitch))
    return own


def distance_transform(vox: DataFrame, label: str, resolution=(1.0, 1.0, 1.0), ignore_label: int | None = 0) -> DataFrame:
    """``(z, y, x, label, distance)``: how far each labelled voxel is from the nearest one of another label or none.

    Places without a row count as of no label, as do those past the volume. Null labels and ``ignore_label`` get no row.
    """
    own = vox.select(*AXES, F.col(label).cast("long").alias("id")).where("id IS NOT NULL")
    if ignore_label is not None:
        own = own.where(F.col("id") != ignore_label)
    return squared_distances(own, resolution).select(*AXES, F.col("id").alias(label), F.sqrt("square").alias("distance"))
