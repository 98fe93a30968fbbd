"""Kernels on dense blocks: voxels meet at their block with a halo, a numpy function runs, inner voxels come back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from gridloom.model import AXES, Blocking

_NUMPY = {"double": float, "long": np.int64, "boolean": bool}


def map_blocks(vox: DataFrame, blocking: Blocking, kernel: Callable[[dict], dict], reads: dict[str, str], writes: dict[str, str], halo: tuple[int, int, int] = (0, 0, 0), by: tuple[str, ...] = (), blocks: list[int] | Column | None = None, beside: DataFrame | None = None) -> DataFrame:
    """``kernel`` on each block: arrays of the columns ``reads`` by name, with ``begin`` and ``block_id``, to arrays ``writes``.

    A block is a group of bounded size: the voxels of its outer box. ``blocks`` restricts the work to some of them
    (ids, or a condition on ``block_id``), ``by`` adds grouping columns (a z slice, a channel). Rows of ``beside(block_id, …)`` come with their block as
    ``block["beside"]``. A kernel may return ``more``, a frame of rows without a place, which come back with null coordinates.
    """
    names = list(reads)
    placed = blocking.with_halo(vox.select(*AXES, *[c for c in by if c not in AXES], *names), halo)
    if blocks is not None:
        placed = placed.where(blocks if isinstance(blocks, Column) else placed.block_id.isin(list(blocks)))
    schema = ", ".join(["z long, y long, x long", "block_id long", *(f"`{n}` {t}" for n, t in writes.items())])

    def work(frame: pd.DataFrame, rows: pd.DataFrame | None) -> pd.DataFrame:
        at = frame[list(AXES)].to_numpy()
        begin = at.min(axis=0)
        where = tuple((at - begin).T)
        shape = tuple(at.max(axis=0) - begin + 1)
        block = {"begin": begin, "block_id": int(frame["block_id"].iloc[0]), "inner": np.zeros(shape, bool), "present": np.zeros(shape, bool)}
        block["inner"][where] = frame["inner"].to_numpy()
        block["present"][where] = True
        for n in names:
            block[n] = np.zeros(shape, _NUMPY[reads[n]])
            block[n][where] = frame[n].to_numpy()
        block["beside"] = rows
        out = kernel(block)
        inner = frame["inner"].to_numpy()
        take = tuple(w[inner] for w in where)
        made = {c: at[inner, k] for k, c in enumerate(AXES)} | {"block_id": block["block_id"]} | {n: out[n][take].astype(_NUMPY[t]) for n, t in writes.items()}
        made = pd.DataFrame(made)
        if "more" in out:
            more = out["more"].assign(block_id=block["block_id"], **{c: pd.array([pd.NA] * len(out["more"]), "Int64") for c in AXES})
            made = pd.concat([made.astype(dict.fromkeys(AXES, "Int64")), more[made.columns]])
        return made

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return work(frame, None)

    if beside is None:
        return placed.groupBy("block_id", *by).applyInPandas(run, schema)

    def with_rows(frame: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return work(frame, rows) if len(frame) else pd.DataFrame({c: [] for c in [*AXES, "block_id", *writes]})

    return placed.groupBy("block_id").cogroup(beside.groupBy("block_id")).applyInPandas(with_rows, schema)
