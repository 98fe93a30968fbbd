"""Volumes as voxel tables, and the regular blocking of them.

A voxel table has one row a voxel: ``z, y, x`` (bigint), values (double) and labels (bigint). Blocks are a
regular grid over the shape; a block's id is its position in the grid in C order.

Joins of voxels with voxels have the hint ``merge``: their files are so small for their rows that Spark would take them for
tables to broadcast, which grow by the row in the driver and in each executor.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


@dataclass(frozen=True)
class Blocking:
    """The grid of blocks of ``block`` voxels over ``shape``; the last ones are clipped."""

    shape: tuple[int, int, int]
    block: tuple[int, int, int]

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(ceil(s / b) for s, b in zip(self.shape, self.block))

    @property
    def count(self) -> int:
        g = self.grid
        return g[0] * g[1] * g[2]

    def block_id(self, z="z", y="y", x="x") -> Column:
        """The id of the block that holds a voxel."""
        at = [F.floor((F.col(c) if isinstance(c, str) else c) / b) for c, b in zip((z, y, x), self.block)]
        return ((at[0] * self.grid[1] + at[1]) * self.grid[2] + at[2]).cast("long")

    def box(self, block_id: int) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
        """Begin and end of a block."""
        g = self.grid
        at = (block_id // (g[1] * g[2]), block_id // g[2] % g[1], block_id % g[2])
        return tuple(a * b for a, b in zip(at, self.block)), tuple(min((a + 1) * b, s) for a, b, s in zip(at, self.block, self.shape))

    def blocks_in(self, begin=None, end=None, only=None) -> list[int]:
        """Ids of blocks that overlap the region of interest and are in the list ``only``, where given."""
        begin = [0 if b is None else b for b in (begin or (None,) * 3)]
        end = [s if e is None else min(e, s) for e, s in zip(end or (None,) * 3, self.shape)]
        ranges = [range(b // k, ceil(e / k)) for b, e, k in zip(begin, end, self.block)]
        found = [(i * self.grid[1] + j) * self.grid[2] + k for i, j, k in product(*ranges)]
        return found if only is None else sorted(set(found) & set(only))

    def colours(self) -> tuple[list[int], list[int]]:
        """The two colours of a checkerboard, of any sizes."""
        g = self.grid
        both: tuple[list[int], list[int]] = ([], [])
        for i, j, k in product(*map(range, g)):
            both[(i + j + k) % 2].append((i * g[1] + j) * g[2] + k)
        return both

    def colour(self, block_id="block_id") -> Column:
        """The colour of a block, 0 or 1 (see ``colours``), as an expression: no plan holds a list that grows with the volume."""
        g, b = self.grid, F.col(block_id) if isinstance(block_id, str) else block_id
        return (F.floor(b / (g[1] * g[2])) + F.floor(b / g[2]) % g[1] + b % g[2]) % 2

    def with_halo(self, vox: DataFrame, halo: tuple[int, int, int]) -> DataFrame:
        """Voxels replicated to each block whose outer box holds them: ``block_id`` and ``inner`` are added."""
        reach = [ceil(h / b) for h, b in zip(halo, self.block)]
        out = vox.withColumn("_home", F.struct(*[F.floor(F.col(c) / b).cast("long").alias(c) for c, b in zip(AXES, self.block)]))
        moves = [m for m in product(*(range(-r, r + 1) for r in reach))]
        out = out.withColumn("_m", F.explode(F.array(*[F.struct(*[F.lit(int(v)).alias(c) for c, v in zip(AXES, m)]) for m in moves])))
        keep = F.lit(True)
        at = {}
        for c, b, g, h in zip(AXES, self.block, self.grid, halo):
            at[c] = F.col(f"_home.{c}") + F.col(f"_m.{c}")
            keep = keep & at[c].between(0, g - 1) & (F.col(c) >= at[c] * b - h) & (F.col(c) < (at[c] + 1) * b + h)
        g = self.grid
        block_id = ((at["z"] * g[1] + at["y"]) * g[2] + at["x"]).cast("long")
        inner = (F.col("_m.z") == 0) & (F.col("_m.y") == 0) & (F.col("_m.x") == 0)
        return out.where(keep).withColumns({"block_id": block_id, "inner": inner}).drop("_home", "_m")


def region(vox: DataFrame, begin, end) -> DataFrame:
    """The voxels of a box: a range predicate that reaches the scan."""
    keep = F.lit(True)
    for c, b, e in zip(AXES, begin, end):
        keep = keep & (F.col(c) >= b) & (F.col(c) < e)
    return vox.where(keep)


def shifted(vox: DataFrame, offset: tuple[int, int, int], names: dict[str, str]) -> DataFrame:
    """``vox`` moved so that the voxel at ``p + offset`` stands at ``p``, with its columns renamed."""
    return vox.select(*[(F.col(c) - int(o)).alias(c) for c, o in zip(AXES, offset)], *[F.col(a).alias(b) for a, b in names.items()])


#: Voxels a side of the blocks in which neighbours are paired: 12 % of voxels are copied to another block.
PAIR_BLOCK = (16, 32, 32)


def lower_pairs(vox: DataFrame, columns: list[str], more: list[str] = (), block: tuple[int, int, int] = PAIR_BLOCK) -> DataFrame:
    """Every pair of neighbours along an axis: columns with the suffixes ``_a`` and ``_b``, and ``axis``.

    The table has one row a voxel. A voxel is shuffled once to its block and to those of its lower neighbours, where these are
    others; within a block the next voxel along each axis is that of a window, which takes a sort and no shuffle.
    """
    # the place of a block as one number, for grids of up to a million blocks a side; numbers sort faster than structures
    cell = lambda k: sum((F.floor((F.col(c) - int(i == k)) / b).cast("long") * (1 << 21 * (2 - i)) for i, (c, b) in enumerate(zip(AXES, block))), F.lit(0))
    read = [c for c in dict.fromkeys([*columns, *more]) if c not in AXES]
    placed = vox.select(*AXES, *read, cell(3).alias("_home"), F.explode(F.array_distinct(F.array(*[cell(k) for k in (3, 0, 1, 2)]))).alias("_block"))
    placed = placed.repartition("_block")
    both = list(dict.fromkeys(columns))
    for k, c in enumerate(AXES):
        line = Window.partitionBy("_block", *[o for o in AXES if o != c]).orderBy(c)
        placed = placed.withColumn(f"_n{k}", F.lead(F.struct(F.lit(k).alias("axis"), F.col(c).alias("at"), *[F.col(n).alias(f"{n}_b") for n in both])).over(line))
    touching = [F.when(F.col(f"_n{k}.at") == F.col(c) + 1, F.col(f"_n{k}")) for k, c in enumerate(AXES)]
    pairs = placed.where("_home = _block").withColumn("_n", F.explode(F.array(*touching))).where("_n IS NOT NULL")
    return pairs.select(*AXES, *[F.col(c).alias(f"{c}_a") for c in columns], *more, "_n.axis", *[f"_n.{c}_b" for c in columns])
