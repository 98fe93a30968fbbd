"""Operator 8: mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The cells' sums are raked to the target shares of each margin
in turn until all margins agree; the ratio of raked to observed tokens is the cell's factor. Documents are then
sampled: a cell's probability is its factor times one common scale, 1 at most, with the scale such that the
expected tokens are the budget. Cells at 1 give all they have, the rest is scaled up for it.

The target of a margin is a table of shares or, by default, the observed shares to the power of ``TEMPER``,
brought to a sum of 1; values without a target keep nothing, targets of values that don't occur are left out and
the rest brought to 1. Tokens are estimated as a fourth of the text's bytes, one at least, unless a column is
named; the topic is the text's form unless a column is named. Null sources and languages are values of their own
(''). Whether a document is drawn depends on its id, the seed and its cell alone, so rows that repeat an id are
drawn alike; one without an id is drawn by its text. An empty table gives an empty one. Margins that contradict each other
(no cell for what is wanted) are met as nearly as the sweeps get, with a warning. Columns of the caller that have the name
of a new one, or ``_s``, ``_l`` and ``_u``, are left out.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import read_table
from gridloom.plans.scratch import Scratch

MARGINS = ("source", "lang", "topic")
TEMPER, BUDGET, SEED = 0.7, 0.8, 8
#: Raking ends where no margin is off by more than ``EXACT`` of all tokens; beyond ``AGREED`` it warns.
SWEEPS, EXACT, AGREED = 100, 1e-9, 1e-4
#: Cells that are raked in the driver's memory (about 100 bytes each); more are raked in the cluster, alike.
DRIVER_CELLS = 100_000


def tokens_of(text: str = "text") -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def topic_of(text: str = "text") -> Column:
    """A text's form: what is more than a quarter digits and signs is a listing, the rest prose by its length."""
    t = F.coalesce(text, F.lit(""))
    signs = F.length(F.regexp_replace(t, r"[\p{L}\p{M}\s]+", ""))
    return (
        F.when(signs * 4 > F.length(t), "listing")
        .when(F.octet_length(t) < 600, "short")
        .when(F.octet_length(t) < 4000, "medium")
        .otherwise("long")
    )


def _warn_unless_agreed(worst: float) -> None:
    if worst >= AGREED:
        warnings.warn(f"margins still differ by {worst:.2g} of all tokens after {SWEEPS} sweeps: their targets may contradict each other", stacklevel=3)


def _rake_here(cells, targets: dict[str, dict[str, float]], budget: float) -> np.ndarray:
    """Probabilities of cells given as a pandas frame with the margins and ``tokens``."""
    total = cells.tokens.to_numpy(float)
    weight = total.copy()
    code, goal = {}, {}
    for m in MARGINS:
        names = sorted(set(cells[m]))
        at = {x: k for k, x in enumerate(names)}
        code[m] = np.array([at[x] for x in cells[m]])
        share = np.array([max(0.0, targets[m].get(x, 0.0)) for x in names])
        goal[m] = share / share.sum() * total.sum() if share.sum() else share
    for _ in range(SWEEPS):
        worst = 0.0
        for m in MARGINS:
            have = np.bincount(code[m], weight, len(goal[m]))
            factor = np.divide(goal[m], have, out=np.zeros(len(have)), where=have > 0)
            worst = max(worst, float(np.abs(have - goal[m]).max() / total.sum()))
            weight = weight * factor[code[m]]
        if worst < EXACT:
            break
    _warn_unless_agreed(worst)
    factor = np.divide(weight, total, out=np.zeros(len(total)), where=total > 0)
    full = np.zeros(len(total), bool)
    while True:
        open_mass = float((total * factor)[~full].sum())
        scale = max(0.0, budget * total.sum() - total[full].sum()) / open_mass if open_mass > 0 else 0.0
        now = full | (factor * scale >= 1)
        if (now == full).all():
            return np.where(full, 1.0, np.minimum(1.0, factor * scale))
        full = now


def _rake_there(spark: SparkSession, cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    """The same on a table of cells, one written table a sweep."""
    scratch = Scratch(spark, "raking")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    table, last = scratch.save(cells.withColumn("w", F.col("tokens").cast("double")), "w0"), "w0"
    goals = {}
    for m in MARGINS:
        seen = cells.select(m).distinct().join(targets[m], m, "left").select(m, F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)).alias("share"))
        sums = seen.agg(F.sum("share").alias("_all"))
        goals[m] = scratch.save(seen.crossJoin(F.broadcast(sums)).select(m, F.when(F.col("_all") > 0, F.col("share") / F.col("_all") * total).otherwise(0.0).alias("goal")), f"goal-{m}")
    for sweep in range(1, SWEEPS + 1):
        worst = 0.0
        for m in MARGINS:
            have = table.groupBy(m).agg(F.sum("w").alias("have")).join(goals[m], m)
            worst = max(worst, (have.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] or 0.0) / max(total, 1))
            factor = have.select(m, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("_f"))
            new = table.join(factor, m).withColumn("w", F.col("w") * F.col("_f")).select(cells.columns + ["w"])
            table = scratch.save(new, f"w{sweep}{m}")
            scratch.drop(last)
            last = f"w{sweep}{m}"
        if worst < EXACT:
            break
    _warn_unless_agreed(worst)
    table = table.withColumn("factor", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0))
    edge, given = float("inf"), 0
    while True:
        full = F.col("factor") >= edge
        row = table.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("t"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w"), F.sum(full.cast("int")).alias("n")).first()
        scale = max(0.0, budget * total - (row.t or 0)) / row.w if row.w else 0.0
        new = min(edge, 1 / scale) if scale > 0 else edge
        now = table.where(F.col("factor") >= new).count()
        if now == given:
            return table.select(*MARGINS, F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.col("factor") * scale)).alias("probability"))
        edge, given = new, now


def probabilities(spark: SparkSession, cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """``(source, lang, topic, probability)`` for ``cells`` with ``tokens``."""
    targets = targets or {}
    scratch = Scratch(spark, "cells")
    cells = scratch.save(cells, "cells")

    def goal(m: str) -> DataFrame:
        if m in targets:
            return spark.createDataFrame([(str(k), float(v)) for k, v in targets[m].items()], f"{m} string, share double")
        return cells.groupBy(m).agg((F.sum("tokens").cast("double") ** TEMPER).alias("share"))

    if cells.count() > DRIVER_CELLS:
        return _rake_there(spark, cells, {m: goal(m) for m in MARGINS}, budget)
    frame = cells.toPandas()
    share = {m: targets.get(m) or (frame.groupby(m).tokens.sum().astype(float) ** TEMPER).to_dict() for m in MARGINS}
    frame["probability"] = _rake_here(frame, share, budget) if len(frame) else []
    found = spark.createDataFrame(frame[[*MARGINS, "probability"]].values.tolist(), "source string, lang string, topic string, probability double")
    return F.broadcast(found)  # at most DRIVER_CELLS rows


def draw(id: str, text: str, seed: int = SEED) -> Column:
    """A number from 0 to 1 by id and seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = SEED, tokens: Column | None = None, topic: Column | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``mix_topic``, ``mix_tokens``, ``probability`` and ``kept`` (columns named so are replaced)."""
    own = docs.drop("mix_topic", "mix_tokens", "probability", "kept", "_s", "_l", "_u")
    own = own.withColumns({"_s": F.coalesce("source", F.lit("")), "_l": F.coalesce("lang", F.lit("")), "mix_topic": topic_of() if topic is None else topic, "mix_tokens": tokens_of() if tokens is None else tokens})
    cells = own.groupBy(F.col("_s").alias("source"), F.col("_l").alias("lang"), F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens"))
    p = probabilities(spark, cells, targets, budget).select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("mix_topic"), "probability")
    out = own.withColumn("_u", draw("doc_id", "text", seed)).drop(*drop).join(p, ["_s", "_l", "mix_topic"])
    names = [c for c in own.columns if c not in ("_s", "_l", "mix_topic", "mix_tokens", *drop)]
    return out.select(*names, "mix_topic", "mix_tokens", "probability", (F.col("_u") < F.col("probability")).alias("kept"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mix(spark, docs, drop=("text",)).select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("probability", 9).alias("probability"), "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the drawn documents stay."""
    return mix(spark, docs).where("kept").select(docs.columns)


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL: dict[str, str] = {}
