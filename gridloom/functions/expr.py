"""Column expressions of the operators: normalising, log-odds, quantising, and reducers by name."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Channel reducers and accumulation methods by name.
REDUCERS = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "median": F.median,
    "prod": F.product,
    "std": F.stddev_pop,
    "var": F.var_pop,
}


def reducer(name: str):
    if name not in REDUCERS:
        raise ValueError(f"no reducer {name!r}; there are {', '.join(sorted(REDUCERS))}")
    return REDUCERS[name]


def normalized(value: str, *by: str) -> Column:
    """Minus the minimum, divided by the largest shifted value if that isn't 0, within the groups ``by``."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.col(value) - low)


def log_odds(p: Column, beta: float = 0.5, edge: float = 0.001) -> Column:
    """Signed cost of a boundary probability: positive is attractive."""
    clipped = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.log((1 - clipped) / clipped) + F.log(F.lit((1 - beta) / beta))


def to_uint8(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Values from low to high as 0 to 255, clipped."""
    scale = float(int(255 / (high - low)))
    return F.least(F.greatest(F.round(value * scale + (255 - scale * high)), F.lit(0)), F.lit(255)).cast("int")


def unsigned(value: Column, bits: int) -> Column:
    """A signed integer moved to the unsigned range of as many bits."""
    return (value.cast("long") + (1 << (bits - 1))).cast("long")


def compare(value: Column, threshold: float, mode: str) -> Column:
    if mode not in ("greater", "less", "equal"):
        raise ValueError(f"mode {mode!r}")
    return {"greater": value > threshold, "less": value < threshold, "equal": value == threshold}[mode]
