"""What the corpus operators share: reading tables and mapping Arrow batches in bounded slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Bytes of Arrow data that one call of a batch function sees, whatever the number of rows.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes (one row at least)."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, min(rows, int(rows * limit / max(1, batch.nbytes))))
    for at in range(0, rows, step):
        yield batch.slice(at, min(step, rows - at))


def with_columns(df: DataFrame, fields: list[StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns computed by Arrow batch in Python.

    ``make()`` runs once in each Python task and returns the function from a batch to the new arrays.
    Columns of ``df`` ride along, but for those in ``drop``; one that has the name of a new column is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and f.name not in drop]
    schema = StructType([*kept, *fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch):
                arrays = [part.column(part.schema.get_field_index(n)) for n in names] + list(fn(part))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    return [v or b"" for v in values.to_pylist()]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each group, as numpy arrays, from batches that are sorted by the integer column ``key``.

    Columns must be of fixed width and hold no null. One group is in memory at a time, besides a batch.
    """
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        keys = columns[key]
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for begin, end in zip(edges, edges[1:]):
            part = {n: v[begin:end] for n, v in columns.items()}
            if held and held[0][key][0] != part[key][0]:
                yield _joined(held)
                held = []
            held.append(part)
    if held:
        yield _joined(held)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def spanning_labels(size: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """For items 0..size-1 linked by (a, b): the smallest linked item of each, given what earlier links gave."""
    labels = np.arange(size) if labels is None else labels
    while len(a):
        low = np.minimum(labels[a], labels[b])
        if (labels[a] == labels[b]).all():
            break
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            nearer = labels[labels]
            if (nearer == labels).all():
                break
            labels = nearer
    return labels
