"""Chunked array folders in the two public layouts: zarr version 2 and N5.

A store is a folder with a file of attributes and one file a chunk. Reading lists and fetches chunk files by Spark's own
binary source, so every file system that Spark knows will do, a task takes at most ``spark.sql.files.maxPartitionBytes`` of
chunks, and a region is a choice of file names: other chunks are never opened. Shape and types need the attributes alone.
Chunks without a file hold the fill value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, prod

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import AXES, Blocking

NAMES = ("c", *AXES)


@dataclass(frozen=True)
class ChunkStore:
    """What the attributes say; shapes have one to four axes, the last ones are those of ``AXES``, before them channels."""

    path: str
    layout: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    compression: str | None
    fill: float = 0
    separator: str = "."
    order: str = "C"

    @property
    def axes(self) -> tuple[str, ...]:
        return NAMES[-max(len(self.shape), 3) :]

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(ceil(s / c) for s, c in zip(self.shape, self.chunks))

    @property
    def blocking(self) -> Blocking:
        """The chunks as blocks of a volume."""
        return Blocking(((1, 1, 1) + self.shape)[-3:], ((1, 1, 1) + self.chunks)[-3:])

    def name(self, at) -> str:
        """The file of the chunk at a place of the grid; N5 counts axes from the last to the first."""
        return self.separator.join(str(int(a)) for a in (reversed(at) if self.layout == "n5" else at))

    def place(self, path: str) -> tuple[int, ...]:
        """The place of a chunk by its file."""
        parts = path.split("/")[-1].split(".") if self.separator == "." else path.split("/")[-len(self.shape) :]
        at = tuple(int(p) for p in parts)
        return at[::-1] if self.layout == "n5" else at

    def glob(self, low, high) -> str:
        """The files of chunks from ``low`` to before ``high``, as one pattern."""
        each = ["{" + ",".join(map(str, range(a, b))) + "}" for a, b in zip(low, high)]
        return self.separator.join(reversed(each) if self.layout == "n5" else each)

    def decode(self, content: bytes | None) -> np.ndarray:
        """A chunk's array; N5 cuts those at the upper border, zarr fills them up."""
        if content is None:
            return np.full(self.chunks, self.fill, np.dtype(self.dtype))
        if self.layout == "n5":
            axes = int.from_bytes(content[2:4], "big")
            if int.from_bytes(content[:2], "big") != 0 or axes != len(self.shape):
                raise ValueError(f"{self.path}: a chunk of varying length or of other dimensions")
            shape = tuple(int.from_bytes(content[4 + 4 * k : 8 + 4 * k], "big") for k in range(axes))[::-1]
            content = content[4 + 4 * axes :]
        else:
            shape = self.chunks
        data = np.frombuffer(_unpacked(content, self.compression), np.dtype(self.dtype), prod(shape))
        return data.reshape(shape, order=self.order)

    def encode(self, data: np.ndarray) -> bytes:
        if self.layout != "n5":
            return _packed(data.astype(self.dtype).tobytes(self.order), self.compression)
        head = b"\0\0" + len(data.shape).to_bytes(2, "big") + b"".join(n.to_bytes(4, "big") for n in data.shape[::-1])
        return head + _packed(data.astype(self.dtype).tobytes(), self.compression)


def _unpacked(data: bytes, how: str | None) -> bytes:
    import bz2
    import gzip
    import lzma
    import zlib

    if how == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return {None: lambda d: d, "zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress}[how](data)


def _packed(data: bytes, how: str | None) -> bytes:
    import bz2
    import gzip
    import lzma
    import zlib

    if how == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    return {None: lambda d: d, "zlib": zlib.compress, "gzip": lambda d: gzip.compress(d, mtime=0), "bz2": bz2.compress, "lzma": lzma.compress}[how](data)


def _file(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _read_text(spark: SparkSession, path: str) -> str | None:
    system, there = _file(spark, path)
    if not system.exists(there):
        return None
    stream = system.open(there)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    system, there = _file(spark, path)
    stream = system.create(there, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def open_chunks(spark: SparkSession, path: str) -> ChunkStore:
    """A store by its attributes; no chunk is looked at."""
    path = path.rstrip("/")
    text = _read_text(spark, f"{path}/.zarray")
    if text is not None:
        a = json.loads(text)
        if a.get("zarr_format") != 2 or a.get("filters"):
            raise ValueError(f"{path}: only version 2 without filters")
        fill = a.get("fill_value")
        how = (a.get("compressor") or {}).get("id")
        store = ChunkStore(path, "zarr", tuple(a["shape"]), tuple(a["chunks"]), a["dtype"], how, float(fill) if isinstance(fill, str) else fill or 0, a.get("dimension_separator", "."), a.get("order", "C"))
    else:
        text = _read_text(spark, f"{path}/attributes.json")
        if text is None:
            raise FileNotFoundError(f"{path}: neither .zarray nor attributes.json")
        a = json.loads(text)
        how = (a.get("compression") or {}).get("type", "raw")
        how = {"raw": None, "gzip": "zlib" if (a.get("compression") or {}).get("useZlib") else "gzip", "bzip2": "bz2", "xz": "lzma"}.get(how, how)
        store = ChunkStore(path, "n5", tuple(a["dimensions"][::-1]), tuple(a["blockSize"][::-1]), np.dtype(a["dataType"]).newbyteorder(">").str, how, separator="/")
    if store.compression not in (None, "zlib", "gzip", "bz2", "lzma", "zstd"):
        raise ValueError(f"{path}: compression {store.compression!r}")
    if not 1 <= len(store.shape) <= 4:
        raise ValueError(f"{path}: {len(store.shape)} dimensions")
    return store


def chunk_files(spark: SparkSession, store: ChunkStore, begin=None, end=None) -> DataFrame:
    """``(path, content)`` of the chunk files that a region touches, or of all; the content is fetched if it is selected."""
    files = spark.read.format("binaryFile")
    n = len(store.shape)
    whole = begin is None and end is None
    low = [max(b, 0) // c for b, c in zip(begin or (0,) * n, store.chunks)]
    high = [ceil(min(e, s) / c) for e, s, c in zip(end or store.shape, store.shape, store.chunks)]
    if store.separator == ".":
        pattern = ".".join(["*"] * n) if whole else store.glob(low, high)
        found = files.option("pathGlobFilter", pattern if n > 1 or not whole else "[0-9]*").load(store.path)
    else:
        try:
            # a whole store is listed by the cluster, level by level; a region by its folders' names
            found = files.option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*").load(store.path) if whole else files.load(f"{store.path}/{store.glob(low, high)}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "path string, content binary")
    return found.select("path", "content")


def read_chunks(spark: SparkSession, path: str, begin=None, end=None, value: str = "v", fill: bool = True) -> DataFrame:
    """``(z, y, x, value)`` of a store or a region of it, with ``c`` in front if it has four axes; whole numbers are long.

    Without ``fill`` chunks without a file give no rows, which keeps sparse volumes sparse. An empty region has no rows.
    """
    store = open_chunks(spark, path)
    n = len(store.shape)
    low = [max(b, 0) for b in (begin or (0,) * n)]
    high = [min(e, s) for e, s in zip(end or store.shape, store.shape)]
    whole = np.dtype(store.dtype).kind in "iub"
    schema = ", ".join([*(f"{c} long" for c in store.axes), f"`{value}` {'long' if whole else 'double'}"])
    if any(a >= b for a, b in zip(low, high)):
        return spark.createDataFrame([], schema)
    some = begin is not None or end is not None
    files = chunk_files(spark, store, low if some else None, high if some else None)
    if fill:
        first = [a // c for a, c in zip(low, store.chunks)]
        sides = [ceil(b / c) - f for b, c, f in zip(high, store.chunks, first)]
        at, rest = [], F.col("id")
        for f, side in reversed(list(zip(first, sides))):
            at.insert(0, (rest % side + f).cast("long").cast("string"))
            rest = F.floor(rest / side)
        name = F.concat_ws(store.separator, *(reversed(at) if store.layout == "n5" else at))
        depth = 1 if store.separator == "." else n
        there = files.select(F.substring_index("path", "/", -depth).alias("path"))
        none = spark.range(prod(sides)).select(name.alias("path")).join(there, "path", "left_anti")
        files = files.unionByName(none.withColumn("content", F.lit(None).cast("binary")))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name, content in zip(frame["path"], frame["content"]):
                start = np.array(store.place(name)) * store.chunks
                data = store.decode(content)
                box = [slice(max(a - s, 0), max(b - s, 0)) for a, b, s in zip(low, high, start)]
                data = data[tuple(box)]
                place = np.indices(data.shape).reshape(n, -1) + (start + [s.start for s in box])[:, None]
                columns = dict(zip(store.axes[-n:], place))
                yield pd.DataFrame({c: columns.get(c, 0) for c in store.axes} | {value: data.ravel().astype(np.int64 if whole else float)}, index=range(data.size))

    return files.mapInPandas(decode, schema)


def write_chunks(vox: DataFrame, value: str, path: str, blocking: Blocking, dtype: str = "<f8", compression: str | None = "zlib", fill: float = 0, layout: str = "zarr") -> ChunkStore:
    """A voxel table as a new store, a chunk a block; places without a row and null values take the fill value.

    A chunk is a group of bounded size and is written by the task that has it, under another name first, so that tasks may be
    repeated; chunks of the fill value alone get no file, the attributes come last. Workers write by Arrow's file systems:
    a folder they all see, or an address these know. N5 has no fill value but zero.
    """
    spark = vox.sparkSession
    path = path.rstrip("/")
    if layout not in ("zarr", "n5") or (layout == "n5" and fill):
        raise ValueError(f"layout {layout!r} with fill {fill}")
    system, there = _file(spark, path)
    if system.exists(there) and len(system.listStatus(there)):
        raise FileExistsError(path)
    kind = np.dtype(dtype).newbyteorder(">").str if layout == "n5" else np.dtype(dtype).str
    store = ChunkStore(path, layout, blocking.shape, blocking.block, kind, compression, fill, "/" if layout == "n5" else ".")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import uuid

        from pyarrow import fs

        block = int(frame["block_id"].iloc[0])
        begin, end = blocking.box(block)
        data = np.full(np.subtract(end, begin) if layout == "n5" else blocking.block, fill, np.dtype(kind))
        frame = frame[frame[value].notna()]
        data[tuple((frame[list(AXES)].to_numpy() - begin).T)] = frame[value].to_numpy()
        if (data == fill).all():
            return pd.DataFrame({"block_id": [block], "bytes": [0]})
        content = store.encode(data)
        local = path.removeprefix("file:") if path.startswith("file:") else path
        files, root = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if "://" not in local else fs.FileSystem.from_uri(local)
        name = f"{root}/{store.name(np.array(begin) // blocking.block)}"
        files.create_dir(name.rsplit("/", 1)[0], recursive=True)
        waiting = f"{root}/_{uuid.uuid4().hex}"
        with files.open_output_stream(waiting) as out:
            out.write(content)
        files.move(waiting, name)
        return pd.DataFrame({"block_id": [block], "bytes": [len(content)]})

    placed = vox.select(*AXES, value).withColumn("block_id", blocking.block_id())
    system.mkdirs(there)
    placed.groupBy("block_id").applyInPandas(run, "block_id long, bytes long").agg(F.sum("bytes")).first()
    if layout == "n5":
        kinds = {None: {"type": "raw"}, "zlib": {"type": "gzip", "useZlib": True}, "gzip": {"type": "gzip"}, "bz2": {"type": "bzip2"}, "lzma": {"type": "xz"}, "zstd": {"type": "zstd"}}
        about = {"dimensions": blocking.shape[::-1], "blockSize": blocking.block[::-1], "dataType": np.dtype(dtype).name, "compression": kinds[compression]}
    else:
        about = {"zarr_format": 2, "shape": blocking.shape, "chunks": blocking.block, "dtype": kind, "compressor": compression and {"id": compression}, "fill_value": fill if np.isfinite(fill) else str(fill).replace("nan", "NaN").replace("inf", "Infinity"), "order": "C", "filters": None}
    _write_text(spark, f"{path}/{'attributes.json' if layout == 'n5' else '.zarray'}", json.dumps(about))
    return store
