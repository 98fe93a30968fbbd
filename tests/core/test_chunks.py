"""Chunked stores: round trips, folders written by hand, and which files a region opens."""

import gzip
import json
import zlib

import numpy as np
import pytest

from gridloom.model import AXES, Blocking
from gridloom.plans import workflows
from gridloom.sources import chunks
from tests.core.test_operators import dense, volume

SHAPE, CHUNK = (5, 7, 9), (2, 3, 4)


@pytest.mark.parametrize(("layout", "compression", "dtype"), [("zarr", "zlib", "<f8"), ("zarr", None, "<f4"), ("zarr", "zstd", "<i8"), ("n5", "gzip", "<f8"), ("n5", None, "<u2"), ("n5", "zlib", "<i4")])
def test_round_trip(spark, tmp_path, layout, compression, dtype):
    data = np.random.default_rng(1).integers(1, 99, SHAPE)
    data = data.astype(float) if dtype[1] == "f" else data
    path = f"file:{tmp_path}/s"
    chunks.write_chunks(volume(spark, data), "v", path, Blocking(SHAPE, CHUNK), dtype, compression, layout=layout)
    store = chunks.open_chunks(spark, path)
    assert (store.shape, store.chunks, store.layout, store.compression) == (SHAPE, CHUNK, layout, compression)
    found = chunks.read_chunks(spark, path)
    assert found.count() == data.size and (dense(found, "v", SHAPE) == data).all()
    assert dict(found.dtypes)["v"] == ("double" if dtype[1] == "f" else "bigint")
    begin, end = (1, 3, 2), (4, 6, 99)
    part = chunks.read_chunks(spark, path, begin, end)
    got = {tuple(r[c] for c in AXES): r.v for r in part.collect()}
    assert len(got) == 3 * 3 * 7 and all(data[p] == v for p, v in got.items()) and min(got) == begin
    # rows 3 to 5 are the second of three chunks, columns 2 to 8 take all three
    names = {store.place(p) for p in chunks.chunk_files(spark, store, begin, (4, 6, 9)).inputFiles()}
    assert names == {(z, 1, x) for z in (0, 1) for x in (0, 1, 2)}
    assert chunks.read_chunks(spark, path, (2, 2, 2), (2, 9, 9)).count() == 0
    assert not [p for p in (tmp_path / "s").rglob("_*")]
    with pytest.raises(FileExistsError):
        chunks.write_chunks(volume(spark, data), "v", path, Blocking(SHAPE, CHUNK))


@pytest.mark.parametrize("layout", ["zarr", "n5"])
def test_absent_chunks_hold_the_fill_value(spark, tmp_path, layout):
    data = np.zeros(SHAPE, int)
    data[0, 0, 0], data[4, 6, 8] = 5, 6
    vox = volume(spark, data).where("v <> 0 OR z = 2")
    fill = 0 if layout == "n5" else 7
    path = str(tmp_path / "s")
    chunks.write_chunks(vox, "v", path, Blocking(SHAPE, CHUNK), "<i8", fill=fill, layout=layout)
    sparse = chunks.read_chunks(spark, path, fill=False)
    full = chunks.read_chunks(spark, path)
    want = np.full(SHAPE, fill)
    want[2], want[0, 0, 0], want[4, 6, 8] = 0, 5, 6
    assert sparse.count() < full.count() == data.size and (dense(full, "v", SHAPE) == want).all()
    there = chunks.read_chunks(spark, path, (0, 3, 4), (2, 6, 8))
    assert there.count() == 24 and {r.v for r in there.collect()} == {fill}
    assert chunks.read_chunks(spark, path, (0, 3, 4), (2, 6, 8), fill=False).count() == 0


def test_nothing_to_write_and_nulls(spark, tmp_path):
    empty = spark.createDataFrame([], "z long, y long, x long, v double")
    chunks.write_chunks(empty, "v", str(tmp_path / "e"), Blocking((2, 2, 2), (1, 2, 2)))
    assert [r.v for r in chunks.read_chunks(spark, str(tmp_path / "e")).collect()] == [0.0] * 8
    some = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, 2.0)], "z long, y long, x long, v double")
    chunks.write_chunks(some, "v", str(tmp_path / "n"), Blocking((1, 1, 2), (1, 1, 2)), fill=-1)
    assert sorted(r.v for r in chunks.read_chunks(spark, str(tmp_path / "n")).collect()) == [-1.0, 2.0]


def test_folders_written_by_hand(spark, tmp_path):
    """The bytes of both layouts as their specifications have them, with four axes, Fortran order and nested folders."""
    data = np.arange(2 * 3 * 4 * 5).reshape(2, 3, 4, 5)
    root = tmp_path / "zarr"
    for c in range(2):
        (root / f"{c}/0/0").mkdir(parents=True)
        for k in range(2):
            part = np.zeros((1, 3, 4, 3), "<i2")
            part[..., : min(3, 5 - 3 * k)] = data[c : c + 1, :, :, 3 * k : 3 * k + 3]
            (root / f"{c}/0/0/{k}").write_bytes(zlib.compress(part.tobytes("F")))
    about = {"zarr_format": 2, "shape": [2, 3, 4, 5], "chunks": [1, 3, 4, 3], "dtype": "<i2", "compressor": {"id": "zlib", "level": 1}, "fill_value": None, "order": "F", "filters": None, "dimension_separator": "/"}
    (root / ".zarray").write_text(json.dumps(about))
    rows = chunks.read_chunks(spark, str(root)).collect()
    assert len(rows) == data.size and all(data[r.c, r.z, r.y, r.x] == r.v for r in rows)
    flat = data[0, 0]
    root = tmp_path / "n5"
    for j in range(2):
        (root / str(j)).mkdir(parents=True)
        part = flat[:, 3 * j : 3 * j + 3]
        head = b"\x00\x00\x00\x02" + part.shape[1].to_bytes(4, "big") + part.shape[0].to_bytes(4, "big")
        (root / str(j) / "0").write_bytes(head + gzip.compress(part.astype(">u4").tobytes()))
    (root / "attributes.json").write_text(json.dumps({"dimensions": [5, 4], "blockSize": [3, 4], "dataType": "uint32", "compression": {"type": "gzip"}}))
    rows = chunks.read_chunks(spark, str(root)).collect()
    assert len(rows) == 20 and all(r.z == 0 and flat[r.y, r.x] == r.v for r in rows)
    (root / "attributes.json").write_text(json.dumps({"dimensions": [5, 4], "blockSize": [3, 4], "dataType": "uint32", "compression": {"type": "blosc"}}))
    with pytest.raises(ValueError):
        chunks.open_chunks(spark, str(root))
    with pytest.raises(FileNotFoundError):
        chunks.open_chunks(spark, str(tmp_path))


def test_a_pyramid_of_stores(spark, tmp_path):
    data = np.random.default_rng(4).random((4, 6, 8))
    chunks.write_chunks(volume(spark, data), "v", str(tmp_path / "a"), Blocking(data.shape, (3, 4, 5)), fill=float("nan"))
    levels = workflows.copy_chunks_workflow(spark, str(tmp_path / "a"), str(tmp_path / "b"), Blocking(data.shape, (2, 2, 4)), [2, (1, 3, 2)], layout="n5")
    want = data.reshape(2, 2, 3, 2, 4, 2).mean((1, 3, 5))
    assert [chunks.open_chunks(spark, str(tmp_path / f"b/s{k}")).shape for k in range(3)] == [(4, 6, 8), (2, 3, 4), (2, 1, 2)]
    assert np.allclose(dense(levels[1], "v", want.shape).astype(float), want)
    assert np.allclose(dense(levels[2], "v", (2, 1, 2)).astype(float), want.reshape(2, 1, 3, 2, 2).mean((2, 4)))
