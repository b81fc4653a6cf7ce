"""Image files: written and read as the format says, in ranges, whole or not at all."""

import os
import struct
import tracemalloc

import pytest

from wayfold.operators import delta
from wayfold.operators.errors import WayfoldError
from wayfold.sources import images

BLOCKS, SIZES = "disk string, idx long, data binary", "disk string, n_blocks long"


def written(spark, tmp_path, rows, sizes, kind=images.DISK, size=4):
    at = str(tmp_path / "files")
    stats = images.write_packed(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame(sizes, SIZES), at, size, kind)
    return at, {r.disk: (r.n_blocks, r.len, r.n_dirty) for r in stats.collect()}


@pytest.mark.parametrize("kind", [images.DISK, images.MEMORY])
def test_files_have_the_format(spark, tmp_path, kind):
    rows = [("a/b ü", 7, b"7777"), ("a/b ü", 2, b"2"), ("c", 0, b"toolong")]
    at, stats = written(spark, tmp_path, rows, [("a/b ü", 9), ("c", 1), ("none", 5)], kind)
    assert stats == {"a/b ü": (9, 36, 2), "c": (1, 4, 1), "none": (5, 20, 0)}
    files = {images.disk_of(f, ".img"): open(f"{at}/{f}", "rb").read() for f in os.listdir(at)}
    assert files == {
        "a/b ü": struct.pack("<4sIIQQQQ", kind, 1, 4, 9, 2, 2, 7) + b"2\0\0\0" + b"7777", "c": struct.pack("<4sIIQQQ", kind, 1, 4, 1, 1, 0) + b"tool", "none": struct.pack("<4sIIQQ", kind, 1, 4, 5, 0),
    }
    back = images.read_images(spark, at, kind=kind)
    assert sorted((r.disk, r.block_size, r.n_blocks, r.idx, bytes(r.data)) for r in back.collect()) == [("a/b ü", 4, 9, 2, b"2\0\0\0"), ("a/b ü", 4, 9, 7, b"7777"), ("c", 4, 1, 0, b"tool")]
    with pytest.raises(Exception, match="does not begin with"):
        images.read_images(spark, at, kind=images.MEMORY if kind == images.DISK else images.DISK).collect()


def test_a_large_file_is_read_in_ranges(spark, tmp_path):
    """Many partitions of one file give its blocks once each; each reads its own range, a slice at a time."""
    n, size = 9_000, 4096
    rows = spark.range(n).selectExpr("'big' as disk", "id * 3 as idx", "cast(lpad(cast(id as string), 4096, 'x') as binary) as data")
    at = str(tmp_path / "big")
    images.write_packed(rows, spark.createDataFrame([("big", 3 * n)], SIZES), at, size)
    assert os.path.getsize(f"{at}/big.img") == 28 + n * (8 + size)
    back = images.read_images(spark, at, part_bytes=1 << 20)
    assert back.rdd.getNumPartitions() == -(-(28 + n * (8 + size)) // (1 << 20))
    assert back.join(rows, ["disk", "idx", "data"]).count() == n == back.count()
    reader = images.ImageReader({"path": at, "part_bytes": str(1 << 20)})
    tracemalloc.start()
    assert sum(b.num_rows for b in reader.read(reader.partitions()[3])) < 300
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_dense_images(spark, tmp_path):
    upper, base = spark.createDataFrame([("d", 1, b"11"), ("e", 0, b"e")], BLOCKS), spark.createDataFrame([("d", 0, b"00"), ("d", 1, b"xx"), ("d", 9, b"far")], BLOCKS)
    sizes, at = spark.createDataFrame([("d", 4), ("e", 1), ("f", 0)], SIZES), str(tmp_path / "dense")
    images.write_dense(upper, sizes, at, 4, base)
    files = {f: open(f"{at}/{f}", "rb").read() for f in os.listdir(at)}
    assert files == {"d.img": b"00\0\0" + b"11\0\0" + bytes(8), "e.img": b"e\0\0\0", "f.img": b""}
    images.write_dense(upper, sizes, at, 4)
    assert open(f"{at}/d.img", "rb").read() == bytes(4) + b"11\0\0" + bytes(8)
    back = images.read_images(spark, at, dense_size=4)
    assert sorted((r.disk, r.n_blocks, r.idx, bytes(r.data)) for r in back.where("disk = 'd'").collect()) == [("d", 4, i, b"11\0\0" if i == 1 else bytes(4)) for i in range(4)]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    at, _ = written(spark, tmp_path, [("a", 0, b"old")], [("a", 1)])
    before = open(f"{at}/a.img", "rb").read()
    bad = spark.createDataFrame([("a", 0, b"new"), ("b", 1, b"x")], "disk string, piece long, content binary").selectExpr("disk", "if(disk = 'b', cast(raise_error('gone') as bigint), piece) as piece", "content")
    with pytest.raises(Exception, match="gone"):
        images._write(bad, at, ".img")
    assert os.listdir(at) == ["a.img"] and open(f"{at}/a.img", "rb").read() == before
    with pytest.raises(WayfoldError, match="no file"):
        images.write_packed(spark.createDataFrame([], BLOCKS), spark.createDataFrame([(None, 1)], SIZES), at, 4)


def test_truncated_files_are_errors(spark, tmp_path):
    at, _ = written(spark, tmp_path, [("a", i, b"data") for i in range(9)], [("a", 9)])
    raw = open(f"{at}/a.img", "rb").read()
    with open(f"{at}/a.img", "wb") as f:
        f.write(raw[:-1])
    with pytest.raises(Exception, match="ends before"):
        images.read_images(spark, at).collect()


def test_dirty_runs(spark):
    rows = [("d", i, b"x") for i in (0, 1, 2, 2, 5, 7, 8, 1 << 40)] + [("e", 3, b"x")]
    out = delta.dirty_runs(spark.createDataFrame(rows, BLOCKS)).collect()
    assert sorted(map(tuple, out)) == [("d", 0, 3), ("d", 5, 1), ("d", 7, 2), ("d", 1 << 40, 1), ("e", 3, 1)]
