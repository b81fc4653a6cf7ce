"""Packed delta files: a header, the indexes of the blocks that are there, the blocks.

Fixed values of the format: a magic, then little-endian version and block size (32 bits each), blocks in all
and blocks in the file (64 bits each), then 64-bit indexes, then the blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import fixed_width
from ..operators.ordered import numbered, stage

DISK, MEMORY, VERSION = b"OVBD", b"TDIF", 1
HEAD = "<4sIIQQ"
#: Blocks of a slice or a piece.
SLICE = 1024
SCHEMA = "disk string, block_size int, n_blocks long, idx long, data binary"


def _unpacked(raw: bytes, name: str, dense_size: int | None, kind: bytes) -> Iterator[tuple[list[int], list[bytes], int, int]]:
    """(indexes, blocks, block size, blocks in all) of slices of a file."""
    if raw[:4] != kind:
        if dense_size is None:
            raise ValueError(f"{name} does not begin with {kind.decode()}")
        n = -(-len(raw) // dense_size)
        for at in range(0, n, SLICE):
            ids = list(range(at, min(at + SLICE, n)))
            yield ids, [raw[i * dense_size : (i + 1) * dense_size].ljust(dense_size, b"\0") for i in ids], dense_size, n
        return
    _, version, size, n, dirty = struct.unpack_from(HEAD, raw)
    if kind == DISK and version != VERSION:
        raise ValueError(f"{name} has version {version}")
    first = struct.calcsize(HEAD)
    for at in range(0, dirty, SLICE):
        k = min(SLICE, dirty - at)
        start = first + 8 * dirty + at * size
        yield list(struct.unpack_from(f"<{k}Q", raw, first + 8 * at)), [raw[start + i * size : start + (i + 1) * size] for i in range(k)], size, n


def unpack(files: DataFrame, dense_size: int | None = None, kind: bytes = DISK) -> DataFrame:
    """Blocks of all ``files`` (path, content), one a row; ``disk`` is the path. An empty file has no blocks.

    A file that is not of the ``kind`` is an error, or with ``dense_size`` a dense image of blocks of that size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0), b.column(1)):
                for ids, data, size, n in _unpacked(raw.as_py() or b"", name.as_py(), dense_size, kind):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(ids), "string"), pa.array([size] * len(ids), "int32"), pa.array([n] * len(ids), "int64"), pa.array(ids, "int64"), pa.array(data, "binary")], ["disk", "block_size", "n_blocks", "idx", "data"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_packed(spark: SparkSession, path: str, dense_size: int | None = None, kind: bytes = DISK) -> DataFrame:
    """Blocks of all packed files under ``path``; see ``unpack``."""
    return unpack(spark.read.format("binaryFile").load(path), dense_size, kind)


def pieces(blocks: DataFrame, sizes: DataFrame, block_size: int, kind: bytes = DISK, per_piece: int = SLICE) -> DataFrame:
    """(disk, piece, content): each disk's packed file in pieces; put together in order of ``piece`` they are the file.

    Piece 0 is the header; then come pieces of indexes, then as many of blocks, of ``per_piece`` blocks each, so
    no task holds more than a piece, however large the disk is. Disks of ``sizes`` without blocks have a header alone.
    """
    placed = numbered(stage(blocks.select("disk", "idx", fixed_width(F.col("data"), block_size).alias("data")), "packing"), ["disk"], ["idx"])
    part = F.floor((F.col("nth") - 1) / per_piece)
    lists = placed.groupBy("disk", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("nth", "idx", "data"))).alias("rows"))
    counts = stage(placed.groupBy("disk").agg(F.count("*").alias("dirty")), "packed-counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for disk, at, rows, dirty in zip(*(c.to_pylist() for c in b.columns)):
                n = -(-dirty // per_piece)
                out = [struct.pack(f"<{len(rows)}Q", *[r["idx"] for r in rows]), b"".join(r["data"] for r in rows)]
                yield pa.RecordBatch.from_arrays([pa.array([disk, disk], "string"), pa.array([1 + at, 1 + n + at], "int64"), pa.array(out, "binary")], ["disk", "piece", "content"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [struct.pack(HEAD, kind, VERSION, block_size, n, dirty) for n, dirty in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * len(out), "int64"), pa.array(out, "binary")], ["disk", "piece", "content"])

    schema = "disk string, piece long, content binary"
    head = sizes.join(counts, "disk", "left").select("disk", "n_blocks", F.coalesce("dirty", F.lit(0).cast("long")).alias("dirty")).mapInArrow(heads, schema)
    return head.unionByName(lists.join(counts, "disk").select("disk", "part", "rows", "dirty").mapInArrow(run, schema))


def packed(blocks: DataFrame, sizes: DataFrame, block_size: int, magic: bytes = DISK) -> DataFrame:
    """(disk, content): each disk's packed file as one value, for disks that fit in one (2 GB); larger ones stay ``pieces``."""
    rows = pieces(blocks, sizes, block_size, magic)
    whole = F.array_sort(F.collect_list(F.struct("piece", "content")))
    return rows.groupBy("disk").agg(F.aggregate(whole, F.lit(b""), lambda a, x: F.concat(a, x["content"])).alias("content"))
