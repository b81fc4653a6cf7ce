"""Packed and dense image files as a data source: read in block ranges, written whole or not at all.

``PackedFiles`` reads files of any size: each partition takes a range of a file's blocks, reads the header and its slice of
the index, and seeks to its blocks; no task holds more than ``SLICE`` blocks. It writes pieces, in order, to one file
a disk: a task streams the pieces to a file of its own, and the commit renames what all tasks finished.

Files are reached by Arrow's file systems, so paths are local, s3, gs or hdfs URIs that driver and executors share.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.values import fixed_width
from ..operators.delta import dirty_runs, whole
from ..operators.errors import WayfoldError
from .packed import DISK, HEAD, MEMORY, SCHEMA, SLICE, VERSION, pieces

NAME = "wayfold_images"
#: Bytes of a file that a partition reads, about.
PART_BYTES = 64 << 20
#: Files that a commit moves at once.
MOVERS = 32
#: Files that a task writes, about.
TASK_FILES = 500
PIECES = "disk string, piece long, content binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which may be a URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def disk_of(path: str, suffix: str) -> str:
    return unquote(path.rsplit("/", 1)[-1].removesuffix(suffix))


@dataclass
class Ranges(InputPartition):
    """(path, k, n): the k-th of n ranges of a file's blocks; several whole files if they are small."""

    of: list[tuple[str, int, int]]


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", ".img")
        self.kind = options.get("kind", DISK.decode()).encode()
        self.dense_size = int(options["dense_size"]) if "dense_size" in options else None
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[Ranges]:
        # Names and lengths only: headers are read by the tasks.
        system, at = opened(self.path)
        found = system.get_file_info(fs.FileSelector(at)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
        files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)]
        out, room = [], 0
        for path, size in sorted(files):
            if size >= self.part_bytes:
                n = -(-size // self.part_bytes)
                out += [Ranges([(path, k, n)]) for k in range(n)]
                room = 0
            elif size <= room:
                out[-1].of.append((path, 0, 1))
                room -= size
            else:
                out.append(Ranges([(path, 0, 1)]))
                room = self.part_bytes - size
        return out

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for path, k, n in part.of:
            yield from self._blocks(system, path, k, n)

    def _blocks(self, system: fs.FileSystem, path: str, k: int, n: int) -> Iterator[pa.RecordBatch]:
        disk = disk_of(path, self.suffix)
        with system.open_input_file(path) as f:
            length, head = f.size(), f.read(struct.calcsize(HEAD))
            packed = head[:4] == self.kind
            if packed:
                _, version, size, n_blocks, stored = struct.unpack(HEAD, head)
                if self.kind == DISK and version != VERSION:
                    raise ValueError(f"{path} has version {version}")
                if length < len(head) + stored * (8 + size):
                    raise ValueError(f"{path} ends before its {stored} blocks do")
            elif self.dense_size is None:
                raise ValueError(f"{path} does not begin with {self.kind.decode()}")
            else:
                size = self.dense_size
                n_blocks = stored = -(-length // size)
            for lo in range(k * stored // n, (k + 1) * stored // n, SLICE):
                count = min(lo + SLICE, (k + 1) * stored // n) - lo
                ids = list(range(lo, lo + count))
                if packed:
                    f.seek(len(head) + 8 * lo)
                    ids = list(struct.unpack(f"<{count}Q", f.read(8 * count)))
                f.seek((len(head) + 8 * stored if packed else 0) + lo * size)
                raw = f.read(count * size).ljust(count * size, b"\0")
                data = [raw[i * size : (i + 1) * size] for i in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array([disk] * count, "string"), pa.array([size] * count, "int32"), pa.array([n_blocks] * count, "int64"), pa.array(ids, "int64"), pa.array(data, "binary")], ["disk", "block_size", "n_blocks", "idx", "data"])


@dataclass
class Written(WriterCommitMessage):
    """The files that a task wrote: (name, bytes)."""

    files: list[tuple[str, int]]
    folder: str


class ImageWriter(DataSourceArrowWriter):
    """Streams pieces, which come sorted by (disk, piece) with a disk in one task, to a file a disk."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", ".img")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = opened(self.path)
        folder, files, now, out, last = f"{at}/_writing-{self.job}/{uuid.uuid4().hex}", [], None, None, -1
        system.create_dir(folder)

        def close() -> None:
            if out is not None:
                files.append((now, out.tell()))
                out.close()

        for batch in iterator:
            for disk, piece, content in zip(*(batch.column(c) for c in ("disk", "piece", "content"))):
                name = quote(disk.as_py(), safe="") + self.suffix
                if name != now:
                    close()
                    now, out, last = name, system.open_output_stream(f"{folder}/{name}"), -1
                if piece.as_py() <= last:
                    raise ValueError(f"pieces of {disk} are not in order")
                last = piece.as_py()
                out.write(content.as_buffer())
        close()
        return Written(files, folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        # A disk is a file: one after another, the moves of very many wait for the file system each.
        with ThreadPoolExecutor(MOVERS) as movers:
            for m in filter(None, messages):
                for _ in movers.map(lambda name, folder=m.folder: system.move(f"{folder}/{name}", f"{at}/{name}"), [name for name, _ in m.files]):
                    pass
        system.delete_dir(f"{at}/_writing-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        if system.get_file_info(f"{at}/_writing-{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{at}/_writing-{self.job}")


class PackedFiles(DataSource):
    """Options: ``path``; ``suffix`` of the files (.img); to read, ``kind`` (OVBD or TDIF), ``dense_size`` (files that are not
    of the kind are dense images of blocks of that size; without it they are an error), ``part_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(dict(self.options))


def read_images(spark: SparkSession, path: str, dense_size: int | None = None, kind: bytes = DISK, suffix: str = ".img", part_bytes: int = PART_BYTES) -> DataFrame:
    """(disk, block_size, n_blocks, idx, data) of every stored block of the files under ``path``; a disk is named by its file. Files without blocks give no row."""
    spark.dataSource.register(PackedFiles)
    options = {"kind": kind.decode(), "suffix": suffix, "part_bytes": str(part_bytes)} | ({} if dense_size is None else {"dense_size": str(dense_size)})
    return spark.read.format(NAME).options(**options).load(path)


def _write(rows: DataFrame, path: str, suffix: str, disks: int = 1) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(PackedFiles)
    system, at = opened(path)
    system.create_dir(at)
    # Opening files takes longer than their bytes: tasks are by the number of disks, a shuffle's at least.
    tasks = max(1, min(disks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-disks // TASK_FILES))
    rows.select("disk", "piece", "content").repartition(tasks, "disk").sortWithinPartitions("disk", "piece").write.format(NAME).option("suffix", suffix).mode("append").save(path)


def write_packed(blocks: DataFrame, sizes: DataFrame, path: str, block_size: int, kind: bytes = DISK, suffix: str = ".img") -> DataFrame:
    """Write the stored ``blocks`` (disk, idx, data) of the disks of ``sizes`` (disk, n_blocks) as packed files, one a disk, over older ones.

    Returns what was written: (disk, n_blocks, len, n_dirty), len in bytes of the whole image; the blocks' numbers are the
    runs of ``dirty_runs``. Blocks are padded or cut to ``block_size``. All files appear once every one is written.
    A disk of no name is an error.
    """
    if sizes.where("disk is null").take(1):
        raise WayfoldError("UnnamedDisk", "a disk without a name has no file")
    _write(pieces(blocks, sizes, block_size, kind), path, suffix, sizes.count())
    n = blocks.groupBy("disk").agg(F.count("*").alias("n_dirty"))
    return sizes.join(n, "disk", "left").select("disk", "n_blocks", (F.col("n_blocks") * block_size).alias("len"), F.coalesce("n_dirty", F.lit(0).cast("long")).alias("n_dirty"))


def write_dense(blocks: DataFrame, sizes: DataFrame, path: str, block_size: int, base: DataFrame | None = None, suffix: str = ".img") -> None:
    """Write each disk of ``sizes`` as a dense image: its ``blocks``, else those of ``base`` (None: zeros), in order of idx. A disk of no blocks is an empty file."""
    if sizes.where("disk is null").take(1):
        raise WayfoldError("UnnamedDisk", "a disk without a name has no file")
    each = whole(sizes, blocks, base, block_size).select("disk", F.col("idx").alias("piece"), fixed_width(F.col("data"), block_size).alias("content"))
    none = sizes.where("n_blocks = 0").select("disk", F.lit(0).cast("long").alias("piece"), F.lit(b"").alias("content"))
    _write(each.unionByName(none), path, suffix, sizes.count())


__all__ = ["DISK", "MEMORY", "PackedFiles", "dirty_runs", "read_images", "write_dense", "write_packed"]
