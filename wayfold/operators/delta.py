"""Blocks and pages: differences, overlays, whole images, maps, forks, address lookups.

A disk or a memory image is rows (disk, idx, data); what is not there is zero. Whole images and bases are
shared by reference: a child is its own rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import fixed_width, page_of
from .ordered import HOT_SHARE, numbered, ordered, stage, with_facts

BLOCK_SIZE = PAGE_SIZE = 4096


def zero(size: int) -> Column:
    return F.lit(bytes(size))


def changed(working: DataFrame, base: DataFrame | None, size: int = BLOCK_SIZE) -> DataFrame:
    """Blocks of ``working`` that differ from ``base`` (None: from zeros). Blocks that only the base has do not count."""
    mine = working.select("disk", "idx", fixed_width(F.col("data"), size).alias("data"))
    if base is None:
        return mine.where(F.col("data") != zero(size))
    theirs = base.select("disk", "idx", fixed_width(F.col("data"), size).alias("was"))
    return mine.join(theirs, ["disk", "idx"], "left").where(F.col("data") != F.coalesce("was", zero(size))).select("disk", "idx", "data")


def read_blocks(wanted: DataFrame, upper: DataFrame, base: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """(disk, idx, data, layer) of the wanted (disk, idx): from the upper, else from the base, else zeros."""
    up = upper.select("disk", "idx", F.col("data").alias("u"))
    low = base.select("disk", "idx", F.col("data").alias("b"))
    both = wanted.join(up, ["disk", "idx"], "left").join(low, ["disk", "idx"], "left")
    layer = F.when(F.col("u").isNotNull(), "upper").when(F.col("b").isNotNull(), "base").otherwise("zero")
    return both.select("disk", "idx", fixed_width(F.coalesce("u", "b", zero(size)), size).alias("data"), layer.alias("layer"))


def write_blocks(upper: DataFrame, writes: DataFrame) -> DataFrame:
    """The upper after the point writes (disk, idx, data, seq): the last write of a block wins."""
    last = writes.groupBy("disk", "idx").agg(F.max_by("data", "seq").alias("data"))
    return upper.join(last, ["disk", "idx"], "left_anti").unionByName(last)


def whole(sizes: DataFrame, upper: DataFrame, base: DataFrame | None = None, size: int = BLOCK_SIZE) -> DataFrame:
    """Every block of the disks of ``sizes`` (disk, n_blocks): from the upper, else from the base (None: there is none), else zeros."""
    base = upper.limit(0) if base is None else base
    every = sizes.where("n_blocks > 0").select("disk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("idx"))
    return read_blocks(every, upper, base, size)


def block_map(upper: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """(disk, idx, layer, offset): where each block of a packed upper lies, in order of idx."""
    rows = numbered(stage(upper.select("disk", "idx"), "block-map"), ["disk"], ["idx"])
    return rows.select("disk", "idx", F.lit("upper").alias("layer"), ((F.col("nth") - 1) * size).alias("offset"))


def dirty_runs(blocks: DataFrame) -> DataFrame:
    """(disk, idx, n): the stored blocks of each disk as runs of ``n`` neighbours from ``idx`` on, a row a run.

    Blocks that are stored twice count once. A disk's numbers are never one row's list, and rows of one disk may be many tasks'.
    """
    rows = numbered(stage(blocks.select("disk", "idx").distinct(), "dirty"), ["disk"], ["idx"])
    return rows.groupBy("disk", (F.col("idx") - F.col("nth")).alias("_run")).agg(F.min("idx").alias("idx"), F.count("*").alias("n")).select("disk", "idx", "n")


def headers(sizes: DataFrame, upper: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """(disk, n_blocks, size, n_dirty, dirty_bytes) of each disk of ``sizes``."""
    n = upper.groupBy("disk").agg(F.count("*").alias("n_dirty"))
    return sizes.join(n, "disk", "left").select("disk", "n_blocks", (F.col("n_blocks") * size).alias("size"), F.coalesce("n_dirty", F.lit(0)).alias("n_dirty"), (F.coalesce("n_dirty", F.lit(0)) * size).alias("dirty_bytes"))


def memory_headers(images: DataFrame, dirty: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """(disk, page_size, len, n_pages, n_dirty) of each image of ``images`` (disk, n_blocks, packed).

    All pages of a dense image count as dirty; which pages of a packed one are is in the rows of ``dirty``.
    """
    rows = headers(images.select("disk", "n_blocks"), dirty, size).select("disk", "n_dirty")
    n = F.when(F.col("packed"), F.col("n_dirty")).otherwise(F.col("n_blocks"))
    return images.join(rows, "disk").select("disk", F.lit(size).alias("page_size"), (F.col("n_blocks") * size).alias("len"), F.col("n_blocks").alias("n_pages"), n.alias("n_dirty"))


def fork(upper: DataFrame, children: DataFrame, writes: DataFrame) -> DataFrame:
    """(child, disk, idx, data): each child's upper, the parent's overlaid by the child's own ``writes``.

    ``children`` has (disk, child). A block that a child wrote itself is not taken from the parent.
    """
    own = writes.select("child", "disk", "idx", "data")
    shared = children.join(upper, "disk").join(own.select("child", "disk", "idx"), ["child", "disk", "idx"], "left_anti")
    return shared.select("child", "disk", "idx", "data").unionByName(own)


def reopen(stored: DataFrame, bases: DataFrame) -> DataFrame:
    """Disks of ``stored`` (disk, base_id, base_uri, upper) with the base they stand on: by id, else by place. A disk whose base is
    missing has the error StateNotFound and nothing to stand on; the others go on."""
    known = bases.select(F.col("base_id"), F.col("uri").alias("by_id"))
    placed = bases.select(F.col("uri").alias("base_uri"), F.col("uri").alias("by_uri"))
    both = stored.withColumn("base_id", F.coalesce("base_id", F.lit("rootfs"))).join(known, "base_id", "left").join(placed.distinct(), "base_uri", "left")
    base = F.coalesce("by_id", "by_uri")
    return both.select("disk", base.alias("base"), F.when(base.isNotNull(), F.coalesce("upper", F.lit("upper"))).alias("upper"), F.when(base.isNull(), "StateNotFound").alias("error"))


#: Address bits below the sign: an interval of 2**62 is the largest that a region is cut into.
LEVELS = 63


def intervals(regions: DataFrame) -> DataFrame:
    """``regions`` with (level, at): each region cut into whole intervals [at * 2**level, (at + 1) * 2**level), two a level at most."""
    end, one = F.col("base") + F.col("size"), F.lit(1).cast("long")
    cut = regions.where("size > 0").select("*", end.alias("_end"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    # The level's intervals that lie in the region; those that the next level's leave over are an odd first and an odd last one.
    below = F.call_function("shiftleft", one, F.col("level")) - 1
    lo = F.call_function("shiftright", F.col("base"), F.col("level")) + F.when(F.col("base").bitwiseAND(below) != 0, 1).otherwise(0)
    hi = F.call_function("shiftright", F.col("_end"), F.col("level"))
    ends = F.array(F.when(F.pmod("_lo", F.lit(2)) == 1, F.col("_lo")), F.when(F.pmod("_hi", F.lit(2)) == 1, F.col("_hi") - 1))
    cut = cut.withColumns({"_lo": lo, "_hi": hi}).where("_lo < _hi")
    return cut.withColumn("at", F.explode(F.array_compact(ends))).drop("_end", "_lo", "_hi")


def locate(addresses: DataFrame, regions: DataFrame) -> DataFrame:
    """(address, region, page) of each address: the first region that holds it, by ordinal; null if none does.

    ``regions`` has (region, base, size, offset, page_size); they may overlap and nest, and hold from one byte to 2**62. Each is cut
    into at most two intervals for each power of two, and an interval keeps its first region alone. An address lies in
    one interval of each length that occurs, so the range join is an equi-join of at most 63 rows an address. Intervals that very many
    addresses lie in are broadcast, so their rows stay in place. Null addresses are in no region.
    """
    # A region's place in order stands for it: minima of whole numbers are kept in hash tables, and no row carries a region's columns.
    placed = ordered(regions.select("region", "base", "size", "offset", "page_size"), ["region", "base", "offset", "page_size"], []).withColumnRenamed("_seq", "place").drop("_part")
    nodes = stage(intervals(placed).groupBy("level", "at").agg(F.min("place").alias("place")).select(F.struct("level", "at").alias("node"), "place"), "intervals")
    levels = sorted(r["level"] for r in nodes.select("node.level").distinct().collect())
    level = F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")).alias("level")
    known = stage(addresses.where("address is not null").select("address").distinct(), "addresses")
    asked = known.select("address", level)
    asked = asked.select("address", F.struct("level", F.call_function("shiftright", F.col("address"), F.col("level")).alias("at")).alias("node"))
    hits = with_facts(asked, *_asked(asked, nodes, "node"))
    best = stage(hits.groupBy("address").agg(F.min("place").alias("place")), "places")
    best = with_facts(best, *_asked(best, placed, "place"))
    page = page_of(F.col("address"), F.col("base"), F.col("offset"), F.col("page_size"))
    return addresses.join(best.select("address", "region", page.alias("page")), "address", "left").select("address", "region", "page")


def _asked(rows: DataFrame, facts: DataFrame, key: str) -> tuple[DataFrame, str, Column]:
    """What ``with_facts`` takes: the facts of keys that ``rows`` hold, and which of these are hot."""
    known = stage(facts.join(rows.groupBy(key).agg(F.count("*").alias("asks")), key), f"{key}-asked")
    total = known.agg(F.sum("asks")).first()[0] or 0
    return known, key, F.col("asks") > HOT_SHARE * total
