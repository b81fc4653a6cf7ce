"""Sharding by fixed virtual slots (operator 6, DataFrame functions only).

Records are hashed into a fixed number of virtual slots, bytes are summed per slot, and a versioned
slot-to-shard map says where each slot lives. Rebalancing edits the map and leaves the hash alone: for more shards slots
move to the new ones, for fewer those of the shards that go. A key that weighs as much as many slots has a slot of its
own in the map, so that it can be placed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, numbered, ordered, running, small, stage, stored, table

N_SLOTS = 4096
#: A key that weighs more than this share of a mean shard is heavy; there are fewer than its inverse for each shard.
HEAVY_SHARE = 1 / 8
MAP = "version int, slot int, key long, shard int"


def first_map(n_slots: int, n_shards: int) -> list[int]:
    return [s % n_shards for s in range(n_slots)]


def rebalance(held: list[int], slot_bytes: list[int], n_shards: int, tolerance: float = 1e-4, fixed: frozenset[int] = frozenset()) -> list[int]:
    """Edit a map: move single slots from the fullest shard to the emptiest while that narrows the gap.

    ``held[s]`` is the shard of slot ``s``; slots of ``fixed`` stay. The loop is over ``n_slots`` numbers, whatever the input's size.
    """
    to, load = list(held), [0] * n_shards
    of: list[set[int]] = [set() for _ in range(n_shards)]
    for s, shard in enumerate(to):
        load[shard] += slot_bytes[s]
        if s not in fixed:
            of[shard].add(s)
    mean = sum(load) / n_shards
    for _ in range(8 * len(to)):
        full, empty = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        if gap <= tolerance * mean:
            break
        useful = [s for s in of[full] if 0 < slot_bytes[s] < gap]
        if not useful:
            break
        s = min(useful, key=lambda s: (abs(2 * slot_bytes[s] - gap), s))
        of[full].remove(s)
        of[empty].add(s)
        to[s] = empty
        load[full] -= slot_bytes[s]
        load[empty] += slot_bytes[s]
    return to


def packed(heavy: dict[int, int], held: dict[int, int], n_shards: int, mean: float) -> dict[int, int]:
    """Shards for the keys of ``heavy`` (key to weight), all whole: the heaviest first, each where it was held if that
    leaves the shard within the mean or it is the emptiest, else on the emptiest shard."""
    load, to = [0] * n_shards, {}
    for key, weight in sorted(heavy.items(), key=lambda x: (-x[1], x[0])):
        best = min(range(n_shards), key=lambda s: (load[s], s))
        at = held.get(key, best)
        at = at if at < n_shards and (load[at] + weight <= mean or load[at] == load[best]) else best
        to[key] = at
        load[at] += weight
    return to


def shrink(held: list[int], slot_bytes: list[int], n_shards: int) -> list[int]:
    """The map for ``n_shards`` shards, fewer than there were: the slots of the shards that go move to the emptiest of the others, and none moves elsewhere."""
    to, load = list(held), [0] * n_shards
    for s, shard in enumerate(to):
        if shard < n_shards:
            load[shard] += slot_bytes[s]
    for s in sorted((s for s, shard in enumerate(to) if shard >= n_shards), key=lambda s: (-slot_bytes[s], s)):
        to[s] = min(range(n_shards), key=lambda i: (load[i], i))
        load[to[s]] += slot_bytes[s]
    return to


def grow(held: list[int], slot_bytes: list[int], n_shards: int, fixed: frozenset[int] = frozenset()) -> list[int]:
    """The map for one more shard: slots leave the fullest shards for the new one, and none moves elsewhere; slots of ``fixed`` stay."""
    to, load = list(held), [0] * (n_shards + 1)
    for s, shard in enumerate(to):
        load[shard] += slot_bytes[s]
    share = sum(load) / (n_shards + 1)
    for s in sorted(range(len(to)), key=lambda s: (-slot_bytes[s], s)):
        if s not in fixed and to[s] < n_shards and load[to[s]] - slot_bytes[s] / 2 >= share and load[n_shards] + slot_bytes[s] / 2 <= share:
            load[to[s]] -= slot_bytes[s]
            load[n_shards] += slot_bytes[s]
            to[s] = n_shards
    return to


def write_map(spark: SparkSession, path: str, version: int, to: list[int], heavy: dict[int, int]) -> None:
    """Add a version to the map at ``path``: rows (version, slot, key, shard). Hashed slots have no key; heavy keys
    have slots from ``len(to)`` on. A version that is there already is an error."""
    keys, shards = [None] * len(to) + list(heavy), to + list(heavy.values())
    # A few thousand numbers, whatever the input's size.
    text = ",".join(f"{'' if k is None else k}:{s}" for k, s in zip(keys, shards))
    each = F.split(F.element_at(F.split(F.lit(text), ","), (F.col("id") + 1).cast("int")), ":")
    rows = spark.range(len(shards)).select(F.col("id").cast("int").alias("slot"), each.alias("e"))
    rows.select("slot", F.nullif(F.element_at("e", 1), F.lit("")).cast("long").alias("key"), F.element_at("e", 2).cast("int").alias("shard")).coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version of the map at ``path``; None if there is none. A map that is there and cannot be read is an error."""
    if not stored(spark, path):
        return None
    rows = spark.read.schema(MAP).parquet(path)
    latest = rows.agg(F.max("version")).first()[0]
    return None if latest is None else rows.where(F.col("version") == latest)


def held_map(rows: DataFrame | None) -> tuple[int, list[int], dict[int, int]]:
    """(version, shard of each hashed slot, shard of each heavy key); version 0 if there is no map yet."""
    found = [] if rows is None else sorted(rows.collect(), key=lambda r: r["slot"])
    return found[0]["version"] if found else 0, [r["shard"] for r in found if r["key"] is None], {r["key"]: r["shard"] for r in found if r["key"] is not None}


def shard_by_slots(rows: DataFrame, key: Column, row_id: Column, size: Column, n_shards: int, n_slots: int = N_SLOTS, keep: dict[str, Column] | None = None, map_path: str | None = None) -> DataFrame:
    """Deal ``rows`` to shards of near equal ``size``; equal ``key`` values share a slot and so a shard.

    Returns the columns of ``keep``, with ``size``, ``virtual_slot``, ``map_version``, ``shard`` and ``slot``
    (the row's place in its shard, gapless from 0). Every key that weighs a mean shard at most stays whole, even where
    sizes are the less equal for it: heavy ones are placed first, the heaviest before the others, then the slots of all
    others are moved until sizes are near equal. Only a key that weighs more than a mean shard is spread, over all
    slots, by its rows' numbers within it.

    The map at ``map_path`` (a new one if None) is read, edited and stored as its next version. It keeps its number of
    slots, whatever ``n_slots``. For more shards than it has, slots move to the new ones alone, for fewer those of the shards
    that go; beyond that a slot moves only where the sizes ask for it. Null keys and ids hash like any value; rows that are
    alike in all are told apart by number alone; an empty table gives an empty result. The input is read once; every later
    step reads its staged digest. Places are counted over range partitions, so neither a shard nor a key is one task's.
    """
    spark, path = rows.sparkSession, map_path or new_path(rows.sparkSession, "shard-map")
    version, held, held_heavy = held_map(read_map(spark, path))
    n_slots = len(held) or n_slots
    # The hashed names cannot clash with the caller's columns: only what is kept and hashed goes on.
    kept = F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in (keep or {}).items()])
    digest = stage(rows.select(kept.alias("kept"), size.cast("long").alias("size"), F.xxhash64(key).alias("k"), F.xxhash64(row_id, key).alias("r"), F.monotonically_increasing_id().alias("row")), "shard-digest")
    mean = (digest.agg(F.sum("size")).first()[0] or 0) / n_shards
    # Fewer than n_shards / HEAVY_SHARE.
    keys = stage(digest.groupBy("k").agg(F.sum("size").alias("w")).where(F.col("w") > HEAVY_SHARE * mean).select("k", "w", (F.col("w") > mean).alias("spread")), "shard-heavy")
    whole = {r["k"]: r["w"] for r in keys.where("not spread").collect()}
    placed_whole = packed(whole, held_heavy, n_shards, mean)

    columns = ["kept", "size", "k", "r", "row"]
    hashed = lambda c: F.pmod(c, F.lit(n_slots)).cast("int").alias("virtual_slot")
    marked = digest.join(small(keys.select("k", "spread")), "k", "left")
    slotted = marked.where("spread is null or not spread").select(*columns, F.when(F.col("spread").isNull(), hashed(F.col("k"))).alias("virtual_slot"))
    if keys.where("spread").take(1):
        parted = numbered(stage(marked.where("spread").select(*columns), "shard-spread"), ["k"], ["r", "row"])
        slotted = slotted.unionByName(parted.select(*columns, hashed(F.col("nth"))))
    slotted = stage(slotted, "shard-slotted")

    slot_bytes = [0] * n_slots + [whole[k] for k in placed_whole]
    for virtual_slot, n_bytes in slotted.where("virtual_slot is not null").groupBy("virtual_slot").agg(F.sum("size")).collect():  # n_slots rows at most
        slot_bytes[virtual_slot] = n_bytes
    to = (held or first_map(n_slots, n_shards)) + list(placed_whole.values())
    fixed = frozenset(range(n_slots, len(slot_bytes)))
    if max(to) >= n_shards:
        to = shrink(to, slot_bytes, n_shards)
    for n in range(max(to[:n_slots]) + 1, n_shards):
        to = grow(to, slot_bytes, n, fixed)
    to = rebalance(to, slot_bytes, n_shards, fixed=fixed)
    write_map(spark, path, version + 1, to[:n_slots], placed_whole)
    latest = stage(read_map(spark, path).select(F.col("version").alias("map_version"), F.col("slot").alias("map_slot"), "key", F.col("shard").alias("map_shard")), "shard-map")

    # As many rows as the map: its slots, a few thousand, and eight heavy keys a shard at most.
    by_slot, by_key = small(latest.where("key is null").drop("key")), small(latest.where("key is not null"))
    light = slotted.where("virtual_slot is not null").join(by_slot, F.col("virtual_slot") == F.col("map_slot"))
    heavy = slotted.where("virtual_slot is null").join(by_key, F.col("k") == F.col("key"))
    named = [*columns, F.col("map_slot").alias("virtual_slot"), "map_version", F.col("map_shard").alias("shard")]
    placed = running(ordered(light.select(*named).unionByName(heavy.select(*named)), ["shard"], ["virtual_slot", "r", "row"]), ["shard"], {"nth": F.lit(1)})
    return placed.select(*[F.col("kept")[n].alias(n) for n in keep or {}], "size", "virtual_slot", "map_version", "shard", (F.col("nth") - 1).cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 16) -> DataFrame:
    """All documents in 16 shards under the law ``bytes``. A null text weighs 1 and hashes like an empty one."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = shard_by_slots(docs, text, F.col("doc_id"), F.octet_length(text) + 1, n_shards, keep={"doc_id": F.col("doc_id"), "text_crc32": F.crc32(text.cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
