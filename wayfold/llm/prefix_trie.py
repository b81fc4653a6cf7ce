"""The trie of conversation prefixes, from mergeable partial tries (operator 13).

A node is named by a hash of all turns from the root to it. That hash is a sum of hashes of (place, turn), so it is a running
sum: no conversation is gathered. Each partition combines its turns into a partial trie, a table with a row for each node; tables
are merged by node, first within bundles of partitions, then over all. Sums and least members merge; the conversations that
end at a node are a sorted list in pieces.

The rollup goes bottom-up along each conversation: what its own nodes (those whose least member it is) hold is summed from its
end to each place, and these sums are merged by node. A node's subtree is made of such ends of conversations, so one pass is
enough, however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import HOT_SHARE, by_size, numbered, stage, table, with_facts

#: Rows of a partial trie that a partition holds before it gives them out.
HELD = 1 << 16
#: Bundles of partitions whose tables are merged first.
BUNDLES = 32
#: Ids of a piece of a node's list of ends.
PIECE = 4096
#: A group of this many conversations shares the first turns of its first one, up to three.
GROUP, MOST_SHARED = 20, 4
PARTS = ("s0", "s1", "s2", "s3")


def merged(rows: DataFrame, firsts: list[str], sums: list[str], least: list[str]) -> DataFrame:
    """One row for each ``node`` of ``rows``: of ``firsts`` any value (they are alike), of ``sums`` the sum, of ``least`` the least.

    Partitions give tables that are combined locally; these are merged in bundles, then all.
    """
    spec = [(c, "one") for c in firsts] + [(c, "sum") for c in sums] + [(c, "min") for c in least]
    names = ["node", *[c for c, _ in spec]]
    rows = rows.select(*names)
    schema = StructType([*rows.schema.fields, StructField("bundle", IntegerType())])

    def combined(parts: list[pa.RecordBatch]) -> pa.Table:
        held = pa.Table.from_batches(parts).group_by("node").aggregate(spec)
        return held.select(["node", *[f"{c}_{how}" for c, how in spec]]).rename_columns(names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, held = TaskContext.get().partitionId() % BUNDLES, []
        for batch in batches:
            held += combined([batch]).to_batches()
            if sum(b.num_rows for b in held) >= HELD:
                held = combined(held).to_batches()
                if sum(b.num_rows for b in held) >= HELD // 2:
                    yield from (b.append_column("bundle", pa.array([bundle] * b.num_rows, "int32")) for b in held)
                    held = []
        if held:
            yield from (b.append_column("bundle", pa.array([bundle] * b.num_rows, "int32")) for b in combined(held).to_batches())

    how = {"one": F.any_value, "sum": F.sum, "min": F.min}
    out = rows.mapInArrow(partial, schema)
    for keys in (["node", "bundle"], ["node"]):
        out = out.groupBy(*keys).agg(*[how[h](c).alias(c) for c, h in spec])
    return out


def _hashed(*values: Column) -> list[Column]:
    """The MD5 of ``values`` as four numbers of 32 bits, whose sums over any number of rows fit a long."""
    digest = F.md5(F.concat_ws("\x1f", *values).cast("binary"))
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(PARTS)]


def paths(turns: DataFrame) -> DataFrame:
    """(conv, place, node, parent, words, is_end) for each turn of ``turns`` (conv, place, role, text), staged.

    Places number a conversation's turns from 1 without gaps; ``is_end`` marks its last one. A turn's node is the same in all conversations that are alike up to it.
    """
    words = F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long").alias("words")
    # The lengths keep apart what the separators in role and text might not.
    own = turns.select("conv", "place", words, *_hashed(F.col("place").cast("string"), F.length("role").cast("string"), "role", "text"))
    own = stage(own, "trie-turns")
    ends = own.groupBy("conv").agg(F.max("place").alias("last"), F.count("*").alias("held"))
    summed = by_size(own, ["conv"], ["place"], lambda rows, add: add(rows, {f"to_{p}": F.col(p) for p in PARTS}))
    name = lambda place, sums: F.unhex(F.md5(F.concat_ws(",", place.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))
    before = [F.col(f"to_{p}") - F.col(p) for p in PARTS]
    found = summed.select("conv", "place", name(F.col("place"), [F.col(f"to_{p}") for p in PARTS]).alias("node"), name(F.col("place") - 1, before).alias("parent"), "words")
    ends = stage(ends, "trie-ends")
    hot = F.col("held") > HOT_SHARE * (ends.agg(F.sum("held")).first()[0] or 0)
    return stage(with_facts(found, ends, "conv", hot).select("conv", "place", "node", "parent", "words", (F.col("place") == F.col("last")).alias("is_end")), "trie-paths")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from pieces that come sorted by node and place; what is held is one hash state."""
    node, state = None, None
    for batch in batches:
        nodes, digests = [], []
        for of, text in zip(batch.column("node"), batch.column("piece")):
            of = of.as_py()
            if of != node:
                if node is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = of, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, "binary"), pa.array(digests, "string")], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], "binary"), pa.array([state.hexdigest()], "string")], ["node", "ends_sha256"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first, piece): each stretch of up to ``PIECE`` rows (node, conv) of one node, as comma-joined ids; rows come sorted."""
    for batch in batches:
        node, conv = batch.column("node"), batch.column("conv")
        cuts = pc.fill_null(pc.not_equal(node[1:], node[:-1]), True).to_numpy(zero_copy_only=False).nonzero()[0] + 1 if batch.num_rows > 1 else []
        starts, out = [0, *[int(c) for c in cuts], batch.num_rows] if batch.num_rows else [0], []
        for lo, hi in zip(starts, starts[1:]):
            for at in range(lo, hi, PIECE):
                ids = conv[at : min(hi, at + PIECE)].to_pylist()
                out.append((node[at].as_py(), ids[0], ",".join(map(str, ids)).encode()))
        kinds = zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.int64(), pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in kinds], ["node", "first", "piece"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``ends`` (node, conv): the SHA-256 of a node's conversations, rising, comma-joined.

    The rows are sorted over all partitions, so the list of one node may span many; only its pieces of thousands of ids
    meet in one task, one after another, since such a digest can only be taken in order.
    """
    rows = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    pieces = stage(rows.mapInArrow(_pieces, "node binary, first long, piece binary"), "trie-pieces")
    return pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "piece").mapInArrow(_digested, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of the conversations ``convs`` (conv), with turns ``turns`` (conv, place, role, text).

    Columns: ``node`` (its hash), ``conv_id`` (the least conversation that starts so), ``depth``, ``parent_conv_id`` (the
    parent's; null for the root), ``n_convs``, ``n_children``, ``n_leaves`` (of its subtree, itself included), ``saved_tokens`` (of its
    subtree: each node's conversations but one, times the words of its last text) and ``ends_sha256``.
    Every conversation has the root, without turns too; without conversations there is no node. Role and text must not be null.
    """
    # The root is a place 0 of every conversation.
    root = F.unhex(F.md5(F.lit("0,0,0,0,0").cast("binary")))
    walks = paths(turns)
    none = convs.join(walks.select("conv").distinct(), "conv", "left_anti").select("conv", F.lit(True).alias("is_end"))
    roots = none.unionByName(walks.where("place = 1").select("conv", F.lit(False).alias("is_end")))
    roots = roots.select("conv", F.lit(0).cast("long").alias("place"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), "is_end")
    walks = stage(walks.unionByName(roots), "trie-walks")

    one = walks.withColumns({"n_convs": F.lit(1).cast("long"), "conv_id": F.col("conv"), "depth": F.col("place")})
    nodes = stage(merged(one, ["parent", "depth", "words"], ["n_convs"], ["conv_id"]), "trie-nodes")
    children = stage(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "trie-children")
    nodes = stage(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-grown")
    n_rows, n_nodes = walks.count(), nodes.count()

    # What a conversation's own nodes hold, from its end up to each place.
    facts = nodes.select("node", "conv_id", "n_convs", (F.col("n_children") == 0).alias("is_leaf"))
    own = F.col("conv") == F.col("conv_id")
    seen = with_facts(walks, facts, "node", F.col("n_convs") > HOT_SHARE * n_rows)
    seen = stage(seen.select("conv", (-F.col("place")).alias("up"), "node", F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"), F.when(own & F.col("is_leaf"), 1).otherwise(0).cast("long").alias("leaf")), "trie-seen")
    rolled = by_size(seen, ["conv"], ["up"], lambda rows, add: add(rows, {"saved_tokens": F.col("saved"), "n_leaves": F.col("leaf")}))
    totals = merged(rolled, [], ["saved_tokens", "n_leaves"], [])

    ends = end_digests(walks.where("is_end").select("node", "conv"))
    parents = stage(nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of")), "trie-parents")
    below = with_facts(nodes.where("parent is not null"), parents, "parent", F.col("of") > HOT_SHARE * n_nodes).drop("of")
    named = below.unionByName(nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast(dict(nodes.dtypes)["conv_id"])))
    out = named.join(totals, "node").join(ends, "node", "left")
    return out.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of ``conversations`` (conv_id, turn, role, text), with first turns shared within groups of twenty ids.

    A conversation c takes the first h turns of conversation c - c % 20 (all, if those are fewer; none, if it is absent) and its own after
    its first h, h being the CRC-32 of its id modulo 4. Turns are in order of ``turn``, null first, then of role and text; null roles and
    texts are empty. Rows without a conv_id belong to no conversation.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    given = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.col("turn").isNotNull(), F.lit(False)).alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"), blank("role"), blank("text"))
    # Rows alike in all are alike in the result, whatever their order.
    rows = stage(numbered(stage(given, "trie-given"), ["conv"], ["has_turn", "turn", "role", "text"]).select("conv", F.col("nth").alias("nth"), "role", "text"), "trie-numbered")
    convs = rows.groupBy("conv").agg(F.count("*").alias("n"))
    shared = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(MOST_SHARED)).alias("h")
    convs = stage(convs.select("conv", "n", (F.col("conv") - F.col("conv") % GROUP).alias("head"), shared), "trie-convs")
    heads = convs.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    convs = stage(convs.join(heads, "head", "left").withColumn("taken", F.least("h", F.coalesce("head_n", F.lit(0))).cast("long")).select("conv", "n", "head", "h", "taken"), "trie-shares")
    first = rows.where(F.col("nth") < MOST_SHARED).withColumnRenamed("conv", "head")
    lent = first.join(convs.where("taken > 0").select("head", "conv", "taken"), "head").where("nth <= taken").select("conv", F.col("nth").alias("place"), "role", "text")
    hot = F.col("n") > HOT_SHARE * rows.count()
    kept = with_facts(rows, convs.select("conv", "n", "h", "taken"), "conv", hot).where("nth > h").select("conv", (F.col("nth") - F.col("h") + F.col("taken")).alias("place"), "role", "text")
    return lent.unionByName(kept), convs.select("conv")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt: a row for each node. An empty table gives an empty result."""
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations"))).drop("node")


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv as varchar), ''), lambda c: ascii(c)::bigint)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""
OP13_SQL = f"""
with given as (
  select conv_id as conv, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as nth
  from conversations where conv_id is not null),
convs as (select conv, conv - conv % 20 as head, {_CRC} % 4 as h from (select distinct conv from given)),
taken as (select c.*, least(h, (select count(*) from given g where g.conv = c.head)) as k from convs c),
turns as (
  select t.conv, g.nth as place, g.role, g.text from taken t join given g on g.conv = t.head where g.nth <= t.k
  union all select t.conv, g.nth - t.h + t.k, g.role, g.text from taken t join given g on g.conv = t.conv where g.nth > t.h),
whole as (select c.conv, coalesce(list(struct_pack(r := t.role, t := t.text) order by t.place) filter (where t.place is not null), []) as path from convs c left join turns t on t.conv = c.conv group by c.conv),
walks as (select conv, unnest(generate_series(0, len(path))) as depth, path from whole),
members as (select conv, depth, path[1 : depth] as prefix, depth = len(path) as is_end from walks),
nodes as (
  select prefix, depth, min(conv) as conv_id, count(*) as n, coalesce(string_agg(cast(conv as varchar), ',' order by conv) filter (where is_end), '') as ends,
    case when depth = 0 then 0 else len(list_filter(string_split_regex(prefix[depth].t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) end as words
  from members group by prefix, depth),
kids as (select prefix[1 : depth - 1] as prefix, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by all),
grown as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k on k.prefix = n.prefix and k.depth = n.depth),
above as (select conv_id, depth, unnest(generate_series(0, depth)) as up, prefix, (n - 1) * words as saved, (n_children = 0)::int as leaf from grown),
sums as (select prefix[1 : up] as prefix, up as depth, sum(saved)::bigint as saved, sum(leaf)::bigint as leaves from above group by all)
select g.conv_id, g.depth::bigint as depth, p.conv_id as parent_conv_id, g.n::bigint as n_convs, g.n_children::bigint as n_children, s.leaves as n_leaves, s.saved as saved_tokens, sha256(g.ends) as ends_sha256
from grown g join sums s on s.prefix = g.prefix and s.depth = g.depth left join nodes p on p.depth = g.depth - 1 and p.prefix = g.prefix[1 : g.depth - 1]
"""
