"""Blocks of vectors, cells of query blocks and shards, and tree merging of best lists."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SHARD_ROWS, FAN_IN = 8192, 16
#: A query's hits, best first: ``low`` is the score negated. Whole scores beyond 64 bits are ranked by ``more``, empty else.
BEST = "array<struct<low: double, vec_id: long, row: long>>"
BEST_WHOLE = "array<struct<low: long, more: binary, vec_id: long, row: long>>"
#: Pairs of a query and a vector that are worth a cell, and that one should hold at most; between the two there are ``CELLS``, or three a core.
LEAST_PAIRS, MOST_PAIRS, CELLS = 1 << 23, 10**11, 48
#: Bytes that the queries of a cell and their best lists take in a Python worker, at most about, and that its shards have for a few queries; bytes of a hit.
CELL_BYTES, HIT_BYTES = 128 << 20, 28
#: Bytes of ``more``: as many as products of doubles need.
MORE_BYTES = 272


def usable(v: Column) -> Column:
    """Vectors that are not null and hold neither null nor non-finite components."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of float64; shorter vectors are filled up with zeros, which changes no inner product."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def table_of(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def packed(rows: DataFrame, per_block: int, content: Callable[[np.ndarray], dict[str, bytes]], fields: list[str], count: int) -> DataFrame:
    """Blocks of about ``per_block`` rows of (row, vec_id, asks, v): (part, width, n, n_asks, rows, ids, asks, *fields), staged.

    ``content`` turns a block's matrix into the binary columns ``fields``. A block's rows are in order of vec_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := table_of(batches)) is None:
            return
        order = np.lexsort((t.column("row").to_numpy(), t.column("vec_id").to_numpy()))
        t = t.take(pa.array(order)).combine_chunks()
        x, asks = matrix(t.column("v").chunk(0)), t.column("asks").to_numpy()
        made = content(x)
        counts = [pa.array([v], "int32") for v in (TaskContext.get().partitionId(), x.shape[1], len(x), asks.sum())]
        columns = [pa.array([v], "binary") for v in (t.column("row").to_numpy().tobytes(), t.column("vec_id").to_numpy().tobytes(), asks.tobytes(), *(made[f] for f in fields))]
        yield pa.RecordBatch.from_arrays([*counts, *columns], ["part", "width", "n", "n_asks", "rows", "ids", "asks", *fields])

    schema = "part int, width int, n int, n_asks int, rows binary, ids binary, asks binary" + "".join(f", {f} binary" for f in fields)
    return stage(rows.repartition(max(1, -(-count // per_block))).mapInArrow(run, schema), "vector-blocks")


def asking(blocks: DataFrame) -> DataFrame:
    """Of each block the rows that ask: (part, width, rows, ids, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asks = np.frombuffer(batch["asks"][i].as_buffer(), bool)
                picked = [np.frombuffer(batch[f][i].as_buffer(), "uint8").reshape(len(asks), -1)[asks].tobytes() for f in ("rows", "ids", "data")]
                yield pa.RecordBatch.from_arrays([batch["part"].slice(i, 1), batch["width"].slice(i, 1), *[pa.array([v], "binary") for v in picked]], ["part", "width", "rows", "ids", "data"])

    return blocks.where("n_asks > 0").select("part", "width", "asks", "rows", "ids", "data").mapInArrow(run, "part int, width int, rows binary, ids binary, data binary")


def grid(blocks: int, rows: int, asked: int, vector_bytes: int, query_bytes: int, k: int, cores: int) -> tuple[int, int]:
    """Groups of query blocks, and of shards; a cell is a pair of them.

    A vector is sent to as many cells as there are groups of queries, a query and its lists to as many as there are groups of
    shards; the groups are those that send the fewest bytes. The queries of a cell and their lists fit a worker, and
    however few these are, a task doesn't go through all shards of a large table.
    """
    pairs = rows * asked
    cells = max(min(pairs / LEAST_PAIRS, max(CELLS, 3 * cores)), pairs / MOST_PAIRS, vector_bytes / CELL_BYTES, 1)
    moved = query_bytes + asked * k * HIT_BYTES
    # Queries are put together from their blocks, and a hit is joined by others before it is dropped.
    groups = -(-2 * moved // CELL_BYTES)
    of_shards = round((cells * vector_bytes / max(moved, 1)) ** 0.5)
    of_queries = min(max(1, groups, round(cells / max(of_shards, 1))), blocks)
    return of_queries, min(max(1, round(cells / of_queries)), blocks)


class Best:
    """The ``k`` best hits of each query of a cell so far, in slices of the queries, each sorted by query, score, id and row."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, whole: bool):
        self.ids, self.rows, self.k, self.whole, self.held = ids, rows, k, whole, {}

    def least(self, of: slice) -> np.ndarray:
        """The k-th best score of each query, in doubles; -inf where there are fewer, or where scores are Python's."""
        out = np.full(of.stop - of.start, -np.inf)
        if of.start in self.held and (value := self.held[of.start][1]).dtype != object:
            at = self.held[of.start][0]
            last = np.searchsorted(at, np.arange(len(out)), "right") - 1
            full = np.bincount(at, minlength=len(out)) == self.k
            out[full] = value[last[full]]
        return out

    def add(self, of: slice, at: np.ndarray, value: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(at):
            return
        if value.dtype != object:
            value = value.astype("int64" if self.whole else "float64")
        new = (at, value, ids, rows)
        if of.start in self.held:
            new = tuple(np.concatenate(x) for x in zip(self.held[of.start], new))
        at, value, ids, rows = new
        if value.dtype == object:  # too large for numbers of the machine
            order = np.array(sorted(range(len(at)), key=lambda i: (at[i], -value[i], ids[i], rows[i])))
        else:
            order = np.lexsort((rows, ids, -value, at))
        at = at[order]
        order = order[np.arange(len(at)) - np.searchsorted(at, at) < self.k]
        self.held[of.start] = tuple(x[order] for x in new)

    def lists(self, shard: int) -> Iterator[pa.RecordBatch]:
        for start, (at, value, ids, rows) in sorted(self.held.items()):
            found, first = np.unique(at, return_index=True)
            hits = [pa.array(ids), pa.array(rows)]
            items = pa.StructArray.from_arrays([*_lows(value), *hits], ["low", "more", "vec_id", "row"]) if self.whole else pa.StructArray.from_arrays([pa.array(-value), *hits], ["low", "vec_id", "row"])
            ends = pa.array(np.append(first, len(at)).astype("int32"))
            yield pa.RecordBatch.from_arrays([pa.array(self.rows[start + found]), pa.array(self.ids[start + found]), pa.array(np.full(len(found), shard, "int32")), pa.ListArray.from_arrays(ends, items)], ["row", "query_id", "shard", "best"])


def nearest(blocks: DataFrame, fields: list[str], together: Callable[[list[dict]], np.ndarray], score: Callable, k: int, whole: bool = False) -> DataFrame:
    """(row, query_id, best): the ``k`` best of each row that asks, over all of ``blocks``, which are staged.

    Query blocks and shards are dealt to cells, each a task: it holds its queries and their best so far, and goes through its
    shards one by one. Nothing is joined, so nothing is broadcast; of a query, one list leaves a cell. ``together`` gives
    the matrix of some query blocks. ``score`` gets that matrix, the queries' ids, a shard with its arrays ``ids`` and ``rows``, and what
    gives the k-th best score so far of a slice of the queries; it gives (slice, place in the slice, place in the shard, score) of
    all hits that may be of the best, a query's own vec_id left out. Scores are doubles, or with ``whole`` whole numbers:
    in floats that hold them, in 64 bits, or as Python's.
    """
    size = sum((F.octet_length(f).cast("long") for f in ("rows", "ids", *fields)), F.lit(0).cast("long"))
    asked_size = F.coalesce(F.octet_length("data") / F.col("n"), F.lit(0)) + 16
    n_blocks, n, asked, vector_bytes, query_bytes = (int(x or 0) for x in blocks.agg(F.count("*"), F.sum("n"), F.sum("n_asks"), F.sum(size), F.sum(asked_size * F.col("n_asks"))).first())
    by_query, by_shard = grid(max(n_blocks, 1), n, asked, vector_bytes, query_bytes, k, blocks.sparkSession.sparkContext.defaultParallelism)
    each = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    cell = lambda query, shard: (query * by_shard + shard).cast("int").alias("cell")
    part, g, sent = F.col("part"), F.col("g"), ["part", "width", "rows", "ids", *fields]
    left = asking(blocks).select("*", each(by_shard)).select(cell(part % by_query, g), F.lit(0).alias("side"), "part", "width", "rows", "ids", *[F.col(f) if f == "data" else F.lit(None).cast("binary").alias(f) for f in fields])
    right = blocks.select(*sent, each(by_query)).select(cell(g, part % by_shard), F.lit(1).alias("side"), *sent)
    dealt = left.unionByName(right).repartitionById(by_query * by_shard, "cell").sortWithinPartitions("cell", "side", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, best = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {f: batch[f][i].as_py() for f in ("cell", "side", "width")} | {f: batch[f][i].as_buffer() for f in ("rows", "ids", *fields) if batch[f][i].is_valid}
                r |= {f: np.frombuffer(r[f], "int64") for f in ("rows", "ids")}
                if r["cell"] != now:
                    if best:
                        yield from best.lists(now % by_shard)
                    now, queries, best = r["cell"], [], None
                if not r["side"]:
                    queries.append(r)
                elif queries or best:
                    if not best:
                        best = Best(*(np.concatenate([q[f] for q in queries]) for f in ("ids", "rows")), k, whole)
                        x, queries = together(queries), []
                    for of, at, col, value in score(x, best.ids, r, best.least):
                        best.add(of, at, value, r["ids"][col], r["rows"][col])
        if best:
            yield from best.lists(now % by_shard)

    return merged(dealt.mapInArrow(run, f"row long, query_id long, shard int, best {BEST_WHOLE if whole else BEST}"), k, by_shard)


def padded(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of all ``parts``, filled up with zeros."""
    out, at = np.zeros((sum(map(len, parts)), max(p.shape[1] for p in parts)), np.result_type(*parts)), 0
    for p in parts:
        out[at : at + len(p), : p.shape[1]] = p
        at += len(p)
    return out


def own(query_ids: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Queries that have rows of their own id among ``ids``, which are in order, and these rows."""
    low, high = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    return ((i, slice(low[i], high[i])) for i in np.flatnonzero(high > low))


def chosen(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, place in the shard, score) of the ``k`` best of each row of ``scores``; of those as good as ``least`` only, where there is one."""
    n = scores.shape[1]
    if scores.dtype == object:
        # Too large for numbers of the machine: in Python, row by row. Columns are in order of ids and rows.
        ranked = [sorted((j for j in range(n) if ids[j] != query_ids[i]), key=lambda j, i=i: (-scores[i, j], j))[:k] for i in range(len(scores))]
        at, col = np.repeat(np.arange(len(scores)), [len(r) for r in ranked]), np.array([j for r in ranked for j in r], "int64")
        return at, col, scores[at, col]
    none = -np.inf if scores.dtype.kind == "f" else np.iinfo("int64").min
    for i, js in own(query_ids, ids):
        scores[i, js] = none
    bare = np.flatnonzero(np.isneginf(least))
    if len(bare) and n > k:
        least[bare] = np.partition(scores[bare] if len(bare) < len(scores) else scores, n - k, axis=1)[:, n - k]
    if scores.dtype.kind == "f":
        # Whole scores that single precision holds stay in their order to any rounded bound.
        least = least.astype(scores.dtype)
    good = scores >= least[:, None]
    if scores.dtype.kind == "f" and np.count_nonzero(good) > 8 * k * len(scores):
        for i in np.flatnonzero(np.count_nonzero(good, axis=1) > 4 * k):
            ties = np.flatnonzero(scores[i] == least[i])[:k]
            good[i] = scores[i] > least[i]
            good[i, ties] = True
    at, col = np.divmod(np.flatnonzero(good), n)
    others = query_ids[at] != ids[col]
    at, col = at[others], col[others]
    return at, col, scores[at, col]


def _lows(scores: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """``low`` and ``more`` of whole scores."""
    most = 2**63 - 1
    if scores.dtype != object:
        return pa.array(-scores.astype("int64")), pa.array([b""] * len(scores), "binary")
    low = [-int(v) for v in scores]
    return pa.array([max(-most - 1, min(most, v)) for v in low], "int64"), pa.array([b"" if -most <= v <= most else (v + (1 << (8 * MORE_BYTES - 1))).to_bytes(MORE_BYTES, "big") for v in low], "binary")


def merged(tops: DataFrame, k: int, n_shards: int) -> DataFrame:
    """Lists of one query merged ``FAN_IN`` at a time, level by level, to (row, query_id, best)."""
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    while n_shards > FAN_IN:
        tops = tops.groupBy("row", "query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(best)
        n_shards = -(-n_shards // FAN_IN)
    return tops.groupBy("row", "query_id").agg(best)
