"""Exact top-k search by tiled matrix products (operator 5)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import SHARD_ROWS, chosen, nearest, packed, padded, usable

K = 20
SCALE = 64
#: Queries of a cell that are multiplied with a shard at a time.
SLICE = 256


def _whole(x: np.ndarray) -> dict[str, bytes]:
    """floor(64 x) in 8 or 16 bits where those hold a block, else whole 64ths in doubles: beyond 2**52 a double is whole, and 64 times it may be too large for one."""
    small = np.abs(x) < 2**52
    y = np.floor(SCALE * np.where(small, x, 0))
    for kind in ("int8", "int16"):
        if small.all() and np.iinfo(kind).min <= y.min(initial=0) and y.max(initial=0) <= np.iinfo(kind).max:
            return {"data": y.astype(kind).tobytes()}
    return {"data": np.where(small, y / SCALE, x).tobytes()}


def _matrix(block: dict) -> np.ndarray:
    """A block's rows, whole numbers or doubles."""
    n, width, size = len(block["ids"]), block["width"], len(block["data"])
    kind = {1: "int8", 2: "int16", 8: "float64"}[size // (n * width)] if size else "int8"
    return np.frombuffer(block["data"], kind).reshape(n, width)


def _together(blocks: list[dict]) -> np.ndarray:
    parts = [_matrix(b) for b in blocks]
    if any(p.dtype.kind == "f" for p in parts):
        parts = [p if p.dtype.kind == "f" else p / SCALE for p in parts]
    return padded(parts)


def _most(x: np.ndarray) -> float:
    return (1 if x.dtype.kind == "i" else SCALE) * max(-float(x.min(initial=0)), float(x.max(initial=0))) + 1


def _scaled(x: np.ndarray, kind: str) -> np.ndarray:
    return (x if x.dtype.kind == "i" else np.floor(SCALE * x)).astype(kind)


def _exact(x: np.ndarray) -> np.ndarray:
    """floor(64 x) in Python's numbers."""
    if x.dtype.kind == "i":
        return x.astype(object)
    return np.array([[math.floor(SCALE * v) if abs(v) < 2**52 else SCALE * int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _score(x: np.ndarray, query_ids: np.ndarray, s: dict, least: Callable[[slice], np.ndarray], k: int) -> Iterator[tuple]:
    """Best integer inner products: in floats of 32 or 64 bits where those hold every sum, else in 64 bits, else in Python's numbers."""
    y = _matrix(s)
    width = min(x.shape[1], y.shape[1])
    x, y = x[:, :width], y[:, :width]
    most = max(width, 1) * _most(x) * _most(y)
    kind = next((kind for kind, bits in (("float32", 24), ("float64", 53), ("int64", 62)) if most < 2**bits), None)
    turn = (lambda z: _scaled(z, kind)) if kind else _exact
    y = turn(y).T
    for at in range(0, len(x), SLICE):
        of = slice(at, min(at + SLICE, len(x)))
        yield of, *chosen(turn(x[of]) @ y, query_ids[of], s["ids"], least(of), k)


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` highest integer inner products of each query with all rows.

    ``vectors`` has (vec_id, embedding) and what ``is_query`` needs; components become floor(64 x). Vectors that are
    null or hold null or non-finite components, and rows with a null vec_id, take no part. A query's own vec_id is
    left out with all rows that bear it; other repeated ids are candidates of their own, and a repeated query has a
    list for each of its rows. Shorter vectors count as filled up with zeros. Ties go to smaller vec_ids. An empty
    table gives an empty result. Ranks are by exact sums of any size; a score beyond 64 bits is given as the
    nearest number of 64 bits.
    """
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    rows = vectors.where(good).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col("embedding").alias("v"))
    blocks = packed(rows, SHARD_ROWS, _whole, ["data"], rows.count())
    best = nearest(blocks, ["data"], _together, lambda x, ids, s, least: _score(x, ids, s, least, k), k, whole=True)
    each = best.select("query_id", F.posexplode("best").alias("rank", "hit"))
    # The least number of 64 bits has no negative; it stands for scores beyond the greatest.
    most = F.lit(2**63 - 1)
    score = F.when(F.col("hit.low") < -most, most).otherwise(-F.greatest(F.col("hit.low"), -most))
    return each.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), score.alias("score"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 20 against all rows."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, (row_number() over w)::int as rank, vec_id, score from s
window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= {K}
"""
