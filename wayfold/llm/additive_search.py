"""Approximate nearest neighbours by additive quantisation (operator 9).

A vector is coded as a sum of one codeword from each of several codebooks over all dimensions, found by beam
search over the residuals. Inner products with a query are sums of table entries; divided by the stored norm
of the sum they rank all vectors; the best are ranked again on the original vectors. Each vector's angle to its sum is
stored: no vector is nearer to a query than the query is to the sum, less that angle. All vectors that may be
nearer than the best so far are ranked on the original vectors as well, so none is missed, whatever the vectors are.
The first candidates of a cell by their codes give its first best; its later shards go on from the best so far.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import SHARD_ROWS, matrix, nearest, own, packed, padded, usable

K = 5
BOOKS, WORDS, BEAM = 24, 256, 4
#: Sweeps of a least-squares fit; each fits every book to what the others leave.
SWEEPS = 8
#: Vectors that codebooks are trained on, at most about; all vectors are indexed.
SAMPLE_ROWS = 16384
#: Candidates of each query that are ranked exactly first, over all shards; beyond ``RERANK_ROWS`` rows they grow with the root of the rows.
RERANK, RERANK_ROWS = 200, 100_000
SLICE = 64
#: Numbers of vectors that are ranked at a time.
RANKED = 1 << 21


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def summed(x: np.ndarray, to: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of ``x`` by their group ``to`` of ``k``."""
    order, out = np.argsort(to, kind="stable"), np.zeros((k, x.shape[1]), x.dtype)
    found, first = np.unique(to[order], return_index=True)
    out[found] = np.add.reduceat(x[order], first, axis=0)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.RandomState, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)
        sums, counts = summed(x, near, k), np.bincount(near, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)]).astype("float32")
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, per_slice: int = 2048) -> np.ndarray:
    """Codes of each row, by beam search: at each book the ``beam`` sums with the least residual go on."""
    out = np.empty((len(x), len(books)), "uint8")
    squares = (books * books).sum(2)
    for at in range(0, len(x), per_slice):
        rest = x[at : at + per_slice, None, :]
        n = len(rest)
        codes = np.zeros((n, 1, 0), "uint8")
        for book, square in zip(books, squares):
            width = rest.shape[1]
            gain = (rest.reshape(n * width, -1) @ (-2 * book).T).reshape(n, width, -1)
            gain += square
            gain += (rest * rest).sum(2)[:, :, None]
            flat = gain.reshape(n, -1)
            best = np.empty((n, min(beam, flat.shape[1])), "int64")
            for i in range(best.shape[1]):
                best[:, i] = flat.argmin(axis=1)
                np.put_along_axis(flat, best[:, i : i + 1], np.inf, 1)
            path, word = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, path[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None].astype("uint8")], 2)
        out[at : at + per_slice] = codes[:, 0]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 1) -> np.ndarray:
    """Codebooks: k-means on residuals, book by book, then least squares on beam codes, by sweeps over the books."""
    rng, x = np.random.RandomState(seed), x.astype("float32")
    rest, out = x.copy(), []
    for _ in range(books):
        out.append(kmeans(rest, words, rng))
        rest = rest - out[-1][np.argmax(rest @ out[-1].T - 0.5 * (out[-1] ** 2).sum(1), axis=1)]
    found = np.stack(out)
    for _ in range(rounds):
        codes = encode(x, found)
        rest = x - decode(codes, found)
        for _ in range(SWEEPS):
            for m in range(books):
                step = summed(rest, codes[:, m], words) / (np.bincount(codes[:, m], minlength=words)[:, None] + 0.05).astype("float32")
                found[m] += step
                rest -= step[codes[:, m]]
    return found


def trained_on(n: int) -> Column:
    """Whether a row (vec_id, v) of ``n`` is of the sample: by a hash of all of it, since ids may repeat."""
    return F.pmod(F.xxhash64(F.col("vec_id").cast("long"), "v", F.lit("train")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE_ROWS / max(n, 1))))


def reranked(n: int, rerank: int = RERANK) -> int:
    """Candidates of each query over ``n`` rows."""
    return int(np.ceil(rerank * max(1.0, n / RERANK_ROWS) ** 0.5))


def reached(near: np.ndarray, v: np.ndarray, q: np.ndarray, first: int, k: int) -> np.ndarray:
    """Of each query (a row of ``near``) the k-th best cosine with ``first`` of those nearest by their codes; -inf if these are fewer than ``k``."""
    first = min(first, near.shape[1])
    i, j = np.divmod(np.flatnonzero(near >= np.partition(near, -first, axis=1)[:, -first, None]), near.shape[1])
    kept = (np.arange(len(i)) - np.searchsorted(i, i) < first) & (near[i, j] > -np.inf)
    i, j = i[kept], j[kept]
    value = (v[j] * q[i]).sum(1)
    value = value[np.lexsort((-value, i))]
    out, start, count = np.full(len(near), -np.inf), np.searchsorted(i, np.arange(len(near))), np.bincount(i, minlength=len(near))
    out[count >= k] = value[start[count >= k] + k - 1]
    return out


def ranked(most: np.ndarray, angles: np.ndarray, v: np.ndarray, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine) of all vectors that reach their query's ``floor``; those of no ``most`` are left out.

    ``most`` bounds the cosine of a vector's sum and a query from above. At an angle of ``angles`` from the sum, a vector reaches
    the floor only if the sum's angle to the query is at most the floor's and that angle together.
    """
    low = np.clip(floor - 1e-5, -1, 1)
    high = np.sqrt(1 - low * low)
    may = most >= np.cos(angles)[:, None] * low.astype("float32") - np.sin(angles)[:, None] * high.astype("float32")
    rest = (np.pi - np.arccos(low)).astype("float32")
    if angles.max() >= rest.min() - 1e-6:  # together half a turn or more: nothing is ruled out
        may |= (angles[:, None] >= rest - np.float32(1e-6)) & (most > -np.inf)
    # Products of unit vectors, in single precision and then in double, rule out most of what codes leave.
    for kind, off in (("float32", (v.shape[1] + 8) * 1.2e-7), ("float64", 1e-9)):
        if np.count_nonzero(may) > may.size / 32:
            may &= v.astype(kind) @ q.T.astype(kind) >= (floor - off).astype(kind)
    at = np.flatnonzero(may)
    found, step = [], max(1, RANKED // v.shape[1])
    for start in range(0, len(at), step):
        j, i = np.divmod(at[start : start + step], len(q))
        # Row by row in the same order, so that equal vectors have equal scores.
        value = (v[j] * q[i]).sum(1)
        keep = value >= floor[i]
        found.append((i[keep], j[keep], value[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (at, at, np.zeros(0))


def search(vectors: DataFrame, is_query: Column, k: int = K, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest of each query by cosine, in double precision.

    ``vectors`` has (vec_id, embedding) and what ``is_query`` needs. Vectors that are null, zero or hold null or non-finite components,
    and rows with a null vec_id, take no part. A query's own vec_id is left out with all rows that bear it;
    other repeated ids are candidates of their own, and a repeated query has a list for each of its rows.
    Shorter vectors count as filled up with zeros. Ties go to smaller vec_ids. An empty table gives an
    empty result. Codebooks are fitted on a bounded sample; every vector is indexed and scored. ``rerank``
    candidates are ranked exactly, more beyond ``RERANK_ROWS`` rows, then all that their codes don't rule out.
    """
    spark = vectors.sparkSession
    kind = "float32" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "float64"
    nonzero = F.exists("embedding", lambda x: x != 0)
    v = F.col("embedding") if kind == "float32" else F.col("embedding").cast("array<double>")
    rows = vectors.where(usable(F.col("embedding")) & nonzero & F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.coalesce(is_query, F.lit(False)).alias("asks"), v.alias("v"))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    rerank = reranked(n, rerank)
    doubles = rows.select("vec_id", F.col("v").cast("array<double>").alias("v"))
    sample = doubles.where(trained_on(n)).select("v").limit(2 * SAMPLE_ROWS).toArrow()
    if not len(sample):  # rows alike are all of the sample or none is
        sample = doubles.select("v").limit(SAMPLE_ROWS).toArrow()
    x = np.zeros((max(len(sample), 1), width or 1))
    if len(sample):
        found = matrix(sample.column("v").combine_chunks())
        x[:, : found.shape[1]] = found
    books = spark.sparkContext.broadcast(pickle.dumps(train(unit(x))))  # BOOKS * WORDS codewords

    n_shards = max(1, -(-n // SHARD_ROWS))
    first = max(k, -(-rerank // n_shards))

    def plain(x: np.ndarray) -> dict[str, bytes]:
        return {"data": np.pad(x, ((0, 0), (0, (width or 1) - x.shape[1]))).astype(kind).tobytes()}

    def plain_matrix(block: dict) -> np.ndarray:
        return np.frombuffer(block["data"], kind).reshape(-1, width or 1)

    def whole(x: np.ndarray) -> np.ndarray:
        return unit(x.astype("float64"))

    def coded(x: np.ndarray) -> dict[str, bytes]:
        b, made = pickle.loads(books.value), plain(x)
        x = whole(plain_matrix(made))
        codes = encode(x.astype("float32"), b)
        at = decode(codes, b.astype("float64"))
        norms = np.sqrt((at * at).sum(1))
        half = np.sqrt(((x - at / np.maximum(norms, 1e-300)[:, None]) ** 2).sum(1)) / 2
        # A sum of no direction rules nothing out.
        angles = np.where(norms < 1e-3, np.pi, 2 * np.arcsin(np.minimum(half, 1)))
        return made | {"codes": codes.tobytes(), "norms": np.maximum(norms, 1e-3).astype("float32").tobytes(), "angles": angles.astype("float32").tobytes()}

    def scored(x: np.ndarray, query_ids: np.ndarray, s: dict, least: Callable[[slice], np.ndarray]) -> Iterator[tuple]:
        b, v = pickle.loads(books.value), whole(plain_matrix(s))
        words = b.reshape(-1, b.shape[2]).astype("float64")
        codes = np.ascontiguousarray(np.frombuffer(s["codes"], "uint8").reshape(-1, len(b)).T)
        norms, angles = np.frombuffer(s["norms"], "float32"), np.frombuffer(s["angles"], "float32")
        # Sums of so many entries in single precision are off by less.
        slack = 3e-7 * len(b) * np.sqrt((b * b).sum(2)).max(1).sum() / norms + np.float32(1e-6)
        for at in range(0, len(x), SLICE):
            of = slice(at, min(at + SLICE, len(x)))
            q = whole(x[of])
            near = np.zeros((len(v), len(q)), "float32")
            for m, entries in enumerate((words @ q.T).astype("float32").reshape(*b.shape[:2], -1)):
                near += np.take(entries, codes[m], axis=0)
            near /= norms[:, None]
            for i, js in own(query_ids[of], s["ids"]):
                near[js, i] = -np.inf
            floor = least(of)
            bare = np.flatnonzero(np.isneginf(floor))
            if len(bare):
                floor[bare] = reached(np.ascontiguousarray(near[:, bare].T), v, q[bare], first, k)
            i, j, value = ranked(near + slack[:, None], angles, v, q, floor)
            yield of, i, j, value

    blocks = packed(rows, SHARD_ROWS, coded, ["data", "codes", "norms", "angles"], n)
    best = nearest(blocks, ["data", "codes", "norms", "angles"], lambda parts: padded([plain_matrix(p) for p in parts]), scored, k)
    each = best.select("query_id", F.posexplode("best").alias("rank", "hit"))
    return each.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.low")).alias("score"))


def op9_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 50 against all rows."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
