"""Operators 5 and 9 against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wayfold.llm import additive_search, topk_search
from wayfold.llm import vectors as cells

V = "vec_id long, embedding array<float>, score string"


def vectors(spark, odd=True):
    rng = np.random.RandomState(0)
    rows = [(i, [float(x) for x in np.round(rng.randn(6), 1)], "s") for i in range(120)] + [(i, [0.5] * 6, "s") for i in range(200, 260)]
    if odd:
        rows += [(300, None, "s"), (320, [None] * 6, "s"), (340, [float("nan")] * 6, "s"), (360, [float("inf")] + [0.0] * 5, "s"), (380, [], "s"), (400, [1.0, 2.0], "s"), (None, [1.0] * 6, "s"), (20, [0.25] * 6, "again"), (500, [0.0] * 6, "zero")]
    return rows, spark.createDataFrame(rows, V).repartition(5)


def usable(rows):
    return [(i, np.pad(np.array(v, float), (0, 6 - len(v)))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]


def test_exact_top_k(spark):
    rows, df = vectors(spark)
    good = [(i, np.floor(64 * np.array(v, "float32").astype(float))) for i, v in usable(rows)]
    wanted = []
    for q, x in good:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:20]
            wanted += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    out = [tuple(r) for r in topk_search.search(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(out) == sorted(wanted)
    assert topk_search.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = topk_search.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3]


@pytest.mark.parametrize("size", [1e5, 1e8, 1e13, 1e160])
def test_products_beyond_doubles(spark, size):
    rng = np.random.RandomState(3)
    given = [(i, [float(size * v) for v in rng.randn(2)] + [float(rng.randint(3))]) for i in range(30)] + [(30 + i, [size, size, 1.0 + i / 64]) for i in range(4)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    exact = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in given}
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.search(df, F.col("vec_id") >= 0, k=6).collect()}
    for q, x in exact.items():
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in exact.items() if i != q)[:6]
        for rank, (low, i) in enumerate(best, 1):
            found, score = out[(q, rank)]
            assert (found, score) == (i, max(1 - 2**63, min(2**63 - 1, -low)))


def test_queries_by_any_column(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "q"), (2, [1.0, 1.0], "c"), (3, [0.0, 1.0], None)], "vec_id long, embedding array<float>, kind string")
    assert [(r.query_id, r.vec_id) for r in topk_search.search(df, F.col("kind") == "q", k=1).collect()] == [(1, 2)]
    assert [(r.query_id, r.vec_id) for r in additive_search.search(df, F.col("kind") == "q", k=1).collect()] == [(1, 2)]


def test_one_repeated_id(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0])] * 50 + [(8, [2.0, 1.0]), (50, [1.0, 1.9])], "vec_id long, embedding array<float>")
    out = additive_search.search(df, F.col("vec_id") % 50 == 0, k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == [(50, 1, 7), (50, 2, 7), (50, 3, 7)]
    assert additive_search.search(df.where("vec_id = 7"), F.col("vec_id") == 7).count() == 0


def cosines(good, q, x):
    unit = lambda v: v / np.linalg.norm(v)
    return sorted((-float(unit(x) @ unit(y)), i) for i, y in good if i != q)


def test_approximate_search(spark):
    rows, df = vectors(spark)
    good = [(i, v) for i, v in usable([(i, v if v is None else [None if c is None else float(np.float32(c)) for c in v], s) for i, v, s in rows]) if v.any()]
    out = additive_search.search(df, F.col("vec_id") % 50 == 0, rerank=60).collect()
    hits = total = 0
    for q, x in good:
        if q % 50 == 0:
            mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
            best = cosines(good, q, x)[:5]
            assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
            total += 5
            hits += sum(abs(r.score + b[0]) < 1e-9 for r, b in zip(mine, best))
    assert hits / total >= 0.9
    assert additive_search.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    data = df.toPandas()
    x = np.stack(data["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = data["vec_id"].to_numpy()
    found = {}
    for r in additive_search.search(df, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        s = x @ x[at]
        s[at] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        hits += len(found[ids[at]] & set(best.tolist()))
        total += 5
    assert hits / total >= 0.9


@pytest.mark.parametrize("n", [30_000, 150_000])
def test_recall_beyond_the_sample(spark, tmp_path, n):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.RandomState(11).randn(n, 64).astype("float32")
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    rows = df.where(F.col("vec_id") % (n // 200) == 0).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    unseen = {r.vec_id for r in rows.where(~additive_search.trained_on(n)).select("vec_id").collect()}
    assert len(unseen) > 60
    found = {}
    for r in additive_search.search(df, F.col("vec_id").isin(*unseen)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in unseen:
        s = x @ x[q]
        s[q] = -9
        hits += len(found[q] & set(np.argsort(-s)[:5].tolist()))
    print("recall", n, hits, 5 * len(unseen))
    assert hits / (5 * len(unseen)) >= 0.95


def test_reranking_grows():
    n = additive_search.RERANK_ROWS
    assert additive_search.reranked(n) == additive_search.RERANK and additive_search.reranked(4 * n) == 2 * additive_search.RERANK


def hard(kind, n=12_000, width=32):
    """Rows that codes tell apart badly: one direction with small changes, many tight groups, wide and rare scales, or kinds that the sample hardly has."""
    rng = np.random.RandomState(5)
    if kind == "one direction":
        return 5 * rng.randn(width) + 0.01 * rng.randn(n, width)
    if kind == "tight groups":
        return rng.randn(12, width)[rng.randint(12, size=n)] + 1e-4 * rng.randn(n, width)
    if kind == "almost equal":
        return rng.randn(width) + 1e-7 * rng.randn(n, width)
    x = rng.randn(n, width) * np.exp(3 * rng.randn(width))
    x[::50] = rng.randn(width) * 1e6 + rng.randn(len(x[::50]), width)
    return x


@pytest.mark.parametrize("kind", ["one direction", "tight groups", "almost equal", "rare kinds"])
def test_nothing_is_missed(spark, tmp_path, kind):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = hard(kind)
    n, width = x.shape
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), width).cast(pa.list_(pa.float64()))}), tmp_path / "v.parquet")
    out = {(r.query_id, r["rank"]): r for r in additive_search.search(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 200 == 0).collect()}
    assert len(out) == 5 * -(-n // 200)
    x = additive_search.unit(x)
    for q in range(0, n, 200):
        s = (x * x[q]).sum(1)
        s[q] = -9
        assert [out[q, r].vec_id for r in range(1, 6)] == np.lexsort((np.arange(n), -s))[:5].tolist()


def test_equal_vectors_tie(spark):
    v = [[float(c) for c in row] for row in np.random.RandomState(6).randn(2, 7)]
    df = spark.createDataFrame([(i, v[min(i, 1)]) for i in range(400, -1, -1)], "vec_id long, embedding array<double>").repartition(6)
    assert sorted((r["rank"], r.vec_id) for r in additive_search.search(df, F.col("vec_id") == 0).collect()) == [(r, r) for r in range(1, 6)]


def test_nothing_of_op5_is_broadcast(spark):
    plan = topk_search.search(vectors(spark)[1], F.col("vec_id") % 20 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan


def test_cells_at_size():
    """Fifteen million rows: a worker's queries and lists stay small, and what is sent is a few times the input."""
    n, asked, vector, k = 15_000_000, 750_000, 80, 20
    by_query, by_shard = cells.grid(-(-n // 8192), n, asked, n * vector, asked * vector, k, 12)
    assert asked / by_query * 2 * (vector + k * cells.HIT_BYTES) <= 1.1 * cells.CELL_BYTES
    assert by_query * by_shard >= 48 and by_query * n * vector + by_shard * asked * (vector + k * cells.HIT_BYTES) <= 16 * n * vector
    assert cells.grid(1, 0, 0, 0, 0, k, 12) == (1, 1)
    assert cells.grid(-(-n // 8192), n, 1, n * 304, 272, 5, 12) == (1, round(n * 304 / cells.CELL_BYTES))


@pytest.mark.parametrize("sizes", [(1,), (100,), (1, 1e3), (1, 1e5), (1, 1e9, 1e17), (1, 1e200)])
def test_many_cells(spark, monkeypatch, sizes):
    """Blocks of all kinds of numbers, many ties, repeated ids and short vectors, over several groups of queries and of shards."""
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 12)
    monkeypatch.setattr(topk_search, "SLICE", 5)
    monkeypatch.setattr(cells, "LEAST_PAIRS", 300)
    grids = []
    monkeypatch.setattr(cells, "grid", lambda *a, f=cells.grid: grids.append(f(*a)) or grids[-1])
    rng = np.random.RandomState(8)
    given = [(int(rng.randint(90)), [float(sizes[rng.randint(len(sizes))] * v) for v in rng.randint(-2, 3, size=rng.randint(1, 4)) / 2]) for _ in range(160)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>").repartition(3)
    exact = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in given]
    wanted = []
    for q, x in exact:
        if q % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in exact if i != q)[:7]
            wanted += [(q, rank, i, max(1 - 2**63, min(2**63 - 1, -low))) for rank, (low, i) in enumerate(best, 1)]
    out = [tuple(r) for r in topk_search.search(df, F.col("vec_id") % 3 == 0, k=7).collect()]
    assert sorted(out) == sorted(wanted)
    assert min(grids[0]) > 1


def test_nothing_of_op9_is_broadcast(spark):
    plan = additive_search.search(vectors(spark)[1], F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("kind", ["one direction", "tight groups", "almost equal", "rare kinds"])
def test_nothing_is_missed_over_many_cells(spark, tmp_path, monkeypatch, kind):
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(additive_search, "SHARD_ROWS", 300)
    monkeypatch.setattr(cells, "LEAST_PAIRS", 20_000)
    grids = []
    monkeypatch.setattr(cells, "grid", lambda *a, f=cells.grid: grids.append(f(*a)) or grids[-1])
    x = hard(kind, n=3000, width=16)
    x[700:800], ids = x[700], np.arange(len(x))
    ids[40:50], ids[::7] = 40, ids[::-7][: len(ids[::7])]
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 16).cast(pa.list_(pa.float64()))}), tmp_path / "v.parquet")
    found = {}
    for r in additive_search.search(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = additive_search.unit(x)
    for q in np.unique(ids[ids % 20 == 0]):
        wanted = []
        for at in np.flatnonzero(ids == q):
            s = (x * x[at]).sum(1)
            s[ids == q] = -9
            wanted += [(r, int(ids[j]), float(s[j])) for r, j in enumerate(np.lexsort((ids, -s))[:5], 1)]
        assert sorted(found[q]) == sorted(wanted)
    assert len(found) == len(np.unique(ids[ids % 20 == 0])) and grids[0][0] * grids[0][1] > 3
