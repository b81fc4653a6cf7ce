"""Chains of layers, nested regions and bucketed tables."""

import random

import pytest

from tests.conftest import SF
from wayfold.operators import delta, layers
from wayfold.operators.errors import WayfoldError
from wayfold.plans import registry

LAYERS, BLOCKS = "layer string, parent string", "layer string, idx long, data binary"


def test_reads_find_the_nearest_layer(spark):
    """A chain of five, a hundred children of its tip that store only their own rows; brute force."""
    rng = random.Random(1)
    parent = {"l0": None, **{f"l{i}": f"l{i - 1}" for i in range(1, 5)}, **{f"c{i}": "l4" for i in range(100)}, "alone": None}
    held = {(name, rng.randrange(12)): b"%d" % i for i, name in enumerate(rng.choices(list(parent)[:105], k=260))}
    made = [(c, p) for c, p in parent.items() if not c.startswith("c")]
    chain, failures = layers.fork_layers(spark.createDataFrame(made, LAYERS), spark.createDataFrame([(c, p) for c, p in parent.items() if c.startswith("c")], LAYERS))
    assert sorted(map(tuple, chain.collect())) == sorted(parent.items()) and failures.count() == 0
    blocks = spark.createDataFrame([(*k, v) for k, v in held.items()], BLOCKS)
    wanted = [(name, i) for name in parent for i in range(13)]

    def read(name, i):
        while name is not None and (name, i) not in held:
            name = parent[name]
        return held.get((name, i), b"").ljust(4, b"\0"), name

    out = layers.read_layers(chain, blocks, spark.createDataFrame(wanted, "layer string, idx long"), 4)
    assert {(r.layer, r.idx): (bytes(r.data), r.source) for r in out.collect()} == {(n, i): read(n, i) for n, i in wanted}
    whole = {n: [read(n, i)[1] for i in range(13) if read(n, i)[1]] for n in parent}
    sizes = {r.layer: (r.own_bytes, r.full_bytes, r.shared_bytes) for r in layers.layer_sizes(chain, blocks, 4).collect()}
    assert sizes == {n: (4 * sum(k[0] == n for k in held), 4 * len(s), 4 * sum(x != n for x in s)) for n, s in whole.items()}
    total = layers.stored_bytes(chain, blocks, 4).first()
    assert tuple(total) == (len(parent), sum(s[1] for s in sizes.values()), 4 * len(held), 4 * len(set(held.values())))


def test_forks_that_fail_leave_the_others(spark):
    given, kids = [("a", None)], [("b", "a"), ("a", "a"), ("c", "none"), ("d", "a"), ("e", "a"), ("e", "a"), ("f", None)]
    out, failures = layers.fork_layers(spark.createDataFrame(given, LAYERS), spark.createDataFrame(kids, LAYERS), broken=layers.F.col("layer") == "d")
    assert sorted(r.layer for r in out.collect()) == ["a", "b"]
    assert {r.layer: r.error for r in failures.collect()} == {"a": "LayerExists", "c": "StateNotFound", "d": "BranchFailed", "e": "LayerExists", "f": "StateNotFound"}
    with pytest.raises(WayfoldError, match="its own"):
        layers.chains(spark.createDataFrame([("a", "b"), ("b", "a")], LAYERS))


def test_huge_and_nested_regions(spark):
    """One region of 2**50 bytes over thousands of small ones, some nested, empty or of a byte; first match by ordinal."""
    rng = random.Random(2)
    regions = [(0, (1 << 50) + 7, 1 << 20), (9_000, 0, 1 << 50), (9_001, 0, 1 << 62), (3, 5, 0)]
    regions += [(i, rng.randrange(1 << 40), rng.choice([1, 2, 4096, 4097, rng.randrange(1 << 36)])) for i in range(10, 3000)]
    asked = [0, 1, (1 << 50) - 1, 1 << 50, (1 << 50) + 7, (1 << 62) - 1, 1 << 62, (1 << 63) - 1, -1, None]
    asked += [b + d for _, b, n in rng.sample(regions, 300) for d in (-1, 0, n - 1, n) if b + d >= 0] + [77] * 500
    out = delta.locate(spark.createDataFrame([(a,) for a in asked], "address long"), spark.createDataFrame([(*r, r[0] * 4096, 4096) for r in regions], "region int, base long, size long, offset long, page_size long"))
    got = out.collect()
    assert len(got) == len(asked)

    def first(a):
        return min((r for r in regions if a is not None and r[1] <= a < r[1] + r[2]), default=None)

    for r in {r.address: r for r in got}.values():
        hit = first(r.address)
        assert (r.region, r.page) == ((None, None) if hit is None else (hit[0], (hit[0] * 4096 + r.address // 4096 * 4096 - hit[1]) // 4096))
    assert delta.locate(spark.createDataFrame([(1,)], "address long"), spark.createDataFrame([], "region int, base long, size long, offset long, page_size long")).first().region is None


def test_bucketed_tables_join_in_place(spark):
    plan = registry.QUERIES["q71_bucketed_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_lookups_are_aggregated_in_hash_tables(spark, monkeypatch):
    """Minima of structs are sorted, a task's rows at a time; those of whole numbers are not."""
    plans, stage = [], delta.stage
    monkeypatch.setattr(delta, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, name))
    regions = spark.createDataFrame([(2, 0, 8, 0, 4), (1, 4, 4, 4096, 4), (1, 4, 4, 0, 4)], "region int, base long, size long, offset long, page_size long")
    out = delta.locate(spark.createDataFrame([(5,), (1,), (9,)], "address long"), regions)
    assert sorted((r.address, r.region, r.page) for r in out.collect() if r.region) == [(1, 2, 0), (5, 1, 0)]
    assert plans and not any("SortAggregate" in p for p in plans)
