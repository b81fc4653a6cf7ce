"""Decimals of doubles, against Python's own."""

import math
import random
import struct

from wayfold.functions import values


def doubles():
    rng = random.Random(10)
    out = [2.675, 1.00005, 0.00005, 0.00015, 0.5, 0.125, 0.0625, 0.03125, 2.5, 1e-5, 1e-14, 9999995.0, 999999.5, 999998.5, 99999.95, 123456789.123456789, 1234567890123.45678, 123456789012345.671875, 4503599627370497.5, 0.1 + 0.2, 1e15, 1e16 / 3, 9.99999949e-5, 1e5, 1e6, 100000.5]
    out += [10.0**e for e in range(-14, 16)] + [math.nextafter(10.0**e, s) for e in range(-14, 16) for s in (0, math.inf)]
    out += [rng.random() * 10 ** rng.randrange(-12, 15) for _ in range(5000)] + [rng.randrange(10**9) / 2 ** rng.randrange(1, 40) for _ in range(3000)]
    while len(out) < 12_000:
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if math.isfinite(x) and 2.0**-49 <= abs(x) < 2.0**53:
            out.append(x)
        out.append(rng.randrange(10**7) / 10**4 + 0.00005)
    return [s * x for x in out for s in (1, -1)]


def test_exact_decimals(spark):
    given = doubles()
    df = spark.createDataFrame([(x,) for x in given], "x double")
    out = df.select("x", values.rounded(values.F.col("x")).alias("r"), values.general(values.F.col("x")).alias("g")).collect()
    assert len(out) == len(given)
    assert [(r.x, r.r, repr(round(r.x, 4))) for r in out if abs(r.x) < 2.0**53 and not r.x.is_integer() and r.r != repr(round(r.x, 4))] == []
    assert [(r.x, r.g, f"{r.x:g}") for r in out if 2.0**-49 <= abs(r.x) < 2.0**53 and r.g != f"{r.x:g}"] == []


def test_snapshot_of_odd_counters(spark):
    df = spark.createDataFrame([({"usd": 2.675, "z": 1e-9, "steps": 3.0, "neg": -0.00001},), (None,)], "c map<string,double>")
    assert [r.s for r in df.select(values.budget_snapshot(values.F.col("c")).alias("s")).collect()] == ['{"neg":-0.0,"steps":3,"usd":2.675,"z":0.0}', None]


def test_products_near_a_half_are_rounded_exactly(spark):
    """Where the product of doubles can't tell which side of a half a value is on, the whole numbers do."""
    import math
    from decimal import ROUND_HALF_EVEN, Decimal

    halves = [(k + 0.5) / 10**4 for k in (0, 1, 7, 1234, 99_999, 123_456_789, 2**40 + 1)] + [0.5 + 2.0**-30, 2.0**-49, 3.0]
    asked = [x for v in halves for x in (math.nextafter(v, 0), v, math.nextafter(v, math.inf))]
    out = spark.createDataFrame([(x,) for x in asked], "x double").select("x", values.scaled(values.F.col("x"), values.F.lit(4)).alias("n")).collect()
    assert {r.x: int(r.n) for r in out} == {x: int((Decimal(x) * 10**4).to_integral_value(ROUND_HALF_EVEN)) for x in asked}
