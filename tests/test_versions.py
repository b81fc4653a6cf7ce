"""Versioned tables: what an upsert rewrites, and what readers see."""

import os

import pytest

from wayfold.operators.errors import WayfoldError
from wayfold.sources import versions

SCHEMA = "k long, seq int, a string, b string"
ARGS = (["k"], ["seq"], ["a"], ["b"])


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(at):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{at}/data") for f in names if f.endswith(".parquet")}


def test_a_correction_rewrites_one_bucket(spark, tmp_path):
    at = str(tmp_path / "t")
    assert versions.read_version(spark, at, *ARGS) is None and versions.versions(spark, at) == []
    first = spark.createDataFrame([(i, 1, f"a{i}", f"b{i}") for i in range(500)], SCHEMA)
    assert versions.upsert_version(first, at, ["k"], ["seq"], buckets=16) == 1
    reader, before = versions.read_version(spark, at, *ARGS), files(at)
    late = spark.createDataFrame([(7, 2, "late", None), (7, 0, "early", "x")], SCHEMA)
    assert versions.upsert_version(late, at, ["k"], ["seq"], buckets=99) == 2
    # The old files are as they were; one folder more holds the one bucket.
    after = files(at)
    assert {f: after[f] for f in before} == before and len({f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()}) == 1
    assert rows(reader) == [(i, f"a{i}", f"b{i}") for i in range(500)] == rows(versions.read_version(spark, at, *ARGS, version=1))
    assert rows(versions.read_version(spark, at, *ARGS)) == sorted([(i, f"a{i}", f"b{i}") for i in range(500) if i != 7] + [(7, "early", None)])
    assert len(versions.manifest(spark, at)) == 16 and versions.upsert_version(late.limit(0), at, ["k"], ["seq"]) == 2
    with pytest.raises(WayfoldError, match="no version 9"):
        versions.read_version(spark, at, *ARGS, version=9)


def test_writers_that_fail_or_meet(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    one = spark.createDataFrame([(1, 1, "a", "b")], SCHEMA)
    versions.upsert_version(one, at, ["k"], ["seq"], batch=0)
    assert versions.upsert_version(one, at, ["k"], ["seq"], batch=0) == 1 and versions.upsert_version(one, at, ["k"], ["seq"], batch=1) == 2
    with pytest.raises(Exception, match="gone"):
        versions.upsert_version(one.selectExpr("k", "seq", "a", "cast(raise_error('gone') as string) as b"), at, ["k"], ["seq"])
    assert versions.versions(spark, at) == [1, 2] and rows(versions.read_version(spark, at, *ARGS)) == [(1, "a", "b")]
    # Another writer, which read the table before version 2 was made.
    held = versions.manifest(spark, at, 1)
    monkeypatch.setattr(versions, "manifest", lambda *a: held)
    with pytest.raises(Exception, match="(?i)exists"):
        versions.upsert_version(one, at, ["k"], ["seq"])


def test_an_upsert_shuffles_its_rows_once(spark, tmp_path, monkeypatch):
    """Rows are sorted where the files of their buckets are written; buckets of many rows have several files."""
    plans, ends = [], versions.write_ends

    def seen(*args):
        out = ends(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(versions, "write_ends", seen)
    monkeypatch.setattr(versions, "TASK_ROWS", 40, raising=False)
    at, df = str(tmp_path / "t"), spark.createDataFrame([(i % 300, i, f"a{i}", f"b{i}") for i in range(900)], SCHEMA)
    versions.upsert_version(df, at, ["k"], ["seq"], buckets=4)
    assert plans[0].count("Exchange") == 1 and "_bucket" in plans[0].split("Exchange")[1].split(", REPARTITION_BY_NUM")[0] and "REPARTITION_BY_NUM" in plans[0]
    assert rows(versions.read_version(spark, at, *ARGS)) == [(k, f"a{k}", f"b{600 + k}") for k in range(300)]
