"""Upserts, lookups, JSON and scalars, deltas, checks, sources and streams on small frames."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from wayfold import schemas
from wayfold.functions import json as js
from wayfold.functions import values
from wayfold.operators import delta, events, lineage, ordered, quality, upsert
from wayfold.operators.errors import WayfoldError
from wayfold.sources import objects, packed
from wayfold.operators import loop
from wayfold.streaming import episodes, ingest


def event(**given):
    names = [c.strip().split(" ")[0] for c in schemas.EVENT.replace("map<string,double>", "map").split(",")]
    return tuple({"protocol": 1, "t": 1, "ts": 0.5, "action": "inc", "status": "ok", "cost": 1, "run_id": "r", "span_id": "s"}.get(n) if n not in given else given[n] for n in names)


def one(df):
    return [tuple(r) for r in df.collect()]


def test_upsert_keeps_first_and_last_with_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x", 5), ("a", 2, None, 9), ("b", 1, None, None)], "k string, seq int, last string, first int")
    assert sorted(one(upsert.partial_upsert(df, ["k"], ["seq"], ["first"], ["last"])), key=str) == [("a", 5, None), ("b", None, None)]


def test_insert_only(spark):
    have, new = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("b",)], "k string")
    assert upsert.insert_only(have, new, "k").count() == 2
    for bad in (have, new.union(new)):
        with pytest.raises(WayfoldError):
            upsert.insert_only(have, bad, "k")


def test_falsy_defaults_and_lookups(spark):
    df = spark.createDataFrame([event(protocol=0, cost=None, run_id=None), event(t=2, observation='{"a":1}')], schemas.EVENT)
    table = events.span_events(df)
    first = events.get_event(table, "s", 1)
    assert (first["protocol"], first["cost"], first["run_id"]) == (1, 0, "")
    assert events.query_events(table, run_id="", span_id="s").count() == 2 and events.query_events(table, action="peek").count() == 0
    with pytest.raises(WayfoldError) as e:
        events.get_event(table, "0" * 26, 1)
    assert e.value.code == "SpanNotFound"


def test_rebuild_is_idempotent_and_late_writes_win(spark):
    df = spark.createDataFrame([event(), event(status="error", cost=7)], schemas.EVENT).withColumn("v", F.monotonically_increasing_id())
    row = events.rebuild(df, ["v"]).first()
    assert (row.status, row.cost) == ("error", 1) and events.rebuild(df.union(df), ["v"]).collect() == [row]


def test_get_span(spark):
    df = spark.createDataFrame([event(t=2), event(t=1), event(span_id="other")], schemas.EVENT)
    spans = spark.createDataFrame([("s", 1)], "span_id string, t_start int")
    row, mine = events.get_span(spans, events.span_index(df), df, "s")
    assert row["t_start"] == 1 and [r.t for r in mine.collect()] == [1, 2]


@pytest.mark.parametrize("a, b, same", [('{"a":1,"b":2}', '{ "b":2, "a":1 }', True), ("1", "1.0", True), ("true", "1", False), ("null", None, False), (None, None, True), ("[1,2]", "[2,1]", False), ("{bad", "[worse", None), ("{bad", "1", None), ('{"a":1,"a":2}', '{"a":2}', None), (None, "{bad", None)])
def test_json_equal(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(js.json_equal(F.col("a"), F.col("b"))).first()[0] is same


@pytest.mark.parametrize("text, path", [('{"_k":1}', "observation._k"), ('{"a":[1,{"b":0},{"_k":1}]}', "observation.a[2]._k"), ('{"a":"_x"}', None), ('{"a":"\\",\\"_x\\":1"}', None), ("[1,2]", None), (None, None), ('{"a":{"_":1}}', "observation.a._"), ("{bad", None), ('{"b":{"c":[{"_x":{"_y":1}}]},"_a":2}', "observation.b.c[0]._x")])
def test_hidden_keys(spark, text, path):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(js.hidden_key_path("t")).first()[0] == path
    assert df.select(F.coalesce(js.has_hidden_key(F.col("t")), F.lit(False))).first()[0] == (path is not None)


def test_summaries(spark):
    df = spark.createDataFrame([("x" * 401, ["a"] * 9), ("x" * 400, ["a"] * 5), (None, None)], "s string, l array<string>")
    out = df.select(js.summary_text(F.col("s")), js.summary_list(F.col("l"))).collect()
    assert out[0][0] == "x" * 400 + "...[401 chars]" and out[0][1] == ["a"] * 5 + ["...4 more"]
    assert out[1][0] == "x" * 400 and out[1][1] == ["a"] * 5 and out[2][0] is None
    deep = json.dumps({"items": [f"item_{i}" for i in range(8)], "d": {"s": "y" * 500}})
    got = json.loads(spark.createDataFrame([(deep,)], "t string").select(js.summary_json("t")).first()[0])
    assert len(got["items"]) == 6 and got["items"][-1] == "...3 more" and got["d"]["s"].endswith("...[500 chars]")


def test_ids_and_scalars(spark):
    row = spark.range(1).select(values.new_id(F.lit(1704067200123)).alias("id")).select("id", values.id_millis(F.col("id")).alias("ms"), values.is_id(F.col("id")).alias("ok")).first()
    assert row.ms == 1704067200123 and row.ok and len(row.id) == 26
    codes = spark.createDataFrame([("StateNotFound",), ("BranchFailed",), (None,), ("VmmFailed",), ("ReplayDivergence",)], "c string")
    assert [r[0] for r in codes.select(values.http_status(F.col("c"))).collect()] == [404, 400, 200, 503, 409]
    uri = values.event_uri(F.lit("r"), F.lit("s"), F.lit(123456789))
    assert spark.range(1).select(uri).first()[0] == "runs/r/spans/s/events/123456789.json"
    assert one(spark.range(1).select(values.exit_code(F.lit(False), F.lit(0), F.lit(9)), values.exit_code(F.lit(True), F.lit(3), F.lit(None)), values.exit_code(F.lit(False), F.lit(0), F.lit(None)))) == [(137, 3, 1)]


def test_budget_snapshots_and_bytes(spark):
    df = spark.createDataFrame([({"b": 3.0, 'a"]': 0.123456, "c": -1.5},), ({},), (None,), ({"x": 0.0001, "y": 1e20, "z": 12345678.5, "w": -0.5},)], "m map<string,double>")
    assert [r[0] for r in df.select(values.budget_snapshot(F.col("m"))).collect()] == ['{"a\\"]":0.1235,"b":3,"c":-1.5}', "{}", None, '{"w":-0.5,"x":0.0001,"y":100000000000000000000,"z":12345678.5}']
    raw = spark.createDataFrame([(bytearray(b"a\xffb"),), (bytearray("ü".encode()),), (None,)], "d binary")
    assert [r[0] for r in raw.select(values.decoded(F.col("d"))).collect()] == ["a\ufffdb", "ü", None]


B = "disk string, idx long, data binary"


def blocks(spark, *rows):
    return spark.createDataFrame([("d", i, bytearray(x)) for i, x in rows], B)


def test_diff_of_longer_and_shorter_disks(spark):
    base = blocks(spark, (0, b"BASE"), (1, b"TWO"), (5, b"tail"))
    working = blocks(spark, (0, b"BASE"), (1, b"CHG"), (2, b""), (3, b"new"))
    out = {r.idx: bytes(r.data) for r in delta.changed(working, base, 4).collect()}
    assert out == {1: b"CHG\0", 3: b"new\0"}
    assert [r.idx for r in delta.changed(blocks(spark, (0, b"\0\0"), (7, b"p")), None, 4).collect()] == [7]
    assert delta.changed(base, base, 4).count() == 0


def test_overlay_write_map_and_whole(spark):
    base, upper = blocks(spark, (0, b"BASE"), (1, b"TWO ")), blocks(spark, (2, b"UPPR"))
    upper = delta.write_blocks(upper, spark.createDataFrame([("d", 2, bytearray(b"LAST"), 2), ("d", 2, bytearray(b"FRST"), 1), ("d", 4, bytearray(b"GROW"), 1)], B + ", seq int"))
    sizes = spark.createDataFrame([("d", 5), ("empty", 0)], "disk string, n_blocks long")
    image = b"".join(bytes(r.data) for r in delta.whole(sizes, upper, base, 4).orderBy("idx").collect())
    assert image == b"BASETWO LAST\0\0\0\0GROW"
    assert sorted((r.idx, r.offset) for r in delta.block_map(upper, 4).collect()) == [(2, 0), (4, 4)]
    head = {r.disk: r for r in delta.headers(sizes, upper, 4).collect()}
    assert (head["d"].n_dirty, head["d"].size, head["empty"].n_dirty) == (2, 20, 0)


def test_fork_children_are_independent(spark):
    kids = spark.createDataFrame([("d", "x"), ("d", "y")], "disk string, child string")
    writes = spark.createDataFrame([("x", "d", 1, bytearray(b"mine"))], "child string, disk string, idx long, data binary")
    out = {(r.child, r.idx): bytes(r.data) for r in delta.fork(blocks(spark, (1, b"par1"), (2, b"par2")), kids, writes).collect()}
    assert out == {("x", 1): b"mine", ("x", 2): b"par2", ("y", 1): b"par1", ("y", 2): b"par2"}


def test_locate_first_region(spark):
    regions = spark.createDataFrame([(0, 4096, 8192, 0, 4096), (1, 8192, 8192, 65536, 4096), (2, 0, 0, 0, 4096)], "region int, base long, size long, offset long, page_size long")
    asked = spark.createDataFrame([(4096,), (12287,), (12288,), (99999999,), (8192,)], "address long")
    assert {r.address: (r.region, r.page) for r in delta.locate(asked, regions).collect()} == {4096: (0, 0), 12287: (0, 1), 12288: (1, 17), 99999999: (None, None), 8192: (0, 1)}


def test_reopen(spark):
    stored = spark.createDataFrame([("a", "known", None, None), ("b", "lost", "/x", "up"), ("c", "lost", None, None)], "disk string, base_id string, base_uri string, upper string")
    bases = spark.createDataFrame([("known", "/k"), ("other", "/x")], "base_id string, uri string")
    assert {r.disk: (r.base, r.upper, r.error) for r in delta.reopen(stored, bases).collect()} == {"a": ("/k", "upper", None), "b": ("/x", "up", None), "c": (None, None, "StateNotFound")}


def test_packed_files_round_trip(spark, tmp_path):
    made = packed.packed(blocks(spark, (9, b"NINTH"), (0, b"FIRST")), spark.createDataFrame([("d", 16), ("none", 3)], "disk string, n_blocks long"), 8, packed.MEMORY)
    for r in made.collect():
        (tmp_path / r.disk).write_bytes(r.content)
    out = packed.read_packed(spark, str(tmp_path), kind=packed.MEMORY).collect()
    assert sorted((r.idx, bytes(r.data), r.n_blocks) for r in out) == [(0, b"FIRST\0\0\0", 16), (9, b"NINTH\0\0\0", 16)]
    (tmp_path / "dense").write_bytes(b"abcdefghij")
    dense = packed.read_packed(spark, str(tmp_path / "dense"), 8).orderBy("idx").collect()
    assert [bytes(r.data) for r in dense] == [b"abcdefgh", b"ij\0\0\0\0\0\0"]
    for name in ("dense", "d"):  # a memory file is no disk
        with pytest.raises(Exception, match="does not begin with OVBD"):
            packed.read_packed(spark, str(tmp_path / name)).collect()


def test_packed_pieces_make_the_file(spark):
    given = [(i, bytes([i % 251]) * 4) for i in range(0, 40, 3)]
    sizes = spark.createDataFrame([("d", 40), ("none", 2)], "disk string, n_blocks long")
    rows = packed.pieces(blocks(spark, *given), sizes, 4, per_piece=5).collect()
    file = b"".join(bytes(r.content) for r in sorted((r for r in rows if r.disk == "d"), key=lambda r: r.piece))
    n = len(given)
    assert file == b"OVBD" + struct.pack("<IIQQ", 1, 4, 40, n) + struct.pack(f"<{n}Q", *[i for i, _ in given]) + b"".join(x for _, x in given)
    assert sorted(r.piece for r in rows if r.disk == "d") == [0, 1, 2, 3, 4, 5, 6]
    whole = {r.disk: bytes(r.content) for r in packed.packed(blocks(spark, *given), sizes, 4).collect()}
    assert whole == {"d": file, "none": b"OVBD" + struct.pack("<IIQQ", 1, 4, 2, 0)}
    old = file[:4] + struct.pack("<I", 2) + file[8:]
    with pytest.raises(Exception, match="has version 2"):
        packed.unpack(spark.createDataFrame([("x", bytearray(old))], "path string, content binary")).collect()
    memory = spark.createDataFrame([("x", bytearray(b"TDIF" + old[4:]))], "path string, content binary")
    assert packed.unpack(memory, kind=packed.MEMORY).count() == n


def test_stored_batches(spark, tmp_path):
    states = spark.createDataFrame([("r-s0", "r", 0), ("r-s1", "r", 4), ("q-s0", "q", 0)], "state_id string, run_id string, t int")
    runs = spark.createDataFrame([("r", "counter", 3, "episode", 0.0), ("q", "counter", 5, "episode", 0.0)], schemas.RUNS)
    rows = lineage.metadata(states.where("state_id <> 'r-s1'"), runs)
    objects.write_snapshots(rows, str(tmp_path))
    found = objects.with_snapshots(states, objects.read_snapshot_batches(spark, str(tmp_path))).collect()
    assert {r.state_id: (r.snapshot and (r.snapshot.seed, r.snapshot.protocol), r.error) for r in found} == {"r-s0": ((3, 1), None), "r-s1": (None, "StateNotFound"), "q-s0": ((5, 1), None)}
    objects.write_prompts(states.select("run_id", "state_id", F.when(F.col("t") == 0, '{"system":"x"}').alias("prompt")), str(tmp_path))
    assert sorted(r.prompt_uri for r in objects.read_prompt_batches(spark, str(tmp_path)).collect()) == ["runs/q/prompts/q-s0.json", "runs/r/prompts/r-s0.json"]
    looked = events.found(spark.createDataFrame([("r-s0",), ("lost",)], "state_id string"), "state_id", states, "StateNotFound").collect()
    assert {r.state_id: (r.t, r.error) for r in looked} == {"r-s0": (0, None), "lost": (None, "StateNotFound")}


def test_checks(spark):
    df = spark.createDataFrame([("s", 1), ("s", 2), ("s", 5), ("s", 5), ("u", 3), ("u", 4)], "span_id string, t int")
    assert one(quality.gaps(df)) == [("s", 2, 2)]
    assert one(quality.repeated_keys(df, ["span_id", "t"])) == [("s", 5, 2)]
    parents = spark.createDataFrame([("s",)], "id string")
    assert quality.orphans(df, "span_id", parents, "id").count() == 2
    assert quality.outside(spark.createDataFrame([("episode",), ("moon",), (None,)], "b string"), "b", schemas.BACKENDS).count() == 2
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "x"), (2, None), (3, "z")], [(1, "x"), (2, None), (4, "z")]))
    assert sorted(one(quality.disagreements(a, b, ["k"], ["v"]))) == [(3, "only first"), (4, "only second")]


@pytest.mark.parametrize("large", [upsert.LARGE, 50])
def test_upserts_sort_tasks_of_bounded_size(spark, monkeypatch, large):
    """Writes are dealt by key as they are; a key of very many writes has partial aggregates."""
    monkeypatch.setattr(upsert, "TASK_ROWS", 100)
    monkeypatch.setattr(upsert, "LARGE", large)
    writes = spark.createDataFrame([(i % 200 if i < 400 else 7, i, f"a{i}") for i in range(1000)], "k long, seq int, a string")
    for out in (upsert.partial_upsert(writes, ["k"], ["seq"], [], ["a"], dealt=True), upsert.write_ends(writes, ["k"], ["seq"])):
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == (1 if large > 50 else 2)
    last = {k: max(i for i in range(1000) if (i % 200 if i < 400 else 7) == k) for k in range(200)}
    assert {r.k: r.a for r in upsert.partial_upsert(writes, ["k"], ["seq"], [], ["a"], dealt=True).collect()} == {k: f"a{i}" for k, i in last.items()}
    assert sorted((r.k, r.seq) for r in out.collect()) == sorted([(k, k) for k in range(200)] + [(k, i) for k, i in last.items()])


@pytest.mark.parametrize("n", [400, 401, 413, 414, 415, 1414])
def test_a_summary_of_its_own_length_is_cut(spark, n):
    df = spark.createDataFrame([(1, "x" * n)], "k int, text string").withColumn("obs_summary", js.summary_text(F.col("text")))
    assert quality.cut_observations(df.withColumnRenamed("text", "observation")).count() == 0
    assert quality.cut_observations(df.withColumn("observation", F.col("obs_summary"))).count() == (n > 400)


def test_cut_observations_and_counts(spark):
    long, short = "x" * 401, "y"
    cut = "x" * 400 + "...[401 chars]"
    df = spark.createDataFrame([(1, long, cut), (2, cut, cut), (3, short, short), (4, None, cut), (5, None, None)], "k int, observation string, obs_summary string")
    assert sorted(r.k for r in quality.cut_observations(df).collect()) == [2, 4]
    assert one(quality.row_counts({"a": df, "none": df.limit(0)})) == [("a", 5), ("none", 0)]


def test_memory_headers(spark):
    images = spark.createDataFrame([("d", 64, True), ("e", 64, True), ("f", 3, False)], "disk string, n_blocks long, packed boolean")
    out = {r.disk: (r.len, r.n_pages, r.n_dirty) for r in delta.memory_headers(images, blocks(spark, (9, b"a"), (20, b"b"))).collect()}
    assert out == {"d": (64 * 4096, 64, 2), "e": (64 * 4096, 64, 0), "f": (3 * 4096, 3, 3)}


def test_json_objects(spark, tmp_path):
    at = tmp_path / "runs/r/spans/s/events"
    at.mkdir(parents=True)
    for t in (1, 2):
        (at / f"{t:08d}.json").write_text(json.dumps({"t": t, "action": "inc", "params": {"n": t}, "budget_remaining": {"steps": 19}, "run_id": "r", "span_id": "s", "observation": {"b": 1, "a": "ü"}}, indent=2))
    df = objects.read_events(spark, str(tmp_path), "r").orderBy("t")
    row = df.collect()[1]
    assert row.event_uri == "runs/r/spans/s/events/00000002.json" and json.loads(row.params) == {"n": 2} and row.budget_remaining == {"steps": 19.0}
    objects.write_trajectory(df.drop("event_uri"), str(tmp_path / "lines"))
    assert objects.read_trajectory(spark, str(tmp_path / "lines")).count() == 2
    objects.write_events(df.drop("event_uri"), str(tmp_path))
    assert objects.read_batches(spark, str(tmp_path)).where("run_id = 'r'").count() == 2
    snap = tmp_path / "snapshots/st"
    snap.mkdir(parents=True)
    (snap / "metadata.json").write_text(json.dumps({"state_id": "st", "t": 2}, indent=2))
    (snap / "episode.json").write_text(json.dumps({"t": 2, "done": False, "rows": [{"t": 1, "action": "inc"}, {"t": 2, "action": "peek"}]}, indent=2))
    assert objects.read_snapshots(spark, str(tmp_path)).first().state_id == "st"
    assert [r.action for r in objects.snapshot_events(objects.read_snapshots(spark, str(tmp_path), "episode")).collect()] == ["inc", "peek"]
    (tmp_path / "runs/r/prompts").mkdir()
    (tmp_path / "runs/r/prompts/st.json").write_text('{"system": "x"}')
    states = objects.with_prompt_uri(spark.createDataFrame([("r", "st"), ("r", "none")], "run_id string, state_id string"))
    assert {r.state_id: r.prompt for r in events.with_prompts(states, objects.read_prompts(spark, str(tmp_path))).collect()} == {"st": '{"system": "x"}', "none": None}
    objects.write_table(df, str(tmp_path / "table"), ["run_id", "span_id", "t"])
    assert objects.read_table(spark, str(tmp_path / "table"), schemas.EVENT).count() == 2


def test_stream_of_events_is_upserted(spark, tmp_path):
    at = tmp_path / "in/runs/r/spans/s/events"
    at.mkdir(parents=True)
    keys, first, last = upsert.SPAN_EVENTS_RULE
    args = (str(tmp_path / "table"), str(tmp_path / "check"), keys, ["ts"], first, last)

    def arrive(name, **given):
        (at / name).write_text(json.dumps({"t": 1, "ts": 1.0, "action": "inc", "status": "ok", "cost": 1, "run_id": "r", "span_id": "s", **given}, indent=2))
        return ingest.run_upserts(events.span_events(ingest.event_stream(spark, str(tmp_path / "in"))), *args)

    now = lambda: ingest.current(spark, args[0], keys, ["ts"], first, last)
    assert now() is None
    assert arrive("1.json") == 1 and now().count() == 1
    arrive("2.json", ts=2.0, status="error", cost=9)
    assert [(r.status, r.cost) for r in now().collect()] == [("error", 1)]
    ingest.compact(spark, args[0], keys, ["ts"])
    assert [(r.status, r.cost) for r in now().collect()] == [("error", 1)]
    arrive("3.json", t=2)
    # A write that comes late but was first keeps what it gave.
    arrive("4.json", ts=0.5, status="ok", cost=4)
    assert sorted((r.t, r.status, r.cost) for r in now().collect()) == [(1, "error", 4), (2, "ok", 1)]
    # Nothing new: nothing changes.
    assert ingest.run_upserts(events.span_events(ingest.event_stream(spark, str(tmp_path / "in"))), *args) == 0 and now().count() == 2


def test_stateful_episodes(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "run_id string, seq int, action string, params string"
    tasks = loop.counter_tasks([f"id_{i}" for i in range(64)])
    initial = {"budget": {"steps": 3}, "value": 0, "cursor": 0}

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = episodes.episodes(spark.readStream.schema(schema).parquet(path), tasks, initial)
        kept = []
        query = stream.writeStream.foreachBatch(lambda df, _: kept.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(kept, key=lambda r: (r.run_id, r.t))

    one_ = run([("a", 2, "inc", None), ("a", 1, "inc", None), ("b", 1, "bogus", None)])
    assert [(r.t, r.status, r.observation) for r in one_ if r.run_id == "a"] == [(1, "ok", '{"value":1}'), (2, "ok", '{"value":2}')]
    two = run([("a", 3, "sample", '{"n":2}'), ("a", 4, "inc", None), ("a", 5, "submit", '{"answer":7}'), ("a", 6, "peek", None)])
    assert [(r.t, r.error, r.cost) for r in two] == [(3, None, 1), (4, "ActionRefused", 1), (5, None, 0), (6, "EpisodeComplete", 0)]
    assert json.loads(two[2].observation) == {"ok": True, "value": 2, "submission": 7}


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    df = spark.createDataFrame([("a" * 50, 1), (None, 2)], "k string, v int")
    hinted = lambda **limits: "Hint" in ordered.small(df, **limits)._jdf.queryExecution().analyzed().toString()
    assert hinted() and hinted(max_rows=2, max_bytes=50) and hinted(max_bytes=50)
    assert not hinted(max_rows=1) and not hinted(max_bytes=49)
    assert "Hint" in ordered.small(df.limit(0))._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_facts_of_hot_keys_meet_their_rows_at_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(ordered, "MOST_BYTES", most)
    rows_ = spark.createDataFrame([("hot", i) for i in range(20)] + [(None, 20), ("rare", 21), ("lost", 22)], "k string, i int")
    facts = spark.createDataFrame([("hot", 1), (None, 2), ("rare", 3), ("rare", 4)], "k string, f int")
    out = ordered.with_facts(rows_, facts, "k", F.col("f") < 3)
    assert sorted((r.i, r.k, r.f) for r in out.collect()) == [*[(i, "hot", 1) for i in range(20)], (20, None, 2), (21, "rare", 3), (21, "rare", 4)]


def test_hidden_keys_of_what_has_no_canonical_form(spark):
    """Nested deeper than the parsers take, repeated keys, broken texts: what may hold a hidden key counts as if it did."""
    deep = lambda n, key: '{"a":' * n + f'{{"{key}" : 1}}' + "}" * n
    given = [deep(1500, "_k"), deep(1500, "k"), deep(200_000, "_k"), deep(200_000, "k"), '{"a": 1, "a": {"\\u005fk": 2}}', '{"a": 1, "a": 2}', '{"_a": ', "plain", None]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    out = {r.i: (r.h, r.p) for r in df.select("i", js.has_hidden_key(F.col("t")).alias("h"), js.hidden_key_path(F.col("t")).alias("p")).collect()}
    assert [out[i][0] for i in range(9)] == [True, False, True, False, True, False, True, False, None]
    assert out[0][1].endswith(".a._k") and out[1][1] is None and (out[2][1] or "").startswith("observation") and out[3][1] is None and out[4][1] == "observation.a._k"
