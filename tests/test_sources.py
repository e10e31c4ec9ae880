import json

import pytest
from pyspark.sql import functions as F

from rulegrain.functions import vector
from rulegrain.operators import governance, store
from rulegrain.operators.geometry import Artifacts, Axis
from rulegrain.operators.scratch import ensure_checkpoint_dir
from rulegrain.plans.forward import Context
from rulegrain.sources.files import (
    Cache, Snapshots, append_events, big_endian_vector, facts_json, json_fact, little_endian_vector, read_addresses, read_artifact,
    read_json_array, read_segments, recover_segments, storage_stats, validate_manifest, vector_blob, write_artifact,
)
from rulegrain.streaming import processor


def test_segments_leave_out_torn_lines_only(spark, tmp_path):
    (tmp_path / "events-1.jsonl").write_text('{"id":"a","stream":"s","timestamp_ns":1}\n\n{"id":"b","stream":"s","timestamp_ns":2}\n{"id":"c","str')
    (tmp_path / "events-3.jsonl").write_text('{"id":"e"}')
    (tmp_path / "events-4.jsonl").write_text('{"id":"f"}\n{"id":"g"}')
    (tmp_path / "other.txt").write_text("x")
    root = str(tmp_path)
    assert sorted(r["id"] for r in read_segments(spark, root).collect()) == ["a", "b", "f"]
    assert [x.rsplit("/", 1)[1] for x in recover_segments(spark, root)] == ["events-1.jsonl", "events-3.jsonl", "events-4.jsonl"]
    assert (tmp_path / "events-3.jsonl").read_text() == "" and (tmp_path / "events-4.jsonl").read_text() == '{"id":"f"}\n'
    assert sorted(r["id"] for r in read_segments(spark, root).collect()) == ["a", "b", "f"]
    (tmp_path / "events-2.jsonl").write_text('{"id":"d","stream":"s"}\n{"id":\n')  # complete, but bad
    with pytest.raises(Exception, match="bad line"):
        read_segments(spark, root).collect()


def test_events_append_and_come_back(spark, tmp_path):
    root = f"{tmp_path}/log"
    assert read_segments(spark, root).count() == 0
    rows = [("s", "k", i, '{"n":%d}' % i, [1.0, float(i)] if i % 2 else None, "m" if i % 2 else None) for i in range(40)]
    events = spark.createDataFrame(rows, "stream string, kind string, timestamp_ns bigint, payload string, vector array<float>, embedding_model string").repartition(3)
    append_events(events, root, "one")
    append_events(events.withColumn("timestamp_ns", F.col("timestamp_ns") + 100), root, "one")
    append_events(events.limit(5), root, "two")
    back = read_segments(spark, root).collect()
    assert sorted(r["sequence"] for r in back if r["instance_id"] == "one") == list(range(80)) and len({r["id"] for r in back}) == 85
    assert sorted(r["sequence"] for r in back if r["instance_id"] == "two") == list(range(5))
    assert [r["payload"] for r in sorted(back, key=lambda r: (r["instance_id"], r["sequence"]))][:40] == [r[3] for r in rows]
    stats = storage_stats(spark, root)
    assert (stats["events"], stats["streams"]) == (85, {"s": 85}) and stats["segments"] >= 3
    for bad in (events.withColumn("embedding_model", F.lit("m")), events.withColumn("stream", F.lit("")), events.withColumns({"vector": F.array(F.lit(0.0)), "embedding_model": F.lit("m")})):
        with pytest.raises(Exception, match="needs a stream"):
            append_events(bad, root, "one")
    assert read_segments(spark, root).count() == 85


def test_cache_puts_expires_and_counts(spark, tmp_path):
    cache = Cache(spark, f"{tmp_path}/cache")
    entries = lambda *rows: spark.createDataFrame(rows, "key string, vector array<float>")
    assert cache.put(entries(("a", [1.0]), ("b", [2.0])), 1) == 0 and cache.stats()["entries"] == 2
    assert cache.expire(2) == 1 and cache.stats()["entries"] == 0
    assert cache.put(entries(("a", [3.0])), 3) == 1
    got = {r["key"]: (r["found"], r["vector"]) for r in cache.get(spark.createDataFrame([("a",), ("b",)], "key string")).collect()}
    assert got == {"a": (True, [3.0]), "b": (False, None)} and cache.epoch() == 1
    with pytest.raises(Exception, match="needs a key"):
        cache.put(entries(("c", [0.0])), 4)


def test_memory_of_agents(spark, tmp_path):
    root = f"{tmp_path}/log"
    embed = lambda t: F.array(F.length(t).cast("double"), F.lit(1.0))
    told = spark.createDataFrame([("likes tea", ["drink"]), ("has a dog", None)], "fact string, tags array<string>")
    first = {json.loads(r["payload"])["fact"]: r["id"] for r in append_events(store.memory_event("write", told, "s1", F.lit(1).cast("long"), embed, "m"), root, "i").collect()}
    new = spark.createDataFrame([(first["likes tea"], "likes coffee")], "id string, fact string")
    second = append_events(store.memory_event("update", new, "s1", F.lit(2).cast("long"), embed, "m"), root, "i").first()["id"]
    append_events(store.memory_event("delete", spark.createDataFrame([(first["has a dog"],)], "id string"), "s1", F.lit(3).cast("long")), root, "i")
    events = read_segments(spark, root)
    found = store.search(events, "memory", "m", [12.0, 1.0], 5).collect()
    assert [r["id"] for r in found] == [second]
    ensure_checkpoint_dir(spark)
    assert [r["id"] for r in store.memory_history(events, second).collect()] == [second, first["likes tea"]]
    assert store.memory_stats(events).first().asDict() == {"writes": 2, "updates": 1, "deletes": 1, "facts": 1}


def test_audit_and_activity(spark, tmp_path):
    calls = spark.createDataFrame([("t", "s", True, 5), ("t", "s", False, 6), (None, "z", True, 7)], "tool string, session string, ok boolean, ts long")
    append_events(governance.activity_events(calls, F.col("tool"), F.col("session"), F.col("ok"), F.col("ts")), str(tmp_path), "i")
    append_events(governance.audit_events(calls, F.col("tool"), F.lit("b"), F.lit('{"query":"abc"}'), F.lit("d"), F.col("ts"), lambda t: F.array(F.length(t).cast("double")), "m"), str(tmp_path), "i")
    events = read_segments(spark, str(tmp_path))
    assert [tuple(r) for r in store.tool_stats(governance.activity(events)).collect()] == [("t", 2, 1, 6)]
    assert store.tool_stats(governance.activity(events), newest=2).first()["calls"] == 1
    assert {tuple(r["vector"]) for r in events.where("stream = 'audit'").collect()} == {(5.0,)}
    assert store.session_scan(events.where("stream = 'activity'"), "s", 1).first()["timestamp_ns"] == 6


def test_json_facts_and_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a":1,"b":"x"}'), (2, None)], "id int, j string")
    out = json_fact(df, "j", "a int, b string", "T")
    assert {r["id"]: r["T"] and tuple(r["T"]) for r in out.collect()} == {1: (1, "x"), 2: None}
    assert facts_json(out, ["T"]).where("id = 1").first()["facts"] == '{"T":{"a":1,"b":"x"}}'
    for bad in ("[1]", "{oops", "5"):
        with pytest.raises(Exception, match="must be a JSON object"):
            json_fact(df.withColumn("j", F.lit(bad)), "j", "a int", "T").collect()
    (tmp_path / "t.json").write_text('[{"name": "x"},\n {"name": "y"}]')
    assert sorted(r["name"] for r in read_json_array(spark, str(tmp_path / "t.json")).collect()) == ["x", "y"]


def test_vector_blobs_round_trip(spark):
    df = spark.createDataFrame([([1.0, -2.5, 1e-30],), (None,)], "v array<float>")
    for big, read in ((True, big_endian_vector), (False, little_endian_vector)):
        assert df.select(read(vector_blob(F.col("v"), big)).alias("v")).collect() == df.collect()
    with pytest.raises(Exception, match="4 bytes for each"):
        spark.createDataFrame([(b"abc",)], "b binary").select(little_endian_vector(F.col("b"))).collect()


def test_revisions(spark):
    sources = spark.createDataFrame([("r1", "b.grl", 'rule "B" { when A.x == 1 then A.y = 2; }'), ("r1", "a.grl", 'rule "A" { when A.x == 1 then A.y = 1; }'), ("r1", "notes.txt", "rule {"), ("r2", "a.grl", "rule {")], "revision string, path string, source string")
    assert governance.listing(governance.load_at(sources, "r1"), "r1")["count"] == 2
    with pytest.raises(Exception, match="a.grl at r2"):
        governance.load_at(sources, "r2")
    facts = spark.createDataFrame([(1, (1,)), (2, (5,))], "id int, A struct<x:int>")
    assert {r["id"]: r["fired"][:2] for r in governance.run(facts, sources=sources, revision="r1").collect()} == {1: ["A", "B"], 2: []}
    with pytest.raises(ValueError, match="not both"):
        governance.run(facts, inline="x", sources=sources, revision="r1")
    heads = governance.branch_heads(spark.createDataFrame([("main", "r1", 1), ("main", "r2", 2), ("dev", "r1", 5)], "branch string, revision string, moved_at int"))
    assert {r["branch"]: r["revision"] for r in heads.collect()} == {"main": "r2", "dev": "r1"}
    proved = governance.what_if_proved(facts, 'rule "P" { when A.x == 1 then A.ok = true; }', 'query "Q" {\ngoal: A.ok == true\n}', {"A.x": F.lit(1)}, "id")
    assert {r["id"]: (r["provable"], r["provable_if"]) for r in proved.collect()} == {1: (True, True), 2: (False, True)}
    cases = facts.withColumn("expected", F.array(F.lit("P")))
    assert {r["id"]: r["passed"] for r in governance.test_run(cases, 'rule "P" no-loop { when A.x == 1 then A.ok = true; }').collect()} == {1: True, 2: False}


def test_a_processor_has_one_model():
    ctx = Context(artifacts=Artifacts(a=Axis("a", [1.0], "m", 1)), embedder=vector.HashingEmbedder(4))
    with pytest.raises(ValueError, match="one model"):
        processor.one_model(ctx)


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "snap"))
    assert s.restore() is None
    for n in range(4):
        assert s.publish(spark.range(n + 1)) == n
    assert s.restore().count() == 4
    assert s.collect_garbage(2) == [0, 1] and s.generations() == [2, 3]


def test_addresses_and_artifacts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lon,lat,number,street,city,region,postcode,id,hash\n1,2, 12 ,Elm St,X,IL,60000,,h1\n1,2,,Oak,X,IL,60000,7,h2\n")
    rows = read_addresses(spark, str(tmp_path / "a.csv"), "src").collect()
    assert [(r["id"], r["NUMBER"], r["COUNTRY"]) for r in rows] == [("oa:src:h1", "12", "US")]
    write_artifact(spark.createDataFrame([("x", "upsert")], "id string, op string"), str(tmp_path / "art"), {"schema": 1, "domain": "d", "dim": 128})
    manifest, ops = read_artifact(spark, str(tmp_path / "art"), "id string, op string")
    validate_manifest(manifest, "d", 128)
    assert ops.count() == 1
    with pytest.raises(ValueError):
        validate_manifest(manifest, "d", 64)


def test_stream_gives_what_the_batch_gives(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    agg = lambda df, mark: processor.windowed(df, "ts", "tumbling", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")], watermark=mark)
    run = agg(stream, "1 day").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((str(r["window_start"]), r["event_type"], r["n"]) for r in spark.table("windows").collect())
    assert got == sorted((str(r["window_start"]), r["event_type"], r["n"]) for r in agg(batch, None).collect())


def test_timings_are_exact_whatever_the_number_of_values(spark):
    import random

    rng = random.Random(6)
    groups = {"many": [rng.random() for _ in range(30_000)], "few": [3.0, 1.0, 2.0], "equal": [5.0] * 300 + [7.0], "odd": [float("nan"), 1.0, -0.5], None: [float(i) for i in range(100)], "none": [None, None]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    got = {r["k"]: r for r in store.timings(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs = sorted((v for v in vs if v is not None), key=lambda v: (v != v, v))
        at = lambda p: repr(vs[-(-p * len(vs) // 100) - 1]) if vs else repr(None)  # noqa: B023, E731
        assert got[k]["n"] == len(vs) and [repr(got[k][f"p{p}"]) for p in (50, 95, 99)] == [at(p) for p in (50, 95, 99)], k
        assert repr(got[k]["max"]) == (repr(vs[-1]) if vs else "None")
