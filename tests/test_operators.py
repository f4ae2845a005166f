import datetime as dt
from dataclasses import replace

import pytest

from tidemill import errors, storage
from tidemill.config import RetryPolicy, Tenant, size_of
from tidemill.functions.scalars import date_spine
from tidemill.metrics import Metrics
from tidemill.operators import history, merge, quality, transforms, vault
from tidemill.pipeline import Definition, Pipeline
from tidemill.sources import strategies
from tidemill.sources.versioned import Conflict, VersionedTable
from tidemill.state import Cursor, CursorStore, StageStore
from tidemill.streaming.landing import ingest, windowed

NOW = dt.datetime(2024, 3, 1)


def table(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_date_spine_is_empty_unless_end_is_later(spark):
    d = dt.date
    assert date_spine(spark, d(2024, 1, 1), d(2024, 1, 3)).count() == 2
    assert date_spine(spark, d(2024, 1, 1), d(2024, 1, 1)).count() == 0
    assert date_spine(spark, d(2024, 1, 2), d(2024, 1, 1)).count() == 0


def test_merge_rejects_a_key_twice(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.overwrite(spark.createDataFrame([(1, "a")], "id int, v string"))
    with pytest.raises(merge.DuplicateKey):
        t.upsert(spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string"), ["id"])
    assert table(t.read()) == [(1, "a")]


def test_versions_append_upsert_and_time_travel(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    t.append(spark.createDataFrame([(3, "c", 1.5)], "id int, v string, w double"))
    t.upsert(spark.createDataFrame([(2, "B", 2.0)], "id int, v string, w double"), ["id"])
    assert table(t.read().select("id", "v")) == [(1, "a"), (2, "B"), (3, "c")]
    assert table(t.read(0)) == [(1, "a"), (2, "b")]
    assert {r["_change_type"] for r in t.changes(1, ["id"]).collect()} == {"update_preimage", "update_postimage"}
    other = VersionedTable(spark, t.path)
    with pytest.raises(Conflict):
        other._commit(1, [], t.read())


def test_partitioned_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", partition="p")
    t.overwrite(spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "id int, p string, v string"))
    before = {p["p"]: p["dir"] for p in t._manifest(0)["parts"]}
    t.upsert(spark.createDataFrame([(1, "x", "A"), (3, "x", "n")], "id int, p string, v string"), ["id"])
    after = {p["p"]: p["dir"] for p in t._manifest(1)["parts"]}
    assert before["y"] == after["y"] and before["x"] != after["x"]
    assert table(t.read()) == [(1, "x", "A"), (2, "y", "b"), (3, "x", "n")]


def test_scd2_nulls_reruns_and_missing_keys(spark):
    s = "id int, tier string, note string"
    first = history.scd2(None, spark.createDataFrame([(1, None, "x"), (2, "a", "x"), (3, "a", "x")], s), ["id"], ["tier"], dt.datetime(2024, 1, 1))
    load = spark.createDataFrame([(1, "g", "x"), (2, None, "x")], s)
    second = history.scd2(first, load, ["id"], ["tier"], dt.datetime(2024, 1, 2))
    again = history.scd2(second, load, ["id"], ["tier"], dt.datetime(2024, 1, 2))
    got = sorted((r["id"], r["valid_from"].day, r["is_current"], r["tier"]) for r in again.collect())
    assert got == [(1, 1, False, None), (1, 2, True, "g"), (2, 1, False, "a"), (2, 2, True, None), (3, 1, True, "a")]
    other = history.scd2(second, spark.createDataFrame([(1, "g", "changed")], s), ["id"], ["tier"], dt.datetime(2024, 1, 3))
    assert other.count() == 5


def test_point_in_time_is_half_open(spark):
    v = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 20, "b")], "k int, valid_from int, valid_to int, name string")
    o = spark.createDataFrame([(1, 0), (1, 10), (1, 20)], "k int, at int")
    assert sorted((r["at"], r["name"]) for r in o.transform(transforms.point_in_time(v, "k", "at")).collect()) == [(0, "a"), (10, "b"), (20, None)]


def test_dedup_direction_and_ties(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "c")], "k int, t int, v string")
    assert table(df.transform(transforms.dedup(["k"], "t"))) == [(1, 5, "a")]
    assert table(df.transform(transforms.dedup(["k"], "t", newest=False))) == [(1, 4, "c")]


def test_quarantine_first_rule_owns_and_warnings_stay(spark):
    df = spark.createDataFrame([(1, 5, "a@b.co"), (None, -1, "a@b.co"), (2, None, "a@b.co"), (3, 1, "bad")], "id int, amount int, mail string")
    good, bad = quality.split(df, [quality.not_null("id"), quality.positive("amount"), quality.valid_email("mail")])
    assert sorted((r["id"], r["_warnings"]) for r in good.collect()) == [(1, []), (3, ["mail_email"])]
    assert sorted(r["_quarantine_rule"] for r in bad.collect()) == ["amount_positive", "id_not_null"]


def test_cdc_apply_last_change_wins_and_replays_are_no_ops(spark):
    s = "id int, v string, _lsn long, _change_type string"
    changes = spark.createDataFrame([(1, "a", 1, "insert"), (1, "b", 2, "update"), (2, "x", 3, "insert"), (2, "x", 4, "delete")], s)
    once = strategies.apply_changes(None, changes, ["id"])
    assert table(once) == [(1, "b")]
    assert table(strategies.apply_changes(once, changes, ["id"])) == [(1, "b")]


def test_landing_cursor_skips_late_names_and_the_manifest_does_not(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/w")
        part = next((tmp_path / "w").glob("part*"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / name)
        for p in (tmp_path / "w").iterdir():
            p.unlink()
        (tmp_path / "w").rmdir()

    context = lambda cursor: strategies.Context(spark, Tenant("t"), "t", {"path": f"file://{tmp_path}/in", "pattern": "*.parquet"}, cursor, NOW)
    put("b.parquet", [(1,)], "id int")
    _, by_name = strategies.landing(context(None))
    _, listed = strategies.manifest(context(None))
    put("a.parquet", [(2, "n")], "id int, extra string")
    assert strategies.landing(context(by_name))[0].columns == []
    assert [r["id"] for r in strategies.manifest(context(listed))[0].collect()] == [2]
    both, _ = strategies.landing(context(None))
    assert sorted((r["id"], r["extra"], r["_source_file"]) for r in both.collect()) == [(1, None, "b.parquet"), (2, "n", "a.parquet")]


def test_full_reload_runs_once_unless_forced(spark):
    df = spark.createDataFrame([(1,)], "id int")
    make = lambda cursor, **o: strategies.Context(spark, Tenant("t"), "t", {"frame": df} | o, cursor, NOW)
    first, cursor = strategies.full_reload(make(None))
    assert first.count() == 1
    assert strategies.full_reload(make(cursor))[0].count() == 0
    assert strategies.full_reload(make(cursor, force_reload=True))[0].count() == 1


def test_composite_cursor_sees_ties_that_the_strict_one_misses(spark):
    t = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([(1, t)], "id int, updated_at timestamp_ntz")
    later = first.union(spark.createDataFrame([(2, t)], first.schema))
    run = lambda f, df, cursor: f(strategies.Context(spark, Tenant("t"), "t", {"frame": df, "key": "id"}, cursor, NOW))
    _, strict = run(strategies.timestamp, first, None)
    _, both = run(strategies.composite, first, None)
    assert run(strategies.timestamp, later, strict)[0].count() == 0
    assert [r["id"] for r in run(strategies.composite, later, both)[0].collect()] == [2]


def test_pick_strategies():
    assert strategies.pick(Tenant("t", size="WHALE"))[0] == "CdcDelta"
    assert strategies.pick(Tenant("t", size="SMALL"))[0] == "TimestampDelta"
    assert strategies.pick(Tenant("t", size="SMALL", strategy="CdcDelta"))[0] == "TimestampDelta"
    with pytest.raises(KeyError):
        strategies.pick("nothing")
    assert [size_of(n) for n in (1, 1_000_000, 10_000_000, 100_000_000)] == ["SMALL", "MEDIUM", "LARGE", "WHALE"]
    t = Tenant.from_json('{"customerId": "c", "customerSize": "LARGE"}')
    assert (t.storage_type, t.strategy_name, t.retry.max_retries) == ("OLAP", "DeltaLakeMerge", 3)


def test_retry_counts_and_breaker():
    policy, calls = RetryPolicy(max_retries=2), []

    def failing(category, until=99):
        def f():
            calls.append(1)
            if len(calls) < until:
                raise errors.PipelineError("x", category)
            return "ok"

        return f

    quick = {"sleep": lambda s: None, "metrics": Metrics()}
    assert errors.call(failing("NETWORK", 3), policy, ("a", "b"), errors.Breaker(), **quick) == "ok" and len(calls) == 3
    calls.clear()
    with pytest.raises(errors.PipelineError):
        errors.call(failing("LOGIC"), policy, ("a", "b"), errors.Breaker(), **quick)
    assert len(calls) == 1
    time, breaker = [0.0], errors.Breaker(threshold=2, clock=lambda: time[0])
    for _ in range(2):
        with pytest.raises(errors.PipelineError):
            errors.call(failing("NETWORK"), policy, ("a", "b"), breaker, **quick)
    with pytest.raises(errors.CircuitOpen):
        errors.call(lambda: 1, policy, ("a", "b"), breaker, **quick)
    time[0] = 61
    assert errors.call(lambda: 1, policy, ("a", "b"), breaker, **quick) == 1
    assert 750 <= errors.delay_ms(RetryPolicy(), 0) <= 1250 and errors.delay_ms(RetryPolicy(), 10) == 30_000


def test_pipeline_commits_after_load_and_reruns(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 5), (2, dt.datetime(2024, 1, 2), -5)], "id int, updated_at timestamp_ntz, amount int")
    p = Pipeline(spark, f"file://{tmp_path}/state", sleep=lambda s: None)
    t = Tenant("c", retry=RetryPolicy(max_retries=0))

    def broken(df):
        raise RuntimeError("no")

    make = lambda *steps: Definition("p", "orders", f"file://{tmp_path}/target", "merge", ("id",), {"frame": df}, (quality.positive("amount"),), steps)
    assert p.run(t, make(broken), NOW).status == "FAILED"
    assert p.cursors.load("c", "orders", "TimestampDelta") is None
    done = p.run(t, make(), NOW)
    assert (done.status, done.processed, done.quarantined) == ("PARTIAL", 1, 1)
    assert p.cursors.load("c", "orders", "TimestampDelta").watermark.startswith("2024-01-02")
    assert p.run(t, make(), NOW).status == "SKIPPED"
    assert table(VersionedTable(spark, f"file://{tmp_path}/target").read().select("id")) == [(1,)]
    assert [j["status"] for j in p.jobs.last(3)] == ["SKIPPED", "PARTIAL", "FAILED"]
    assert "pipeline_success" in p.metrics.flush()
    with pytest.raises(ValueError):
        Definition("p", "s", "t", "merge")


def test_cursor_history_and_delete(spark, tmp_path):
    s = CursorStore(spark, f"file://{tmp_path}")
    for w in ("1", "2"):
        s.save(Cursor("c", "t", "x", w))
    assert s.load("c", "t", "x").watermark == "2" and len(s.history("c", "t", "x")) == 2
    s.delete("c", "t", "x")
    assert s.load("c", "t", "x") is None


def test_streaming_landing_upserts_each_file_once(spark, tmp_path):
    schema = spark.createDataFrame([], "id int, t int, v string").schema
    go = lambda: ingest(spark, f"file://{tmp_path}/in", schema, f"file://{tmp_path}/out", ["id"], "t", f"file://{tmp_path}/cp")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    go()
    spark.createDataFrame([(2, 1, "c")], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    go()
    assert table(VersionedTable(spark, f"file://{tmp_path}/out").read()) == [(1, 2, "b"), (2, 1, "c")]


def test_a_file_appears_whole_or_not_at_all(spark, tmp_path):
    at = f"file://{tmp_path}/log/0.json"
    assert storage.publish(spark, at, b"first") and not storage.publish(spark, at, b"second")
    assert (tmp_path / "log/0.json").read_bytes() == b"first"
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["0.json"]  # no draft is left


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    a, b = (VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    a.overwrite(df)
    with pytest.raises(Conflict):
        b._commit(None, [], df)


@pytest.mark.parametrize("values", (("2024-01-01 00:00:00", "a/b"), ("x=y%", ""), (None, "ü ö")))
def test_partitions_of_any_value_are_replaced(spark, tmp_path, values):
    s = "k int, p string, v int"
    t = VersionedTable(spark, f"file://{tmp_path}/t", "p")
    t.overwrite(spark.createDataFrame([(i, values[i % 2], 0) for i in range(4)], s))
    t.upsert(spark.createDataFrame([(0, values[1], 1), (1, values[1], 1), (9, "new", 1)], s), ["k"])
    got = {r["k"]: (r["p"], r["v"]) for r in t.read().collect()}
    assert t.read().count() == len(got) == 5
    assert got == {0: (values[1], 1), 1: (values[1], 1), 2: (values[0], 0), 3: (values[1], 0), 9: ("new", 1)}


def test_schema_follows_the_source(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.overwrite(spark.createDataFrame([(1, "x")], "k int, old string"))
    t.evolve(spark.createDataFrame([(2, 5.0)], "k int, new double"))
    assert t.read().columns == ["k", "new"] and table(t.read()) == [(1, None), (2, 5.0)]
    assert t.read(0).columns == ["k", "old"]


def test_streaming_landing_leaves_out_rows_older_than_the_targets(spark, tmp_path):
    src, dst = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = spark.createDataFrame([], "k int, t int, v string").schema
    for rows in ([(1, 5, "new"), (2, 1, "a")], [(1, 3, "late"), (2, 2, "b"), (3, None, "c")], [(3, 1, "d"), (2, None, "e")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest(spark, src, schema, dst, ["k"], "t", f"file://{tmp_path}/check")
    assert table(VersionedTable(spark, dst).read()) == [(1, 5, "new"), (2, 2, "b"), (3, 1, "d")]


def test_replays_in_any_order_give_the_last_state(spark):
    s = "id int, v string, _lsn long, _change_type string"
    old, new = spark.createDataFrame([(1, "a", 1, "insert"), (2, "x", 3, "insert")], s), spark.createDataFrame([(1, "b", 2, "update"), (2, "x", 4, "delete")], s)
    state = strategies.replay(strategies.replay(strategies.replay(None, new, ["id"]), old, ["id"]), new, ["id"])
    assert table(strategies.alive(state)) == [(1, "b")]


def test_dedup_counts_nulls_last_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, "z"), (1, 3, None), (1, 3, "b"), (2, None, "q"), (2, None, None)], "k int, t int, v string")
    assert table(df.transform(transforms.dedup(["k"], "t"))) == [(1, 3, "b"), (2, None, "q")]
    assert table(df.transform(transforms.dedup(["k"], "t", newest=False))) == [(1, 3, "b"), (2, None, "q")]
    assert df.transform(transforms.dedup(["k"], "t")).columns == ["k", "t", "v"]


def test_a_rerun_writes_its_quarantine_once_and_a_corrected_source_is_read_again(spark, tmp_path):
    p, t = Pipeline(spark, f"file://{tmp_path}/state", sleep=lambda s: None), Tenant("t", retry=RetryPolicy(max_retries=0))
    rows = spark.createDataFrame([(1, 5), (2, -1)], "id int, amount int")

    def fails(df):
        raise RuntimeError("no")

    good = Definition("p", "src", f"file://{tmp_path}/t", rules=(quality.positive("amount"),), options={"frame": rows}, strategy="FullReload")
    assert p.run(t, replace(good, transforms=(fails,)), NOW).status == "FAILED"
    assert p.run(t, good, NOW).status == "PARTIAL"
    assert p.quarantine.read(spark, "t", "src").count() == 1
    strict = Definition("q", "src2", f"file://{tmp_path}/t2", rules=(quality.positive("amount", quality.CRITICAL),), options={"frame": rows}, strategy="FullReload")
    assert p.run(t, strict, NOW).status == "FAILED"
    assert p.run(t, replace(strict, options={"frame": rows.where("amount > 0")}), NOW).status == "SUCCESS"


def test_what_only_tests_call(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 2.0), (2, dt.date(2024, 1, 9), 3.0)], "k int, event_date date, value double")
    runs = transforms.each_window(["k"], [("SUM", "value", "total")], ["1 day", "7 days"])
    assert {w: df.transform(f).count() for w, f in runs.items()} == {"1 day": 2, "7 days": 2}
    assert table(merge.matched(df.select("k"), df.where("k = 2"), ["k"])) == [(2,)]
    assert table(vault.unseen(df.select("k"), df.where("k = 2"), ["k"])) == [(1,)]
    assert quality.descriptive_columns(df.withColumnRenamed("k", "x_hk"), "x") == ["event_date", "value"]
    store = StageStore(spark, f"file://{tmp_path}/s")
    assert store.resume("p", ["extract", "validate"], "t") is None
    store.save(df, "p", "extract", "t")
    name, got = store.resume("p", ["extract", "validate"], "t")
    assert name == "extract" and got.count() == 2
    df.select("k", df["event_date"].cast("timestamp").alias("at"), "value").write.parquet(f"file://{tmp_path}/e")
    stream = windowed(spark.readStream.schema("k int, at timestamp, value double").parquet(f"file://{tmp_path}/e"), "at", ["k"])
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert table(spark.table("windows").select("k", "n", "total")) == [(1, 1, 2.0), (2, 1, 3.0)]


def test_files_of_a_committed_run_move_to_the_archive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("k,v\n1,x\n")
    c = strategies.Context(spark, Tenant("t"), "t", {"path": f"file://{tmp_path}/in", "format": "csv"}, None, NOW)
    df, cursor = strategies.landing(c)
    assert table(df.select("k", "v")) == [(1, "x")]
    strategies.archive(c, cursor, f"file://{tmp_path}/done")
    assert not (tmp_path / "in/a.csv").exists() and (tmp_path / "done/a.csv").read_text() == "k,v\n1,x\n"
    c.cursor = cursor
    assert strategies.landing(c)[0].columns == []
