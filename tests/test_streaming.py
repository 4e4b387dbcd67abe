"""Streams over hand-made files: order, late rows, repeats and restarts."""

import datetime as dt
import json

from pyspark.sql import functions as F

from scorewright.streaming import guard, ingest, progress, replay, retries, windows

SCHEMA = "event_id long, ts timestamp, worker_id long, model string, status string, cost double, k long, value double"
START = dt.datetime(2024, 1, 1)


def event(i, minute, model="m", status="start", cost=1.0, worker=1):
    return (i, START + dt.timedelta(minutes=minute), worker, model, status, cost, 1, 0.0)


def files(spark, tmp_path, *batches):
    """One file per batch, written in turn so that the stream reads them in this order."""
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return replay.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, 1)


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    stream = files(spark, tmp_path, [event(1, 1), event(2, 8)], [event(3, 45)], [event(5, 46)], [event(4, 2)], [event(6, 90)])
    out = replay.appended(windows.throughput(stream, "10 minutes", delay="10 minutes"), "late")
    got = {r.window_start.minute + 60 * r.window_start.hour: r.events for r in out.collect()}
    # Event 4 belongs to the first window, which closed when event 3 moved the watermark to minute 35.
    assert got == {0: 2, 40: 2}


def test_rows_within_the_delay_count(spark, tmp_path):
    stream = files(spark, tmp_path, [event(1, 1), event(2, 12)], [event(3, 5)], [event(4, 60)])
    out = replay.appended(windows.throughput(stream, "10 minutes", delay="10 minutes"), "delayed")
    assert {r.window_start.minute: r.events for r in out.collect()} == {0: 2, 10: 1}


def test_sessions_join_across_batches(spark, tmp_path):
    stream = files(spark, tmp_path, [event(1, 0), event(2, 20)], [event(3, 10)], [event(4, 100)])
    out = replay.appended(windows.sessions(stream, "15 minutes", ["worker_id"], delay="30 minutes"), "sessions")
    assert [(r.session_start.minute, r.events) for r in out.collect()] == [(0, 3)]


def test_progress_equals_the_batch_result(spark, tmp_path):
    rows = [event(i, i, model=f"m{i % 2}", status=["start", "done", "fail", "progress"][i % 4]) for i in range(40)]
    stream = files(spark, tmp_path, rows[:15], rows[15:30], rows[30:])
    got = replay.final_state(progress.live_progress(stream, ["model"]), "p").collect()
    want = progress.live_progress(spark.createDataFrame(rows, SCHEMA), ["model"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_cost_guard_carries_totals_over_batches(spark, tmp_path):
    hot = [event(i, i, "hot", cost=1.0) for i in range(10)]
    cold = [event(100, 1, "cold", cost=0.5)]
    stream = files(spark, tmp_path, hot[:4] + cold, hot[4:7], hot[7:])
    got = {r.model: (r.alert_at, r.late_starts, r.total_cost) for r in guard.cost_guard(stream, ["model"], 6.0).collect()}
    # The sixth event brings the total to the cap; the four starts after it come too late.
    assert got == {"hot": (5, 4, 10.0), "cold": (None, 0, 0.5)}


def record(n, model="m", status="success"):
    return json.dumps({"task_name": "t", "profile_name": "p", "model": model, "run_number": n, "status": status,
                       "scores": {"composite": 50.0 + n}})


def test_ingest_takes_each_run_once_and_survives_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table = str(tmp_path / "table")
    keys = ["model", "profile", "task", "run_number"]

    def arrive(name, *lines):
        (folder / name).write_text("\n".join(lines) + "\n")

    arrive("run-a.json", record(1), record(2), record(2), "{broken")
    arrive("run-b.json", record(1), record(3, model="other"))
    first = ingest.ingest_stream(ingest.record_stream(spark, str(folder), files_per_batch=1), keys, table)
    assert sorted((r.model, r.run_number) for r in first.collect()) == [("m", 1), ("m", 2), ("other", 3)]
    arrive("run-c.json", record(2), record(4))
    arrive("run-d.json", record(4))
    second = ingest.ingest_stream(ingest.record_stream(spark, str(folder), files_per_batch=1), keys, table)
    assert sorted((r.model, r.run_number) for r in second.collect()) == [("m", 1), ("m", 2), ("m", 4), ("other", 3)]


def test_ingest_reads_only_folders_that_hold_a_key(spark, tmp_path, monkeypatch):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    read = []
    places = ingest.known_places
    monkeypatch.setattr(ingest, "known_places", lambda *a: read.append(places(*a)) or read[-1])
    keys = ["model", "run_number"]
    for n, numbers in enumerate([range(40), range(40, 80), range(80, 120), [7], [7, 50, 200]]):
        (folder / f"run-{n}.json").write_text("\n".join(record(k) for k in numbers) + "\n")
        out = ingest.ingest_stream(ingest.record_stream(spark, str(folder), files_per_batch=1), keys, table)
    assert sorted(r.run_number for r in out.collect()) == [*range(120), 200]
    # Two batches of new keys read no folder, the others one for each repeated key.
    at = {r.run_number: (r.batch, r.bucket) for r in out.collect()}
    assert read == [[], [], [at[7]], sorted([at[7], at[50]])]


def test_ingest_of_a_batch_that_broke_off(spark, tmp_path):
    """Rows were written but the batch was not committed: it runs again and gives the same table and index."""
    folder, table = tmp_path / "in", tmp_path / "table"
    folder.mkdir()
    stream = lambda: ingest.record_stream(spark, str(folder), files_per_batch=1)
    (folder / "run-0.json").write_text(record(1) + "\n")
    ingest.ingest_stream(stream(), ["model", "run_number"], str(table))
    (folder / "run-1.json").write_text("\n".join([record(1), record(2)]) + "\n")
    ingest.ingest_stream(stream(), ["model", "run_number"], str(table))
    for done in (tmp_path / "table-checkpoint" / "commits").glob("*1*"):
        done.rename(tmp_path / f"not-committed{done.suffix}-{done.name.strip('.')}")
    out = ingest.ingest_stream(stream(), ["model", "run_number"], str(table))
    assert sorted((r.run_number, r.batch) for r in out.collect()) == [(1, 0), (2, 1)]
    assert spark.read.schema(ingest.INDEX).parquet(f"{table}-index").count() == 2


def test_repeats_within_the_watermark(spark, tmp_path):
    stream = files(spark, tmp_path, [event(1, 1), event(1, 2)], [event(1, 3), event(2, 4)])
    out = replay.appended(ingest.within_watermark(stream, ["event_id"], "ts", "10 minutes"), "dedup")
    assert sorted(r.event_id for r in out.collect()) == [1, 2]


def test_retry_chain(spark):
    rows = [
        ("ok", 1, False, "rate limit"), ("ok", 2, True, None),
        ("auth", 1, False, "rate limit"), ("auth", 2, False, "token expired"), ("auth", 3, True, None),
        ("spent", 1, False, "529"), ("spent", 2, False, "529"), ("spent", 3, False, "529"), ("spent", 4, False, "529"), ("spent", 5, True, None),
        ("bad", 1, False, "syntax"), ("open", 1, False, "overloaded")]
    df = spark.createDataFrame(rows, "k string, attempt int, success boolean, error string")
    got = {r.k: (r.outcome, r.retries, r.total_delay) for r in retries.retry_chain(df, ["k"]).collect()}
    assert got == {"ok": ("success", 1, 30), "auth": ("auth", 1, 30), "spent": ("exhausted", 3, 210), "bad": ("other", 0, 0), "open": ("pending", 0, 0)}


def test_auth_aborts(spark):
    df = spark.createDataFrame([("g", 1, "x"), ("g", 2, "expired"), ("g", 3, None), ("h", 1, None)], "g string, i int, error string")
    assert {r.g: (r.aborted_at, r.aborted) for r in retries.auth_aborts(df, ["g"], "i").collect()} == {"g": (2, 1), "h": (None, 0)}


def test_known_keys_are_read_from_the_touched_buckets_only(spark, tmp_path):
    table = str(tmp_path / "table")
    frame = spark.createDataFrame([(k, k % 4, b) for k in range(40) for b in (0, 1)], "k int, bucket int, batch int")
    frame.write.partitionBy("batch", "bucket").parquet(table)
    known = ingest.read_table(spark, table, frame.select("k").schema).where((F.col("batch") < 1) & F.col("bucket").isin([2]))
    files = [r[0] for r in known.select(F.input_file_name()).distinct().collect()]
    assert files and all("batch=0/bucket=2/" in f for f in files)


def test_retries_of_a_stream_are_merged(spark, tmp_path):
    from scorewright.streaming import replay as rp, retries

    rows = [(k, a, a == 3 and k % 2 == 0, None if a == 3 and k % 2 == 0 else "Rate limit") for k in range(20) for a in range(1, 6)]
    df = spark.createDataFrame(rows, "k int, attempt int, success boolean, error string")
    path = str(tmp_path / "attempts")
    df.repartition(6).write.parquet(path)
    streamed = retries.retry_table(rp.file_stream(spark, path, df.schema, 2), ["k"])
    assert sorted(streamed.collect()) == sorted(retries.retry_chain(df, ["k"]).collect())


def test_a_batch_writes_the_groups_it_touched_only(spark, tmp_path):
    schema = "g string, status string, cost double, event_id long"
    files = [[("a", "start", 1.0, 1), ("b", "start", 1.0, 2), (None, "start", 1.0, 3)], [("a", "done", 2.0, 4)], [("b", "fail", 1.0, 5), ("c", "start", 0.5, 6)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    stream = replay.file_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema, 1)
    table = replay.latest_state(progress.live_progress(stream, ["g"]), ["g"], "touched")
    got = {r["g"]: (r["started"], r["completed"], r["cost"], r["last_status"]) for r in table.collect()}
    assert got == {"a": (1, 1, 3.0, "done"), "b": (1, 1, 2.0, "fail"), None: (1, 0, 1.0, "start"), "c": (1, 0, 0.5, "start")}
    folder = table.inputFiles()[0].split("/changes/")[0] + "/changes"
    written = spark.read.parquet(folder).groupBy("batch").agg(F.collect_set(F.coalesce("g", F.lit("-"))).alias("g")).collect()
    touched = [sorted({r[0] or "-" for r in rows}) for rows in files]
    assert sorted(sorted(r["g"]) for r in written) == sorted(touched)


def test_ended_runs_are_told_once_and_forgotten(spark, tmp_path):
    schema = "k long, attempt int, success boolean, error string, ts timestamp"
    at = lambda minute: START + dt.timedelta(minutes=minute)
    batches = [[(1, 1, False, "Rate limit", at(0)), (2, 1, False, "SSO session has expired", at(1)), (3, 1, False, "Rate limit", at(1))],
               [(1, 2, True, None, at(3)), (3, 2, False, "Rate limit", at(4))],
               [(4, 1, True, None, at(60))],
               [(5, 1, False, "bad input", at(61))],
               [(1, 3, True, None, at(5))],  # run 1 has been told by now
               [(None, None, None, None, at(200))]]
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    dropped, left = [], []
    stream = retries.ended_runs(replay.file_stream(spark, path, spark.createDataFrame([], schema).schema, 1), ["k"], "ts", "10 minutes")
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    for progress_ in query.recentProgress:
        for op in progress_["stateOperators"]:
            dropped.append(op["numRowsDroppedByWatermark"])
            left.append(op["numRowsTotal"])
    got = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 2, "success", 1, 30), (2, 1, "auth", 0, 0), (3, 2, "pending", 1, 30), (4, 1, "success", 0, 0), (5, 1, "other", 0, 0)], got
    assert sum(dropped) == 1 and left[-1] == 0


def test_ended_runs_of_many_runs_need_no_python(spark, tmp_path):
    rows = [(k, a, a == 3 and k % 2 == 0, "SSO session has expired" if k % 5 == 0 and a > 1 else "Rate limit", START + dt.timedelta(seconds=k % 600 + 30 * a))
            for k in range(20_000) for a in range(1, 2 + k % 6)]
    schema = "k long, attempt int, success boolean, error string, ts timestamp"
    df, path = spark.createDataFrame(rows, schema), str(tmp_path / "in")
    for part in (df.where("attempt < 3"), df.where("attempt >= 3"), spark.createDataFrame([(None, None, None, None, START + dt.timedelta(days=3))], schema)):
        part.coalesce(2).write.mode("append").parquet(path)
    stream = retries.ended_runs(replay.file_stream(spark, path, df.schema, 2), ["k"], "ts", "1 day")
    assert "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
    assert sorted(replay.appended(stream, "many").collect()) == sorted(retries.retry_chain(df, ["k"]).collect())


def test_kinds_are_those_of_the_error_classes():
    """They travel as places in a list, which must be sorted and whole."""
    from scorewright.functions import labels

    named = str(labels.error_class("error"))
    assert retries._KINDS == sorted(retries._KINDS) and "success" in retries._KINDS
    assert all(k in named for k in retries._KINDS if k != "success")


def test_attempts_are_joined_and_grouped_in_more_parts(spark):
    from scorewright.plans import streaming_queries
    from scorewright.plans.bindings import Tables

    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = streaming_queries._attempts(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    repartitions = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(repartitions) == 2 and all(f", {parts}" in line for line in repartitions)


def test_parts_of_retries_are_merged_in_more_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, False, None), (1, 2, False, "529"), (2, 1, True, None)], "k int, attempt int, success boolean, error string")
    df.write.parquet(str(tmp_path / "in"))
    table = retries.retry_table(replay.file_stream(spark, str(tmp_path / "in"), df.schema), ["k"])
    assert "RepartitionByExpression" in table._jdf.queryExecution().optimizedPlan().toString()
    # A failure without a message has no kind and ends the run if nothing else does.
    assert sorted(map(tuple, table.collect())) == [(1, 2, "pending", 1, 30), (2, 1, "success", 0, 0)] == sorted(map(tuple, retries.retry_chain(df, ["k"]).collect()))


def _shuffle_files(spark):
    """Names of the shuffle files that are on disk."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}


def test_ingest_leaves_no_shuffles_on_disk(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    keys = ["model", "run_number"]
    before, setting = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    for n, numbers in enumerate([range(40), range(30, 60)]):
        (tmp_path / "in" / f"run-{n}.json").write_text("\n".join(record(k) for k in numbers) + "\n")
    ingest.ingest_stream(ingest.record_stream(spark, str(tmp_path / "in"), files_per_batch=1), keys, str(tmp_path / "table"))
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_ingest_takes_a_large_batch_by_its_folders(spark, tmp_path, monkeypatch):
    """Several slices of a batch give the table of one; each looks up its own folders, and what was staged goes."""
    (tmp_path / "in").mkdir()
    keys, asked = ["model", "run_number"], []
    places = ingest.known_places
    monkeypatch.setattr(ingest, "known_places", lambda *a: asked.append(a[4]) or places(*a))
    monkeypatch.setattr(ingest, "SLICE_ROWS", 25)
    batches = [[*range(60), *range(10)], [*range(40, 110), 5, 5], [3], [], [200, 200, *range(0, 120, 2)]]
    for n, numbers in enumerate(batches):
        (tmp_path / "in" / f"run-{n}.json").write_text("".join(record(k) + "\n" for k in numbers) + "{broken\n")
        out = ingest.ingest_stream(ingest.record_stream(spark, str(tmp_path / "in")), keys, str(tmp_path / "table"))
    first = {k: next(n for n, b in enumerate(batches) if k in b) for b in batches for k in b}
    assert sorted((r.run_number, r.batch) for r in out.collect()) == sorted(first.items())
    # The first batch looks up nothing; of 72, 1, 0 and 62 rows at most 25 are taken at a time, by the mean of a folder.
    assert [len(a) for a in asked] == [5, 5, 5, 1, 16, 16, 6, 6, 4] and sum(asked, []) == [*range(16)] * 4
    assert spark.read.schema(ingest.INDEX).parquet(str(tmp_path / "table-index")).count() == len(first)
    assert spark.read.schema("h long").parquet(str(tmp_path / "table-staged")).count() == 0


def test_arrivals_make_room_for_the_next(spark):
    """Each part of the arrivals is in the table before the next is written, and no run is lost or counted twice."""
    import pathlib

    import __spark_entry__ as entry

    base = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(base.glob("*"))
    out = entry.queries()["incremental_ingest"](spark, "/root/testdata/sf0.001")
    total = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().count()
    assert sum(r["runs"] for r in out.collect()) == total
    made = {p.name.split("-")[0]: p for p in set(base.glob("*")) - before if p.name.startswith("arrivals-")}
    assert 0.4 * total < spark.read.text(f"{made['arrivals']}/part-*").count() < 0.6 * total
