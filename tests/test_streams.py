from datetime import datetime, timedelta

from lectern.streaming.papers import arriving_files, ingest_new_papers
from lectern.operators.tasks import batch_states, latest_status
from lectern.sources.reference import land_papers, write_papers
from lectern.streaming.tasks import current_batches, current_tasks, expire_sessions, marker, track_batches, track_tasks

START = datetime(2024, 1, 1)


def run(spark, tmp_path, rows, schema, make, out):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    make(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).parquet(str(tmp_path / "out")).collect()


def test_tasks_end_or_time_out(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [("a", "running", at(0)), ("a", "done", at(30)), ("b", "running", at(1)), ("b", "failed", at(20)), ("c", "running", at(2)), ("c", "done", at(5000)), ("d", "running", at(90_000))]
    got = run(spark, tmp_path, rows, "task_id string, state string, ts timestamp", lambda s: track_tasks(s, 600, "1 minute"), "task_id string, outcome string, ts timestamp")
    assert {(r["task_id"], r["outcome"]) for r in got} == {("a", "done"), ("b", "failed"), ("c", "timeout")}


def test_sessions_expire(spark, tmp_path):
    rows = [("a", START), ("a", START + timedelta(hours=5)), ("b", START + timedelta(hours=60))]
    got = run(spark, tmp_path, rows, "session_id string, ts timestamp", lambda s: expire_sessions(s, 24, "1 minute"), "session_id string, last_ts timestamp")
    assert [(r["session_id"], r["last_ts"]) for r in got] == [("a", START + timedelta(hours=5))]


def test_new_papers_land_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "1.xml").write_text("<a>1</a>")
    for body in ("2", "3"):
        ingest_new_papers(arriving_files(spark, str(inbox)), "paper_id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        (inbox / "2.xml").write_text(f"<a>{body}</a>")
    assert sorted(r["paper_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


EVENTS = "task_id long, batch_id long, state string, ts timestamp"


def test_states_over_many_micro_batches(spark, tmp_path):
    """The kept tables equal the batch roll-up after every part of the stream, with and without snapshots; a task may move to another batch."""
    at = lambda s: START + timedelta(seconds=s)
    parts = [[(1, 0, "running", at(0)), (2, 0, "running", at(1)), (3, 1, "pending", at(1))], [(1, 0, "done", at(5))], [(2, 0, "done", at(9)), (3, 1, "failed", at(9)), (4, 2, "converting", at(9))], [(4, 2, "done", at(7)), (1, 3, "running", at(8)), (5, None, "done", at(1)), (6, 1, None, at(2))]]
    batches = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,)], "batch_id long")
    for compact in (None, 2):
        seen, home = [], tmp_path / f"compact-{compact}"
        for number, part in enumerate(parts):
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(home / "in"))
            seen += part
            stream = spark.readStream.schema(EVENTS).parquet(str(home / "in"))
            track_batches(stream, str(home / "kept"), str(home / "cp"), compact=compact).awaitTermination()
            latest = latest_status(spark.createDataFrame(seen, EVENTS))
            got = current_tasks(spark, str(home / "kept"))
            assert sorted(map(tuple, got.select(*latest.columns).collect())) == sorted(map(tuple, latest.collect())), (compact, number)
            want = batch_states(batches, latest)
            assert sorted(map(tuple, current_batches(spark, str(home / "kept"), batches).collect())) == sorted(map(tuple, want.collect())), (compact, number)
        assert marker(spark, str(home / "kept"))[1] >= (0 if compact else -1)


def test_readers_see_whole_versions(spark, tmp_path):
    """Changes without their marker don't count: a micro-batch that broke off is not read, and replaces itself."""
    kept = str(tmp_path / "kept")
    spark.createDataFrame([(1, 0, "running", START)], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    track_batches(stream, kept, str(tmp_path / "cp")).awaitTermination()
    version = marker(spark, kept)[0]
    spark.read.parquet(f"{kept}/tasks/changes/version={version}").write.parquet(f"{kept}/tasks/changes/version={version + 1}")
    spark.read.parquet(f"{kept}/batches/changes/version={version}").write.parquet(f"{kept}/batches/changes/version={version + 1}")
    batches = spark.createDataFrame([(0,)], "batch_id long")
    assert [tuple(r) for r in current_batches(spark, kept, batches).collect()] == [(0, "running", 0, 1)]
    spark.createDataFrame([(2, 0, "done", START)], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    track_batches(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), kept, str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in current_batches(spark, kept, batches).collect()] == [(0, "running", 1, 2)]


def test_a_micro_batch_costs_what_changes(spark, tmp_path):
    """With 20,000 tasks known, ten events write the rows of ten tasks, and of their batches."""
    many = spark.range(20_000).selectExpr("id AS task_id", "id % 3 AS batch_id", "'running' AS state", "TIMESTAMP'2024-01-01 00:00:00' AS ts")
    many.coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = str(tmp_path / "kept")
    go = lambda: track_batches(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), kept, str(tmp_path / "cp")).awaitTermination()
    go()
    first = marker(spark, kept)[0]
    many.limit(10).selectExpr("task_id", "batch_id", "'done' AS state", "ts + INTERVAL 1 SECOND AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    new = [v for v in range(first + 1, marker(spark, kept)[0] + 1)]
    rows = lambda name: sum(spark.read.parquet(f"{kept}/{name}/changes/version={v}").count() for v in new)
    assert rows("tasks") == 10 and rows("batches") <= 3
    batches = spark.createDataFrame([(0,), (1,), (2,)], "batch_id long")
    got = current_batches(spark, kept, batches).collect()
    assert sum(r["done"] for r in got) == 10 and sum(r["total"] for r in got) == 20_000


def outcomes(spark, home, parts, **how):
    """What track_tasks tells of parts that arrive one after the other, and the rows of state at its end."""
    schema = "task_id string, state string, ts timestamp"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(home / "in"))
        stream = spark.readStream.schema(schema).parquet(str(home / "in"))
        q = track_tasks(stream, 600, "1 minute", **how).writeStream.outputMode("append").format("parquet").option("path", str(home / "out")).option("checkpointLocation", str(home / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.schema("task_id string, outcome string, ts timestamp").parquet(str(home / "out")).collect()
    return sorted(map(tuple, rows)), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_outcomes_do_not_hang_on_arrival(spark, tmp_path):
    """Within the watermark, the order in which events arrive changes no outcome; a deadline runs from the least event time."""
    at = lambda s: START + timedelta(seconds=s)
    events = [("a", "running", at(20)), ("a", "failed", at(40)), ("a", "done", at(30)), ("b", "running", at(1)), ("c", "running", at(0)), ("c", "running", at(30))]
    last, end, close = [("b", "done", at(605))], [("x", "running", at(100_000))], [("z", "running", at(600_000))]
    want = [("a", "done", at(30)), ("b", "timeout", at(601)), ("c", "timeout", at(600))]
    orders = (events, [events[i] for i in (1, 5, 2, 3, 4, 0)], [events[i] for i in (2, 0, 5, 4, 3, 1)])
    for i, order in enumerate(orders):
        got, _ = outcomes(spark, tmp_path / f"in{i}", [order[:3], order[3:] + last, end, close], settle=True)
        assert got == [*want, ("x", "timeout", at(100_600))], i


def test_state_of_ended_tasks_goes(spark, tmp_path):
    """As event time moves on, nothing is left of the many tasks that ended but the state of the one that has just begun."""
    at = lambda s: START + timedelta(seconds=s)
    rows = [(f"t{i}", state, at(i % 50 + 10 * k)) for i in range(300) for k, state in enumerate(("running", "done" if i % 3 else "pending"))]
    for settle in (False, True):
        got, left = outcomes(spark, tmp_path / str(settle), [rows, [("late", "running", at(50_000))], [("later", "running", at(200_000))], [("last", "running", at(900_000))]], settle=settle)
        told = [g for g in got if g[0].startswith("t")]
        assert len(told) == 300 and sum(g[1] == "done" for g in told) == 200
        assert left <= 6, left  # values and timers of the tasks still open


def test_landed_papers_are_respected(spark, tmp_path):
    """Papers that landed before the stream, or meanwhile by another run, are not landed again; a repeated addition replaces itself."""
    home, target = tmp_path / "in", str(tmp_path / "landed")
    schema = "pmid long, body string"
    write_papers(spark.createDataFrame([(1, "before"), (2, "before")], schema), target)
    spark.createDataFrame([(2, "stream"), (3, "stream b"), (3, "stream a"), (None, "no key")], schema).coalesce(1).write.parquet(str(home))
    go = lambda: ingest_new_papers(spark.readStream.schema(schema).parquet(str(home)), "pmid", target, str(tmp_path / "cp")).awaitTermination()
    go()
    land_papers(spark.createDataFrame([(4, "other run")], schema), target, "pmid", "other")
    spark.createDataFrame([(4, "stream"), (5, "stream")], schema).coalesce(1).write.mode("append").parquet(str(home))
    go()
    for _ in range(2):
        land_papers(spark.createDataFrame([(6, "again"), (5, "again")], schema), target, "pmid", "twice")
    got = sorted((r["pmid"], r["body"]) for r in spark.read.parquet(target).collect())
    assert got == [(1, "before"), (2, "before"), (3, "stream a"), (4, "other run"), (5, "stream"), (6, "again")]
