"""Streaming forms on file sources, driven to their end."""

import time

from veridock.streaming import events as se


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_current_state(spark, tmp_path):
    s = write(spark, str(tmp_path / "a"), [("r", 1, "RECEIVED"), ("r", 2, "FAILED"), ("q", 1, "RECEIVED")], "run string, seq long, state string")
    got = {r["run"]: r["state"] for r in drain(se.stream_current_state(s, "run", "seq", "state"), "cs", "complete")}
    assert got == {"r": "FAILED", "q": "RECEIVED"}


def test_unique_append(spark, tmp_path):
    s = write(spark, str(tmp_path / "b"), [("r", 1, "2024-01-01 00:00:00"), ("r", 1, "2024-01-01 00:00:01"), ("r", 2, "2024-01-01 00:00:02")], "run string, seq long, at string")
    s = s.selectExpr("run", "seq", "CAST(at AS timestamp) AS at")
    assert len(drain(se.stream_unique(s, ["run", "seq"], "at", "1 hour"), "un", "append")) == 2


def test_transitions(spark, tmp_path):
    rows = [("r", 1, "RECEIVED", "TRANSITION"), ("r", 2, "CLASSIFYING_INPUTS", "TRANSITION"), ("r", 3, "BLOCKED", "TRANSITION"), ("r", 4, "RUNNING_MATH", "RESUME"), ("q", 1, "FAILED", "TRANSITION"), ("r", 6, "RUNNING_RULES", "TRANSITION")]
    s = write(spark, str(tmp_path / "c"), rows, "run_id string, sequence long, next_state string, kind string")
    got = {(r["run_id"], r["sequence"]): r["accepted"] for r in drain(se.stream_transitions(s, patience_ms=0), "tr", "append")}
    assert got == {("r", 1): True, ("r", 2): True, ("r", 3): True, ("r", 4): True, ("q", 1): False, ("r", 6): False}


def test_an_early_event_waits_for_its_predecessors(spark, tmp_path):
    schema, path = "run_id string, sequence long, next_state string, kind string", str(tmp_path / "early")
    batches = [[("r", 2, "CLASSIFYING_INPUTS", "TRANSITION"), ("q", 3, "FAILED", "TRANSITION")], [("r", 3, "FAILED", "TRANSITION")], [("r", 1, "RECEIVED", "TRANSITION"), ("r", 3, "BLOCKED", "TRANSITION")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted((r["run_id"], r["sequence"], r["next_state"], r["accepted"]) for r in drain(se.stream_transitions(stream, patience_ms=None), "early", "append") if r["run_id"] == "r")
    # The second event of a sequence number isn't accepted, whichever file came first.
    assert [(s, ok) for _, s, _, ok in got if ok] == [(1, True), (2, True), (3, True)] and len(got) == 4


def test_what_waits_too_long_is_not_accepted(spark, tmp_path):
    schema, path = "run_id string, sequence long, next_state string, kind string", str(tmp_path / "late")
    spark.createDataFrame([("q", 3, "FAILED", "TRANSITION")], schema).coalesce(1).write.parquet(path)
    stream = se.stream_transitions(spark.readStream.schema(schema).parquet(path), patience_ms=500)
    q = stream.writeStream.format("memory").queryName("late").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            rows = spark.sql("SELECT * FROM late").collect()
            if rows:
                break
            time.sleep(1)
        assert [tuple(r) for r in rows] == [("q", 3, "FAILED", False)]
    finally:
        q.stop()


def test_windows_and_sessions_plan(spark, tmp_path):
    s = write(spark, str(tmp_path / "d"), [("u", "2024-01-01 00:00:00", 1.0), ("u", "2024-01-01 00:03:00", 2.0)], "user string, at string, value double")
    s = s.selectExpr("user", "CAST(at AS timestamp) AS at", "value")
    assert sum(r["n"] for r in drain(se.stream_windows(s, "at", "1 hour", "5 minutes", "5 minutes", "user"), "win", "update")) == 2
    assert sum(r["n"] for r in drain(se.stream_sessions(s, "at", "1 hour", "10 minutes", "user"), "ses", "complete")) == 2
