"""Exactly-once intake through failures at each step, and progress whose finished runs leave the state."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from parchment.streaming import intake
from parchment.streaming.progress import live_progress


def run_intake(spark, root, home, seen):
    def transform(fresh):
        seen.append(1)
        return fresh.select("path", "state", F.decode("content", "UTF-8").alias("text"))

    q = intake.intake_table(spark, str(root), str(home / "table"), transform).option("checkpointLocation", str(home / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()


def rows_of(spark, home):
    return sorted((r.path.rsplit("/", 1)[1], r.state, r.text) for r in intake.read_intake(spark, str(home / "table"), "path string, state string, text string").collect())


@pytest.mark.parametrize("after_rename", [False, True])
def test_a_failure_between_the_steps_leaves_one_result(spark, tmp_path, monkeypatch, after_rename):
    root, home = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    home.mkdir()
    (root / "a.txt").write_text("one")
    (root / "b.txt").write_text("two")
    assert rows_of(spark, home) == []
    real = intake._rename

    def broken(spark, source, target):
        if after_rename:
            real(spark, source, target)
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(intake, "_rename", broken)
    seen = []
    with pytest.raises(Exception, match="driver is lost"):
        run_intake(spark, root, home, seen)
    both = [("a.txt", "NEW", "one"), ("b.txt", "NEW", "two")]
    assert rows_of(spark, home) == (both if after_rename else [])
    monkeypatch.setattr(intake, "_rename", real)
    run_intake(spark, root, home, seen)
    assert rows_of(spark, home) == both and len(seen) == (1 if after_rename else 2)
    (root / "c.txt").write_text("three")
    run_intake(spark, root, home, seen)
    assert rows_of(spark, home) == [*both, ("c.txt", "NEW", "three")]


def test_finished_runs_leave_the_state(spark, tmp_path):
    source, at = tmp_path / "events", dt.datetime(2024, 1, 1)
    source.mkdir()

    def write(name, rows):
        lines = [json.dumps({"run": r, "ts": (at + dt.timedelta(seconds=s)).isoformat(), "c": c, "f": f, "s": t}) for r, s, c, f, t in rows]
        (source / name).write_text("\n".join(lines))

    out, states = [], []
    stream = spark.readStream.schema("run string, ts timestamp, c int, f int, s string").option("maxFilesPerTrigger", 1).json(str(source))
    live = live_progress(stream, "run", "ts", "c", "f", "s", late="10 seconds", keep_seconds=1000, linger_seconds=60)

    def step(name, rows):
        write(name, rows)
        q = live.writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(map(tuple, df.collect())))
        q = q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])

    step("1", [("a", 0, 1, 0, "RUNNING"), ("a", 5, 3, 0, "RUNNING"), ("b", 2, 7, 1, "RUNNING"), (None, 1, None, None, None)])
    assert sorted(map(str, out)) == sorted(map(str, [("a", 3, 0, "RUNNING", 5.0, False), ("b", 7, 1, "RUNNING", 0.0, False), (None, 0, 0, "", 0.0, False)]))
    out.clear()
    step("2", [("a", 20, 2, 0, "DONE"), ("a", 18, 9, 2, "RUNNING"), ("b", 30, 8, 0, "RUNNING")])
    assert sorted(out) == [("a", 9, 2, "DONE", 20.0, True), ("b", 8, 1, "RUNNING", 28.0, False)]
    out.clear()
    step("3", [("a", 25, 10, 2, "RUNNING"), ("b", 200, 9, 1, "RUNNING")])
    assert ("b", 9, 1, "RUNNING", 198.0, False) in out and all(r[3] == "DONE" for r in out if r[0] == "a")
    step("4", [("b", 400, 10, 1, "RUNNING")])
    assert states[-1] == 2  # a has left, the run without a name is still waited for
    step("5", [("b", 2000, 10, 1, "FAILED")])
    step("6", [("z", 2500, 1, 0, "RUNNING")])
    assert states[0] == 3 and states[-1] == 1
