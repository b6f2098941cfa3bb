"""Event-log operators against small sequential models of their rules."""

import random
import re
import time
from datetime import datetime, timedelta
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from millrace.operators import event_log as el

STATES = ["started", "started", "success", "failed", "stopped", "finished"]
KIND = (
    "seq bigint, run_id string, flow_name string, step_name string, source_label string, "
    "status string, elapsed_seconds double, created_at timestamp, line string"
)
T0 = datetime(2026, 4, 1)


def random_events(seed, size=1500, runs=60):
    pick = random.Random(seed)
    rows = []
    for seq in range(size):
        run = pick.randrange(runs)
        step = pick.choice([None, "read", "write"])
        rows.append(
            (seq, f"r{run}", f"f{run % 3}", step, pick.choice(["a.csv", "b.csv"]), pick.choice(STATES),
             pick.choice([None, float(seq)]), T0 + timedelta(seconds=seq), f"line {seq}")
        )
    return rows


def run_model(rows):
    """Replay the log one event at a time: a failure or stop is not undone by a success."""
    state = {}
    for seq, run, flow, step, source, status, elapsed, _, line in rows:
        now = state.setdefault(run, {"status": "started", "line": None, "elapsed": None, "first": seq,
                                     "source": source, "flow": flow, "seen": False})
        if step is not None:
            continue
        sticky = now["status"] in ("failed", "stopped") and status in ("success", "finished")
        if not sticky:
            now["status"], now["line"] = status, line
        now["elapsed"] = elapsed
    return {run: (v["flow"], v["first"], v["source"], v["status"], v["elapsed"], v["line"]) for run, v in state.items()}


@pytest.mark.parametrize("seed", range(3))
def test_run_status_replays_the_log(spark, seed):
    rows = random_events(seed, size=1500 if seed else 150)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = {
        r.run_id: (r.flow_name, r.first_seq, r.source_label, r.status, r.elapsed_seconds, r.summary_line)
        for r in el.run_status(df).collect()
    }
    assert got == run_model(rows)


def step_model(rows):
    """Keep a stack of open starts per step; an end takes the place of the newest one."""
    kept, stacks = {}, {}
    for seq, run, flow, step, source, status, *_ in rows:
        if step is None:
            continue
        stack = stacks.setdefault((run, flow, step, source), [])
        if status == "started":
            stack.append(seq)
        elif status in ("success", "failed", "stopped") and stack:
            start = stack.pop()
            kept.pop(start, None)
            kept[seq] = start
            continue
        kept[seq] = seq
    return kept


@pytest.mark.parametrize("seed, chunk", [(1, None), (2, None), (3, 20), (4, 7)])
def test_step_status_replays_the_log(spark, seed, chunk):
    rows = random_events(seed, runs=60 if seed < 3 else 2)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = [(r.seq, r.first_seq) for r in el.step_status(df, chunks=chunk).collect()]
    assert len(got) == len(set(got))
    assert dict(got) == step_model(rows)


def events(spark, *rows):
    data = [
        (i, run, "flow", step, "a.csv", status, None, T0 + timedelta(seconds=i), f"{run} {status}")
        for i, (run, step, status) in enumerate(rows)
    ]
    return spark.createDataFrame(data, KIND)


def test_one_successful_run(spark):
    df = events(spark, ("r", None, "started"), ("r", "read", "started"), ("r", "read", "success"), ("r", None, "success"))
    rolled = el.run_rollup(df)
    (run,) = rolled["runs"].collect()
    assert (run.status, run.display_label) == ("success", "2026-04-01 12:00:03 AM")
    assert [(s.step_name, s.status) for s in rolled["steps"].collect()] == [("read", "success")]


def test_success_after_a_failure_does_not_count(spark):
    df = events(spark, ("r", None, "started"), ("r", None, "failed"), ("r", None, "success"))
    (run,) = el.run_status(df).collect()
    assert (run.status, run.summary_line) == ("failed", "r failed")
    (summary,) = el.run_summary(el.run_status(df)).collect()
    assert (summary.state, summary.error_text) == ("failed", "r failed")
    assert summary.finished_at == T0 + timedelta(seconds=1)


def test_summary_of_running_and_newest(spark):
    df = events(spark, ("a", None, "success"), ("b", "read", "success"), ("c", None, "started"))
    rows = el.run_summary(el.run_status(df), limit=2).collect()
    assert [(r.run_id, r.state, r.finished_at, r.error_text) for r in rows] == [
        ("b", "running", None, None), ("c", "running", None, None)
    ]
    assert len(el.run_summary(el.run_status(df), limit=-1).collect()) == 3


@pytest.mark.parametrize(
    "message, event, line",
    [
        ("x run=r1 flow=f step=Read Excel source=/in/my file.csv status=success elapsed=1.250",
         ("r1", "f", "Read Excel", "my file.csv", "success", 1.25), "f  Read Excel  success  my file.csv"),
        ("run=r1 flow=f source=None status=started", ("r1", "f", None, "-", "started", None), "f  started  -"),
        ("run=r1 flow=f source=/in/dir/ status=failed", ("r1", "f", None, "dir", "failed", None), "f  failed  dir"),
        ("flow=f source=/in/a.csv status=ok", None, "f  ok  a.csv"),
        ("copied /in/a.csv to /out/b/ at / now", None, "copied a.csv to b at / now"),
        ("nothing here", None, "nothing here"),
        (None, None, None),
    ],
)
def test_parsing(spark, message, event, line):
    df = spark.createDataFrame([(message,)], "message string")
    row = df.select(
        el.parse_event(F.col("message")).alias("event"), el.short_line(F.col("message")).alias("line")
    ).first()
    assert (None if row.event is None else tuple(row.event)) == event
    assert row.line == line


def test_typed_log_filters(spark):
    logs = spark.createDataFrame(
        [(1, "f", "run=r1 flow=f source=a status=started", "2026-04-01T10:00:00+00:00"),
         (2, None, "run=r1 flow=f source=a status=success", "2026-04-01T10:00:01.5+00:00"),
         (3, "g", "no event", "2026-04-01T10:00:02+00:00")],
        "id bigint, flow_name string, message string, created_at_utc string",
    )
    assert [(r.seq, r.kind) for r in el.typed_log(logs).collect()] == [(1, "flow"), (2, "system"), (3, "flow")]
    assert [r.seq for r in el.typed_log(logs, run_id="r1").collect()] == [1, 2]
    assert [r.seq for r in el.typed_log(logs, flow_name="f", run_id="r1").collect()] == [1]


def test_durations(spark):
    df = events(spark, ("a", None, "started"), ("b", None, "success"))
    now = F.lit("2026-04-01 00:01:00.5").cast("timestamp")
    got = {r.run_id: r.duration_seconds for r in el.run_duration(el.run_status(df), now).collect()}
    assert got == {"a": 60.5, "b": None}
    earlier = F.lit("2026-03-01 00:00:00").cast("timestamp")
    assert el.run_duration(el.run_status(df), earlier).where("run_id = 'a'").first().duration_seconds == 0.0


def test_run_error(spark):
    entries = spark.createDataFrame(
        [("r", "s1"), ("r", "s2"), ("r", None), ("q", "s1")], "run_id string, step_name string"
    )
    steps = spark.createDataFrame(
        [(2, "r", "s1", "failed", "second"), (1, "r", "s1", "failed", "first"), (3, "r", "s2", "success", "no"),
         (4, "q", "s1", "failed", None)],
        "id bigint, run_id string, step_label string, status string, error_text string",
    )
    runs = spark.createDataFrame([("r", "run error"), ("q", "q error")], "run_id string, error_text string")
    got = {(r.run_id, r.step_name): (r.error_title, r.error_text) for r in el.run_error(entries, steps, runs).collect()}
    assert got == {
        ("r", "s1"): ("s1 Error", "first"), ("r", "s2"): ("Run Error", "run error"),
        ("r", None): ("Run Error", "run error"), ("q", "s1"): ("s1 Error", "q error"),
    }


def test_run_logs_and_dedupe(spark):
    df = events(spark, ("a", None, "started"), ("b", None, "failed"), ("a", None, "failed"), ("a", None, "stopped"))
    got = el.run_logs(df, "a", limit=2).collect()
    assert [(r.seq, r.level) for r in got] == [(2, "error"), (3, "info")]
    entries = df.unionByName(df.withColumn("seq", F.col("seq") + 100)).withColumns(
        {"kind": F.lit("flow"), "log_flow_name": F.lit("flow"), "created_at": F.timestamp_seconds("seq")}
    )
    assert sorted(r.seq for r in el.fingerprint_dedupe(entries).collect()) == [0, 1, 2, 3]
    no_run = entries.withColumn("run_id", F.lit(None).cast("string"))
    assert el.fingerprint_dedupe(no_run).count() == 8


def steps(spark):
    at = "2026-04-01T10:00:0{}+00:00".format
    return spark.createDataFrame(
        [(1, "f", "read", "success", at(0), at(2), 1500, "/o/1"), (2, "f", "write", "failed", at(5), at(3), None, None),
         (3, "g", "read", "Started ", at(0), None, None, None), (4, "f", "read", "queued", at(0), None, None, None),
         (5, "f", "read", "success", at(0), at(4), None, "/o/5"), (6, "f", "old", "success", at(0), at(1), -5, "")],
        "id bigint, flow_name string, step_label string, status string, started_at_utc string, "
        "finished_at_utc string, elapsed_ms bigint, output_path string",
    )


def test_step_tracker(spark):
    known = spark.createDataFrame(
        [("f", "read"), ("f", "write"), ("g", "read"), ("g", "never")], "flow_name string, step_label string"
    )
    got = {
        (r.flow_name, r.step_label): (r.state, r.elapsed_seconds, r.is_current)
        for r in el.step_tracker(steps(spark), known).collect()
    }
    assert got == {
        ("f", "read"): ("idle", 4.0, True), ("f", "write"): ("failed", 0.0, False),
        ("g", "read"): ("running", None, True), ("g", "never"): ("idle", None, False),
    }
    everything = {r.step_label: r.elapsed_seconds for r in el.step_tracker(steps(spark)).where("flow_name = 'f'").collect()}
    assert everything["old"] == 0.0


def test_latest_outputs(spark):
    rows = steps(spark)
    latest = el.latest_outputs(rows)
    assert [tuple(r) for r in latest.collect()] == [("f", "read", 5, "/o/5")]
    there = spark.createDataFrame([("/o/1",)], "path string")
    assert el.latest_outputs(rows, existing=there).first().output_path == "/o/1"
    early = el.latest_outputs(rows.where("id < 3"))
    assert el.latest_outputs(rows.where("id >= 3"), known=early).collect() == latest.collect()
    none = spark.createDataFrame([("f", "write")], "flow_name string, step_label string")
    assert el.latest_outputs(rows, operations=none).count() == 0


def test_ledger_views(spark):
    at = "2026-04-0{}T10:00:00+00:00".format
    runs = spark.createDataFrame(
        [("r1", "f", "/in/a.csv", "failed", at(1), at(2), "bad"), ("r2", "f", None, "odd", None, at(3), " "),
         ("r3", "f", "", "success", at(4), None, None), ("r4", "g", "x", "failed", at(1), None, " ")],
        "run_id string, flow_name string, source_path string, status string, started_at_utc string, "
        "finished_at_utc string, error_text string",
    )
    assert {r.flow_name: r.run_id for r in el.latest_run(runs).collect()} == {"f": "r3", "g": "r4"}
    logged = spark.createDataFrame([("r3",)], "run_id string")
    got = {r.run_id: (r.source_label, r.status, r.elapsed_seconds, r.summary_line) for r in el.ledger_summary(runs, logged).collect()}
    assert got == {
        "r1": ("a.csv", "failed", 86400.0, "bad"), "r2": ("-", "started", None, "f  started  -"),
        "r4": ("x", "failed", None, "g  failed  x"),
    }


STEP_RULE = re.compile(r"run=(\S+) flow=(\S+) step=(.+?) source=(.+?) status=(\S+)(?: elapsed=(\S+))?")
FLOW_RULE = re.compile(r"run=(\S+) flow=(\S+) source=(.+?) status=(\S+)(?: elapsed=(\S+))?")
STEP_SHORT = re.compile(r"flow=(\S+) step=(.+?) source=(.+?) status=(\S+)")
FLOW_SHORT = re.compile(r"flow=(\S+) source=(.+?) status=(\S+)")


def label(path):
    return "-" if path in ("", "None") else PurePosixPath(path).name


def event_model(message):
    if found := STEP_RULE.search(message):
        run, flow, step, source, status, elapsed = found.groups()
    elif found := FLOW_RULE.search(message):
        (run, flow, source, status, elapsed), step = found.groups(), None
    else:
        return None
    return run, flow, step, label(source), status, elapsed and float(elapsed)


def line_model(message):
    if found := STEP_SHORT.search(message):
        flow, step, source, status = found.groups()
        return "  ".join([flow, step, status, label(source)])
    if found := FLOW_SHORT.search(message):
        flow, source, status = found.groups()
        return "  ".join([flow, status, label(source)])
    return None


def test_messages_in_any_order_of_their_words(spark):
    """The linear matcher finds what a backtracking search does."""
    pick = random.Random(21)
    words = [
        "run=a", "run=", "xrun=b", "run=run=c", " ", " ", " ", "\n", " flow=f", " flow=", "flow=g", " step=s t", " step=",
        " source=x", " source=", " source=d/e.csv", " status=ok", " status=", " elapsed=1.5", " elapsed=", "z", "run=a flow=f",
        " step=s source=c.csv status=started", " source=c.csv status=success elapsed=2", "run=q flow=w step=e source=r status=t",
    ]
    texts = ["".join(pick.choices(words, k=pick.randint(1, 9))) for _ in range(4_000)]
    # A number that is none is an error on either side.
    texts = [t for t in texts if not re.search(r"elapsed=(?!1\.5(?!\S)|2(?!\S))\S", t)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq int, message string")
    rows = df.select("seq", el.parse_event(F.col("message")).alias("e"), el.short_line(F.col("message")).alias("line")).collect()
    matched = 0
    for r in rows:
        expected = event_model(texts[r.seq])
        assert (tuple(r.e) if r.e else None) == expected, texts[r.seq]
        if (line := line_model(texts[r.seq])) is not None:
            assert r.line == line, texts[r.seq]
        matched += expected is not None
    assert matched > 200


@pytest.mark.parametrize("unit", ["run=a flow=b step=c source=d ", "run=", "run=a flow=b step=", " source=", "flow=x step=y "])
def test_a_megabyte_without_a_status_takes_no_time(spark, unit):
    text = unit * (1_000_000 // len(unit))
    df = spark.createDataFrame([(text,), (text + " status=x",), (text + "\n status=x",)], "message string")
    df.select(el.parse_event(F.lit("warm up")), el.short_line(F.lit("warm up"))).collect()
    begin = time.perf_counter()
    df.select(F.max(el.parse_event(F.col("message"))), F.max(F.length(el.short_line(F.col("message"))))).collect()
    assert time.perf_counter() - begin < 6
