import pytest
from pyspark.sql import functions as F

from millrace.operators import ledger as lg


def frame(spark, name, *rows):
    schema = lg.SCHEMAS[name]
    return spark.createDataFrame([tuple(row.get(f) for f in schema.names) for row in rows], schema)


@pytest.fixture
def tables(spark):
    old, new = "2026-01-01T00:00:00+00:00", "2026-04-01T00:00:00+00:00"
    return {
        "runs": frame(
            spark, "runs",
            {"run_id": "r1", "flow_name": "f", "status": "success", "started_at_utc": old, "finished_at_utc": old},
            {"run_id": "r2", "flow_name": "f", "status": "started", "started_at_utc": old, "finished_at_utc": new},
            {"run_id": "r3", "flow_name": "g", "status": "started", "started_at_utc": old, "error_text": "mine"},
            {"run_id": "r4", "flow_name": "g", "status": "started", "started_at_utc": new},
        ),
        "step_runs": frame(
            spark, "step_runs", *[{"id": i, "run_id": f"r{i}", "flow_name": "f" if i < 3 else "g", "status": "started"}
                                  for i in range(1, 5)],
        ),
        "logs": frame(
            spark, "logs",
            *[{"id": i, "run_id": f"r{i}", "flow_name": "f" if i < 3 else "g", "message": m, "created_at_utc": new}
              for i, m in enumerate(["first", "second", "third"], 1)],
            {"id": 9, "message": "system", "created_at_utc": old},
        ),
        "file_state": frame(
            spark, "file_state",
            {"flow_name": "f", "source_path": "a", "mtime_ns": 1, "size_bytes": 1, "last_success_run_id": "r1"},
            {"flow_name": "g", "source_path": "b", "mtime_ns": 1, "size_bytes": 1, "last_success_run_id": "r4"},
        ),
    }


def ids(df, name="run_id"):
    return [r[name] for r in df.collect()]


def test_log_tail(tables):
    logs = tables["logs"]
    assert ids(lg.log_tail(logs, after_id=1, flow_name="f"), "message") == ["second"]
    assert ids(lg.log_tail(logs, limit=2), "id") == [3, 9]
    assert ids(lg.log_tail(logs), "id") == [9, 1, 2, 3]
    assert ids(lg.log_tail(logs, run_id="r3"), "id") == [3]
    assert ids(lg.log_tail(logs, limit=-3), "id") == []


def test_lists(tables):
    assert ids(lg.history_list(tables["runs"])) == ["r4", "r3", "r2", "r1"]
    assert ids(lg.active_runs(tables["runs"], flow_name="g")) == ["r3", "r4"]
    assert ids(lg.step_list(tables["step_runs"], flow_name="f", after_id=1), "id") == [2]


def test_prune_history(tables):
    kept = lg.prune_history(tables, "2026-03-01T00:00:00+00:00")
    assert sorted(ids(kept["runs"])) == ["r2", "r4"]
    assert sorted(ids(kept["step_runs"], "id")) == [2, 4]
    assert sorted(ids(kept["logs"], "id")) == [2, 9]
    assert {r.source_path: r.last_success_run_id for r in kept["file_state"].collect()} == {"a": None, "b": "r4"}


def test_reset_flow(spark, tables):
    # A row under another flow's name that belongs to a removed run goes as well.
    stray = frame(spark, "step_runs", {"id": 7, "run_id": "r1", "flow_name": "g"})
    tables["step_runs"] = tables["step_runs"].unionByName(stray)
    kept = lg.reset_flow(tables, "f")
    assert sorted(ids(kept["runs"])) == ["r3", "r4"]
    assert sorted(ids(kept["step_runs"], "id")) == [3, 4]
    assert sorted(ids(kept["logs"], "id")) == [3, 9]
    assert ids(kept["file_state"], "source_path") == ["b"]


def test_reconcile_orphans(tables):
    done = lg.reconcile_orphans(tables["runs"], status="stopped", finished_at_utc="now", error_text="gone")
    got = {r.run_id: (r.status, r.finished_at_utc, r.error_text) for r in done.collect()}
    assert got["r3"] == ("stopped", "now", "mine") and got["r4"] == ("stopped", "now", "gone")
    assert got["r1"][0] == "success"
    counts = {r.table_name: r.orphans for r in lg.orphan_counts(tables).collect()}
    assert counts == {"runs": 3, "step_runs": 4}


def test_upsert_file_state(spark, tables):
    changes = spark.createDataFrame(
        [(1, "f", "a", 2, 2, "success", "n1", "t1", None), (2, "f", "a", 3, 3, "failed", "n2", "t2", "bad"),
         (3, "g", "b", 4, 4, "failed", "n3", "t3", "bad"), (4, "g", "new", 5, 5, "failed", "n4", "t4", "x")],
        "seq bigint, flow_name string, source_path string, mtime_ns bigint, size_bytes bigint, "
        "status string, run_id string, finished_at_utc string, error_text string",
    )
    got = {
        r.source_path: (r.mtime_ns, r.last_success_run_id, r.last_success_at_utc, r.last_status, r.last_error_text)
        for r in lg.upsert_file_state(tables["file_state"], changes).collect()
    }
    assert got == {
        "a": (3, "n1", "t1", "failed", "bad"), "b": (4, "r4", None, "failed", "bad"), "new": (5, None, None, "failed", "x"),
    }


def test_checkpoint_and_restore(warehouse, tables):
    generation = lg.checkpoint_tables(warehouse, tables)
    restored = lg.restore_tables(warehouse)
    assert {name: restored[name].count() for name in restored} == {"runs": 4, "step_runs": 4, "logs": 4, "file_state": 2}
    assert restored["runs"].schema.names == lg.SCHEMAS["runs"].names
    # Tables of another generation do not fit in.
    warehouse.write(f"ledger.{generation}.logs", tables["logs"].withColumn(lg.GENERATION, F.lit(generation + "x")))
    assert lg.restore_tables(warehouse) is None
    assert lg.restore_tables(warehouse, "never_written")["runs"].count() == 0


@pytest.mark.parametrize("fails_at", [*lg.SCHEMAS, lg.MARKER])
def test_a_crash_leaves_the_last_good_generation(warehouse, tables, monkeypatch, fails_at):
    lg.checkpoint_tables(warehouse, tables, generation="one")
    fewer = {name: table.limit(1) for name, table in tables.items()}
    write = warehouse.write

    def crash(table, df, **options):
        if table.endswith("." + fails_at):
            raise OSError("disk full")
        return write(table, df, **options)

    with monkeypatch.context() as patch:
        patch.setattr(warehouse, "write", crash)
        with pytest.raises(OSError):
            lg.checkpoint_tables(warehouse, fewer, generation="two")
    assert lg.restore_tables(warehouse)["runs"].count() == 4
    old = lg.restore_tables(warehouse)["logs"]
    lg.checkpoint_tables(warehouse, fewer, generation="three")
    assert {name: table.count() for name, table in lg.restore_tables(warehouse).items()} == dict.fromkeys(lg.SCHEMAS, 1)
    # Frames of the generation before can still be read; what the crash left is gone.
    assert old.count() == 4
    assert warehouse.folder.children(f"{warehouse.folder.path}/ledger") == ["generation", "one", "three"]
    with pytest.raises(ValueError):
        lg.checkpoint_tables(warehouse, fewer, generation="three")
