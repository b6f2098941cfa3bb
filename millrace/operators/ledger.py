"""The four run-history tables and the operators that keep them.

Times are ISO text in UTC, so text order is time order. Every operator takes and returns
frames; storing them is the caller's choice (see ``checkpoint_tables``).
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.joins import one_row_per_key
from millrace.operators.preview import top_k
from millrace.session import local_frame
from millrace.sources.tables import Warehouse


def _schema(**fields: str) -> T.StructType:
    kinds = {"string": T.StringType(), "bigint": T.LongType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields.items()])


# The columns of the four stored tables.
SCHEMAS = {
    "runs": _schema(
        run_id="string", flow_name="string", group_name="string", source_path="string",
        status="string", started_at_utc="string", finished_at_utc="string", error_text="string",
    ),
    "step_runs": _schema(
        id="bigint", run_id="string", flow_name="string", step_label="string", status="string",
        started_at_utc="string", finished_at_utc="string", elapsed_ms="bigint",
        error_text="string", output_path="string",
    ),
    "logs": _schema(
        id="bigint", run_id="string", flow_name="string", step_label="string", level="string",
        message="string", created_at_utc="string",
    ),
    "file_state": _schema(
        flow_name="string", source_path="string", mtime_ns="bigint", size_bytes="bigint",
        last_success_run_id="string", last_success_at_utc="string", last_status="string",
        last_error_text="string",
    ),
}
GENERATION = "snapshot_generation_id"

Tables = dict[str, DataFrame]


# -- lists -------------------------------------------------------------------------------


def _for_flow(rows: DataFrame, flow_name: str | None) -> DataFrame:
    return rows if flow_name is None else rows.where(F.col("flow_name") == flow_name)


def history_list(runs: DataFrame, *, flow_name: str | None = None) -> DataFrame:
    """Runs, newest first."""
    return _for_flow(runs, flow_name).orderBy(
        F.col("started_at_utc").desc_nulls_last(), F.col("run_id").desc_nulls_last()
    )


def active_runs(runs: DataFrame, *, flow_name: str | None = None) -> DataFrame:
    """Runs still marked as started, oldest first."""
    active = _for_flow(runs, flow_name).where(F.col("status") == "started")
    return active.orderBy("started_at_utc", "run_id")


def step_list(
    step_runs: DataFrame, *, flow_name: str | None = None, after_id: int | None = None
) -> DataFrame:
    """Step rows in id order, optionally those after a cursor."""
    rows = _for_flow(step_runs, flow_name)
    return (rows if after_id is None else rows.where(F.col("id") > after_id)).orderBy("id")


def log_tail(
    logs: DataFrame,
    *,
    flow_name: str | None = None,
    run_id: str | None = None,
    after_id: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Log rows after a cursor; with ``limit`` the last ones, in ascending order."""
    rows = _for_flow(logs, flow_name)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if after_id is not None:
        rows = rows.where(F.col("id") > after_id)
    if limit is None:
        return rows.orderBy("created_at_utc", "id")
    return top_k(rows, [("id", True)], max(int(limit), 0)).orderBy("id")


# -- upkeep ------------------------------------------------------------------------------


def cascade_delete(children: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows whose run was not removed; rows without a run stay."""
    return children.join(removed.select("run_id"), "run_id", "left_anti").select(
        *children.columns
    )


def prune_history(tables: Tables, cutoff: str) -> Tables:
    """Remove runs that ended, or else started, before ``cutoff`` with their steps and logs.

    File states lose their pointer to a removed run and keep their signature.
    """
    runs = tables["runs"]
    old = F.coalesce("finished_at_utc", "started_at_utc") < F.lit(cutoff)
    removed = runs.where(old).select("run_id")
    gone = one_row_per_key(
        removed.select(F.col("run_id").alias("last_success_run_id"), F.lit(True).alias("__gone")),
        ["last_success_run_id"],
    )
    states = tables["file_state"]
    kept = (
        states.join(gone, "last_success_run_id", "left")
        .withColumn(
            "last_success_run_id", F.when(F.col("__gone").isNull(), F.col("last_success_run_id"))
        )
        .select(*states.columns)
    )
    return {
        "runs": runs.where(~F.coalesce(old, F.lit(False))),
        "step_runs": cascade_delete(tables["step_runs"], removed),
        "logs": cascade_delete(tables["logs"], removed),
        "file_state": kept,
    }


def reconcile_orphans(
    rows: DataFrame, *, status: str, finished_at_utc: str, error_text: str | None = None
) -> DataFrame:
    """Give rows still marked as started a final status; an error text they have stays."""
    orphan = F.col("status") == "started"
    return rows.withColumns(
        {
            "status": F.when(orphan, F.lit(status)).otherwise(F.col("status")),
            "finished_at_utc": F.when(orphan, F.lit(finished_at_utc)).otherwise(
                F.col("finished_at_utc")
            ),
            "error_text": F.when(
                orphan, F.coalesce("error_text", F.lit(error_text).cast("string"))
            ).otherwise(F.col("error_text")),
        }
    )


def orphan_counts(tables: Tables) -> DataFrame:
    """How many runs and steps ``reconcile_orphans`` changes."""
    parts = [
        tables[name].where(F.col("status") == "started").agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("orphans")
        )
        for name in ("runs", "step_runs")
    ]
    return parts[0].unionByName(parts[1])


def reset_flow(tables: Tables, flow_name: str) -> Tables:
    """All four tables without one flow; rows of its runs go under any flow name."""
    mine = F.col("flow_name") == flow_name
    others = ~F.coalesce(mine, F.lit(False))
    removed = tables["runs"].where(mine).select("run_id")
    return {
        "runs": tables["runs"].where(others),
        "step_runs": cascade_delete(tables["step_runs"].where(others), removed),
        "logs": cascade_delete(tables["logs"].where(others), removed),
        "file_state": tables["file_state"].where(others),
    }


def upsert_file_state(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """File states after a log of finished runs.

    ``changes`` has ``seq, flow_name, source_path, mtime_ns, size_bytes, status, run_id,
    finished_at_utc, error_text``. Signature, status and error come from the newest change,
    the success pointer from the newest success.
    """
    before = ledger.select(
        F.lit(None).cast("bigint").alias("seq"),
        "flow_name", "source_path", "mtime_ns", "size_bytes",
        F.col("last_status").alias("status"),
        F.col("last_error_text").alias("error_text"),
        F.col("last_success_run_id").alias("run_id"),
        F.col("last_success_at_utc").alias("finished_at_utc"),
        F.lit(True).alias("pointer"),
    )
    after = changes.select(
        "seq", "flow_name", "source_path", "mtime_ns", "size_bytes", "status", "error_text",
        "run_id", "finished_at_utc", (F.col("status") == "success").alias("pointer"),
    )
    # The stored state counts as older than every change.
    age = F.struct(F.col("seq").isNotNull(), F.col("seq"))
    success = F.struct("run_id", "finished_at_utc")
    newest = F.struct("mtime_ns", "size_bytes", "status", "error_text")
    return (
        before.unionByName(after)
        .groupBy("flow_name", "source_path")
        .agg(
            F.max_by(newest, age).alias("now"),
            F.max_by(F.when(F.col("pointer"), success), F.when(F.col("pointer"), age)).alias("ok"),
        )
        .select(
            "flow_name", "source_path",
            F.col("now.mtime_ns").alias("mtime_ns"),
            F.col("now.size_bytes").alias("size_bytes"),
            F.col("ok.run_id").alias("last_success_run_id"),
            F.col("ok.finished_at_utc").alias("last_success_at_utc"),
            F.col("now.status").alias("last_status"),
            F.col("now.error_text").alias("last_error_text"),
        )
    )


# -- snapshots ---------------------------------------------------------------------------


def generation_check(tables: Tables) -> DataFrame:
    """One row: how many generations the tables come from, and whether they fit together.

    A table counts when all its rows name one generation; an empty table fits any.
    """
    mark = F.col(GENERATION)
    valid: Column = F.when(F.trim(mark) != "", mark)
    per_table = [
        table.agg(F.min(valid).alias("low"), F.max(valid).alias("high"))
        for table in tables.values()
    ]
    named = reduce(lambda a, b: a.unionByName(b), per_table).where(F.col("low") == F.col("high"))
    count = F.count_distinct("low")
    return named.agg(count.alias("generations"), (count <= 1).alias("is_consistent"))


MARKER = "generation"


def _marked(warehouse: Warehouse, prefix: str) -> list[str]:
    """The generation in use and the one before, newest first."""
    if not warehouse.exists(f"{prefix}.{MARKER}"):
        return []
    rows = warehouse.frame(f"{prefix}.{MARKER}").orderBy("place").limit(2).collect()
    return [row[GENERATION] for row in rows]


def checkpoint_tables(
    warehouse: Warehouse, tables: Tables, prefix: str = "ledger", generation: str | None = None
) -> str:
    """Store the four tables under one generation id, which is returned.

    A generation has tables of its own. A small marker table names the one in use; it is
    written last, so until then, and after a crash at any point before, the one before is in
    use. The generation before stays for frames that still read it; older ones, and what a
    crashed checkpoint left, go once the marker is written.
    """
    generation = generation or uuid.uuid4().hex
    before = _marked(warehouse, prefix)
    if generation in before:
        raise ValueError(f"Generation {generation!r} exists already.")

    def store(name: str) -> str:
        return warehouse.write(
            f"{prefix}.{generation}.{name}", tables[name].withColumn(GENERATION, F.lit(generation))
        )

    # Four independent jobs that share the cluster.
    with ThreadPoolExecutor(len(SCHEMAS)) as pool:
        list(pool.map(store, SCHEMAS))
    kept = [generation, *before[:1]]
    marker = local_frame(warehouse.spark, {"place": list(range(len(kept))), GENERATION: kept})
    warehouse.write(f"{prefix}.{MARKER}", marker)
    warehouse.vacuum(f"{prefix}.{MARKER}")
    for name in warehouse.folder.children(f"{warehouse.folder.path}/{'/'.join(prefix.split('.'))}"):
        if name not in kept and name != MARKER:
            warehouse.folder.delete(f"{warehouse.folder.path}/{'/'.join(prefix.split('.'))}/{name}")
    return generation


def restore_tables(warehouse: Warehouse, prefix: str = "ledger") -> Tables | None:
    """The tables of the last complete generation, empty ones where there never was any.

    ``None`` where what is stored does not belong together.
    """
    marked = _marked(warehouse, prefix)
    stored = {}
    for name, schema in SCHEMAS.items():
        if marked:
            if not warehouse.exists(f"{prefix}.{marked[0]}.{name}"):
                return None
            stored[name] = warehouse.frame(f"{prefix}.{marked[0]}.{name}")
        else:
            empty = warehouse.spark.createDataFrame([], schema)
            stored[name] = empty.withColumn(GENERATION, F.lit(None).cast("string"))
    if not generation_check(stored).first()["is_consistent"]:
        return None
    return {name: table.drop(GENERATION) for name, table in stored.items()}
