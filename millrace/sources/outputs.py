"""Sinks for many outputs at once: mirrored sources, split outputs, saved frames."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import MirrorPaths
from millrace.functions.sortkeys import ColumnLike, as_column
from millrace.session import local_frame, materialise
from millrace.sources.tables import Folder, Warehouse


def mirror_write(
    df: DataFrame,
    root: str,
    relative_path: ColumnLike,
    *,
    layout: str = "suffix",
    name: str | None = None,
) -> str:
    """Write the output of every source to its own place below ``root`` in one job.

    ``layout`` is ``suffix`` (source path with ``.parquet``), ``file`` (a sibling called
    ``name``), ``namespaced`` (``name`` in a folder per source) or ``root`` (one ``name``
    for all). The rows of one source sit in the partition folder ``mirror_path=<place>``. Only
    the places that get rows are replaced; the outputs of other sources stay.
    """
    paths = MirrorPaths("", as_column(relative_path))
    if layout != "suffix" and not name:
        raise ValueError("This layout needs a file name.")
    place = {
        "suffix": lambda: paths.with_suffix(".parquet"),
        "file": lambda: paths.file(name),
        "namespaced": lambda: paths.namespaced_file(name),
        "root": lambda: paths.root_file(name),
    }[layout]()
    placed = df.withColumn("mirror_path", place)
    # Few files per source, yet a hot source is still written by several tasks.
    placed.hint("rebalance", "mirror_path").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("mirror_path").parquet(root)
    return root


def multi_output(df: DataFrame, outputs: Mapping[str, Column], root: str) -> str:
    """Write several filtered outputs of one frame with a single scan.

    A row goes to every output whose condition holds; output ``x`` is ``output=x``. The named
    outputs are replaced, also by nothing; others below ``root`` stay.
    """
    if not outputs:
        raise ValueError("There are no outputs.")
    names = F.array_compact(
        F.array(*[F.when(condition, F.lit(name)) for name, condition in outputs.items()])
    )
    # An output that gets no row is not replaced by the write, so what was there goes first.
    # Few files per output, and several tasks for one that gets most rows.
    split = materialise(df.withColumn("output", F.explode(names)), "outputs")
    filled = {row[0] for row in split.select("output").distinct().collect()}
    split.hint("rebalance", "output").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("output").parquet(root)
    folder = Folder(df.sparkSession, root)
    for name in outputs:
        if name not in filled:
            folder.delete(f"{folder.path}/output={name}")
    return root


ARTIFACTS = "artifacts"


def save_debug_frame(
    warehouse: Warehouse,
    df: DataFrame,
    *,
    flow_name: str,
    name: str = "artifact",
    step_name: str | None = None,
    run_id: str | None = None,
    source_path: str | None = None,
    workspace_id: str | None = None,
    info: Mapping[str, object] | None = None,
) -> str:
    """Keep an intermediate frame and one row about it in the ``artifacts`` table."""
    table = f"debug_frames.f_{uuid.uuid4().hex}"
    path = warehouse.write(table, df)
    facts = {
        "workspace_id": workspace_id,
        "flow_name": flow_name,
        "step_name": step_name,
        "run_id": run_id,
        "source_path": source_path,
        "artifact_kind": "dataframe",
        "artifact_table": table,
        "artifact_path": path,
        "display_name": f"{flow_name} / {step_name or 'Step'} / {name}",
    }
    columns = {key: pa.array([value], pa.string()) for key, value in facts.items()}
    extra = [(str(key), str(value)) for key, value in (info or {}).items()]
    columns["info"] = pa.array([extra], pa.map_(pa.string(), pa.string()))
    row = local_frame(warehouse.spark, columns)
    warehouse.evolve_append(ARTIFACTS, row.withColumn("saved_at_utc", F.current_timestamp()))
    return table
