"""Bring a fact table up to date with a folder of source files, changed files only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import source_key
from millrace.operators.ledger import SCHEMAS, upsert_file_state
from millrace.session import local_frame, materialise
from millrace.sources import files
from millrace.sources.tables import ConcurrentChange, Warehouse

FILE_KEY = "file_key"
STATE_TABLE = "ledger.file_state"


def _plain(path):
    # File paths in row metadata are URI-encoded; a plus sign is not an encoded blank there.
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


_SCHEME = r"^[a-z0-9]+:(//[^/]*)?(?=/)"


def _without_scheme(path):
    # Roots and listed paths differ in their scheme prefix (file:/x, file:///x, /x).
    return F.regexp_replace(path, _SCHEME, "")


# Classes of SQL states that a file's content can cause: data exceptions, errors of a data
# source, errors raised by an author's function, and analysis of a frame that ``read`` makes.
_OF_DATA = ("22", "39", "42", "KD", "P0")


def _causes(error: Exception) -> Iterator:
    """The Java exceptions behind a failed job, outermost first."""
    found = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while found is not None:
        yield found
        found = found.getCause()


def _condition(java) -> tuple[str, str]:
    """The error condition and SQL state of a Java exception, empty where it has none."""
    if not java.getClass().getName().startswith("org.apache.spark."):
        return "", ""
    if not hasattr(java, "getCondition"):
        return "", ""
    return java.getCondition() or "", java.getSqlState() or ""


def _of_data(error: Exception) -> bool:
    """Whether a file's content may be the reason; a full disk or a lost executor is none."""
    causes = list(_causes(error))
    if not causes:
        return True  # raised by ``read`` or ``transform`` themselves
    python = any(c.getClass().getName().endswith("PythonException") for c in causes)
    return python or any(_condition(c)[1].startswith(_OF_DATA) for c in causes)


def _message(error: Exception) -> str:
    causes = [c.getMessage() or c.getClass().getName() for c in _causes(error)]
    return "; ".join(dict.fromkeys(causes)) if causes else str(error)


def _named(error: Exception, chosen: list[str]) -> list[str]:
    """The file that Spark says it could not read, if it is one of those chosen."""
    for java in _causes(error):
        if _condition(java)[0].startswith("FAILED_READ_FILE"):
            path = unquote(java.getMessageParameters().get("path"))
            plain = re.sub(_SCHEME, "", path)
            return [c for c in chosen if re.sub(_SCHEME, "", c) == plain]
    return []


def _failing(error: Exception, chosen: list[str], evaluate: Callable[[list[str]], None]) -> dict[str, str]:
    """The files behind a failure and why; a failure of something else is raised again.

    A file that Spark names costs nothing. Where it names none, as an author's function failed,
    halves are evaluated, but not written, until the files are known.
    """
    if not _of_data(error):
        raise error
    named = _named(error, chosen)
    if named or len(chosen) == 1:
        return dict.fromkeys(named or chosen, _message(error))
    failing = {}
    for half in (chosen[: len(chosen) // 2], chosen[len(chosen) // 2 :]):
        while half:
            try:
                evaluate(half)
                break
            except Exception as inner:
                failing |= _failing(inner, half, evaluate)
                half = [path for path in half if path not in failing]
    if not failing:
        raise error
    return failing


def refresh_sources(
    warehouse: Warehouse,
    root: str,
    table: str,
    *,
    flow_name: str,
    read: Callable[[list[str]], DataFrame],
    transform: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    extensions=None,
    run_id: str | None = None,
) -> DataFrame:
    """Read the new and changed files below ``root`` and replace their slices of ``table``.

    ``read`` opens a list of files as one frame and ``transform`` shapes its rows; every row
    carries its ``file_key``, which ``transform`` has to keep. All files go through one job. If
    it fails because of files, they are recorded as failed with the error, and the others go
    through one job without them; a failure for another reason is the caller's. The ledger of
    file states is written last, so an interrupted refresh is simply done again. Returns the
    signatures of the files that were processed.
    """
    spark = warehouse.spark
    listing = files.candidate_files(spark, root, extensions=extensions)
    signatures = files.with_source_key(listing).select(
        F.col("path").alias("source_path"),
        (F.unix_micros("modified_at") * 1000).alias("mtime_ns"),
        "size_bytes",
        F.col("source_key").alias(FILE_KEY),
    )
    # The folder may change meanwhile: everything below uses one listing.
    signatures = materialise(signatures, "listing")
    if warehouse.exists(STATE_TABLE):
        states = warehouse.frame(STATE_TABLE)
    else:
        states = spark.createDataFrame([], SCHEMAS["file_state"])
    stale = materialise(files.stale_sources(signatures, states, flow_name), "stale")
    # Names of changed files, which Spark needs as a list to plan the scan anyway.
    paths = [row["source_path"] for row in stale.select("source_path").collect()]
    failed: dict[str, str] = {}

    def shaped(chosen: list[str]) -> DataFrame:
        # The key is a function of the path, so rows need no lookup to get theirs.
        path = _without_scheme(_plain(F.col("_metadata.file_path")))
        below = F.substring(path, F.length(base) + 2, F.length(path))
        return transform(read(chosen).withColumn(FILE_KEY, source_key(below)))

    def evaluate(chosen: list[str]) -> None:
        shaped(chosen).write.format("noop").mode("overwrite").save()

    base = _without_scheme(F.lit(root.rstrip("/")))
    good = paths
    while good:
        keys = stale
        if failed:
            lost = local_frame(spark, {"source_path": pa.array(list(failed), pa.string())})
            keys = stale.join(lost, "source_path", "left_anti")
        try:
            warehouse.replace_files(table, shaped(good), keys.select(FILE_KEY), file_hash_column=FILE_KEY)
            break
        except ConcurrentChange:
            raise
        except Exception as error:
            failed |= _failing(error, good, evaluate)
            good = [path for path in good if path not in failed]
    # One entry for each file that failed.
    errors = local_frame(
        spark,
        {
            "source_path": pa.array(list(failed), pa.string()),
            "error_text": pa.array(list(failed.values()), pa.string()),
        },
    )
    finished = stale.join(errors, "source_path", "left").select(
        F.lit(1).cast("bigint").alias("seq"),
        F.lit(flow_name).alias("flow_name"),
        "source_path", "mtime_ns", "size_bytes",
        F.when(F.col("error_text").isNull(), "success").otherwise("failed").alias("status"),
        F.lit(run_id).cast("string").alias("run_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00").alias(
            "finished_at_utc"
        ),
        "error_text",
    )
    kept = files.prune_missing(states, signatures, flow_name)
    warehouse.write(STATE_TABLE, upsert_file_state(kept, finished))
    return stale
