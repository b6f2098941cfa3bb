"""Source files: listing, reading, provenance, and what changed since the last run.

A manifest is a DataFrame with one row per file: ``path``, ``relative_path``, ``name``,
``suffix``, ``modified_at`` and ``size_bytes``. It comes from Spark's file listing without
opening a file. Spark itself skips files whose names begin with ``_`` or ``.``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.paths import (
    file_name,
    file_suffix,
    is_temporary_file,
    normalised_extensions,
    source_key,
)
from millrace.functions.sortkeys import sort_keys
from millrace.operators.joins import null_safe_join
from millrace.operators.ordered import OrderedGroups
from millrace.operators.unions import common_type
from millrace.session import local_frame
from millrace.sources.tables import Folder

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("suffix", T.StringType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("size_bytes", T.LongType()),
    ]
)


def _any_case(extension: str) -> str:
    """A file name pattern for an extension in any case."""
    letters = [f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension.lstrip(".")]
    return "*." + "".join(letters)


def _top_level(spark: SparkSession, root: str) -> DataFrame:
    """The files of one folder, without what is below it."""
    found = Folder(spark, root).listed(root)
    return local_frame(
        spark,
        {
            "path": pa.array([path for path, _, _ in found], pa.string()),
            "millis": pa.array([millis for _, millis, _ in found], pa.int64()),
            "size_bytes": pa.array([size for _, _, size in found], pa.int64()),
        },
    ).select("path", F.timestamp_millis("millis").alias("modified_at"), "size_bytes")


def _listing(
    spark: SparkSession, root: str, recursive: bool = True, extensions: Sequence[str] = ()
) -> DataFrame:
    if recursive:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if extensions:
            reader = reader.option(
                "pathGlobFilter", "{" + ",".join(map(_any_case, extensions)) + "}"
            )
        # The content column is not selected, so no file is read.
        files = reader.load(root).select(
            "path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes")
        )
    else:
        files = _top_level(spark, root)
    # Roots and listed paths differ in their scheme prefix (file:/x, file:///x, /x).
    plain = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    inside = plain.startswith(F.concat(base, F.lit("/")))
    below = F.when(inside, F.substring(plain, F.length(base) + 2, F.length(plain)))
    # A root that is one file: its own name.
    relative = F.coalesce(below, file_name(plain))
    return files.select(
        "path",
        relative.alias("relative_path"),
        file_name(F.col("path")).alias("name"),
        file_suffix(F.col("path")).alias("suffix"),
        "modified_at",
        "size_bytes",
    )


def collect_files(
    spark: SparkSession, extensions, *, root: str, recursive: bool = False
) -> DataFrame:
    """Manifest of the files with one of the extensions; a missing root gives no rows."""
    allowed = normalised_extensions(extensions)
    if not Folder(spark, root).exists(root):
        return spark.createDataFrame([], MANIFEST)
    files = _listing(spark, root, recursive, allowed).where(F.lower("suffix").isin(list(allowed)))
    return files.orderBy("path")


def candidate_files(
    spark: SparkSession,
    root: str,
    *,
    extensions=None,
    recursive: bool = True,
    allow_missing: bool = False,
) -> DataFrame:
    """Manifest of the files to watch, without lock, temporary and partial files."""
    if not Folder(spark, root).exists(root):
        if allow_missing:
            return spark.createDataFrame([], MANIFEST)
        raise ValueError(f"Input root not found: {root}")
    allowed = () if extensions is None else normalised_extensions(extensions)
    files = _listing(spark, root, recursive, allowed).where(~is_temporary_file(F.col("path")))
    if extensions is not None:
        files = files.where(F.lower("suffix").isin(list(allowed)))
    return files.orderBy(F.lower("path"), "path")


def with_source(df: DataFrame) -> DataFrame:
    """Add name, size and modification time of the file every row came from."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_name"),
        F.col("_metadata.file_size").alias("source_size_bytes"),
        F.col("_metadata.file_modification_time").alias("source_modified_at"),
    )


def source_metadata(df: DataFrame) -> DataFrame:
    """One row per source file behind ``df``: name, size, modification time."""
    return df.select(
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    ).distinct()


def scan_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet file, or every parquet file below a folder."""
    reader = spark.read.option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet"
    )
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def read_many(
    spark: SparkSession, paths: Sequence[str] | str, *, format: str = "parquet", **options
) -> DataFrame:
    """Read many files of one format in one job, stacked by column name."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("There are no files to read.")
    reader = spark.read.format(format).options(**options)
    if format in ("parquet", "orc"):
        reader = reader.option("mergeSchema", "true")
    return reader.load(paths)


def read_sheets(frames: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> DataFrame:
    """Stack several tabular sources, the first one or those named, with common types.

    A column a source does not have is NULL there; ``sheet`` tells where a row came from.
    """
    chosen = list(frames)[:1] if names is None else list(names)
    missing = [name for name in chosen if name not in frames]
    if missing or not chosen:
        raise ValueError(f"Sources do not exist: {missing or chosen}")
    columns: dict[str, list[T.DataType]] = {}
    for name in chosen:
        for field in frames[name].schema:
            columns.setdefault(field.name, []).append(field.dataType)
    types = {column: common_type(kinds) for column, kinds in columns.items()}
    result = None
    for name in chosen:
        frame = frames[name]
        part = frame.select(
            F.lit(name).alias("sheet"),
            *[frame[column].cast(types[column]).alias(column) for column in frame.columns],
        )
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result


def with_source_key(manifest: DataFrame) -> DataFrame:
    """Add the stable file key used for slice replacement."""
    return manifest.withColumn("source_key", source_key(F.col("relative_path")))


# -- change detection --------------------------------------------------------------------


def stale_sources(signatures: DataFrame, ledger: DataFrame, flow_name: str) -> DataFrame:
    """Files that are new, or whose modification time or size differs from the ledger.

    ``signatures`` has ``source_path``, ``mtime_ns`` and ``size_bytes``. The status of the
    last run plays no part: an unchanged file that failed is not tried again.
    """
    seen = ledger.where(F.col("flow_name") == flow_name).select(
        "source_path", "mtime_ns", "size_bytes"
    )
    return signatures.join(seen, ["source_path", "mtime_ns", "size_bytes"], "left_anti")


def stale_batch(signatures: DataFrame, ledger: DataFrame, flow_name: str) -> DataFrame:
    """The signatures one batch run has to carry, in path order; no rows means no run."""
    return stale_sources(signatures, ledger, flow_name).orderBy("source_path")


def prune_missing(ledger: DataFrame, signatures: DataFrame, flow_name: str) -> DataFrame:
    """The ledger without this flow's rows for files that are gone."""
    return ledger.join(
        missing_paths(ledger, signatures, flow_name), ["flow_name", "source_path"], "left_anti"
    )


def missing_paths(ledger: DataFrame, signatures: DataFrame, flow_name: str) -> DataFrame:
    """Ledger paths of this flow that the listing no longer has."""
    return (
        ledger.where(F.col("flow_name") == flow_name)
        .select("flow_name", "source_path")
        .join(signatures.select("source_path"), "source_path", "left_anti")
        .select("flow_name", "source_path")
    )


def settled_files(
    snapshots: DataFrame, settle: int = 1, *, chunks: int | None = None
) -> DataFrame:
    """When each changed file had been unchanged for ``settle`` polls in a row.

    ``snapshots`` has one row per file and poll: ``path``, ``poll_no`` (0 is the start),
    ``mtime_ns``, ``size_bytes``. A file that leaves the listing is forgotten. Files present
    at the start are known already, and a signature that was the last one reported is not
    reported again.
    """
    if settle < 0:
        raise ValueError("settle must not be negative.")
    poll = F.col("poll_no")
    signature = F.struct("mtime_ns", "size_bytes")
    # A run is a stretch of polls in which the file was there with one signature; a visit is
    # a stretch in which it was there at all.
    polls = OrderedGroups(snapshots, "path", sort_keys("poll_no"), chunks)
    polls.with_previous("__before", F.struct(poll.alias("poll"), signature.alias("signature")))
    before = F.col("__before.value")
    gap = F.col("__before").isNull() | (before["poll"] != poll - 1)
    changed = gap | ~before["signature"].eqNullSafe(signature)
    polls.with_column("__gap", gap.cast("bigint")).with_column("__new", changed.cast("bigint"))
    polls.with_running("__visit", F.col("__gap")).with_running("__run", F.col("__new"))
    runs = (
        polls.rows("__before", "__gap", "__new")
        .groupBy("path", "__visit", "__run", "mtime_ns", "size_bytes")
        .agg(F.min("poll_no").alias("first_poll"), F.count(F.lit(1)).alias("polls"))
    )
    at_start = F.col("first_poll") == 0
    runs = runs.where(at_start | (F.col("polls") > settle))
    settled = OrderedGroups(runs, ["path", "__visit"], sort_keys("__run"), chunks)
    settled.with_previous("__last", signature)
    news = ~at_start & ~(
        F.col("__last").isNotNull() & F.col("__last.value").eqNullSafe(signature)
    )
    return (
        settled.rows()
        .where(news)
        .select("path", (F.col("first_poll") + settle).alias("poll_no"), "mtime_ns", "size_bytes")
    )


def start_watch(listing: DataFrame) -> DataFrame:
    """The state before the first poll: what is there counts as known.

    ``listing`` has ``path``, ``mtime_ns`` and ``size_bytes``.
    """
    return listing.select(
        "path", "mtime_ns", "size_bytes",
        F.lit(0).cast("bigint").alias("stable_polls"),
        F.col("mtime_ns").alias("told_mtime_ns"),
        F.col("size_bytes").alias("told_size_bytes"),
        F.lit(False).alias("settled"),
    )


def watch_step(state: DataFrame, listing: DataFrame, settle: int = 1) -> DataFrame:
    """One poll: the next state, in which ``settled`` marks the files to process now.

    The same rule as ``settled_files``, carried from poll to poll instead of read from their
    history. Store the result before the next poll.
    """
    if settle < 0:
        raise ValueError("settle must not be negative.")
    before = state.select(
        "path", "stable_polls", "told_mtime_ns", "told_size_bytes",
        F.struct("mtime_ns", "size_bytes").alias("__before"),
    )
    signature = F.struct("mtime_ns", "size_bytes")
    told = F.struct(
        F.col("told_mtime_ns").alias("mtime_ns"), F.col("told_size_bytes").alias("size_bytes")
    )
    calm = F.when(F.col("__before").eqNullSafe(signature), F.col("stable_polls") + 1).otherwise(0)
    joined = listing.select("path", "mtime_ns", "size_bytes").join(before, "path", "left")
    counted = joined.withColumn("stable_polls", calm.cast("bigint")).withColumn(
        "settled", (F.col("stable_polls") >= settle) & ~told.eqNullSafe(signature)
    )
    return counted.select(
        "path", "mtime_ns", "size_bytes", "stable_polls",
        *[
            F.when(F.col("settled"), F.col(name)).otherwise(F.col(f"told_{name}")).alias(f"told_{name}")
            for name in ("mtime_ns", "size_bytes")
        ],
        "settled",
    )


def dedupe_queue(jobs: DataFrame) -> DataFrame:
    """At most one queued job per flow and source, with its batch signatures merged.

    ``jobs`` has ``position``, ``flow_name``, ``source_path`` (NULL for a batch run) and the
    signature columns ``batch_path``, ``mtime_ns``, ``size_bytes`` (NULL for a job without).
    A job keeps its first place in the queue; the newest signature of each path wins.
    """
    key = ["flow_name", "source_path"]
    signature = F.struct("mtime_ns", "size_bytes")
    latest = jobs.groupBy(*key, "batch_path").agg(
        F.min("position").alias("first_position"),
        F.max_by(signature, "position").alias("newest"),
    )
    # A job asked for without signatures adds none to those asked for with some.
    per_job = latest.groupBy(*key).agg(
        F.min("first_position").alias("position"), F.count("batch_path").alias("signatures")
    )
    merged = latest.where(F.col("batch_path").isNotNull())
    return null_safe_join(per_job, merged.drop("first_position"), key, "left").select(
        "position",
        *key,
        "signatures",
        "batch_path",
        F.col("newest.mtime_ns").alias("mtime_ns"),
        F.col("newest.size_bytes").alias("size_bytes"),
    )
