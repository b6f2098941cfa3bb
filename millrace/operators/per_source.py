"""Author functions per source file, without one task or call per whole source.

A source may be far larger than a task's memory, so a function never gets a whole source
at once: it sees record batches, each with rows of one source. What has to look at all rows
of a source is written as a grouped aggregation instead (``run_sources``). Items that do fit a task,
such as files that a function opens by itself, are mapped whole and in order (``map_items``).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.sortkeys import ColumnLike, SortKey, as_column, quoted, sort_keys
from millrace.operators.numbering import surrogate_numbering


def map_batch(
    df: DataFrame,
    function: Callable[[str, pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    *,
    key: str = "source_key",
) -> DataFrame:
    """Call ``function(source, rows)`` on record batches, each with rows of one source.

    No shuffle takes place: rows are mapped where they are read. Empty input is an error.
    """
    if key not in df.columns:
        raise ValueError(f"There is no column {key!r}.")
    if df.isEmpty():
        raise ValueError("There is nothing to map.")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, rows in frame.groupby(key, sort=False, dropna=False):
                yield function(source, rows)

    return df.mapInPandas(batches, schema)


def map_items(
    items: DataFrame,
    function: Callable[..., dict],
    schema: str | T.StructType,
    *,
    order_by: ColumnLike | Sequence[ColumnLike] | None = None,
    descending: bool | Sequence[bool] = False,
    size: ColumnLike | None = None,
    context: object = None,
    position: str = "position",
    partitions: int | None = None,
) -> DataFrame:
    """Call ``function(item)``, or ``function(context, item)``, once for every row of ``items``.

    An item is a row as a dict, of a manifest as a rule: the function reads the whole file and
    returns one result, a dict. Results carry the item's ``position`` from 0, in the order of
    ``order_by`` (of all columns if there is none), equal items in any order. ``size`` says how
    much work an item is: items are packed into tasks from the largest one on, a round of tasks
    forth and the next one back, so a large item does not wait behind others of its kind.
    ``context`` is sent to the tasks as it is.
    """
    count = len(inspect.signature(function).parameters)
    if count not in (1, 2):
        raise ValueError("The function takes (item) or (context, item).")
    names = items.columns
    if position in names:
        raise ValueError(f"Column {position!r} exists already.")
    keys = sort_keys(order_by if order_by is not None else [F.col(quoted(n)) for n in names], descending)
    tie = SortKey(F.xxhash64(*[F.col(quoted(n)) for n in names]))
    placed = surrogate_numbering(items, position, [*keys, tie], start_after=-1)
    if placed.isEmpty():
        raise ValueError("There is nothing to map.")
    tasks = partitions or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = F.col(position)
    if size is not None:
        largest_first = [SortKey(as_column(size), descending=True, nulls_last=True), SortKey(F.col(position))]
        placed = surrogate_numbering(placed, "__rank", largest_first, start_after=-1)
        rank = F.col("__rank")
    turn = rank % (2 * tasks)
    packed = placed.withColumn("__task", F.least(turn, 2 * tasks - 1 - turn).cast("int"))
    packed = packed.repartitionById(tasks, "__task").select(*[F.col(quoted(n)) for n in [*names, position]])
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    result = T.StructType([T.StructField(position, T.LongType()), *fields])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                place = row.pop(position)
                found = function(row) if count == 1 else function(context, row)
                # One result at a time: the next item may be large.
                yield pa.RecordBatch.from_pylist([{**found, position: place}], to_arrow_schema(result))

    return packed.mapInArrow(batches, result)


def run_sources(
    df: DataFrame, aggregates: list, *, run_as: str = "individual", key: str = "source_key"
) -> DataFrame:
    """The same aggregation for each source file, or once over all of them.

    ``individual`` gives a result row per source and ``batch`` one row. Both combine before
    the shuffle, so a source that holds most rows is no burden for one task.
    """
    if run_as == "batch":
        return df.agg(*aggregates)
    if run_as != "individual":
        raise ValueError("run_as is 'individual' or 'batch'.")
    return df.groupBy(quoted(key)).agg(*aggregates)
