"""Dense numbering in sort order without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.sortkeys import SortKey
from millrace.session import materialise

# monotonically_increasing_id keeps the row number of a partition in its low 33 bits.
_ROW_BITS = 33


def surrogate_numbering(
    df: DataFrame, name: str, keys: Sequence[SortKey], start_after: int = 0
) -> DataFrame:
    """Add ``start_after + 1, + 2, ...`` in the order of ``keys``.

    Rows are range-partitioned and sorted inside their partition, so a row's number is its
    position there plus the sizes of the partitions before it. Only those sizes, one per
    partition, meet in a single task. Equal keys share a partition: where many rows may be
    equal, ``keys`` ends with a tie breaker.
    """
    order = [key.expression() for key in keys]
    placed = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__place", _ROW_BITS)),
        "numbering",
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    )
    position = F.col("__place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per partition of the sort: bounded by the number of shuffle partitions.
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.lit(start_after).cast("bigint") + F.col("__offset") + position + 1)
        .drop("__part", "__place", "__offset")
    )
