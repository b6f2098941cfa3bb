"""Operators over ordered groups: propagate a value, count visits, running totals.

A plain window sends a whole group to one task, which fails once a single group holds a
large share of the rows. Two ways around it are used here:

* first and last values are found by aggregation (``max_by`` over a comparable sort key),
  which combines before the shuffle, and are joined back to the rows;
* for running values the rows are stored once and range-partitioned by group and order, so a
  hot group is spread over many chunks. Chunks are scanned on their own, all columns in one
  exchange. Only a chunk's first group can have begun in the chunks before it, so what is handed
  on is one row a chunk. The number of chunks follows from the stored bytes; rows that fit one
  chunk hand nothing on, and their groups are dealt as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.sortkeys import (
    ColumnLike,
    SortKey,
    as_column,
    as_list,
    comparable_key,
    quoted,
    sort_keys,
    tie_breaker,
)
from millrace.operators.joins import null_safe_join
from millrace.session import materialise, remove, stored_bytes


def _named_groups(df: DataFrame, by) -> tuple[DataFrame, list[str], list[str]]:
    """Group columns by name; expressions become helper columns that are dropped later."""
    names, added = [], []
    for i, item in enumerate(as_list(by)):
        if isinstance(item, str):
            names.append(item)
        else:
            name = f"__by_{i}"
            df = df.withColumn(name, item)
            names.append(name)
            added.append(name)
    if not names:
        raise ValueError("At least one group column is needed.")
    return df, names, added


@dataclass(frozen=True)
class Pick:
    """Which row of an ordered group a value is taken from.

    ``where`` limits the candidate rows; NULL values are no candidates unless
    ``ignore_nulls`` is off.
    """

    value: ColumnLike
    sort_by: ColumnLike | Sequence[ColumnLike]
    where: Column | None = None
    descending: bool | Sequence[bool] = False
    nulls_last: bool = False
    ignore_nulls: bool = True
    first: bool = False

    def aggregate(self, df: DataFrame) -> Column:
        value = as_column(self.value)
        keys = sort_keys(self.sort_by, self.descending, self.nulls_last)
        candidate = F.lit(True) if self.where is None else self.where
        if self.ignore_nulls:
            candidate = candidate & value.isNotNull()
        order = F.when(candidate, comparable_key(df, keys))
        # The struct keeps a null value that is the picked row's own apart from "no row".
        return (F.min_by if self.first else F.max_by)(F.struct(value.alias("value")), order)


def propagate(df: DataFrame, picks: Mapping[str, Pick], *, by) -> DataFrame:
    """Put one picked value per column on all rows of its group.

    All columns share one aggregation and one join. A group without a candidate gets NULL.
    """
    framed, groups, added = _named_groups(df, by)
    picked = framed.groupBy(*[F.col(quoted(g)) for g in groups]).agg(
        *[pick.aggregate(df).alias(f"__pick_{i}") for i, pick in enumerate(picks.values())]
    )
    joined = null_safe_join(framed, picked, groups, "left")
    values = {name: F.col(f"__pick_{i}.value") for i, name in enumerate(picks)}
    return joined.withColumns(values).drop(*[f"__pick_{i}" for i in range(len(picks))], *added)


def propagate_last_value(
    df: DataFrame, name: str, value: ColumnLike, *, by, sort_by, **options
) -> DataFrame:
    """Put the last ``value`` of each ordered group on all rows of the group.

    The options are those of ``Pick``.
    """
    return propagate(df, {name: Pick(value, sort_by, **options)}, by=by)


def propagate_first_value(
    df: DataFrame, name: str, value: ColumnLike, *, by, sort_by, **options
) -> DataFrame:
    """Put the first ``value`` of each ordered group on all rows of the group."""
    return propagate(df, {name: Pick(value, sort_by, first=True, **options)}, by=by)


_COMBINE = {
    "sum": (F.sum, lambda mine, carried: mine + F.coalesce(carried, F.lit(0))),
    "min": (F.min, lambda mine, carried: F.least(mine, carried)),
    "max": (F.max, lambda mine, carried: F.greatest(mine, carried)),
}

#: Stored bytes of a chunk, and of a table of carries that is broadcast at most.
CHUNK_BYTES = 64 << 20
BROADCAST_BYTES = 4 << 20
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


class OrderedGroups:
    """Rows in ordered groups, ready for running values.

    Add columns with ``with_previous`` and ``with_running`` and read the result with
    ``rows``. The caller's columns are left alone.

    ``df`` is dealt by ``__chunk``, and ``__first`` and ``__last`` tell whether a row is of its
    chunk's first and last group.
    """

    def __init__(
        self,
        df: DataFrame,
        by,
        keys: Sequence[SortKey],
        chunks: int | None = None,
    ) -> None:
        df, self.by, self._added = _named_groups(df, by)
        # Sort columns are stored under their own names, so that every step can use them
        # after the rows were written and read back.
        order = {f"__order_{i}": key.column for i, key in enumerate(keys)}
        df = df.withColumns(order)
        self._added += list(order)
        self.keys = [
            SortKey(F.col(name), key.descending, key.nulls_last)
            for name, key in zip(order, keys)
        ]
        # Rows of equal order take theirs from a hash of the row, so that all columns, and any
        # rerun, see one order.
        df = df.withColumn("__tie", tie_breaker(df))
        self.keys.append(SortKey(F.col("__tie")))
        self._added += ["__tie", "__chunk", "__first", "__last"]
        self.group = F.struct(*self._columns(self.by))
        stored, count = self._split(df, chunks)
        self.one_chunk = count == 1
        self.order = comparable_key(df, [*(SortKey(c) for c in self._columns(self.by)), *self.keys])
        # The one exchange of the rows: windows and joins by chunk need no other, and the sort is
        # that of the groups.
        inside = Window.partitionBy("__chunk").orderBy(
            *[c.asc_nulls_first() for c in self._columns(self.by)], *[key.expression() for key in self.keys]
        )
        whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        flags = {
            "__first": self.group.eqNullSafe(F.first(self.group).over(whole)),
            "__last": self.group.eqNullSafe(F.last(self.group).over(whole)),
        }
        if self.one_chunk:
            self.df = stored.withColumns(dict.fromkeys(flags, F.lit(True)))
        else:
            self.df = stored.repartition(count, "__chunk").withColumns(flags)

    def _split(self, df: DataFrame, chunks: int | None) -> tuple[DataFrame, int]:
        spark = df.sparkSession
        # Stored before it is sampled: the input is evaluated once.
        rows = materialise(df, "ordered-rows")
        size = stored_bytes(rows)
        if chunks is None and size <= CHUNK_BYTES:
            return rows.withColumn("__chunk", F.lit(0)), 1
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        count = max(2, chunks or max(least, -(-size // CHUNK_BYTES)))
        ranged = rows.repartitionByRange(
            count,
            *[column.asc_nulls_first() for column in self._columns(self.by)],
            *[key.expression() for key in self.keys],
        )
        # Range bounds come from a sample; the stored copy makes the chunks final.
        kept = materialise(ranged.withColumn("__chunk", F.spark_partition_id()), "ordered-chunks")
        remove(rows)
        return kept, count

    @staticmethod
    def _columns(names: Sequence[str]) -> list[Column]:
        return [F.col(quoted(name)) for name in names]

    def window(self, extra: Sequence[str] = (), backwards: bool = False):
        """A group's rows within one chunk."""
        keys = [key.reversed() if backwards else key for key in self.keys]
        return Window.partitionBy("__chunk", *self._columns([*self.by, *extra])).orderBy(
            *[key.expression() for key in keys]
        )

    def per_chunk(self, **totals: Column) -> DataFrame:
        """One row a chunk, all in one task: its ``first`` and ``last`` group and some totals."""
        of = lambda flag: F.min(F.when(F.col(flag), self.group))
        ends = {"first": of("__first"), "last": of("__last"), **totals}
        return self.df.groupBy("__chunk").agg(*[c.alias(n) for n, c in ends.items()]).coalesce(1)

    @staticmethod
    def handed_on(value: Column, backwards: bool = False) -> Column:
        """A column of ``per_chunk`` rows: ``value`` of the chunk before, if its last group goes on.

        With ``backwards``, of the chunk after, if it goes on with this one's last group.
        """
        mine, theirs = ("last", "first") if backwards else ("first", "last")
        chunks = Window.orderBy(F.col("__chunk").desc() if backwards else F.col("__chunk").asc())
        continues = F.col(mine).eqNullSafe(F.lag(theirs).over(chunks)) & (F.row_number().over(chunks) > 1)
        return F.when(continues, F.lag(value).over(chunks))

    @staticmethod
    def so_far(backwards: bool = False):
        """The chunks up to one that end (or begin) with the same group."""
        order = F.col("__chunk").desc() if backwards else F.col("__chunk").asc()
        return Window.partitionBy("first" if backwards else "last").orderBy(order).rowsBetween(*_SO_FAR)

    def _with_carry(self, per_chunk: DataFrame, value: Column, backwards: bool = False) -> None:
        """Put what ``value`` hands on in ``__carry``, on the rows it is for."""
        carry = per_chunk.withColumn("__value_so_far", value).select(
            "__chunk", self.handed_on(F.col("__value_so_far"), backwards).alias("__carry")
        )
        mine = F.col("__last" if backwards else "__first")
        self.df = self.df.join(carry, "__chunk", "left").withColumn("__carry", F.when(mine, F.col("__carry")))

    def with_previous(self, name: str, value: Column) -> "OrderedGroups":
        """The previous row's ``value`` as a struct; NULL on the first row of a group."""
        boxed = F.struct(value.alias("value"))
        if self.one_chunk:
            return self.with_column(name, F.lag(boxed).over(self.window()))
        ends = self.per_chunk(total=F.max_by(boxed, self.order))
        local = F.lag(boxed).over(self.window())
        self._with_carry(ends, F.col("total"))
        self.df = self.df.withColumn(name, F.coalesce(local, F.col("__carry"))).drop("__carry")
        return self

    def with_running(
        self,
        name: str,
        value: Column,
        how: str = "sum",
        *,
        within: Sequence[str] = (),
        backwards: bool = False,
        exclusive: bool = False,
    ) -> "OrderedGroups":
        """A running sum, min or max, optionally within finer groups or from the end."""
        function, combine = _COMBINE[how]
        rows = Window.unboundedPreceding, (-1 if exclusive else Window.currentRow)
        local = function(value).over(self.window(within, backwards).rowsBetween(*rows))
        if self.one_chunk:
            return self.with_column(name, local)
        if within:
            self._carried_within(function, value, within, backwards)
        else:
            edge = F.col("__first" if backwards else "__last")
            totals = self.per_chunk(total=function(F.when(edge, value)))
            self._with_carry(totals, function("total").over(self.so_far(backwards)), backwards)
        carried = F.col("__carry")
        # A chunk whose own rows gave nothing so far still has what came before it.
        merged = F.when(local.isNull(), carried).otherwise(combine(local, carried))
        self.df = self.df.withColumn(name, merged).drop("__carry")
        return self

    def _carried_within(self, function, value: Column, within: Sequence[str], backwards: bool) -> None:
        """Finer groups hand on a row for each of their values, but only those of edge groups."""
        groups = [*self.by, *within]
        edge = self.df.filter("__first OR __last")
        totals = edge.groupBy(*self._columns([*groups, "__chunk"])).agg(function(value).alias("__total"))
        direction = F.col("__chunk").desc() if backwards else F.col("__chunk").asc()
        across = (
            Window.partitionBy(*self._columns(groups))
            .orderBy(direction)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = totals.withColumn("__carry", function("__total").over(across)).drop("__total")
        carry = materialise(carry.filter("__carry IS NOT NULL"), "ordered-carry")
        # As a rule a few values of one group a chunk; beyond that the rows are shuffled again.
        if stored_bytes(carry) <= BROADCAST_BYTES:
            carry = F.broadcast(carry)
        self.df = null_safe_join(self.df, carry, [*groups, "__chunk"], "left")

    def with_column(self, name: str, value: Column) -> "OrderedGroups":
        self.df = self.df.withColumn(name, value)
        return self

    def rows(self, *helpers: str) -> DataFrame:
        """The rows with the added columns, without helper columns."""
        return self.df.drop(*helpers, *self._added)


def visit_counter(
    df: DataFrame,
    name: str,
    value: ColumnLike,
    *,
    by,
    sort_by,
    descending=False,
    nulls_last: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """Number the contiguous runs of each value inside each ordered group.

    Values ``w1 w1 w2 w1`` give ``1 1 1 2``. NULL is a value of its own.
    """
    keys = sort_keys(sort_by, descending, nulls_last)
    groups = OrderedGroups(
        df.withColumn("__value", as_column(value)), by, keys, chunks
    )
    current = F.col("__value")
    groups.with_previous("__previous", current)
    same = F.col("__previous").isNotNull() & current.eqNullSafe(F.col("__previous.value"))
    groups.with_column("__starts", F.when(same, 0).otherwise(1).cast("bigint"))
    groups.with_running(name, F.col("__starts"), within=["__value"])
    return groups.rows("__value", "__previous", "__starts")


def running_total(
    df: DataFrame,
    name: str,
    value: ColumnLike,
    *,
    by,
    sort_by,
    descending=False,
    nulls_last: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` in each ordered group.

    A NULL value adds nothing and its own row shows NULL, as a cumulative sum does.
    """
    keys = sort_keys(sort_by, descending, nulls_last)
    groups = OrderedGroups(
        df.withColumn("__value", as_column(value)), by, keys, chunks
    )
    groups.with_running("__total_so_far", F.col("__value"))
    groups.with_column(
        name, F.when(F.col("__value").isNotNull(), F.col("__total_so_far"))
    )
    return groups.rows("__value", "__total_so_far")
