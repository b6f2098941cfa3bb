"""Sort specifications with explicit null placement, and comparable sort keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(quoted(value)) if isinstance(value, str) else value


def as_list(value) -> list:
    return [value] if isinstance(value, (str, Column)) else list(value)


def quoted(name: str) -> str:
    """A column name that may hold dots or spaces, as one reference."""
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class SortKey:
    """One sort column. Nulls come first in both directions unless asked otherwise."""

    column: Column
    descending: bool = False
    nulls_last: bool = False

    def expression(self) -> Column:
        if self.descending:
            return (
                self.column.desc_nulls_last() if self.nulls_last else self.column.desc_nulls_first()
            )
        return self.column.asc_nulls_last() if self.nulls_last else self.column.asc_nulls_first()

    def reversed(self) -> "SortKey":
        return replace(self, descending=not self.descending, nulls_last=not self.nulls_last)


def sort_keys(
    sort_by: ColumnLike | Sequence[ColumnLike],
    descending: bool | Sequence[bool] = False,
    nulls_last: bool = False,
) -> list[SortKey]:
    columns = [as_column(item) for item in as_list(sort_by)]
    if not columns:
        raise ValueError("At least one sort column is needed.")
    flags = [descending] * len(columns) if isinstance(descending, bool) else list(descending)
    if len(flags) != len(columns):
        raise ValueError("descending needs one flag per sort column.")
    return [SortKey(column, flag, nulls_last) for column, flag in zip(columns, flags)]


def _backwards(column: Column, kind: T.DataType) -> list[Column]:
    """Columns that sort ascending the way ``column`` sorts descending."""
    if isinstance(kind, T.DateType):
        return [F.bitwise_not(F.unix_date(column))]
    if isinstance(kind, T.TimestampType):
        return [F.bitwise_not(F.unix_micros(column))]
    if isinstance(kind, T.TimestampNTZType):
        # Only the order matters, so the session time zone used by the cast does too little
        # harm to notice: it is pinned to UTC, where the cast keeps the order.
        return [F.bitwise_not(F.unix_micros(column.cast("timestamp")))]
    if isinstance(kind, T.BooleanType):
        return [~column]
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return [F.bitwise_not(column.cast("bigint"))]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [F.when(F.isnan(column), 0).otherwise(1), -column]
    if isinstance(kind, T.DecimalType):
        return [-column]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        data = column.cast("binary")
        # Complemented hex digits reverse the byte order; the end mark sorts after every
        # digit, so a text sorts after the longer texts it is a prefix of.
        return [
            F.concat(F.translate(F.hex(data), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
        ]
    raise TypeError(f"Descending order on {kind.simpleString()} is not supported.")


def comparable_key(df: DataFrame, keys: Sequence[SortKey]) -> Column:
    """One struct whose ascending order is the order of ``keys``.

    It lets ``max_by`` and ``min_by`` find the last and first row of a group, which, other
    than a window, combine before the shuffle and need no task to hold a whole group.
    """
    parts: list[Column] = []
    for key in keys:
        kind = df.select(key.column).schema[0].dataType
        null_rank, value_rank = (1, 0) if key.nulls_last else (0, 1)
        parts.append(F.when(key.column.isNull(), null_rank).otherwise(value_rank))
        parts += _backwards(key.column, kind) if key.descending else [key.column]
    return F.struct(*[part.alias(f"k{i}") for i, part in enumerate(parts)])


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(field.dataType) for field in kind)
    return not isinstance(kind, (T.MapType, T.VariantType, T.NullType))


def tie_breaker(df: DataFrame) -> Column:
    """A hash of the whole row, the last sort column of a distributed sort.

    Range partitioning keeps equal sort keys together, so without it a sort on a column with
    a hot value sends all rows of that value to one task. Being a function of the row alone,
    it is the same when a lost task runs again.
    """
    columns = [F.col(quoted(f.name)) for f in df.schema if _hashable(f.dataType)]
    return F.xxhash64(*columns) if columns else F.lit(0).cast("bigint")
