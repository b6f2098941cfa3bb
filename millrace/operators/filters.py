"""Typed column filters that compile to one boolean Spark expression.

Each filter is a small immutable description. ``expression(schema)`` returns a column, or
``None`` where the filter is inactive (an empty operand, no complete range, no values).
Literals are cast to the column's own type, so that comparisons reach the parquet scan.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, time
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sortkeys import quoted

BLANK = object()
"""Stands for NULL in a list of selected values."""

_TEXT_TESTS = {
    "equals": lambda text, wanted: text == wanted,
    "not_equals": lambda text, wanted: text != wanted,
    "begins_with": lambda text, wanted: text.startswith(wanted),
    "ends_with": lambda text, wanted: text.endswith(wanted),
    "contains": lambda text, wanted: text.contains(wanted),
    "not_contains": lambda text, wanted: ~text.contains(wanted),
}

MICROS = 1_000_000


def _any(parts: Iterable[Column | None]) -> Column | None:
    active = [part for part in parts if part is not None]
    return reduce(operator.or_, active) if active else None


def _all(parts: Iterable[Column | None]) -> Column | None:
    active = [part for part in parts if part is not None]
    return reduce(operator.and_, active) if active else None


@dataclass(frozen=True)
class ColumnFilter:
    """Base of all filters on one column."""

    column: str

    def _kind(self, schema: T.StructType | None) -> T.DataType | None:
        return None if schema is None else schema[self.column].dataType

    @property
    def _col(self) -> Column:
        return F.col(quoted(self.column))

    def expression(self, schema: T.StructType | None = None) -> Column | None:
        raise NotImplementedError


@dataclass(frozen=True)
class DistinctFilter(ColumnFilter):
    """The value is one of the selected ones; ``BLANK`` selects NULL."""

    values: tuple = ()

    def expression(self, schema=None):
        kind = self._kind(schema)
        wanted = [F.lit(value) for value in self.values if value is not BLANK]
        if kind is not None:
            wanted = [value.cast(kind) for value in wanted]
        return _any(
            [
                self._col.isin(wanted) if wanted else None,
                self._col.isNull() if len(wanted) < len(self.values) else None,
            ]
        )


@dataclass(frozen=True)
class TextFilter(ColumnFilter):
    """Literal, case-sensitive text conditions, all of which must hold.

    NULL counts as an empty text, so the negative conditions keep it.
    """

    conditions: tuple[tuple[str, str], ...] = ()

    def expression(self, schema=None):
        kind = self._kind(schema)
        text = self._col if isinstance(kind, T.StringType) else self._col.cast("string")
        parts = []
        for operation, wanted in self.conditions:
            if operation not in _TEXT_TESTS:
                raise ValueError(f"Unknown text condition {operation!r}.")
            if wanted == "":
                continue
            test = _TEXT_TESTS[operation]
            if operation.startswith("not_"):
                parts.append(test(F.coalesce(text, F.lit("")), F.lit(wanted)))
            else:
                # No non-empty operand matches an empty text, so NULL rows fail either way;
                # without the coalesce the condition is pushed down to the scan.
                parts.append(test(text, F.lit(wanted)) & text.isNotNull())
        return _all(parts)


@dataclass(frozen=True)
class DateFilter(ColumnFilter):
    """Inclusive date ranges (ISO text), any of which may hold; timestamps count by date."""

    ranges: tuple[tuple[str, str], ...] = ()

    def expression(self, schema=None):
        parts = []
        for start, end in self.ranges:
            if start == "" or end == "":
                continue
            low, high = sorted((date.fromisoformat(start), date.fromisoformat(end)))
            kind = self._kind(schema)
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                # Whole days as a half-open range of moments: the column stays bare, so the
                # range can skip row groups.
                after = F.date_add(F.lit(high), 1).cast(kind)
                parts.append((self._col >= F.lit(low).cast(kind)) & (self._col < after))
            else:
                parts.append(self._col.between(F.lit(low), F.lit(high)))
        return _any(parts)


@dataclass(frozen=True)
class TimeFilter(ColumnFilter):
    """Inclusive time-of-day ranges (ISO text), any of which may hold.

    The column is a timestamp, or microseconds since midnight.
    """

    ranges: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def _micros(text: str) -> int:
        moment = time.fromisoformat(text)
        seconds = moment.hour * 3600 + moment.minute * 60 + moment.second
        return seconds * MICROS + moment.microsecond

    def expression(self, schema=None):
        kind = self._kind(schema)
        column = self._col
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = micros_of_day(column)
        parts = []
        for start, end in self.ranges:
            if start == "" or end == "":
                continue
            low, high = sorted((self._micros(start), self._micros(end)))
            parts.append(column.between(low, high))
        return _any(parts)


@dataclass(frozen=True)
class NumberFilter(ColumnFilter):
    """Inclusive number ranges given as text, any of which may hold; bounds may be blank.

    A bound that is not a number of the column's type matches nothing.
    """

    ranges: tuple[tuple[str, str], ...] = ()

    def expression(self, schema=None):
        kind = self._kind(schema)
        column = self._col if kind is not None else self._col.try_cast("double")
        parts = []
        for low, high in self.ranges:
            low, high = self._ordered(str(low).strip(), str(high).strip())
            bounds = []
            if low:
                bounds.append(column >= F.lit(low).try_cast(kind or T.DoubleType()))
            if high:
                bounds.append(column <= F.lit(high).try_cast(kind or T.DoubleType()))
            parts.append(_all(bounds))
        return _any(parts)

    @staticmethod
    def _ordered(low: str, high: str) -> tuple[str, str]:
        try:
            return (high, low) if low and high and Decimal(low) > Decimal(high) else (low, high)
        except InvalidOperation:
            return low, high


@dataclass(frozen=True)
class BooleanFilter(ColumnFilter):
    """``true``, ``false`` or ``blank``."""

    value: str = ""

    def expression(self, schema=None):
        if self.value == "":
            return None
        known = self._col.isNotNull()
        choices = {"true": known & self._col, "false": known & ~self._col, "blank": ~known}
        if self.value not in choices:
            raise ValueError(f"Unknown boolean choice {self.value!r}.")
        return choices[self.value]


@dataclass(frozen=True)
class AllFilter(ColumnFilter):
    """Several filters on one column, all of which must hold."""

    filters: tuple[ColumnFilter, ...] = ()

    def expression(self, schema=None):
        for part in self.filters:
            if not isinstance(part, ColumnFilter):
                raise TypeError(f"Not a column filter: {part!r}")
        return _all(part.expression(schema) for part in self.filters)


def micros_of_day(moment: Column) -> Column:
    """Microseconds since midnight of a timestamp."""
    seconds = F.hour(moment) * 3600 + F.minute(moment) * 60
    # SECOND with its fraction is an exact decimal.
    exact = F.date_part(F.lit("SECOND"), moment) * F.lit(MICROS)
    return seconds.cast("bigint") * MICROS + exact.cast("bigint")


def filter_rows(df: DataFrame, *filters: ColumnFilter) -> DataFrame:
    """Keep the rows that pass every filter."""
    found = _all(part.expression(df.schema) for part in filters)
    return df if found is None else df.where(found)
