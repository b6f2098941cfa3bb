"""Column projection, renaming, casting and name cleanup."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sortkeys import ColumnLike, as_column, quoted

# Blanks around these separators belong to the separator.
_SEPARATORS = r"[#_\-/\\]"


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select(*[F.col(quoted(name)) for name in columns])


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the columns that exist; the others are ignored."""
    return df.drop(*columns)


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename columns; a missing source column or a repeated result name is an error."""
    missing = [name for name in renames if name not in df.columns]
    if missing:
        raise ValueError(f"Columns to rename do not exist: {missing}")
    names = [renames.get(name, name) for name in df.columns]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"Renaming gives the same name twice: {repeated}")
    return df.toDF(*names)


def cast_columns(df: DataFrame, types: Mapping[str, str | T.DataType]) -> DataFrame:
    """Cast the listed columns to their types and every other column to string."""
    return df.select(
        *[F.col(quoted(c)).cast(types.get(c, "string")).alias(c) for c in df.columns]
    )


def normalize_column_name(name: object) -> str:
    """Lower-case a name, join words with ``_`` and close up separators."""
    closed = re.sub(rf"\s*({_SEPARATORS})\s*", r"\1", str(name).strip())
    return re.sub(r"\s+", "_", closed.strip()).lower()


def normalized_text(value: ColumnLike) -> Column:
    """The rule of ``normalize_column_name`` applied to data values."""
    stripped = F.regexp_replace(as_column(value).cast("string"), r"(?U)^\s+|\s+$", "")
    closed = F.regexp_replace(stripped, rf"(?U)\s*({_SEPARATORS})\s*", "$1")
    return F.lower(F.regexp_replace(closed, r"(?U)\s+", "_"))


def normalized_renames(columns: Iterable[object]) -> dict[str, str]:
    """Old to new name for the columns whose name changes."""
    pairs = {str(name): normalize_column_name(name) for name in columns}
    return {old: new for old, new in pairs.items() if old != new}


def normalize_column_names(df: DataFrame, columns: Iterable[object] | None = None) -> DataFrame:
    """Normalise all column names, or those listed and present."""
    chosen = df.columns if columns is None else [str(c) for c in columns]
    return rename_columns(df, normalized_renames(c for c in chosen if c in df.columns))


def non_null_counts(df: DataFrame) -> DataFrame:
    """One row with the number of non-null values of every column (NaN is a value)."""
    return df.agg(*[F.count(F.col(quoted(c))).alias(c) for c in df.columns])


def remove_null_columns(df: DataFrame) -> DataFrame:
    """Keep the columns with at least one value; without rows no column is kept."""
    if not df.columns:
        return df
    counts = non_null_counts(df).first().asDict()
    return select_columns(df, [c for c in df.columns if counts[c] > 0])


def combine_datetime(day: ColumnLike, time: ColumnLike, *, text: bool = False) -> Column:
    """A date and a time of day as one timestamp without time zone.

    The time is microseconds since midnight, or ``HH:mm:ss`` text with ``text=True``.
    """
    midnight = as_column(day).cast("date").cast("timestamp_ntz")
    if text:
        parts = F.split(as_column(time), ":")
        hours, minutes = F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")
        seconds = F.coalesce(F.get(parts, F.lit(2)), F.lit("0")).cast("decimal(8,6)")
        return midnight + F.make_dt_interval(F.lit(0), hours, minutes, seconds)
    micros = as_column(time)
    whole = F.floor(micros / 1_000_000)
    seconds = (whole % 60).cast("decimal(18,6)") + (
        (micros % 1_000_000).cast("decimal(18,6)") / F.lit(1_000_000).cast("decimal(18,0)")
    )
    return midnight + F.make_dt_interval(
        F.lit(0), F.lit(0), F.floor(whole / 60).cast("int"), seconds.cast("decimal(18,6)")
    )


def _names(values: Iterable[object], what: str) -> list[str]:
    names = [str(value).strip() for value in values]
    if not all(names):
        raise ValueError(f"A {what} must not be empty.")
    if len(set(names)) != len(names):
        raise ValueError(f"A {what} is listed twice: {names}")
    return names


def _pairs(values) -> list[tuple[object, object]]:
    return list(values.items()) if isinstance(values, Mapping) else list(values)


@dataclass(frozen=True)
class TableSchema:
    """A cleanup recipe whose parts are applied in whatever order the caller needs.

    ``df.transform(s.cast).transform(s.drop_unwanted).transform(s.rename_all)``
    """

    columns: Iterable[str] = ()
    dtypes: Mapping[str, str | T.DataType] | Iterable = ()
    rename: Mapping[str, str] | Iterable = ()
    drop: Iterable[str] = ()

    def __post_init__(self) -> None:
        types, renames = _pairs(self.dtypes), _pairs(self.rename)
        typed = _names((name for name, _ in types), "typed column")
        sources = _names((old for old, _ in renames), "renamed column")
        targets = [str(new).strip() for _, new in renames]
        if not all(targets):
            raise ValueError("A new column name must not be empty.")
        object.__setattr__(self, "columns", tuple(_names(self.columns, "column")))
        object.__setattr__(self, "dtypes", dict(zip(typed, (kind for _, kind in types))))
        object.__setattr__(self, "rename", dict(zip(sources, targets)))
        object.__setattr__(self, "drop", tuple(_names(self.drop, "dropped column")))

    def select(self, df: DataFrame) -> DataFrame:
        return select_columns(df, self.columns)

    def cast(self, df: DataFrame) -> DataFrame:
        return cast_columns(df, self.dtypes)

    def rename_all(self, df: DataFrame) -> DataFrame:
        return rename_columns(df, self.rename)

    def drop_unwanted(self, df: DataFrame) -> DataFrame:
        return drop_columns(df, self.drop)

    def normalize_selected(self, df: DataFrame) -> DataFrame:
        """Normalise the names of the selected columns only."""
        return normalize_column_names(df, self.columns)

    def normalize(self, df: DataFrame) -> DataFrame:
        return normalize_column_names(df)
