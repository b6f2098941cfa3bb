"""Looking into large datasets: sort, top-k, previews, distinct values, row counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from millrace.functions.sortkeys import SortKey, quoted, tie_breaker
from millrace.operators.filters import ColumnFilter, filter_rows
from millrace.operators.numbering import surrogate_numbering
from millrace.session import materialise

SortColumns = Sequence[tuple[str, bool]]

# Up to this many rows a limit may meet in one task. The order, ties included, is the same on
# both sides of it: it decides where rows are chosen, not which.
TOP_K_IN_ONE_TASK = 10_000


def _keys(columns: SortColumns) -> list[SortKey]:
    return [SortKey(F.col(quoted(name)), descending) for name, descending in columns]


def multi_sort(df: DataFrame, columns: SortColumns) -> DataFrame:
    """Sort by (column, descending) pairs; NULLs come first in both directions."""
    if not columns:
        return df
    return df.orderBy(*[key.expression() for key in _keys(columns)], tie_breaker(df))


def top_k(df: DataFrame, columns: SortColumns, k: int, *, keys_first: bool = False) -> DataFrame:
    """The first ``k`` rows in the order of ``multi_sort``.

    Ties go by a hash of the row, so the first rows of a larger ``k`` are those of a smaller
    one. For a small ``k`` each task keeps its own best rows and one task merges them. A large
    ``k`` would bring most of the dataset to that task, so the place of the last row is looked
    up in a distributed sort of the keys alone, when this is called, and the rows up to it are
    read and sorted.

    ``keys_first`` is for datasets of many or wide columns in files. The sort column of the
    last row is found in a scan of the sort columns; the scan of all columns gets it as a filter
    and skips the parts of files that hold no such row. The input is read twice then, which
    does not pay where it is computed rather than read.
    """
    if not columns:
        return head(df, k)
    keys = [*_keys(columns), SortKey(tie_breaker(df))]
    if k > TOP_K_IN_ONE_TASK:
        return _many_first(df, columns, k)
    if keys_first and len(df.columns) > len({name for name, _ in columns}):
        df = df.where(_up_to_last(df, columns, k))
    return df.orderBy(*[key.expression() for key in keys]).limit(k)


def _up_to_last(df: DataFrame, columns: SortColumns, k: int) -> Column:
    """Whether a row's first sort column is not beyond that of the row in place ``k``."""
    keys = _keys(columns)
    names = list(dict.fromkeys(name for name, _ in columns))
    best = df.select(*[F.col(quoted(n)) for n in names]).orderBy(*[key.expression() for key in keys]).limit(k)
    last = best.orderBy(*[key.reversed().expression() for key in keys]).limit(1)
    name, descending = columns[0]
    limit, column = last.select(F.col(quoted(name))).scalar(), F.col(quoted(name))
    # Nulls come first; where the last row has one, the comparison lets no value through.
    return column.isNull() | (column >= limit if descending else column <= limit)


def _before(key: SortKey, value: Column) -> Column:
    """Whether a key sorts before ``value``, nulls first."""
    inside = key.column > value if key.descending else key.column < value
    return F.coalesce(inside, key.column.isNull() & value.isNotNull())


def _many_first(df: DataFrame, columns: SortColumns, k: int) -> DataFrame:
    """``top_k`` for more rows than one task should hold."""
    # The keys of the row in place k, from keys and hashes only.
    names = [f"k{i}" for i in range(len(columns) + 1)]
    sources = [*_keys(columns), SortKey(tie_breaker(df))]
    narrow = df.select(*[key.column.alias(name) for name, key in zip(names, sources)])
    placed = surrogate_numbering(narrow, "place", [SortKey(F.col(n), key.descending) for n, key in zip(names, sources)])
    last: Row | None = placed.where(F.col("place") == k).first()
    if last is None:
        return multi_sort(df, columns)
    values = [F.lit(last[n]).cast(narrow.schema[n].dataType) for n in names]
    # Rows that agree in keys and hash are copies of one another; some may be beyond the limit.
    copies = placed.where(reduce(Column.__and__, [F.col(n).eqNullSafe(v) for n, v in zip(names, values)]))
    first, end = copies.agg(F.min("place"), F.max("place")).first()
    alike = [key.column.eqNullSafe(value) for key, value in zip(sources, values)]
    earlier = F.lit(False)
    for key, value, same in reversed(list(zip(sources, values, alike))):
        earlier = _before(key, value) | (same & earlier)
    equal = reduce(Column.__and__, alike)
    # The bare comparison of the first column is what reaches the files.
    column, value, descending = sources[0].column, values[0], sources[0].descending
    near = df.where(column.isNull() | (column >= value if descending else column <= value))
    if end == k:
        return multi_sort(near.where(earlier | equal), columns)
    return multi_sort(near.where(earlier).unionByName(head(near.where(equal), k - first + 1)), columns)


def head(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows, or all if there are fewer.

    A small ``n`` meets in one task. For a large one the rows of each file are counted when
    this is called, and the answer is all rows of the first files by path and some of one more,
    so no task holds more than its piece of a file or what is taken of that one. A frame that
    does not come from files is stored first.
    """
    if n <= TOP_K_IN_ONE_TASK:
        return df.limit(n)
    path = F.coalesce(F.col("_metadata.file_path"), F.lit(""))
    try:
        counts = df.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    except AnalysisException:
        return head(materialise(df, "head"), n)
    # One row per file.
    ends = counts.withColumn("end", F.sum("rows").over(Window.orderBy("path")))
    cut = ends.where(F.col("end") > n).orderBy("path").first()
    if cut is None:
        return df
    rest = n - (cut["end"] - cut["rows"])
    whole = df.where(path < cut["path"])
    return whole.unionByName(df.where(path == cut["path"]).limit(rest)) if rest else whole


def row_count(df: DataFrame) -> int:
    """Number of rows; without filters Spark reads parquet footers only."""
    return df.count()


@dataclass(frozen=True)
class Preview:
    rows: DataFrame
    row_count: int
    column_count: int


def filtered_preview(
    df: DataFrame,
    filters: Sequence[ColumnFilter] = (),
    sort: SortColumns = (),
    limit: int | None = None,
) -> Preview:
    """The rows that pass the filters, the first ``limit`` if given, and how many there are.

    A preview has one row at least. ``df`` is a dataset in files: sort columns are read first,
    then the rows that are shown.
    """
    matching = filter_rows(df, *filters)
    if limit is None:
        rows = multi_sort(matching, sort)
    else:
        rows = top_k(matching, sort, max(1, int(limit)), keys_first=True)
    return Preview(rows, row_count(matching), len(df.columns))


@dataclass(frozen=True)
class DistinctValues:
    """``values`` has ``value, label, more``: ``more`` says that there are others."""

    values: DataFrame

    @property
    def truncated(self) -> bool:
        return not self.values.where("more").isEmpty()


def distinct_values(
    df: DataFrame,
    column: str,
    *,
    filters: Sequence[ColumnFilter] = (),
    value_filter: ColumnFilter | None = None,
    search: str = "",
    descending: bool | None = None,
) -> DataFrame:
    """Distinct values of a column under the filters of all *other* columns."""
    others = [part for part in filters if part.column != column]
    found = filter_rows(df, *others, *([value_filter] if value_filter else []))
    wanted = search.strip().lower()
    value = F.col(quoted(column))
    if wanted:
        text = F.lower(F.coalesce(value.cast("string"), F.lit("")))
        found = found.where(text.contains(F.lit(wanted)))
    values = found.select(value.alias("value")).distinct()
    if descending is not None:
        values = multi_sort(values, [("value", descending)])
    return values


def search_distinct(
    df: DataFrame, column: str, *, limit: int | None = None, **options
) -> DistinctValues:
    """Distinct values with labels, the first ``limit`` if given, as a lazy frame.

    With a limit and no direction the first ones are the smallest, nulls before them.
    """
    values = distinct_values(df, column, **options)
    label = F.coalesce(F.col("value").cast("string"), F.lit("(blank)"))
    if limit is None:
        return DistinctValues(values.select("value", label.alias("label"), F.lit(False).alias("more")))
    limit = max(1, int(limit))
    more = F.lit(limit) < values.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = top_k(values, [("value", bool(options.get("descending")))], limit)
    return DistinctValues(first.select("value", label.alias("label"), more.alias("more")))
