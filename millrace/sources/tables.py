"""Named parquet tables below one root folder; every change is all or nothing.

A table is a folder of parquet segments and small numbered JSON documents. The document with the
highest number is the table: it lists the schema and the segments in use. A change writes new
segments beside the old ones and then publishes the next number, which fails if someone else
has published that number meanwhile (``ConcurrentChange``). So a reader sees the table before
or after a change, a frame made earlier can still be read until ``vacuum``, and no update is
lost. The stored schema makes reading cheap (no footer is opened to infer it) and lets older
segments miss the columns added later.

A table with slice columns keeps its rows in buckets by a hash of those columns, which stay
ordinary columns of the files, so NULL and empty text remain apart. Replacing slices rewrites the
buckets that hold them and no others. The number of buckets follows the size of the table by
linear hashing: a change may split a few buckets, each in two, and leaves all others as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sortkeys import SortKey, as_list, quoted, tie_breaker
from millrace.operators.numbering import surrogate_numbering
from millrace.operators.joins import (
    anti_join_null_safe,
    inner_join_null_safe,
    null_safe_join,
    one_row_per_key,
)
from millrace.operators.preview import head
from millrace.operators.schema import non_null_counts
from millrace.session import local_frame, materialise


def _columns(names: Iterable[str]) -> list[Column]:
    return [F.col(quoted(name)) for name in names]


def clean_names(value, what: str) -> list[str]:
    names = [str(name).strip() for name in as_list(value)]
    if not names or not all(names):
        raise ValueError(f"{what} needs at least one name that is not empty.")
    return names


#: How often an update starts anew that another one has overtaken.
WRITE_ATTEMPTS = 5
#: Bytes of a bucket, the most buckets of a first write, the most splits of one change.
BUCKET_BYTES = 128 << 20
FIRST_BUCKETS = 64
SPLITS = 8
_BUCKET = "__bucket"


class ConcurrentChange(RuntimeError):
    """Another change of the table was published since its state was read."""


class Folder:
    """The few file operations needed, on whichever file system Spark is configured for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")

    def _on(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        target, system = self._on(path)
        return system.exists(target)

    def delete(self, path: str) -> None:
        target, system = self._on(path)
        system.delete(target, True)

    def children(self, path: str) -> list[str]:
        target, system = self._on(path)
        if not system.exists(target):
            return []
        return sorted(
            item.getPath().getName() for item in system.listStatus(target) if item.isDirectory()
        )

    def size(self, *paths: str) -> int:
        """Bytes of the files below some folders."""
        total = 0
        for path in paths:
            target, system = self._on(path)
            total += system.getContentSummary(target).getLength()
        return total

    def files(self, path: str) -> list[str]:
        target, system = self._on(path)
        if not system.exists(target):
            return []
        return sorted(
            item.getPath().getName() for item in system.listStatus(target) if item.isFile()
        )

    def listed(self, path: str) -> list[tuple[str, int, int]]:
        """Path, modification time in milliseconds and size of the files in a folder."""
        target, system = self._on(path)
        return [
            (item.getPath().toString(), item.getModificationTime(), item.getLen())
            for item in system.listStatus(target)
            if item.isFile() and not item.getPath().getName().startswith(("_", "."))
        ]

    def read_text(self, path: str) -> str:
        target, system = self._on(path)
        stream = system.open(target)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write a small file beside its target, then rename it; the target must not exist."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        target, system = self._on(part)
        stream = system.create(target, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        final = self._jvm.org.apache.hadoop.fs.Path(path)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        rename = self._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        rename[0] = options.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            target.toUri(), self._conf
        )
        try:
            context.rename(target, final, rename)
        except Exception as error:
            system.delete(target, False)
            if system.exists(final):
                raise FileExistsError(path) from error
            raise


class Warehouse:
    """Tables below ``root``; ``schema.table`` names become nested folders."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.folder = Folder(spark, root)

    # -- where things are ---------------------------------------------------------------

    @staticmethod
    def _parts(table: str) -> list[str]:
        parts = [part.strip() for part in str(table).split(".")]
        if not all(parts) or any("/" in part for part in parts):
            raise ValueError(f"Not a table name: {table!r}")
        return parts

    def _home(self, table: str) -> str:
        return "/".join([self.folder.path, *self._parts(table)])

    def _states(self, table: str) -> list[str]:
        return [
            name
            for name in self.folder.files(self._home(table))
            if name.startswith("_state-") and name.endswith(".json")
        ]

    def _state(self, table: str) -> dict | None:
        numbered = self._states(table)
        if not numbered:
            return None
        return json.loads(self.folder.read_text(f"{self._home(table)}/{numbered[-1]}"))

    def _known(self, table: str) -> dict:
        state = self._state(table)
        if state is None:
            raise ValueError(f"Table {table!r} does not exist.")
        return state

    def exists(self, table: str) -> bool:
        return self._state(table) is not None

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromJson(self._known(table)["schema"])

    def tables(self) -> list[str]:
        """Names of all tables, sorted."""
        found, level = [], [[]]
        while level:
            deeper = []
            for parts in level:
                for name in self.folder.children("/".join([self.folder.path, *parts])):
                    inner = [*parts, name]
                    if self._states(".".join(inner)):
                        found.append(".".join(inner))
                    elif not name.startswith(("_", ".")):
                        deeper.append(inner)
            level = deeper
        return sorted(found)

    # -- reading ------------------------------------------------------------------------

    def _paths(self, table: str, segments: dict[str, list[str]]) -> list[str]:
        return sorted(
            f"{self._home(table)}/{segment}" + (f"/{_BUCKET}={bucket}" if bucket else "")
            for bucket, names in segments.items()
            for segment in names
        )

    def _read(self, table: str, state: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        """The rows of a state, of some buckets if they are named."""
        schema = T.StructType.fromJson(state["schema"])
        paths = self._paths(table, state["segments"] if buckets is None else {
            bucket: segments for bucket, segments in state["segments"].items() if bucket in buckets
        })
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).select(*_columns(schema.names))

    def frame(self, table: str) -> DataFrame:
        """All rows of a table, as stored when this is called."""
        return self._read(table, self._known(table))

    def _selected(self, table: str, select) -> list[str]:
        names = self.schema(table).names
        if isinstance(select, str) and select.strip() == "*":
            return names
        wanted = clean_names(select, "select")
        missing = [name for name in wanted if name not in names]
        if missing:
            raise ValueError(f"Table {table!r} has no columns {missing}.")
        return wanted

    def read_table(
        self,
        table: str,
        *,
        select: str | Sequence[str] = "*",
        where: str | None = None,
        limit: int | None = None,
    ) -> DataFrame:
        """Projection, SQL predicate and limit of one table."""
        if limit is not None and int(limit) < 0:
            raise ValueError("A limit must not be negative.")
        wanted = self._selected(table, select)
        rows = self.frame(table)
        if where is not None and where.strip():
            rows = rows.where(where)
        rows = rows.select(*_columns(wanted))
        return rows if limit is None else head(rows, int(limit))

    def read_sql(self, sql: str) -> DataFrame:
        """Run one query over the tables, known by their names with ``_`` for the dots."""
        if not str(sql).strip():
            raise ValueError("The query text is empty.")
        for table in self.tables():
            self.frame(table).createOrReplaceTempView("_".join(self._parts(table)))
        return self.spark.sql(sql)

    def read_rows_by_values(
        self, table: str, *, column: str, is_in: Sequence, select: str | Sequence[str] = "*"
    ) -> DataFrame:
        """Rows whose column equals one of the values, ordered as the values are listed.

        ``None`` finds NULL rows; a repeated value counts once; no values, no rows.
        """
        schema = self.schema(table)
        (name,) = clean_names(column, "column")
        if name not in schema.names:
            raise ValueError(f"Table {table!r} has no column {name!r}.")
        wanted = self._selected(table, select)
        rows = self.frame(table)
        values = list(dict.fromkeys(is_in))
        if not values:
            return rows.select(*_columns(wanted)).limit(0)
        lookup = local_frame(
            self.spark, {"__place": list(range(len(values))), "__value": values}
        )
        lookup = lookup.withColumn("__value", F.col("__value").cast(schema[name].dataType))
        match = rows[quoted(name)].eqNullSafe(lookup["__value"])
        found = rows.join(lookup, match, "inner").select("__place", *_columns(wanted))
        # Only the selected columns are read, also for the tie breaker.
        ties = tie_breaker(found.select(*_columns(wanted)))
        return found.orderBy("__place", ties).select(*_columns(wanted))

    # -- writing ------------------------------------------------------------------------

    def _publish(
        self, table: str, base: dict | None, schema: T.StructType, parts: Sequence[str],
        segments: dict[str, list[str]], buckets: int, size: int,
    ) -> None:
        """Make this the table, unless it is no longer in the state ``base``."""
        number = (base["number"] if base else 0) + 1
        state = {
            "number": number, "schema": schema.jsonValue(), "partition_by": list(parts),
            "segments": segments, "buckets": buckets, "bytes": size,
        }
        try:
            self.folder.write_text(f"{self._home(table)}/_state-{number:012d}.json", json.dumps(state))
        except FileExistsError as error:
            raise ConcurrentChange(f"Table {table!r} was changed meanwhile.") from error

    @staticmethod
    def _storable(df: DataFrame) -> DataFrame:
        # Parquet has no column without a type.
        empty = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
        return df.withColumns({name: F.col(quoted(name)).cast("string") for name in empty})

    @staticmethod
    def _bucket(parts: Sequence[str], count: int) -> Column:
        """Linear hashing: a bucket that is not there yet still is a part of the one it splits from."""
        number = F.shiftrightunsigned(F.xxhash64(*_columns(parts)), 1)
        level = 1 << (count.bit_length() - 1)
        fine, coarse = number % (2 * level), number % level
        return F.when(fine < count, fine).otherwise(coarse).cast("int")

    @staticmethod
    def _split_from(bucket: int, count: int) -> int:
        """The bucket among the first ``count`` that holds what is to go to ``bucket``."""
        while bucket >= count:
            bucket -= 1 << (bucket.bit_length() - 1)
        return bucket

    def _first_buckets(self, df: DataFrame) -> int:
        """For a first write, from what Spark expects of its size."""
        expected = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return max(1, min(FIRST_BUCKETS, int(str(expected)) // BUCKET_BYTES))

    def _write_segment(
        self, table: str, df: DataFrame, parts: Sequence[str], buckets: int
    ) -> dict[str, list[str]]:
        """Write rows to a new segment; returns it by bucket. Nothing refers to it yet."""
        segment = f"v-{uuid.uuid4().hex}"
        path = f"{self._home(table)}/{segment}"
        try:
            if not parts:
                df.write.parquet(path)
                return {"": [segment]}
            # Few files per bucket, and several tasks for a bucket that holds much.
            placed = df.withColumn(_BUCKET, self._bucket(parts, buckets)).hint("rebalance", _BUCKET)
            placed.write.partitionBy(_BUCKET).parquet(path)
        except Exception:
            self.folder.delete(path)
            raise
        written = [name.partition("=")[2] for name in self.folder.children(path) if "=" in name]
        return {bucket: [segment] for bucket in written}

    def _change(
        self, table: str, base: dict | None, schema: T.StructType, parts: Sequence[str], df: DataFrame,
        merge=lambda written: written, buckets: int | None = None, kept_bytes: int = 0,
    ) -> str:
        """Write rows, publish what ``merge`` makes of their segment; returns its folder.

        ``kept_bytes`` is the size of the segments that ``merge`` keeps.
        """
        buckets = buckets or self._first_buckets(df)
        written = self._write_segment(table, df, parts, buckets)
        folder = next((f"{self._home(table)}/{s[0]}" for s in written.values()), self._home(table))
        try:
            size = kept_bytes + (self.folder.size(folder) if written else 0)
            self._publish(table, base, schema, parts, merge(written), buckets, size)
        except Exception:
            if written:
                self.folder.delete(folder)
            raise
        return folder

    def write(self, table: str, df: DataFrame, *, partition_by: Sequence[str] = ()) -> str:
        """Replace a table with exactly these rows and columns; returns the data folder.

        If writing fails the old table stays and the unfinished folder is removed.
        """
        df = self._storable(df)
        if not df.columns:
            raise ValueError("A table needs at least one column.")
        return self._change(table, self._state(table), df.schema, list(partition_by), df)

    def vacuum(self, table: str) -> int:
        """Remove the segments and documents that are not in use; returns how many segments."""
        home, state = self._home(table), self._known(table)
        used = {segment for segments in state["segments"].values() for segment in segments}
        old = [n for n in self.folder.children(home) if n.startswith("v-") and n not in used]
        for name in [*old, *self._states(table)[:-1]]:
            self.folder.delete(f"{home}/{name}")
        return len(old)

    @staticmethod
    def _widened(stored: T.StructType, incoming: T.StructType) -> T.StructType:
        extra = [field for field in incoming if field.name not in stored.names]
        return T.StructType(
            [T.StructField(f.name, f.dataType, True) for f in [*stored.fields, *extra]]
        )

    @staticmethod
    def _aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
        """``df`` with exactly the columns of ``schema``, cast to its types."""
        return df.select(
            *[
                (F.col(quoted(f.name)) if f.name in df.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in schema
            ]
        )

    def replace_table(
        self, table: str, df: DataFrame, *, partition_by: Sequence[str] | None = None
    ) -> DataFrame:
        """Replace all rows; columns the table had before stay, filled with NULL."""
        state = self._state(table)
        if not df.columns:
            raise ValueError("A table needs at least one column.")
        df = self._storable(df)
        if state is None:
            self.write(table, df, partition_by=partition_by or ())
            return df
        schema = self._widened(T.StructType.fromJson(state["schema"]), df.schema)
        parts = state["partition_by"] if partition_by is None else partition_by
        self.write(table, self._aligned(df, schema), partition_by=parts)
        return df

    def evolve_append(self, table: str, df: DataFrame) -> None:
        """Append rows by column name, creating or widening the table."""
        self._append(table, self._state(table), df)

    def _append(self, table: str, state: dict | None, df: DataFrame) -> None:
        df = self._storable(df)
        if state is None:
            self._change(table, None, df.schema, [], df)
            return
        schema = self._widened(T.StructType.fromJson(state["schema"]), df.schema)

        def merge(written):
            buckets = {**state["segments"], **written}
            return {b: [*state["segments"].get(b, []), *written.get(b, [])] for b in buckets}

        rows, buckets = self._aligned(df, schema), state["buckets"]
        self._change(table, state, schema, state["partition_by"], rows, merge, buckets, state["bytes"])

    def replace_rows_by_file(
        self, table: str, df: DataFrame, *, file_hash: str, file_hash_column: str = "file_key"
    ) -> DataFrame:
        """Replace the rows of one source file; no rows in ``df`` means none are left.

        A table made here has the key column as its slice column, so only one bucket is written.
        Returns the incoming rows with their key.
        """
        key, column = str(file_hash).strip(), str(file_hash_column).strip()
        if not key or not column:
            raise ValueError("The file key and its column name must not be empty.")
        if column in df.columns:
            raise ValueError(f"Column {column!r} exists already.")
        tagged = self._storable(df).withColumn(column, F.lit(key))
        keys = local_frame(self.spark, {column: [key]})
        self._replace_slices(table, tagged, keys, column)
        return tagged

    def replace_files(
        self, table: str, df: DataFrame, keys: DataFrame, *, file_hash_column: str = "file_key"
    ) -> None:
        """Replace the slices of many source files in one job.

        ``df`` carries the file key of every row. ``keys`` has the keys of all files that were
        read, so a file without rows loses its slice.
        """
        column = str(file_hash_column).strip()
        if column not in df.columns or column not in keys.columns:
            raise ValueError(f"Rows and keys need the column {column!r}.")
        self._replace_slices(table, self._storable(df), keys.select(column).distinct(), column)

    def _replace_slices(self, table: str, df: DataFrame, keys: DataFrame, column: str) -> None:
        """Put the rows of ``df`` in the place of those with one of ``keys``, NULL included.

        ``df`` is evaluated once. Of ``keys`` the driver sees which buckets they fall in.
        """
        state = self._state(table)
        if state is None:
            self.write(table, df, partition_by=[column])
            return
        schema = self._widened(T.StructType.fromJson(state["schema"]), df.schema)
        rows, parts = self._aligned(df, schema), state["partition_by"] or [column]
        keys = keys.select(F.col(quoted(column)).cast(schema[column].dataType).alias(column))
        count, segments = state["buckets"], state["segments"]
        # Buckets to split, so that their number follows the size.
        wanted = state["bytes"] // BUCKET_BYTES
        more = min(max(count, wanted), count + SPLITS)
        touched = {str(self._split_from(b, count)) for b in range(count, more)}
        # Buckets that hold the slices. By another column, or before there were slices, only the
        # rows themselves tell: their key column is read, and of what it says a name each.
        if parts == [column]:
            touched |= {str(r[0]) for r in keys.select(self._bucket(parts, count)).distinct().collect()}
            unsliced = {"": segments[""]} if "" in segments else {}
        else:
            old = self._aligned(self._read(table, state, segments.keys() - {""}), schema)
            held = null_safe_join(old.select(*_columns({*parts, column})), keys, [column], "left_semi")
            touched |= {str(r[0]) for r in held.select(self._bucket(parts, count)).distinct().collect()}
            unsliced = {"": segments.get("", [])}
        mixed = self._holding(table, state, schema, unsliced, keys, column)
        stored = self._aligned(self._read(table, state, touched), schema)
        if mixed:
            taken = {**state, "segments": {"": sorted(mixed)}}
            stored = stored.unionByName(self._aligned(self._read(table, taken), schema))
        kept = null_safe_join(stored, keys, [column], "left_anti")

        def merge(written):
            # A touched bucket without rows is gone; the others stay as they are.
            old = {b: names for b, names in segments.items() if b not in touched}
            if "" in old:
                old[""] = [name for name in old[""] if name not in mixed]
            new = {b: [*old.get(b, []), *written.get(b, [])] for b in {**old, **written}}
            return {b: names for b, names in new.items() if names}

        gone = {b: names for b, names in segments.items() if b in touched} | {"": sorted(mixed)}
        left = state["bytes"] - self.folder.size(*self._paths(table, gone))
        self._change(table, state, schema, parts, kept.unionByName(rows), merge, more, left)

    def _holding(
        self, table: str, state: dict, schema: T.StructType, unsliced: dict, keys: DataFrame, column: str
    ) -> set[str]:
        """Segments without buckets that hold rows of some slices: one name for each append."""
        if not any(unsliced.values()):
            return set()
        rows = self._aligned(self._read(table, {**state, "segments": unsliced}), schema)
        file = F.element_at(F.split(F.input_file_name(), "/"), -2).alias("segment")
        found = null_safe_join(rows.select(F.col(quoted(column)), file), keys, [column], "left_semi")
        return {r["segment"] for r in found.select("segment").distinct().collect()}

    def replace_rows_by_values(self, table: str, df: DataFrame, *, column: str) -> DataFrame:
        """Replace all rows whose ``column`` holds one of the incoming values, NULL included.

        A table made here has that column as its slice column.
        """
        name = str(column).strip()
        if not name:
            raise ValueError("The column name must not be empty.")
        if name not in df.columns:
            raise ValueError(f"Column {name!r} is not in the incoming rows.")
        # Read several times below, and the same rows each time, also if executors are lost.
        incoming = materialise(self._storable(df), "incoming")
        if incoming.isEmpty():
            raise ValueError("There are no incoming rows.")
        self._replace_slices(table, incoming, incoming.select(F.col(quoted(name))).distinct(), name)
        return incoming

    # -- dimensions ---------------------------------------------------------------------

    def build_dimension(
        self, table: str, df: DataFrame, *, key_column: str = "dimension_key"
    ) -> DataFrame:
        """Give every distinct row of ``df`` a surrogate key that never changes again.

        New combinations are numbered after the highest key in use, in the order of their
        columns. Returns the keys of the incoming combinations.
        """
        key = str(key_column).strip()
        names = df.columns
        if not names:
            raise ValueError("A dimension needs at least one column.")
        if not key or key in names:
            raise ValueError(f"Not usable as key column: {key_column!r}")
        order = [SortKey(column, nulls_last=True) for column in _columns(names)]
        for attempt in range(WRITE_ATTEMPTS):
            try:
                return self._extend_dimension(table, df, key, names, order)
            except ConcurrentChange:
                # Someone else numbered combinations meanwhile: theirs are looked up anew.
                if attempt + 1 == WRITE_ATTEMPTS:
                    raise

    def _extend_dimension(self, table: str, df: DataFrame, key: str, names, order) -> DataFrame:
        state = self._state(table)
        stored = None if state is None else self._read(table, state)
        rows = self._storable(df)
        if stored is not None:
            rows = self._aligned(rows, stored.select(*_columns(names)).schema)
        # Stored once: the input may be a large fact table, its combinations are read below
        # for the new ones and for the mapping.
        incoming = materialise(rows.distinct(), "dimension-input")
        new, highest = incoming, 0
        if stored is not None:
            new = materialise(anti_join_null_safe(incoming, stored, names), "dimension-new")
            highest = stored.agg(F.max(F.col(quoted(key)))).first()[0] or 0
        if stored is None or not new.isEmpty():
            numbered = surrogate_numbering(new, key, order, start_after=highest)
            self._append(table, state, numbered.select(F.col(quoted(key)), *_columns(names)))
        mapping = self.frame(table).select(*_columns(names), F.col(quoted(key)))
        if stored is not None:
            mapping = inner_join_null_safe(incoming, mapping, names)
        return mapping.orderBy(*[part.expression() for part in order])

    def attach_dimension(
        self, table: str, df: DataFrame, *, on, key_column: str = "dimension_key",
        drop_key: bool = False,
    ) -> DataFrame:
        """Left join the surrogate key; a NULL natural key gets none."""
        names = clean_names(on, "on")
        missing = [name for name in names if name not in df.columns]
        if missing:
            raise ValueError(f"Columns are not in the incoming rows: {missing}")
        mapping = self.frame(table).select(*_columns([*names, key_column]))
        joined = df.join(one_row_per_key(mapping, names), names, "left")
        order = [*df.columns, key_column]
        return joined.select(*_columns([c for c in order if not (drop_key and c in names)]))

    def denormalize_columns(
        self, table: str, df: DataFrame, *, key_column: str = "dimension_key",
        select: str | Sequence[str] = "*", drop_key: bool = False,
    ) -> DataFrame:
        """Left join the natural columns back from the surrogate key."""
        key = str(key_column).strip()
        if not key or key not in df.columns:
            raise ValueError(f"Key column {key_column!r} is not in the incoming rows.")
        names = self.schema(table).names
        if key not in names:
            raise ValueError(f"Table {table!r} has no key column {key!r}.")
        if isinstance(select, str) and select.strip() == "*":
            wanted = [name for name in names if name != key]
        else:
            wanted = self._selected(table, select)
            if key in wanted:
                raise ValueError("The key column cannot be selected as a natural column.")
        if not wanted:
            raise ValueError("There is no natural column to select.")
        mapping = self.frame(table).select(*_columns([key, *wanted]))
        joined = df.join(one_row_per_key(mapping, [key]), key, "left")
        order = [*[c for c in df.columns if not (drop_key and c == key)], *wanted]
        return joined.select(*_columns(order))

    def normalize_columns(
        self, table: str, df: DataFrame, *, on, key_column: str = "dimension_key",
        drop_key: bool = True, returns: str | None = "df",
    ) -> DataFrame | None:
        """Extend the dimension with the keys of ``df``, then attach them."""
        if returns not in ("df", "map", None):
            raise ValueError("returns is 'df', 'map' or None.")
        names = clean_names(on, "on")
        mapping = self.build_dimension(
            table, df.select(*_columns(names)), key_column=key_column
        )
        if returns == "map":
            return mapping
        if returns is None:
            return None
        return self.attach_dimension(
            table, df, on=names, key_column=key_column, drop_key=drop_key
        )

    # -- maintenance --------------------------------------------------------------------

    def drop_null_columns(
        self, tables: str | Sequence[str] | None = None, *, compact_files: bool = False
    ) -> DataFrame:
        """Rewrite tables without their all-NULL columns; one report row per table.

        The first column stays where all are empty, and a one-column table is left alone.
        ``compact_files`` rewrites the other tables too, into evenly sized files.
        """
        known = self.tables()
        names = known if tables is None else clean_names(tables, "tables")
        missing = [name for name in names if name not in known]
        if missing:
            raise ValueError(f"Tables do not exist: {missing}")
        report, frames = [], {name: self.frame(name) for name in names}
        # The columns of all tables are counted in one job.
        counted = [
            non_null_counts(frame).select(F.lit(name).alias("name"), F.array(*map(quoted, frame.columns)).alias("counts"))
            for name, frame in frames.items()
            if len(frame.columns) > 1
        ]
        found = {row["name"]: row["counts"] for row in reduce(DataFrame.unionAll, counted).collect()} if counted else {}
        for name, frame in frames.items():
            state, dropped = self._known(name), []
            if name in found:
                dropped = [c for c, n in zip(frame.columns, found[name], strict=True) if n == 0]
                if len(dropped) == len(frame.columns):
                    dropped = dropped[1:]
            if dropped or compact_files:
                parts = [c for c in state["partition_by"] if c not in dropped]
                # Even-sized files, whatever pieces the table was written in.
                kept = frame.drop(*dropped)
                kept = kept if parts else kept.hint("rebalance")
                self.write(name, kept, partition_by=parts)
            report.append(dropped)
        return local_frame(
            self.spark,
            {
                "table": pa.array(names, pa.string()),
                "dropped_column_count": pa.array([len(part) for part in report], pa.int64()),
                "dropped_columns": pa.array(report, pa.list_(pa.string())),
            },
        )
