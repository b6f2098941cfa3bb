"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import configure, materialise, remove

#: White space between words, as bytes of UTF-8 and as the body of a regular expression.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch, unless a single row is longer.
ROWS_PER_BATCH = 4096
BYTES_PER_BATCH = 4 << 20
#: Bytes of text that one vectorised step looks at, unless a single text is longer.
BYTES_PER_STEP = 2 << 20

_U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """The session options these operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    # Shuffle files go when the query that made them ends; what is needed later is stored.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back."""
    return materialise(df, label)


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing will read any more, once their readers are stored."""
    for frame in frames:
        remove(frame)


def free_prefix(columns: Iterable[str]) -> str:
    """A prefix that no column's name has, whatever its case."""
    tag = "_"
    while any(c.lower().startswith(tag) for c in columns):
        tag += "_"
    return tag


def texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The two columns an operator reads, under names of its own; a null text is empty."""
    return df.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = values ^ (values >> _U64(33))
    x *= _U64(0xFF51AFD7ED558CCD)
    x ^= x >> _U64(33)
    x *= _U64(0xC4CEB9FE1A85EC53)
    x ^= x >> _U64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 ^ 0x6  # odd, and 3 modulo 8: few low bits are lost to permutations
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U64(0xD6E8FEB86659FD93))


class _Powers:
    """Powers of one odd number modulo 2**64, grown as longer buffers come."""

    def __init__(self, base: int) -> None:
        self.base, self.known = base, np.ones(1, np.uint64)

    def up_to(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = _U64(pow(self.base, len(self.known), 1 << 64))
            self.known = np.concatenate([self.known, self.known * step])
        return self.known[:n]


_POWERS, _INVERSES = _Powers(_BASE), _Powers(_INVERSE)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each span; ``values`` are 64-bit codes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return spans_of(*span_prefix(values), starts, ends)


def span_prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``spans_of`` takes of ``values``: sums of weighted codes, and what undoes the weights."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _POWERS.up_to(len(values)), out=prefix[1:])
    return prefix, _INVERSES.up_to(len(values) + 1)


def spans_of(prefix: np.ndarray, inverses: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of ``span_hashes`` from what ``span_prefix`` returned."""
    return mix64((prefix[ends] - prefix[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a run of texts: their hashes, and where each text's words begin.

    Words are runs of bytes other than white space, with A-Z in lower case. ``first`` has one
    entry more than there are texts.
    """

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray) -> None:
        space = (buffer == 0x20) | ((buffer >= 0x09) & (buffer <= 0x0D))
        lower = buffer + ((buffer >= 0x41) & (buffer <= 0x5A)).view(np.uint8) * np.uint8(0x20)
        begins = ~space
        begins[1:] &= space[:-1]
        inner = offsets[:-1][(offsets[:-1] < len(buffer)) & (offsets[:-1] < offsets[1:])]
        begins[inner] = ~space[inner]
        after = space.copy()  # the byte after a word's last
        after[1:] &= ~space[:-1]
        if len(after):
            after[0] = False
        cut = inner[inner > 0]
        after[cut] = ~space[cut - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(after)
        if len(self.ends) < len(self.starts):
            self.ends = np.append(self.ends, len(buffer))
        self.lower = lower
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(_BYTE[lower], self.starts, self.ends)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows, without copying rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if places is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterable[pa.RecordBatch], size: int = BYTES_PER_STEP) -> Iterator[tuple]:
    """``(batch slice, bytes, offsets)`` with a bounded number of text bytes (or one text)."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield (
                batch.slice(at, to - at),
                data[offsets[at] : offsets[to]],
                offsets[at : to + 1] - offsets[at],
            )
            at = to


def components(edges: DataFrame, label: str) -> DataFrame:
    """``(id, component_id)`` for every end of ``edges (a, b)``: the smallest id reachable.

    Alternates the large-star and small-star steps until the set of links stays the same: every
    step is an aggregation with map-side combine and a join, links stay in tables, and each
    round is stored. The number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    links = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        label,
    )
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.struct("a").alias("k")).agg(F.min("b").alias("m"))
        least = least.select(F.col("k.a").alias("a"), F.least("m", "k.a").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), label)
        least = large.groupBy(F.struct("a").alias("k")).agg(F.min("b").alias("m"))
        least = least.select(F.col("k.a").alias("a"), "m")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.unionByName(least.withColumnRenamed("m", "b")).filter("a <> b").distinct(), label)
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
