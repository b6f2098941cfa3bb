"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for every prefix, a polynomial in its code points modulo two
primes. The hash of any span is a difference of two entries, so equality of spans is two
lookups, and the longest common extension of two positions is a binary search.

The fingerprint keeps the array at a grid of lengths, from the start and from the end, so two
fingerprints tell how far two texts agree from either end without the texts. Its length grows
with the logarithm of the text's.

Defined cases: a null text is empty, and the empty text's fingerprint has no marks; equal
texts have equal fingerprints and likeness 1. Documents are ordered by descending id, nulls
last, rows with one id by their text; a single document is its own next. An empty table gives
no rows. Only the named columns are read. Texts of any length are whole: one text and the one
after it are held at a time, besides a bounded batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare, texts

#: Moduli and bases: fixed values, primes below 2**31 so that products fit 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Marks per doubling of the length.
MARKS_PER_OCTAVE = 6
_MARK = 6  # hex digits of a mark


def _grid() -> np.ndarray:
    """Lengths 1, 2, 3, ... and then a fixed number per doubling, up to 2**40."""
    steps = np.arange(0, 40 * MARKS_PER_OCTAVE + 1)
    return np.unique(np.round(2.0 ** (steps / MARKS_PER_OCTAVE)).astype(np.int64))


GRID = _grid()


class _Powers:
    """Powers of a base and of its inverse modulo a prime, grown as longer texts come."""

    def __init__(self, base: int, prime: int) -> None:
        self.base, self.prime, self.known = base, prime, np.ones(1, np.uint64)

    def up_to(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.base, len(self.known), self.prime))
            self.known = np.concatenate([self.known, self.known * step % np.uint64(self.prime)])
        return self.known[:n]


_POWERS = [
    (_Powers(b, p), _Powers(pow(b, -1, p), p)) for b, p in zip(BASES, PRIMES, strict=True)
]


class PrefixHashes:
    """The prefix arrays of a run of code points; all spans of it can be compared."""

    def __init__(self, codes: np.ndarray) -> None:
        self.length = len(codes)
        self.prefix = []
        values = codes.astype(np.uint64) + np.uint64(1)
        for (powers, _), prime in zip(_POWERS, PRIMES, strict=True):
            terms = values * powers.up_to(self.length) % np.uint64(prime)
            sums = np.zeros(self.length + 1, np.uint64)
            # Terms are below 2**31, so 2**33 of them can be added before the remainder.
            np.cumsum(terms, out=sums[1:])
            self.prefix.append(sums % np.uint64(prime))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 62-bit hash of each span, the same wherever the span stands."""
        parts = []
        for sums, (_, inverses), prime in zip(self.prefix, _POWERS, PRIMES, strict=True):
            p = np.uint64(prime)
            difference = (sums[ends] + p - sums[starts]) % p
            parts.append(difference * inverses.up_to(self.length + 1)[starts] % p)
        return (parts[0] << np.uint64(31)) | parts[1]

    def equal(self, i: int, j: int, length: int) -> bool:
        """Whether the spans of this length at ``i`` and ``j`` are equal."""
        at = np.array([i, j])
        a, b = self.spans(at, at + length)
        return bool(a == b)

    def longest_common_extension(self, i: int, j: int) -> int:
        """How many code points agree from ``i`` and ``j`` on."""
        low, high = 0, self.length - max(i, j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def longest_common_prefix(a: str, b: str) -> int:
    """How many code points two texts share at their start, by binary search."""
    hashes = PrefixHashes(np.concatenate([code_points(a), code_points(b)]))
    return min(hashes.longest_common_extension(0, len(a)), len(a))


def fingerprints(batch: Sequence[str]) -> list[str]:
    """``length:marks from the start:marks from the end:whole`` of each text, in hex."""
    lengths = np.array([len(text) for text in batch], np.int64)
    hashes = PrefixHashes(code_points("".join(batch)))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.searchsorted(GRID, lengths, side="right")
    row = np.repeat(np.arange(len(batch)), counts)
    first = np.cumsum(counts) - counts
    reach = GRID[np.arange(len(row)) - first[row]]
    ahead = _hex(_short(hashes.spans(starts[row], starts[row] + reach)))
    back = _hex(_short(hashes.spans(ends[row] - reach, ends[row])))
    whole = hashes.spans(starts, ends)
    return [
        f"{n:x}:{ahead[_MARK * f : _MARK * (f + c)]}:{back[_MARK * f : _MARK * (f + c)]}:{int(w):016x}"
        for n, f, c, w in zip(lengths.tolist(), first.tolist(), counts.tolist(), whole, strict=True)
    ]


def _short(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(31)) ^ (hashes << np.uint64(3))) & np.uint64(0xFFFFFF)


def _hex(marks: np.ndarray) -> str:
    wide = marks.astype(">u4").view(np.uint8).reshape(-1, 4)
    return wide[:, 1:].tobytes().hex()


def _common(a: str, b: str) -> int:
    """The largest grid length at which two runs of marks agree, by binary search."""
    low, high = 0, min(len(a), len(b)) // _MARK
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * _MARK] == b[: middle * _MARK]:
            low = middle
        else:
            high = middle - 1
    return int(GRID[low - 1]) if low else 0


def likeness(a: str, b: str) -> float:
    """Share of the longer text that both have in common from either end, 0 to 1."""
    if a == b:
        return 1.0
    n, ahead, back, _ = a.split(":")
    m, other_ahead, other_back, _ = b.split(":")
    longest = max(int(n, 16), int(m, 16))
    same = _common(ahead, other_ahead) + _common(back, other_back)
    return min(same, longest - 1) / longest


def edited(text: str, following: str) -> str:
    """The text with its last ``floor(n / 2)`` code points replaced by the next one's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_CHARS_PER_STEP = 1 << 19


def _compare(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Result rows for ``(id, text, next text)`` of consecutive documents."""
    own = [text for _, text, _ in pairs]
    # Each text's successor is the text after it, but where a run ends.
    following = [nxt for _, _, nxt in pairs]
    changed = [edited(text, nxt) for text, nxt in zip(own, following, strict=True)]
    marks = fingerprints(own)
    last = fingerprints([following[-1]])[0]
    next_marks = [
        marks[i + 1] if i + 1 < len(own) and own[i + 1] is following[i] else None
        for i in range(len(own))
    ]
    next_marks[-1] = last
    missing = [i for i, m in enumerate(next_marks) if m is None]
    for i, m in zip(missing, fingerprints([following[i] for i in missing]), strict=True):
        next_marks[i] = m
    changed_marks = fingerprints(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in pairs], pa.int64()),
            pa.array([len(text) for text in own], pa.int64()),
            pa.array(
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                pa.string(),
            ),
            pa.array(marks, pa.string()),
            pa.array(changed_marks, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(marks, changed_marks, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(marks, next_marks, strict=True)], pa.float64()),
        ],
        schema=_ARROW,
    )


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by place and order; the row that ends a place is the next place's first."""
    before: tuple | None = None
    pairs, held = [], 0
    for batch in batches:
        for place, guest, doc_id, text in zip(
            batch.column("place").to_pylist(),
            batch.column("guest").to_pylist(),
            batch.column("id").to_pylist(),
            batch.column("text").to_pylist(),
            strict=True,
        ):
            if before is not None and before[0] == place:
                pairs.append((before[1], before[2], text))
                held += len(before[2]) + len(text)
            before = None if guest else (place, doc_id, text)
            if held >= _CHARS_PER_STEP:
                yield _compare(pairs)
                pairs, held = [], 0
    if pairs:
        yield _compare(pairs)


def fingerprint_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", places: int | None = None
) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    Documents are dealt to ranges of ids, whose limits are quantiles of the ids. The first
    document of a range also goes to the range before it, as its end, so texts are shuffled
    once. The driver sees one id per range.
    """
    spark = prepare(docs.sparkSession)
    rows = texts(docs, id_column, text_column)
    ids = rows.select("id")
    places = places or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ids.approxQuantile("id", [i / places for i in range(1, places)], 0.1 / places) if places > 1 else []
    cuts = np.array(sorted(set(int(x) for x in found)), np.int64)
    nowhere = len(cuts) + 1

    @F.pandas_udf("int")
    def place_of(column: pd.Series) -> pd.Series:
        # Descending: the highest ids are in place 0, ids that are null in the last.
        known = column.notna().to_numpy()
        at = np.full(len(column), nowhere, np.int32)
        values = column[known].astype("int64").to_numpy()
        at[known] = len(cuts) - np.searchsorted(cuts, values, side="left")
        return pd.Series(at)

    tops = {
        r["place"]: r["top"]
        for r in ids.withColumn("place", place_of("id")).groupBy("place").agg(F.max("id").alias("top")).collect()
    }
    if not tops:
        return spark.createDataFrame([], RESULT)
    order = sorted(tops)
    placed = rows.withColumn("place", place_of("id")).withColumn("guest", F.lit(False))
    known = {tops[p]: order[i - 1] for i, p in enumerate(order) if tops[p] is not None}
    before = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else None
    guests = []
    if known:
        guests.append(
            rows.filter(F.col("id").isin(list(known))).withColumn("place", before[F.col("id")].cast("int"))
        )
    if nowhere in tops:
        target = order[order.index(nowhere) - 1]
        guests.append(rows.filter("id IS NULL").withColumn("place", F.lit(target)))
    for guest in guests:
        placed = placed.unionByName(guest.withColumn("guest", F.lit(True)))
    dealt = placed.repartition(places, "place").sortWithinPartitions(
        "place", "guest", F.col("id").desc_nulls_last(), "text"
    )
    return dealt.select("place", "guest", "id", "text").mapInArrow(_walk, RESULT)
