"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. Equal strings get equal ranks: ranks of short strings are sorted, ranks of strings
twice as long come from pairs of ranks at a growing offset, and a position leaves as soon as its
rank is unique, or when the length is reached.

The first round is done on a sample that no repeated string can miss: the start of each string
is put down to the smallest 24-byte rank inside it (the leftmost one), its anchor. Equal strings
have the same anchor at the same place, so one shuffle by the anchors' ranks shows which are
unique to one text, and they leave with all strings they stand for. Then anchors are dealt by
their rank and a hash of all bytes of their strings: what a smaller id has alike goes as a whole,
and a rank with one kind of surroundings is done. Where it has several, the smallest id of each
stays open.

The strings of an open anchor are then told apart in rounds. They are held in cells, by how far
before the anchor they start; all strings of a cell share its core, the bytes around the anchor.
A round cuts each cell in two, which brings in bytes at a growing offset on one side, and ranks
the new cores. Spark groups by rank: what one id has alone leaves, what the smallest id of the rank
has alike on the whole is removed, and the rest are cut again, until a cell is a single string of
``LENGTH`` bytes and the smallest id of its rank is known. Ranks are
two independent 64-bit hashes of the core, so a rank that many documents share is spread by
its following bytes, combined before the shuffle, and never held by one task.

Copies do not weigh on one task: equal texts are one class, of which only the smallest id is
looked at; anchors that many documents of a task share go on as one entry, and so do equal
surroundings.

Defined cases: null and empty texts have no bytes; texts under ``LENGTH`` bytes stay as they
are and remove nothing; rows that share an id do not remove each other's bytes, and a null id
comes after all others; an empty table gives no rows. Matches never cross documents; strings
are judged on the input. Only the named columns are read. Very long texts are gone through in
overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted
from millrace.llm.common import _BYTE, discard, free_prefix, mix64, prepare, span_prefix, spans_of, steps, stored, texts

LENGTH = 50
#: Bytes of the sampled rank, and starts of it in a string of ``LENGTH``.
SEED = 24
REACH = LENGTH - SEED + 1
#: Bytes of a piece of texts, whose arrays stay in a core's cache, entries that a task sorts at a
#: time, bytes of a bucket.
PIECE = 64 << 10
ENTRIES_PER_SORT = 1 << 20
BYTES_PER_BUCKET = 4 << 20

#: Stands for a null id, above all others.
_NO_ID = (1 << 63) - 1
_U64 = np.uint64


def _pieces(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the texts, several at a time, long ones cut with an overlap."""
    at = 0
    while at + 1 < len(offsets):
        to = int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1
        if to > at:
            yield np.arange(at, to), np.stack([offsets[at:to], offsets[at + 1 : to + 1]], 1)
            at = to
            continue
        start, end = int(offsets[at]), int(offsets[at + 1])
        while start < end:
            yield np.array([at]), np.array([[start, min(start + PIECE + LENGTH - 1, end)]])
            start += PIECE
        at += 1


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, key, first, last, place, hash)``: each anchor's text, rank, first and last string
    start, where it is, and a hash of all bytes of its strings.

    Starts are places in ``data``. The strings that begin at ``first`` to ``last`` have it as
    their anchor.
    """
    out = []
    for owner, limits in _pieces(offsets):
        base, end = int(limits[0, 0]), int(limits[-1, 1])
        if end - base < LENGTH:
            continue
        prefix, inverses = span_prefix(_BYTE[data[base:end]])
        # The smallest of the ranks' upper halves, the leftmost of equal ones.
        lowest = prefix[SEED:] - prefix[:-SEED]
        lowest *= inverses[: len(lowest)]
        lowest += _U64(SEED)
        lowest = mix64(lowest)
        lowest &= _U64(0xFFFFFFFF00000000)
        lowest |= np.arange(len(lowest), dtype=np.uint64)
        width = 1
        while width < REACH:
            step = min(width, REACH - width)
            lowest = np.minimum(lowest[: len(lowest) - step], lowest[step:])
            width += step
        starts = limits[:, 0] - base
        stops = limits[:, 1] - base - LENGTH + 1
        change = np.empty(len(lowest), bool)
        np.not_equal(lowest[1:], lowest[:-1], out=change[1:])
        change[starts[starts < len(lowest)]] = True
        change[stops[(stops > starts) & (stops < len(lowest))]] = True
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(lowest)) - 1
        text = np.searchsorted(starts, first, side="right") - 1
        whole = first < stops[text]
        text, first, last = owner[text[whole]], first[whole], last[whole]
        if not len(first):
            continue
        place = (lowest[first] & _U64(0xFFFFFFFF)).astype(np.int64)
        key = mix64(spans_of(prefix, inverses, place, place + SEED))
        out.append((text, key, first + base, last + base, place + base, spans_of(prefix, inverses, first, last + LENGTH)))
    if not out:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(6))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return cut, np.append(cut[1:], len(sorted_values))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a rank, by its upper half: buckets are in the order of ranks."""
    return ((key >> _U64(32)) * _U64(buckets)) >> _U64(32)


def _in_order(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in the order of ``key`` and ``owner``."""
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    some = order[tied]
    order[tied] = some[np.lexsort((owner[some], key[some]))]
    owner = owner[order]
    new = np.append(True, ~same | (owner[1:] != owner[:-1]))[: len(key)]
    return ranked[new], owner[new]


# -- first round: which anchors are shared --------------------------------------------------


def _requests(buckets: int):
    """Anchor ranks with their texts, dealt to buckets. What several texts of this run share is
    known to be shared already and goes on once, without a text. Texts go by their hash."""

    def flush(keys: list, ids: list) -> Iterator[pa.RecordBatch]:
        key, owner = _in_order(np.concatenate(keys), np.concatenate(ids))
        start, end = _runs(key)
        several = np.repeat(end - start > 1, end - start)
        first = np.zeros(len(key), bool)
        first[start] = True
        bucket = _bucket(key, buckets)
        short = (key & _U64(0xFFFFFFFF)).astype("<u4")
        owner = owner.astype("<i8")
        rows = []
        for a, b in zip(*_runs(bucket), strict=True):
            ranks, owners, shared = short[a:b], owner[a:b], several[a:b]
            rows.append(
                (
                    int(bucket[a]),
                    ranks[~shared].tobytes(),
                    owners[~shared].tobytes(),
                    ranks[shared & first[a:b]].tobytes(),
                    ranks[shared].tobytes(),
                    owners[shared].tobytes(),
                )
            )
        kinds = (pa.int32(), *[pa.binary()] * 5)
        for i in range(0, len(rows), 64):
            part = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in part], t) for k, t in enumerate(kinds)],
                names=["bucket", "keys", "ids", "known", "shared_keys", "shared_ids"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch, data, offsets in steps(batches):
            text, key, *_ = anchors(data, offsets)
            keys.append(key)
            ids.append(batch.column("sign").to_numpy()[text])
            held += len(key)
            if held >= ENTRIES_PER_SORT:
                yield from flush(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield from flush(keys, ids)

    return run


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(sign, key)``: the ranks of a text that another one has too. Rows come by bucket."""

    def answer(bucket, short, owner):
        key = (np.int64(bucket) << np.int64(32)) | short.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(key)], names=["sign", "key"])

    def close(bucket, lone, known):
        short, owner = _in_order(np.concatenate([k for k, _ in lone]), np.concatenate([o for _, o in lone]))
        if not len(short):
            return
        start, end = _runs(short)
        shared = np.repeat(end - start > 1, end - start)
        if known:
            shared |= np.isin(short, np.concatenate(known))
        yield from answer(bucket, short[shared], owner[shared])

    at, lone, known = None, [], []
    for batch in batches:
        for bucket, *cells in zip(batch.column(0).to_pylist(), *[batch.column(k) for k in range(1, 6)], strict=True):
            if bucket != at and lone:
                yield from close(at, lone, known)
                lone, known = [], []
            at = bucket
            keys, ids, sure, shared_keys, shared_ids = (c.as_buffer() for c in cells)
            lone.append((np.frombuffer(keys, "<u4"), np.frombuffer(ids, "<i8")))
            if len(sure):
                known.append(np.frombuffer(sure, "<u4"))
            if len(shared_ids):
                yield from answer(bucket, np.frombuffer(shared_keys, "<u4"), np.frombuffer(shared_ids, "<i8"))
    if lone:
        yield from close(at, lone, known)


# -- second round: equal surroundings -------------------------------------------------------

_MARK = np.dtype(
    [("id", "<i8"), ("sign", "<i8"), ("hash", "<u8"), ("first", "<u4"), ("key", "<u4"), ("starts", "u1"), ("before", "u1")]
)
_FOUND = "id long, sign long, start long, end long, key long, hash long, place long"


def _found(entry: np.ndarray, open_: bool) -> pa.RecordBatch:
    """The strings of some anchors: the span that goes, or first and last start where still open."""
    first = entry["first"].astype(np.int64)
    last = first + entry["starts"] - 1
    columns = [entry["id"], entry["sign"], first, last + (0 if open_ else LENGTH)]
    if open_:
        columns += [entry["key"], entry["hash"].view(np.int64), first + entry["before"]]
    arrays = [pa.array(np.ascontiguousarray(c, np.int64)) for c in columns]
    arrays += [pa.nulls(len(entry), pa.int64())] * (7 - len(arrays))
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _FOUND.split(", ")])


def _by_surroundings(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by rank, surroundings and id; and which have a smaller id before them in their group."""
    order = np.lexsort((entry["id"], entry["hash"], entry["key"]))
    ranked = entry[order]
    new = np.concatenate(
        [[True], (ranked["key"][1:] != ranked["key"][:-1]) | (ranked["hash"][1:] != ranked["hash"][:-1])]
    )
    least = ranked["id"][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    return order, ranked["id"] > least


def _surroundings(buckets: int):
    """The shared anchors of documents, with a hash of the bytes of their strings.

    Of equal surroundings in a run of documents only the smallest id's go on; the others'
    strings are known to start in it, and go on as removed.
    """

    def flush(entries: list) -> Iterator[pa.RecordBatch]:
        entry = np.concatenate(entries)
        order, later = _by_surroundings(entry)
        bucket = (entry["hash"] % _U64(buckets)).astype(np.int64)[order]
        by = np.argsort(bucket, kind="stable")
        rows = []
        for a, b in _pairs(bucket[by]):
            here = order[by[a:b]]
            sure = later[by[a:b]]
            rows.append((int(bucket[by[a]]), entry[here[~sure]].tobytes(), entry[here[sure]].tobytes()))
        for i in range(0, len(rows), 16):
            part = rows[i : i + 16]
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in part], t) for k, t in enumerate(kinds)],
                names=["bucket", "entries", "removed"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, held = [], 0
        for batch, data, offsets in steps(batches):
            text, key, first, last, place, alike = anchors(data, offsets)
            if not len(text):
                continue
            keys = batch.column("keys")
            wanted = keys.flatten().to_numpy().astype(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(keys).to_numpy())
            # Ranks are compared as they were sent: bucket of the first round and lower half.
            short = (_bucket(key, buckets) << _U64(32)) | (key & _U64(0xFFFFFFFF))
            pick = np.isin(
                mix64(short) ^ mix64(text.astype(np.uint64)), mix64(wanted) ^ mix64(owner.astype(np.uint64))
            )
            text, key, first, last, place, alike = (c[pick] for c in (text, key, first, last, place, alike))
            if not len(text):
                continue
            entry = np.empty(len(text), _MARK)
            entry["id"] = batch.column("id").to_numpy()[text]
            entry["sign"] = batch.column("sign").to_numpy()[text]
            entry["hash"] = alike
            entry["first"] = first - offsets[text]
            entry["key"] = (key & _U64(0xFFFFFFFF)).astype(np.uint32)
            entry["starts"] = last - first + 1
            entry["before"] = place - first
            entries.append(entry)
            held += len(entry)
            if held >= ENTRIES_PER_SORT // 2:
                yield from flush(entries)
                entries, held = [], 0
        if held:
            yield from flush(entries)

    return run


def _pairs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    start, end = _runs(values) if len(values) else ((), ())
    return zip(start, end, strict=True)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What equal surroundings settle, from the entries of each bucket. Rows come by bucket.

    An entry whose surroundings a smaller id has is removed as a whole. The smallest id of each
    kind of surroundings stays open, as its strings may still start in another kind.
    """

    def close(entries):
        entry = np.concatenate(entries)
        order, later = _by_surroundings(entry)
        ranked = entry[order]
        yield _found(ranked[later], False)
        yield _found(ranked[~later], True)

    at, entries = None, []
    for batch in batches:
        for bucket, entry, removed in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
            sure = np.frombuffer(removed.as_buffer(), _MARK)
            if len(sure):
                yield _found(sure, False)
            if bucket != at and entries:
                yield from close(entries)
                entries = []
            at = bucket
            if len(entry.as_buffer()):
                entries.append(np.frombuffer(entry.as_buffer(), _MARK))
    if entries:
        yield from close(entries)


# -- further rounds: ranks of growing cores -------------------------------------------------

_CELL = (
    "id long, sign long, place long, low int, high int, cell_low int, cell_high int, "
    "core long, second long, whole long, bytes binary"
)
_CELL_NAMES = [c.split()[0] for c in _CELL.split(", ")]
#: Codes of bytes for a second hash.
_OTHER = mix64(_BYTE ^ _U64(0x2545F4914F6CDD1D))


def _cells(columns: list[np.ndarray], data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Cells cut in two, with the ranks of their new cores.

    ``columns``: id, sign, the anchor's place, the least and most bytes that the strings have
    before it, and the cell's limits, the upper one excluded. ``data[at]`` is the first byte of
    the string with most bytes before the anchor.
    """
    identity, sign, place, low, high, cell_low, cell_high = columns
    middle = (cell_low + cell_high + 1) // 2
    which = np.tile(np.arange(len(low)), 2)
    start = (at + high)[which]
    cell_low, cell_high = np.concatenate([cell_low, middle]), np.concatenate([middle, cell_high])
    low, high = np.maximum(low[which], cell_low), np.minimum(high[which], cell_high - 1)
    some = low <= high
    which, start, low, high, cell_low, cell_high = (
        c[some] for c in (which, start, low, high, cell_low, cell_high)
    )
    start -= high
    length = high - low + LENGTH
    core = start + high - cell_low
    end = core + LENGTH + 1 - (cell_high - cell_low)
    # Cores of different cells are told apart by the cell.
    salt = mix64((cell_low * 64 + cell_high).astype(np.uint64))
    codes = span_prefix(_BYTE[data])
    # Two cells are alike on the whole if their strings and the places of these are.
    whole = spans_of(*codes, start, start + length) ^ mix64((low * 64 + high).astype(np.uint64))
    ranks = [
        mix64(spans_of(*codes, core, end) ^ salt),
        mix64(spans_of(*span_prefix(_OTHER[data]), core, end) ^ salt),
        mix64(whole ^ salt),
    ]
    begin = np.cumsum(length) - length
    flat = data[np.repeat(start - begin, length) + np.arange(int(length.sum()))]
    offsets = np.append(begin, length.sum()).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            *[pa.array(c[which], pa.int64()) for c in (identity, sign, place)],
            *[pa.array(c, pa.int32()) for c in (low, high, cell_low, cell_high)],
            *[pa.array(r.view(np.int64)) for r in ranks],
            pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]),
        ],
        names=_CELL_NAMES,
    )


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open anchors of documents as cells."""
    for batch, data, offsets in steps(batches, 4 * PIECE):
        count = pc.list_value_length(batch.column("firsts")).to_numpy()
        text = np.repeat(np.arange(batch.num_rows), count)
        first, last, place = (batch.column(c).flatten().to_numpy() for c in ("firsts", "lasts", "places"))
        every = np.zeros(len(text), np.int64)
        columns = [batch.column(c).to_numpy()[text] for c in ("id", "sign")]
        columns += [place, place - last, place - first, every, every + REACH]
        yield _cells(columns, data, offsets[text] + first)


def _smaller_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells that several ids share: cut again, or without bytes where all their strings go."""
    names = [*_CELL_NAMES[:7]]
    for batch in batches:
        done = batch.column("done")
        ended, batch = batch.filter(done), batch.filter(pc.invert(done))
        if ended.num_rows:
            nothing = [pa.nulls(ended.num_rows, pa.int64())] * 3 + [pa.nulls(ended.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[ended.column(c) for c in names], *nothing], names=_CELL_NAMES)
        if not batch.num_rows:
            continue
        strings = batch.column("bytes")
        offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset :][: len(strings) + 1].astype(np.int64)
        data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        columns = [batch.column(c).to_numpy().astype(np.int64) for c in names]
        yield _cells(columns, data, offsets[:-1] - offsets[0])


def _told_apart(cells: DataFrame) -> DataFrame:
    """``(id, sign, start, end)`` of the strings that start in a smaller id, from first cells."""
    width, before, ended = REACH, None, []
    spans = ["id", "sign", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + LENGTH).alias("end")]
    while True:
        width = (width + 1) // 2
        cells = stored(cells, "cells")
        if before is not None:
            ended.append(stored(cells.filter("bytes IS NULL").select(spans), "ended"))
            discard(before)
        before, cells = cells, cells.filter("bytes IS NOT NULL")
        # The smallest id of a rank; those of a hot one are combined before the shuffle.
        least = cells.groupBy(F.struct("core", "second").alias("k")).agg(
            F.min("id").alias("least"), F.min_by("whole", "id").alias("alike"), F.max("id").alias("most")
        )
        least = least.filter("least < most").select("k.core", "k.second", "least", "alike")
        if width == 1:
            cells = cells.drop("bytes").join(least, ["core", "second"]).filter("id > least").select(spans)
            for frame in ended:
                cells = cells.unionByName(frame)
            return cells
        done = (F.col("id") > F.col("least")) & (F.col("whole") == F.col("alike"))
        cells = (
            cells.join(least, ["core", "second"])
            .select(*_CELL_NAMES[:7], "bytes", done.alias("done"))
            .mapInArrow(_smaller_cells, _CELL)
        )


# -- documents ------------------------------------------------------------------------------


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and adjoining spans joined, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(starts)) - 1
    return starts[new], ends[last]


_RESULT = "id long, sign long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(with_kept: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            rows = []
            copies = batch.column("copy").to_pylist()
            lists = [batch.column(name).to_pylist() for name in ("starts", "ends")]
            for i, (copy, starts, ends) in enumerate(zip(copies, *lists, strict=True)):
                own = data[offsets[i] : offsets[i + 1]]
                if copy and len(own) >= LENGTH:
                    a, b = np.array([0]), np.array([len(own)])
                elif starts:
                    a, b = merged(np.array(starts, np.int64), np.array(ends, np.int64))
                else:
                    a = b = np.zeros(0, np.int64)
                edges = np.concatenate([[0], np.stack([a, b], 1).ravel(), [len(own)]]).reshape(-1, 2)
                kept = [own[x:y].tobytes() for x, y in edges]
                rows.append((len(own), int((b - a).sum()), a, b, kept))
            columns = [
                batch.column("id"),
                batch.column("sign"),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
            ]
            if with_kept:
                spans = [[{"start": int(x), "end": int(y)} for x, y in zip(r[2], r[3], strict=True)] for r in rows]
                columns += [pa.array(spans, spans_type), pa.array([b"".join(r[4]) for r in rows], pa.binary())]
                names = ["id", "sign", "n_bytes", "n_removed", "spans", "kept"]
            else:
                columns += [
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(b"".join(r[4])).hexdigest() for r in rows], pa.string()),
                ]
                names = ["id", "sign", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = texts(docs, id_column, text_column).withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    return rows.withColumn("sign", F.xxhash64("text"))


def removals(rows: DataFrame) -> DataFrame:
    """What goes of the rows ``(id, text, sign)``: ``id, sign, copy, starts, ends``.

    ``copy`` marks rows that are equal to one with a smaller id; the others have spans.
    """
    spark = prepare(rows.sparkSession)
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = rows.select(
        "id", "sign", F.xxhash64(F.lit(3), "text").alias("second"), F.octet_length("text").cast("bigint").alias("size")
    )
    marks = stored(marks, "marks")
    classes = marks.groupBy("sign", "second", "size").agg(F.min("id").alias("least"))
    total = marks.agg(F.sum("size")).first()[0] or 0
    marks = marks.join(classes, ["sign", "second", "size"]).select("id", "sign", (F.col("id") > F.col("least")).alias("copy"))
    marks = stored(marks.distinct(), "copies")
    # About every fourteenth byte is an anchor, of twelve bytes in the first round.
    buckets = max(places, int(total * 12 / 14 / BYTES_PER_BUCKET) + 1)
    shared = (
        rows.select("sign", "text")
        .mapInArrow(
            _requests(buckets),
            "bucket int, keys binary, ids binary, known binary, shared_keys binary, shared_ids binary",
        )
        .repartition(places, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_answers, "sign long, key long")
    )
    shared = stored(shared, "shared")
    wanted = (
        shared.join(marks.filter("NOT copy").groupBy(F.struct("sign").alias("k")).agg(F.min("id").alias("id")).select("k.sign", "id"), "sign")
        .groupBy(F.struct("id", "sign").alias("k"))
        .agg(F.collect_list("key").alias("keys"))
        .select("k.id", "k.sign", "keys")
    )
    settled = (
        rows.join(wanted, ["id", "sign"])
        .mapInArrow(_surroundings(buckets), "bucket int, entries binary, removed binary")
        .repartition(places, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_compare, _FOUND)
    )
    settled = stored(settled, "settled")
    discard(shared)
    left = settled.filter("key IS NOT NULL")
    several = left.groupBy(F.struct("key").alias("k")).agg(F.min("hash").alias("a"), F.max("hash").alias("b"))
    still = (
        left.join(several.filter("a < b").select("k.key"), "key")
        .groupBy(F.struct("id", "sign").alias("k"))
        # Lists of one group are in one order: each is taken from the same rows.
        .agg(F.collect_list(F.struct("start", "end", "place")).alias("open"))
        .select(
            "k.id", "k.sign",
            F.col("open.start").alias("firsts"), F.col("open.end").alias("lasts"), F.col("open.place").alias("places"),
        )
    )
    cells = rows.join(still, ["id", "sign"]).mapInArrow(_opened, _CELL)
    spans = settled.filter("key IS NULL").select("id", "sign", "start", "end").unionByName(_told_apart(cells))
    spans = stored(
        spans.groupBy("id", "sign").agg(
            F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")
        ),
        "spans",
    )
    discard(settled)
    return marks.filter("copy").select("id", "sign", "copy").join(spans, ["id", "sign"], "full")


def _marked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = _rows(docs, id_column, text_column)
    return rows.join(removals(rows), ["id", "sign"], "left").select(
        "id", "sign", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts", "ends"
    )


def repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` per document."""
    schema = "id long, sign long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = _marked(docs, id_column, text_column).mapInArrow(_cut(False), schema)
    return found.drop("sign").withColumn("id", F.nullif("id", F.lit(_NO_ID)))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept)`` per document: what went, and the bytes left."""
    found = _marked(docs, id_column, text_column).mapInArrow(_cut(True), _RESULT)
    return found.drop("sign").withColumn("id", F.nullif("id", F.lit(_NO_ID)))


def _strip(columns: list[str], text_column: str, marks: list[str]):
    """Documents with their marks to documents with shorter texts. A character that loses one
    of its bytes goes whole; a null text stays null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_left = []
            for text, copy, starts, ends in zip(
                *[batch.column(c).to_pylist() for c in (text_column, *marks)], strict=True
            ):
                if text is not None and (copy or starts):
                    data = text.encode()
                    if copy:
                        text = "" if len(data) >= LENGTH else text
                    else:
                        a, b = merged(np.array(starts, np.int64), np.array(ends, np.int64))
                        edges = zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)
                        text = "".join(data[x:y].decode("utf-8", "ignore") for x, y in edges)
                texts_left.append(text)
            kept = pa.array(texts_left, batch.schema.field(text_column).type)
            yield pa.RecordBatch.from_arrays(
                [kept if c == text_column else batch.column(c) for c in columns], names=columns
            )

    return run


def strip_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of their texts; all rows and columns stay."""
    tag = free_prefix(docs.columns)
    key, marks = [f"{tag}id", f"{tag}sign"], [f"{tag}copy", f"{tag}starts", f"{tag}ends"]
    found = removals(_rows(docs, id_column, text_column)).toDF(*key, *marks)
    text = F.coalesce(F.col(quoted(text_column)).cast("string"), F.lit(""))
    keyed = docs.withColumns(
        {
            key[0]: F.coalesce(F.col(quoted(id_column)).cast("bigint"), F.lit(_NO_ID)),
            key[1]: F.xxhash64(text),
        }
    )
    return keyed.join(found, key, "left").mapInArrow(_strip(docs.columns, text_column, marks), docs.schema)
