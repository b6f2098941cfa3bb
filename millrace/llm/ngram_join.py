"""Jaccard self-join on word shingles, indexed by count vectors in an R-tree.

A document is the set of its distinct five-word shingles. Shingles are hashed into groups, and
a document is the point of its group counts. For two points the overlap of the sets is at most
the sum of the smaller coordinates, so a pair, or two tree nodes by their upper corners, that
cannot reach the overlap that the threshold asks for is left out; what survives is verified on
the shingles themselves.

Coarse counts alone do not separate texts at scale: sums over many groups concentrate, and
every query would visit every node. The top of the tree is therefore cut along fine groups, one
for each hash value. In an order by rarity, the coordinates after the first
``n - ceil(0.8 n) + 1`` sum to less than the overlap needed, so two linked documents have one
of their first coordinates in common: a cell. Cells are found with one shuffle of twelve bytes
an entry. Below a cell the tree is packed by size and compared node by node.

Groups of copies do not make pairs. Equal sets are one class from the start. Then every member
of a cell is compared with one other (a star), which joins near copies into components; only
pairs from different components are left to compare, and cells with the same members are looked
at once. A cell with very many members is dealt in blocks, each pair of blocks to some task.
No links, components or sets of all documents come to the driver, only group totals of fixed
size.

Defined cases: fewer than five words make one shingle of the whole sequence; null and empty
texts have no shingles and link with nothing; every row is judged by its own text, whatever rows
share its id or have none; ids only name components, whose name is null if no row of it has an
id; an empty table gives no rows. Only the named columns are read, and texts are read whole.
Inside, a row goes by a 64-bit hash of its id and text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted
from millrace.llm.common import Words, components, free_prefix, mix64, prepare, steps, stored

SHINGLE = 5
#: The threshold as a fraction of integers, so that no rounding decides.
THRESHOLD = (4, 5)
#: Groups of the rarity order (one total each, a fixed four megabytes) and of the points.
RARITY_BITS = 20
GROUPS = 256
#: The highest coordinate that is kept: a point that reaches it is never left out.
MOST = 65535
#: Entries that a task sorts at a time, entries of a bucket, members of a block of a cell.
ENTRIES_PER_SORT = 1 << 20
ENTRIES_PER_BUCKET = 400_000
MEMBERS_PER_BLOCK = 2048
#: Points of a leaf of the tree.
LEAF = 32
#: Partners of one document that one task verifies.
PARTNERS_PER_TASK = 64

_U64 = np.uint64
_FACTORS = mix64(np.arange(11, 11 + SHINGLE, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)
_CELL = _U64(0xA0761D6478BD642F)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of a run of texts, in order, and where each text's begin."""
    many = np.diff(words.first)
    count = np.where(many >= SHINGLE, many - SHINGLE + 1, np.minimum(many, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(first[-1], np.uint64)
    full = np.repeat(many >= SHINGLE, count)
    owner = np.repeat(np.arange(len(many)), count)
    at = words.first[owner] + np.arange(first[-1]) - first[owner]
    code = np.zeros(int(full.sum()), np.uint64)
    for k in range(SHINGLE):
        code += words.hashes[at[full] + k] * _FACTORS[k]
    out[full] = mix64(code)
    for i in np.flatnonzero((many > 0) & (many < SHINGLE)):
        part = words.hashes[words.first[i] : words.first[i + 1]]
        code = (part * _FACTORS[: len(part)]).sum(dtype=np.uint64) + _U64(len(part))
        out[first[i]] = mix64(np.array([code], np.uint64))[0]
    return out, first


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, first = shingles(Words(data, offsets))
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def needed(a, b):
    """The least overlap of sets of sizes ``a`` and ``b`` that are linked."""
    p, q = THRESHOLD
    return -(-(p * (a + b)) // (p + q))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum()) >= needed(len(a), len(b))


# -- rarity ---------------------------------------------------------------------------------

_BLOCKS = 64
_BLOCK = (1 << RARITY_BITS) // _BLOCKS


def _count_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(1 << RARITY_BITS, np.int64)
    for _, data, offsets in steps(batches):
        hashes, _ = shingles(Words(data, offsets))
        totals += np.bincount((hashes >> _U64(64 - RARITY_BITS)).astype(np.int64), minlength=1 << RARITY_BITS)
    if totals.any():
        parts = np.minimum(totals, 0xFFFFFFFF).astype("<u4").reshape(_BLOCKS, _BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(_BLOCKS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["block", "counts"],
        )


def _add_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(counts.as_buffer(), "<u4").astype(np.uint64)
            totals[block] = totals[block] + part if block in totals else part
    if totals:
        capped = [np.minimum(t, 0xFFFFFFFF).astype("<u4").tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array(capped, pa.binary())], names=["block", "counts"]
        )


def group_totals(rows: DataFrame) -> np.ndarray:
    """How many shingles of all documents fall in each group: a fixed number of totals."""
    schema = "block int, counts binary"
    partial = rows.select("text").mapInArrow(_count_groups, schema)
    summed = partial.repartition(_BLOCKS, "block").mapInArrow(_add_blocks, schema)
    totals = np.zeros(1 << RARITY_BITS, np.uint32)
    for row in summed.collect():
        totals[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["counts"], "<u4")
    return totals


# -- points and entries ---------------------------------------------------------------------


def prefix(found: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the order by rarity, as many as must be looked at."""
    p, q = THRESHOLD
    n = len(found)
    many = n - -(-p * n // q) + 1
    rarity = np.minimum(totals[(found >> _U64(64 - RARITY_BITS)).astype(np.int64)], (1 << 24) - 1)
    order = np.argsort((rarity.astype(np.uint64) << _U64(40)) | (found >> _U64(24)), kind="stable")
    return found[order[:many]]


_POINTS = "id long, doc long, n long, sign1 long, sign2 long, point binary, cells binary"


def _points(totals):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            out = []
            for found in shingle_sets(data, offsets):
                point = np.minimum(np.bincount((found & _U64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), MOST)
                cells = mix64(prefix(found, totals.value) ^ _CELL) if len(found) else found
                signs = found.sum(dtype=np.uint64), (mix64(found ^ _U64(77))).sum(dtype=np.uint64)
                out.append((len(found), *np.array(signs, np.uint64).view(np.int64).tolist(), point.astype("<u2").tobytes(), cells.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("doc"), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]],
                names=["id", "doc", "n", "sign1", "sign2", "point", "cells"],
            )

    return run


_TRIPLE = np.dtype([("key", "<i8"), ("a", "<i8"), ("b", "<i8")])


def _entries(buckets: int):
    """Entries of the documents, dealt to buckets: key and id of the first document of a key in
    this run of documents, and a pair of documents for each further one."""

    def flush(cells: list, ids: list) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(cells)
        owner = np.repeat(np.array(ids, np.int64), [len(c) for c in cells])
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        bucket = ((hashes >> _U64(32)) % _U64(buckets)).astype(np.int64)
        short = (hashes & _U64(0xFFFFFFFF)).astype("<u4")
        hub = owner[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        rows = []
        for is_first in (True, False):
            chosen = np.flatnonzero(first if is_first else hub != owner)
            chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
            if not len(chosen):
                continue
            b = bucket[chosen]
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            for start, end in zip(cut, np.append(cut[1:], len(b)), strict=True):
                part = chosen[start:end]
                if is_first:
                    rows.append((int(b[start]), short[part].tobytes(), owner[part].astype("<i8").tobytes(), b""))
                else:
                    triples = np.empty(len(part), _TRIPLE)
                    triples["key"] = (b[start] << 32) | short[part].astype(np.int64)
                    triples["a"], triples["b"] = hub[part], owner[part]
                    rows.append((int(b[start]), b"", b"", triples.tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for i in range(0, len(rows), 64):
            part = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in part], t) for k, t in enumerate(kinds)],
                names=["bucket", "keys", "ids", "pairs"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, ids, held = [], [], 0
        for batch in batches:
            for doc_id, cell in zip(batch.column("id").to_pylist(), batch.column("cells"), strict=True):
                cells.append(np.frombuffer(cell.as_buffer(), "<u8").astype(np.uint64))
                ids.append(doc_id)
                held += len(cells[-1])
                if held >= ENTRIES_PER_SORT:
                    yield from flush(cells, ids)
                    cells, ids, held = [], [], 0
        if cells:
            yield from flush(cells, ids)

    return run


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each cell: its first document with every other. Rows come by bucket."""
    names = ["key", "a", "b"]

    def batch_of(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b)], names=names)

    def close(bucket, keys, ids):
        short, owner = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((owner, short))
        short, owner = short[order], owner[order]
        first = np.concatenate([[True], short[1:] != short[:-1]])
        hub = owner[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        rest = np.flatnonzero(hub != owner)
        key = (np.int64(bucket) << np.int64(32)) | short[rest].astype(np.int64)
        return batch_of(key, hub[rest], owner[rest])

    at, keys, ids = None, [], []
    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        for bucket, key, owner, pairs in zip(columns[0].to_pylist(), *columns[1:], strict=True):
            if bucket != at and keys:
                yield close(at, keys, ids)
                keys, ids = [], []
            at = bucket
            if len(key.as_buffer()):
                keys.append(np.frombuffer(key.as_buffer(), "<u4"))
                ids.append(np.frombuffer(owner.as_buffer(), "<i8"))
            if len(pairs.as_buffer()):
                found = np.frombuffer(pairs.as_buffer(), _TRIPLE)
                yield batch_of(*[np.ascontiguousarray(found[name]) for name in names])
    if keys:
        yield close(at, keys, ids)


# -- bound and verification -----------------------------------------------------------------


def points_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, GROUPS)


def reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most that the sets of points, or of nodes by their upper corners, can overlap."""
    total = np.minimum(a, b).sum(-1, dtype=np.int64)
    if (a == MOST).any() and (b == MOST).any():
        total[((a == MOST).any(-1) & (b == MOST).any(-1))] = np.iinfo(np.int64).max
    return total


def _within_reach(pairs: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose points allow a link: ``(a, b, n_a, n_b, point_a, point_b)``."""
    for batch in pairs:
        if not batch.num_rows:
            continue
        sizes = [batch.column(name).to_numpy() for name in ("n_a", "n_b")]
        good = reach(points_of(batch.column("point_a")), points_of(batch.column("point_b"))) >= needed(*sizes)
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by hub: its own text first, then its partners' texts."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch, data, offsets in steps(batches):
        sets = shingle_sets(data, offsets)
        found = []
        for a, salt, b, one in zip(
            batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("b").to_pylist(), sets, strict=True
        ):
            if b is None:
                hub, own = (a, salt), one
            elif hub == (a, salt) and linked(own, one):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"]
        )


def verified(pairs: DataFrame, points: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """The links among distinct ``pairs (a, b)``: first by the bound, then on the shingles.

    A partner's text goes to its hub's task, and a hub with many partners has several.
    """
    own = points.select("id", "n", "point")
    near = (
        pairs.join(own.toDF("a", "n_a", "point_a"), "a")
        .join(own.toDF("b", "n_b", "point_b"), "b")
        .filter("5 * n_a >= 4 * n_b AND 5 * n_b >= 4 * n_a")
        .mapInArrow(_within_reach, "a long, b long")
    )
    near = stored(near, f"{label}-near")
    degree = near.groupBy(F.struct("a").alias("k")).agg(F.count(F.lit(1)).alias("degree")).select("k.a", "degree")
    tasks = F.ceil(F.col("degree") / PARTNERS_PER_TASK).cast("bigint")
    dealt = near.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), tasks).alias("salt"))
    hubs = degree.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), tasks - 1)).alias("salt"))
    asked = dealt.select("a", "salt", "b", F.col("b").alias("id")).unionByName(
        hubs.select("a", "salt", F.lit(None).cast("bigint").alias("b"), F.col("a").alias("id"))
    )
    sent = asked.join(rows, "id").select("a", "salt", "b", "text")
    links = (
        sent.repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        .mapInArrow(_verify, "a long, b long")
    )
    return stored(links, f"{label}-links")


# -- the tree below a cell ------------------------------------------------------------------


def tree_pairs(sizes: np.ndarray, points: np.ndarray, group: np.ndarray, side: np.ndarray | None = None):
    """Index pairs of points of different groups that the bounds let through, with the bound
    as a multiple of the overlap needed.

    Points are packed into leaves by size and first coordinates; leaf corners are compared
    first, then the points of leaves that may hold a link. ``side``, if given, are the blocks
    of the points, and pairs of two points of one block are left out.
    """
    order = np.lexsort((points[:, 1], points[:, 0], sizes))
    n = len(order)
    cuts = np.arange(0, n, LEAF)
    ordered, size, kind = points[order], sizes[order], group[order]
    low, high = np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts)
    corner = np.maximum.reduceat(ordered, cuts, axis=0)
    same_low, same_high = np.minimum.reduceat(kind, cuts), np.maximum.reduceat(kind, cuts)
    p, q = THRESHOLD
    for i in range(len(cuts)):
        # Leaves are in the order of size: those from i on, as far as sizes may go together.
        last = int(np.searchsorted(p * low, q * high[i], side="right"))
        others = np.arange(i, max(last, i + 1))
        possible = reach(corner[others], corner[i][None]) >= needed(low[i], low[others])
        alone = (same_low[i] == same_high[i]) & (same_low[others] == same_high[others]) & (same_low[others] == same_low[i])
        for j in others[possible & ~alone]:
            x, y = np.arange(cuts[i], min(cuts[i] + LEAF, n)), np.arange(cuts[j], min(cuts[j] + LEAF, n))
            most = reach(ordered[x][:, None, :], ordered[y][None, :, :])
            good = (most >= needed(size[x][:, None], size[y][None, :])) & (kind[x][:, None] != kind[y][None, :])
            if i == j:
                good &= x[:, None] < y[None, :]
            if side is not None:
                good &= side[order][x][:, None] != side[order][y][None, :]
            a, b = np.nonzero(good)
            if len(a):
                yield order[x[a]], order[y[b]], most[a, b] / needed(size[x[a]], size[y[b]])


def _cell_pairs(best: bool):
    """Rows come sorted by cell and block pair: ``key, i, j, block, id, n, group, point``.

    With ``best`` only the most promising pair of any two components is given.
    """

    def close(at, held):
        ids, sizes, groups = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
        points, blocks = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        side = blocks if at[1] != at[2] else None
        found = list(tree_pairs(sizes, points, groups, side))
        if not found:
            return
        a, b, score = (np.concatenate([f[k] for f in found]) for k in range(3))
        if best:
            low, high = np.minimum(groups[a], groups[b]), np.maximum(groups[a], groups[b])
            order = np.lexsort((-score, high, low))
            new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            a, b = a[order[new]], b[order[new]]
        x, y = ids[a], ids[b]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(name).to_numpy() for name in ("key", "i", "j")], 1)
            ids, n, group, block = (batch.column(name).to_numpy() for name in ("id", "n", "component_id", "block"))
            points = points_of(batch.column("point"))
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            for start, end in zip(cut, np.append(cut[1:], len(ids)), strict=True):
                here = tuple(keys[start].tolist())
                if here != at and held:
                    yield from close(at, held)
                    held = []
                at = here
                held.append((ids[start:end], n[start:end], group[start:end], points[start:end], block[start:end]))
        if held:
            yield from close(at, held)

    return run


def across_components(stars: DataFrame, group: DataFrame, points: DataFrame, best: bool) -> DataFrame:
    """Pairs of one cell but different components that the bounds let through.

    With ``best`` one pair for any two components of a cell: most components that belong
    together do so by many links, and one is enough to join them.
    """
    marked = stars.join(group.toDF("a", "group_a"), "a", "left").join(group.toDF("b", "group_b"), "b", "left")
    split = marked.filter(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("key").distinct()
    inside = stars.join(split, "key", "left_semi")
    members = inside.select("key", F.col("a").alias("id")).unionByName(inside.select("key", F.col("b").alias("id"))).distinct()
    members = stored(members, "members")
    # Cells with the same members are one.
    mark = F.xxhash64("id")
    cells = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"),
        F.sum(mark.cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64(F.lit(5), "id")).alias("x"),
        F.min("id").alias("low"),
        F.max("id").alias("high"),
    )
    cells = cells.groupBy("many", "s", "x", "low", "high").agg(F.min("key").alias("key"))
    cells = stored(cells.select("key", F.ceil(F.col("many") / MEMBERS_PER_BLOCK).cast("int").alias("blocks")), "cells")
    placed = (
        members.join(cells, "key")
        .join(points.select("id", "n", "point"), "id")
        .join(group, "id", "left")
        .withColumn("component_id", F.coalesce("component_id", "id"))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )
    return (
        placed.select("key", "i", "j", "block", "id", "n", "component_id", "point")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_cell_pairs(best), "a long, b long")
        .distinct()
    )


def _key(id_column: str, text_column: str):
    """What a row goes by inside."""
    return F.xxhash64(F.col(quoted(id_column)).cast("bigint"), F.lit("|"), F.col(quoted(text_column)).cast("string"))


def _grouped(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows ``(id, doc, n, sign1, sign2)``, ``id`` being the row's key and ``doc`` its id;
    and the group of each set: ``(sign1, sign2, n, group)``."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        _key(id_column, text_column).alias("id"),
        F.col(quoted(id_column)).cast("bigint").alias("doc"),
        F.coalesce(F.col(quoted(text_column)).cast("string"), F.lit("")).alias("text"),
    )
    totals = spark.sparkContext.broadcast(group_totals(rows))
    points = stored(rows.mapInArrow(_points(totals), _POINTS), "points")
    # Documents with one set are one class, which its smallest key stands for.
    signs = ["sign1", "sign2", "n"]
    classes = stored(points.filter("n > 0").groupBy(*signs).agg(F.min("id").alias("class_id")), "classes")
    standing = points.join(classes.withColumnRenamed("class_id", "id"), ["id", *signs], "left_semi")
    # Repeated rows have one key. Only these have to be found out before texts are sent.
    repeated = stored(points.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id"), "repeated")
    rows = rows.select("id", "text")
    if not repeated.isEmpty():
        standing = standing.dropDuplicates(["id"])
        rows = rows.join(repeated, "id", "left_anti").unionByName(
            rows.join(repeated, "id", "left_semi").dropDuplicates(["id"])
        )
    entries = classes.agg(F.sum("n")).first()[0] or 0
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(places, int(entries / THRESHOLD[1] / ENTRIES_PER_BUCKET) + 1)
    standing = stored(standing.select("id", "n", "point", "cells"), "standing")
    stars = (
        standing.select("id", "cells")
        .mapInArrow(_entries(buckets), "bucket int, keys binary, ids binary, pairs binary")
        .repartition(places, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_stars, "key long, a long, b long")
    )
    stars = stored(stars, "stars")
    standing = standing.drop("cells")
    pairs = stored(stars.select("a", "b").distinct(), "pairs")
    links = verified(pairs, standing, rows, "star")
    for label, best in (("best", True), ("cross", False)):
        group = stored(components(links, label), "groups")
        more = across_components(stars, group, standing, best).join(pairs, ["a", "b"], "left_anti")
        more = stored(more, "pairs")
        links = links.unionByName(verified(more, standing, rows, label))
        pairs = pairs.unionByName(more)
    group = components(links, "all").withColumnsRenamed({"id": "class_id", "component_id": "group"})
    named = classes.join(group, "class_id", "left").select(*signs, F.coalesce("group", "class_id").alias("group"))
    return points.select("id", "doc", *signs), named


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` per document, components being those of all links."""
    points, named = _grouped(docs, id_column, text_column)
    signs = ["sign1", "sign2", "n"]
    named = stored(named, "named")
    # A set's smallest id first: a group of copies is one row of the next step.
    least = points.groupBy(F.struct(*signs).alias("k")).agg(F.min("doc").alias("doc")).select("k.*", "doc")
    names = named.join(least, signs).groupBy(F.struct("group").alias("k")).agg(F.min("doc").alias("component_id"))
    classes = named.join(names.select("k.group", "component_id"), "group").select(*signs, "component_id")
    return points.join(classes, signs, "left").select(
        F.col("doc").alias("id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the smallest id, rows without one last.

    Documents without shingles link with nothing and stay, repeated or not. Of repeated rows of
    one id and text the one with the smallest hash of all columns stays.
    """
    points, named = _grouped(docs, id_column, text_column)
    signs = ["sign1", "sign2", "n"]
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "id")
    first = points.groupBy(F.struct(*signs).alias("k")).agg(F.min(order).alias("row"))
    first = first.select("k.*", "row").join(named, signs)
    chosen = first.groupBy("group").agg(F.min("row").alias("row")).select("row.id")
    alone = points.filter("n = 0").select("id").distinct().withColumn("whole", F.lit(True))
    counts = points.join(chosen, "id", "left_semi").groupBy(F.struct("id").alias("k")).agg(F.count(F.lit(1)).alias("many"))
    kept = stored(counts.select("k.id", (F.col("many") == 1).alias("whole")).unionByName(alone), "kept")
    tag = free_prefix(docs.columns)
    keyed = docs.withColumn(f"{tag}key", _key(id_column, text_column))
    columns = [F.col(quoted(c)) for c in docs.columns]
    names = lambda whole: kept.filter("whole" if whole else "NOT whole").select(F.col("id").alias(f"{tag}key"))
    single = keyed.join(names(True), f"{tag}key", "left_semi").select(columns)
    many = (
        keyed.join(names(False), f"{tag}key", "left_semi")
        .groupBy(f"{tag}key")
        .agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(f"{tag}row"))
    )
    return single.unionByName(many.select(*[F.col(f"{tag}row")[c].alias(c) for c in docs.columns]))
