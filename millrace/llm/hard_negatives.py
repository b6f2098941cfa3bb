"""Hard negatives by exact search in multiway hyperplane trees.

Each row's score for an anchor is the inner product of their vectors. With one more coordinate,
that brings every vector of a row to one length ``R`` (0 for an anchor), scores are distances:
``d^2 = |anchor|^2 + R^2 - 2 score``, so a window of scores is an annulus around the anchor.

A tree node has up to ``SPLITS`` split points, far from each other, and deals its rows to the
nearest one. For every pair of split point and subtree it keeps the range of distances between
them. A query is asked with an annulus; by the triangle inequality a subtree can only hold rows
of it if, for each split point, its range meets the distances that the annulus allows there.
Subtrees that do not are eliminated, the others searched, the nearest first, and the annulus
shrinks to the best rows found. Leaves are compared row by row, so the search is exact.

The root's split points come from a bounded sample. Rows are dealt to the nearest, and a cell
with more than ``PIECE`` rows is cut into pieces by a hash, so a task never holds a hot cell;
ranges are those of the rows that a piece has. Anchors are asked of every piece in blocks; a
piece passes on the best few rows of each query, which are merged by an aggregation.

An anchor's positives are searched first, among rows of its label; then each positive's score
gives the window for rows of other labels.

Defined cases: rows with a null label or vector, or a component that is null or not finite, take
no part; neither do vectors of length 2**31 or more, whose scores might not fit a long. A vector that is shorter than another is compared as if it
ended in zeros, so an empty one scores 0. A row is not its own positive, but one with the same
id is; ties go to the smaller id, null last. A null id is not an anchor. Repeated anchors give
their rows each. Scores are exact while they are below 2**53. An empty table gives no rows. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted
from millrace.llm.common import prepare, stored

#: Split points of a node, rows of a leaf, rows sampled for a node's split points.
SPLITS, LEAF, SAMPLE = 16, 256, 64
#: Rows sampled for the root's split points, the most rows of a piece, the least pieces.
ROOT_SAMPLE, PIECE, PIECES = 1024, 32_768, 8
#: Queries that one step looks at together.
TOGETHER = 2048
#: An id after all others, for rows without one.
_LAST = np.iinfo(np.int64).max
#: Distances are rounded: what lies this share of them outside a range is looked at.
_SLACK = 1e-9


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors, vectors)


class Points:
    """Vectors with the coordinate that brings them to one length; distances among them."""

    def __init__(self, vectors: np.ndarray, extra: np.ndarray) -> None:
        self.vectors, self.extra = vectors, extra
        self.norms = _norms(vectors) + extra * extra

    def take(self, rows: np.ndarray) -> "Points":
        return Points(self.vectors[rows], self.extra[rows])

    def distances(self, other: "Points") -> np.ndarray:
        width = min(self.vectors.shape[1], other.vectors.shape[1])
        product = self.vectors[:, :width] @ other.vectors[:, :width].T + np.outer(self.extra, other.extra)
        return np.sqrt(np.maximum(self.norms[:, None] + other.norms - 2 * product, 0))


def on_sphere(vectors: np.ndarray, radius: float) -> Points:
    return Points(vectors, np.sqrt(np.maximum(radius * radius - _norms(vectors), 0)))


def far_apart(points: Points, count: int) -> np.ndarray:
    """Rows of up to ``count`` different points, each far from those before it."""
    chosen = [0]
    nearest = points.distances(points.take(np.array([0])))[:, 0]
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, points.distances(points.take(np.array(chosen[-1:])))[:, 0])
    return np.array(chosen)


@dataclass
class Node:
    """``low[i, j]`` and ``high[i, j]``: distances of split point ``i`` to the rows below ``j``."""

    splits: Points | None
    low: np.ndarray | None
    high: np.ndarray | None
    children: list["Node"]
    rows: np.ndarray


def _ranges(distances: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(count))
    return (
        np.minimum.reduceat(distances[order], begin, axis=0).T,
        np.maximum.reduceat(distances[order], begin, axis=0).T,
    )


def build(points: Points, rows: np.ndarray) -> Node:
    """A tree over ``rows``. A node whose rows are all at one place is a leaf."""
    if len(rows) <= LEAF:
        return Node(None, None, None, [], rows)
    step = max(1, len(rows) // SAMPLE)
    sample = rows[::step]
    splits = points.take(sample[far_apart(points.take(sample), SPLITS)])
    distances = points.take(rows).distances(splits)
    owner = distances.argmin(1)
    used = np.unique(owner)
    if len(used) < 2:
        return Node(None, None, None, [], rows)
    splits, distances = splits.take(used), distances[:, used]
    owner = np.searchsorted(used, owner)
    low, high = _ranges(distances, owner, len(used))
    return Node(splits, low, high, [build(points, rows[owner == j]) for j in range(len(used))], rows[:0])


@dataclass
class Queries:
    """``anchor`` is a query's place among the anchors' points; scores from ``least`` to ``most``."""

    points: Points
    anchor: np.ndarray
    row: np.ndarray
    label: np.ndarray
    least: np.ndarray
    most: np.ndarray
    same: bool
    count: int


class Search:
    """The best rows of one piece for a block of queries."""

    def __init__(self, ids, rows, labels, points: Points, radius: float, queries: Queries) -> None:
        self.ids, self.rows, self.labels, self.points = ids, rows, labels, points
        self.q = queries
        n, k = len(queries.anchor), queries.count
        self.scores = np.full((n, k), -np.inf)
        self.found = np.full((n, k), _LAST)
        self.square = queries.points.norms[queries.anchor] + radius * radius
        self.outside = self._distance(np.arange(n), queries.least)
        self.inside = self._distance(np.arange(n), queries.most)

    def _distance(self, queries: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square[queries] - 2 * score, 0))

    def _reach(self, queries: np.ndarray) -> np.ndarray:
        """The outer radius that is left: rows beyond it are worse than the last one kept."""
        return np.minimum(self.outside[queries], self._distance(queries, self.scores[queries, -1]))

    def alive(self, queries: np.ndarray, distances: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of some subtrees can hold rows of each query's annulus."""
        outer, inner = self._reach(queries), self.inside[queries]
        left = np.ones((len(queries), low.shape[1]), bool)
        for i in range(len(low)):
            d = distances[:, i]
            slack = _SLACK * (1 + d + np.where(np.isfinite(outer), outer, 0))
            nearest = np.maximum(d - outer, inner - d) - slack
            left &= (high[i] >= nearest[:, None]) & (low[i] <= (d + outer + slack)[:, None])
        return left

    def node(self, node: Node, queries: np.ndarray) -> None:
        if not len(queries):
            return
        if not node.children:
            self.leaf(node.rows, queries)
            return
        anchors, inverse = np.unique(self.q.anchor[queries], return_inverse=True)
        distances = self.q.points.take(anchors).distances(node.splits)[inverse]
        nearest = distances.argmin(1)
        for first in (True, False):
            for j, child in enumerate(node.children):
                some = (nearest == j) == first
                left = self.alive(queries[some], distances[some], node.low[:, j : j + 1], node.high[:, j : j + 1])
                self.node(child, queries[some][left[:, 0]])

    def leaf(self, rows: np.ndarray, queries: np.ndarray) -> None:
        anchors, inverse = np.unique(self.q.anchor[queries], return_inverse=True)
        left, right = self.q.points.vectors[anchors], self.points.vectors[rows]
        width = min(left.shape[1], right.shape[1])
        scores = (left[:, :width] @ right[:, :width].T)[inverse]
        fits = (self.labels[rows] == self.q.label[queries][:, None]) == self.q.same
        fits &= self.rows[rows] != self.q.row[queries][:, None]
        fits &= (scores >= self.q.least[queries][:, None]) & (scores <= self.q.most[queries][:, None])
        fits &= scores >= self.scores[queries, -1][:, None]
        at, row = np.nonzero(fits)
        if not len(at):
            return
        # The new rows and those kept so far, the best ones first, each query's first few.
        touched, at = np.unique(at, return_inverse=True)
        query = queries[touched]
        k = self.q.count
        held = np.repeat(np.arange(len(query)), k)
        owner = np.concatenate([held, at])
        score = np.concatenate([self.scores[query].ravel(), scores[touched[at], row]])
        found = np.concatenate([self.found[query].ravel(), self.ids[rows[row]]])
        order = np.lexsort((found, -score, owner))
        begin = np.searchsorted(owner[order], np.arange(len(query)))
        best = order[begin[:, None] + np.arange(k)]
        self.scores[query], self.found[query] = score[best], found[best]


_FOUND = "query bigint, score double, id bigint"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    matrix = np.zeros((len(lengths), width))
    matrix[np.arange(width) < lengths[:, None]] = flat
    return matrix


def _asked(radius: float, splits: np.ndarray, same: bool, count: int) -> Callable:
    """Rows of a piece come before the queries for it: the tree is built, then asked in blocks."""

    def search(tree, low, high, ids, rows, labels, points, batch) -> pa.RecordBatch:
        vectors = _matrix(batch.column("vector"))
        # The queries of an anchor stand together and share its vector.
        row = batch.column("row").to_numpy()
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        queries = Queries(
            Points(vectors[new], np.zeros(int(new.sum()))),
            np.cumsum(new) - 1,
            row,
            batch.column("label").to_numpy(),
            batch.column("least").to_numpy(),
            batch.column("most").to_numpy(),
            same,
            count,
        )
        work = Search(ids, rows, labels, points, radius, queries)
        everything = np.arange(len(row))
        distances = queries.points.distances(on_sphere(splits, radius))[queries.anchor]
        work.node(tree, everything[work.alive(everything, distances, low, high)[:, 0]])
        at, place = np.nonzero(np.isfinite(work.scores))
        found = work.found[at, place]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("query").take(pa.array(at)),
                pa.array(work.scores[at, place]),
                pa.array(found, pa.int64(), mask=found == _LAST),
            ],
            names=["query", "score", "id"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, tree, setting = None, [], None, None
        for batch in batches:
            places = batch.column("piece").to_numpy()
            asks = batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            change = (places[1:] != places[:-1]) | (asks[1:] != asks[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(places)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(begin, end - begin)
                if places[begin] != piece:
                    piece, held, tree, setting = places[begin], [], None, None
                if not asks[begin]:
                    held.append(part)
                    continue
                if not held and tree is None:
                    continue  # a piece without rows
                if tree is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    held = []
                    points = on_sphere(_matrix(table["vector"].combine_chunks()), radius)
                    ids = table["id"].fill_null(_LAST).to_numpy()
                    labels, rows = table["label"].to_numpy(), table["row"].to_numpy()
                    tree = build(points, np.arange(len(ids)))
                    distances = points.distances(on_sphere(splits, radius))
                    low, high = _ranges(distances, np.zeros(len(ids), int), 1)
                    setting = (low, high, ids, rows, labels, points)
                for at in range(0, part.num_rows, TOGETHER):
                    yield search(tree, *setting, part.slice(at, TOGETHER))

    return run


def _best(found: DataFrame, count: int) -> DataFrame:
    """``(query, rank, score, id)``: each query's first rows of those its pieces passed on.

    Spark keeps the first few rows of a query on either side of the shuffle.
    """
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def _prepared(table: DataFrame, id_column: str, vector_column: str, label: Column, scale: float | None) -> DataFrame:
    vector = F.col(quoted(vector_column)).cast("array<double>")
    if scale is not None:
        # A whole number, but as a double: one beyond the range of whole numbers stays what it is.
        scaled = lambda x: x * scale
        vector = F.transform(
            vector, lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
        )
    rows = table.select(
        F.col(quoted(id_column)).cast("bigint").alias("id"), label.cast("bigint").alias("label"), vector.alias("vector")
    )
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)))


def mine_hard_negatives(
    table: DataFrame,
    anchor_step: int,
    label: Column | None = None,
    scale: float | None = None,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``anchor_step``. A positive's negatives are
    the best rows of other labels whose score is within ``window`` hundredths of its own.
    Components are multiplied by ``scale`` and rounded down where that is given.
    """
    spark = prepare(table.sparkSession)
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = F.col(quoted(label_column)) if label is None else label
    rows = _prepared(table, id_column, vector_column, label, scale)
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    rows = rows.withColumn("square", square).filter(F.col("square") < 2.0**62)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).first()
    radius = float(np.sqrt(size["square"] or 0.0))
    sample = rows.select("vector").orderBy(F.xxhash64("row"), "row").limit(ROOT_SAMPLE).toArrow()
    drawn = _matrix(sample["vector"].combine_chunks()) if sample.num_rows else np.zeros((1, 0))
    splits = drawn[far_apart(on_sphere(drawn, radius), SPLITS)]

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        points = on_sphere(_matrix(pa.array(vectors, pa.list_(pa.float64()))), radius)
        return pd.Series(points.distances(on_sphere(splits, radius)).argmin(1).astype(np.int32))

    placed = stored(rows.withColumn("cell", nearest("vector")).select("id", "label", "row", "vector", "cell"), "placed")
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(1, min(PIECE, -(-size["n"] // PIECES)))
    shares = {cell: -(-n // most) for cell, n in counts.items()}
    begin = dict(zip(shares, np.cumsum([0, *shares.values()]).tolist(), strict=False))
    pieces = sum(shares.values())
    if not pieces:
        return spark.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        )
    of_cell = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("cell")]
    piece = (of_cell(begin) + F.pmod(F.xxhash64(F.lit(7), "row"), of_cell(shares))).cast("int")
    order = ["piece", "query", "row", "id", "label", "vector", "least", "most"]
    data = placed.withColumn("piece", piece).withColumns(
        {name: F.lit(None).cast(kind) for name, kind in (("query", "bigint"), ("least", "double"), ("most", "double"))}
    )

    def search(queries: DataFrame, same: bool, count: int) -> DataFrame:
        """``queries``: row, label, vector, query, least and most score."""
        asked = queries.withColumn("id", F.lit(None).cast("bigint")).withColumn(
            "piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
        )
        both = data.select(order).unionByName(asked.select(order))
        dealt = both.repartition(max(places, pieces), "piece").sortWithinPartitions("piece", F.col("query").isNotNull(), "row", "query")
        found = dealt.mapInArrow(_asked(radius, splits, same, count), _FOUND)
        return stored(_best(found, count), "found")

    anchors = placed.filter(F.col("id") % anchor_step == 0).select("row", "id", "label", "vector")
    first = search(
        anchors.select(
            "row", "label", "vector", F.col("row").alias("query"),
            F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most"),
        ),
        True,
        positives,
    )
    pairs = first.select(
        F.col("query").alias("row"),
        F.col("rank").alias("positive_rank"),
        F.col("id").alias("positive_id"),
        F.col("score").cast("bigint").alias("positive_score"),
    )
    # Scores are whole numbers, so the limits are.
    low, high = window
    score = F.col("positive_score").cast("decimal(38,0)")
    limits = pairs.select(
        "*",
        F.ceil(score * low / 100).cast("double").alias("least"),
        F.floor(score * high / 100).cast("double").alias("most"),
    )
    asked = stored(
        limits.join(anchors.withColumnRenamed("id", "anchor_id"), "row").withColumn("query", F.monotonically_increasing_id()),
        "asked",
    )
    second = search(asked.filter("least <= most").select("row", "label", "vector", "query", "least", "most"), False, negatives)
    return asked.join(second, "query").select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").cast("bigint").alias("negative_score"),
    )
