"""Hard negatives against a comparison of all rows."""

import math
import random

import numpy as np
import pytest

from millrace.llm import hard_negatives
from millrace.llm.hard_negatives import mine_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, piece int, query long, id long, square double"


def slow(rows, step):
    usable = [
        (k, i, [float(math.floor(256.0 * x)) for x in v], label)
        for k, (i, v, label) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = lambda c: (-c[0], c[1] is None, c[1] or 0)
    found = []
    for k, i, v, label in usable:
        if i is None or i % step:
            continue
        scored = [(int(sum(a * b for a, b in zip(v, w))), j, other) for r, j, w, other in usable if r != k]
        positives = sorted((c for c in scored if c[2] == label), key=order)[:5]
        for score, j, _ in positives:
            hard = sorted((c for c in scored if c[2] != label and 50 * score <= 100 * c[0] <= 95 * score), key=order)
            found += [(i, j, n + 1, c[1], score, c[0]) for n, c in enumerate(hard[:3])]
    return sorted(found, key=repr)


def mined(spark, rows, step=5):
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4, 5.0) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in mine_hard_negatives(frame, step, scale=256.0).collect()), key=repr)


def vector(rng, width=6):
    v = [rng.gauss(0, 1) for _ in range(width)]
    n = math.sqrt(sum(x * x for x in v))
    return [float(np.float32(x / n)) for x in v]


@pytest.mark.parametrize("leaf, splits, together", [(256, 16, 2048), (4, 3, 7)])
def test_all_pairs_of_anchors_and_positives(spark, monkeypatch, leaf, splits, together):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "SPLITS", splits)
    monkeypatch.setattr(hard_negatives, "TOGETHER", together)
    rng = random.Random(3)
    rows = [(i, vector(rng), rng.randrange(3)) for i in range(260)]
    rows += [(i, rows[0][1], 1) for i in range(260, 330)]  # a group of copies of an anchor
    assert mined(spark, rows) == slow(rows, 5)


def test_odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, vector(rng, 3), rng.randrange(2)) for i in range(60)]
    rows += [
        (60, None, 1), (65, [], 1), (70, [None, 1.0, 0.0], 1), (75, [float("nan"), 0.0, 0.0], 0),
        (80, [float("inf"), 0.0, 0.0], 0), (85, [0.0, 0.0, 0.0], 1), (90, [0.5, 0.5, 0.1], None), (95, [0.5], 0),
        (100, [0.5, 0.25, 0.125, 3.0], 1), (None, [0.5, 0.5, 0.5], 1), (None, [0.5, 0.5, 0.5], 0), (-5, [0.1, 0.9, 0.1], 0),
        (10, [0.5, 0.5, 0.5], 0), (10, [0.5, 0.5, 0.5], 0), (11, [0.5, 0.5, 0.5], 1), (12, [-9.0, 8.5, -3.25], 1),
    ]
    assert mined(spark, rows) == slow(rows, 5)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == []
    assert mined(spark, [(5, [1.0], 0)]) == []
    assert mined(spark, [(5, [], 0), (6, [], 0), (7, [], 1)]) == [(5, 6, 1, 7, 0, 0)]


def test_subtrees_are_eliminated():
    """Clustered points: a query near one cluster compares a small share of the rows."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8)) * 20
    vectors = np.repeat(centres, 200, axis=0) + rng.normal(size=(6_000, 8)) * 0.1
    radius = float(np.sqrt((vectors**2).sum(1).max()))
    points = hard_negatives.on_sphere(vectors, radius)
    rows = np.arange(6_000)
    tree = hard_negatives.build(points, rows)
    queries = hard_negatives.Queries(
        hard_negatives.Points(vectors[:1], np.zeros(1)), np.zeros(1, int), np.array([0]), np.array([0]),
        np.array([-np.inf]), np.array([np.inf]), True, 5,
    )
    work = hard_negatives.Search(rows, rows, np.zeros(6_000, int), points, radius, queries)
    seen = []
    leaf = work.leaf
    work.leaf = lambda r, q: (seen.append(len(r)), leaf(r, q))
    work.node(tree, np.arange(1))
    scores = vectors @ vectors[0]
    scores[0] = -np.inf
    assert work.found[0].tolist() == np.lexsort((rows, -scores))[:5].tolist()
    assert sum(seen) < 3_000
