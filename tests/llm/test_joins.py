"""Near-duplicate operators against brute force."""

import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, embedding_dedup, ngram_join, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def united(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def groups_by_hand(rows):
    """The group of each row, by its place; every row stands for itself."""
    sets = [shingles(text) for _, text in rows]
    links = [
        (x, y)
        for x in range(len(rows))
        for y in range(x)
        if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    ]
    return united(range(len(rows)), links)


def components_by_hand(rows):
    groups = groups_by_hand(rows)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[groups[k]] = min(names.get(groups[k], i), i)
    return [(i, len(shingles(t)), names.get(groups[k])) for k, (i, t) in enumerate(rows)]


def check_join(frame, rows):
    found = [tuple(r) for r in ngram_join.similar_documents(frame).collect()]
    assert sorted(found, key=repr) == sorted(components_by_hand(rows), key=repr)


def test_join_on_odd_rows(frame_of, odd_texts):
    check_join(frame_of(odd_texts), odd_texts)


def test_join_of_an_empty_table(frame_of):
    assert ngram_join.similar_documents(frame_of([])).collect() == []
    assert ngram_join.one_of_each(frame_of([])).collect() == []


def test_join_of_families_of_near_copies(frame_of, monkeypatch):
    """Chains of edits, so that components have members that are not linked; small blocks."""
    monkeypatch.setattr(ngram_join, "MEMBERS_PER_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "ENTRIES_PER_SORT", 300)
    rng = random.Random(9)
    rows, number = [], 0
    for _ in range(4):
        words = [str(rng.randint(0, 10**6)) for _ in range(100)]
        for _ in range(30):
            copy = list(words)
            for _ in range(rng.choice([1, 2, 3, 4])):
                copy[rng.randrange(100)] = str(rng.randint(0, 10**6))
            rows.append((number, " ".join(copy)))
            number += 1
            if rng.random() < 0.3:
                words = copy
    check_join(frame_of(rows), rows)


def kept_by_hand(rows):
    groups = groups_by_hand(rows)
    kept = []
    for group in set(groups.values()):
        members = [rows[k] for k in groups if groups[k] == group]
        least = min((m[0] for m in members if m[0] is not None), default=None)
        kept.append((least, {m[1] for m in members if m[0] == least}))
    return kept


def test_one_of_each_keeps_documents_that_stand_alone(frame_of, odd_texts):
    found = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(frame_of(odd_texts)).collect()]
    expected = kept_by_hand(odd_texts)
    assert len(found) == len(expected)
    for i, texts in expected:
        hit = next(f for f in found if f[0] == i and f[1] in texts)
        found.remove(hit)


def test_rows_without_ids_are_judged_by_their_texts(spark, frame_of):
    """A third of the rows has no id: near copies are found, rows that nothing is like stay."""
    rng = random.Random(12)
    draw = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(60))
    texts = [draw() for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, draw()) for _ in range(20)]
    rows += [(None, texts[i] + " tail") for i in range(5)] + [(None, "same text of nobody at all")] * 3
    rows += [(7, draw()), (7, texts[30] + " tail"), (None, ""), (None, ""), (None, None)]
    check_join(frame_of(rows), rows)
    found = ngram_join.one_of_each(frame_of(rows)).collect()
    # 60 texts, 20 alone, one of nobody's three, one of two rows of document 7, three empty ones.
    assert len(found) == 60 + 20 + 1 + 1 + 3
    assert sum(r["doc_id"] is None for r in found) == 20 + 1 + 3


def test_bound_never_lies():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64)
        b = np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64)
        points = [np.bincount((x % 16).astype(int), minlength=16).astype(np.uint16) for x in (a, b)]
        assert ngram_join.reach(*points) >= len(np.intersect1d(a, b))
        both = len(np.intersect1d(a, b))
        assert ngram_join.linked(a, b) == (100 * both >= 80 * (len(a) + len(b) - both))


def removed_by_hand(rows):
    first = {}
    order = [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    for i, data in order:
        for k in range(len(data) - 49):
            text = data[k : k + 50]
            first[text] = min(first.get(text, math.inf), i)
    out = []
    for i, data in order:
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        out.append((i, bytes(c for c, g in zip(data, gone, strict=True) if not g), sum(gone), bytes(gone)))
    return out


def test_repeated_bytes_on_odd_rows(frame_of, odd_texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    monkeypatch.setattr(suffix_dedup, "ENTRIES_PER_SORT", 64)
    found = suffix_dedup.without_repeats(frame_of(odd_texts)).collect()
    got = sorted(
        (math.inf if r["id"] is None else r["id"], bytes(r["kept"]), r["n_removed"],
         [(s["start"], s["end"]) for s in r["spans"]])
        for r in found
    )
    expected = sorted(
        (i, kept, n, [m.span() for m in re.finditer(rb"\x01+", gone)])
        for i, kept, n, gone in removed_by_hand(odd_texts)
    )
    assert got == expected


def test_strip_keeps_rows_columns_and_whole_characters(frame_of, odd_texts):
    frame = frame_of(odd_texts)
    found = suffix_dedup.strip_repeats(frame)
    assert found.dtypes == frame.dtypes
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in found.collect())
    assert len(left) == len(odd_texts)
    by_hand = {(i is math.inf, 0 if i is math.inf else i): kept for i, kept, _, _ in removed_by_hand(odd_texts)}
    assert all(len(text.encode()) <= len(by_hand[none, i]) for none, i, text in left if i not in (0, 19))


def test_repeats_in_an_empty_table(frame_of):
    assert suffix_dedup.repeated_bytes(frame_of([])).collect() == []


def test_anchors_cover_every_string_in_small_pieces(monkeypatch):
    rng = random.Random(3)
    phrases = ["".join(rng.choices("abcde ", k=rng.randint(1, 90))) for _ in range(40)]
    parts = ["".join(rng.choices(phrases, k=rng.randint(0, 60))) for _ in range(400)] + ["x" * 500, "", "ab" * 400, ""]
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, parts)])
    starts = [p for a, b in itertools.pairwise(offsets) for p in range(a, b - suffix_dedup.LENGTH + 1)]
    seen = []
    for piece in (700, suffix_dedup.PIECE):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        text, key, first, last, place, alike = suffix_dedup.anchors(data, offsets)
        assert ((first <= place) & (last + suffix_dedup.LENGTH >= place + suffix_dedup.SEED)).all()
        assert (alike == common.span_hashes(common._BYTE[data], first, last + suffix_dedup.LENGTH)).all()
        assert (offsets[text] <= first).all() and (last + suffix_dedup.LENGTH <= offsets[text + 1]).all()
        assert [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)] == starts
        which = np.repeat(np.arange(len(first)), last - first + 1)
        seen.append(list(zip(key[which].tolist(), (place[which] - starts).tolist(), strict=True)))
    assert seen[0] == seen[1]
    anchor_of = {}
    for p, anchor in zip(starts, seen[0], strict=True):
        assert anchor_of.setdefault(data[p : p + suffix_dedup.LENGTH].tobytes(), anchor) == anchor


def test_anchors_work_in_little_memory():
    # The arrays of a step of texts are a piece's, whatever the step's size.
    data = np.random.default_rng(1).integers(97, 123, 1 << 20, dtype=np.uint8)
    offsets = np.arange(0, len(data) + 1, 2048)
    tracemalloc.start()
    suffix_dedup.anchors(data, offsets)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 20 * len(data)


def test_rounds_with_phrases_in_every_document(spark, frame_of):
    """Phrases shorter than a string, of many lengths, in other surroundings each time."""
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    phrases = [draw(n) for n in (24, 30, 37, 44, 47, 48, 49, 50, 51, 60, 75, 76)]
    rows = []
    for i in range(120):
        parts = [piece for phrase in rng.sample(phrases, 4) for piece in (draw(rng.randint(0, 40)), phrase)]
        rows.append((i if i % 3 else None if i % 2 else i, "".join(parts)))
    rows += [(7, rows[20][1][:70]), (8, rows[20][1][:70]), (200, "ab" * 100), (201, "ab" * 30)]
    found = suffix_dedup.without_repeats(frame_of(rows)).collect()
    got = sorted(
        (math.inf if r["id"] is None else r["id"], bytes(r["kept"]), r["n_removed"],
         [(s["start"], s["end"]) for s in r["spans"]])
        for r in found
    )
    expected = sorted(
        (i, kept, n, [m.span() for m in re.finditer(rb"\x01+", gone)])
        for i, kept, n, gone in removed_by_hand(rows)
    )
    assert got == expected and sum(r[2] for r in got) > 1_000


def test_a_hot_phrase_is_spread(spark, monkeypatch):
    """A phrase of 30 bytes in every document: its open strings are dealt by their cores."""
    rng = random.Random(10)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    phrase = draw(30)
    rows = [(i, draw(60) + phrase + draw(60)) for i in range(2_000)]
    seen = []
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, label: seen.append((label, kept := common.stored(df, label))) or kept)
    monkeypatch.setattr(suffix_dedup, "discard", lambda *frames: None)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_dedup.repeated_bytes(frame).filter("n_removed > 0").count() == 0
    cells = next(kept for label, kept in seen if label == "cells")
    assert cells.count() >= 2_000
    assert cells.groupBy("core", "second").count().agg(F.max("count")).first()[0] < 20


def test_strip_with_any_column_names(spark):
    text = "a repeated passage of more than fifty bytes, in both of the documents"
    frame = spark.createDataFrame([(1, text, 1, 2, 3), (2, "x" + text, 1, 2, 3)], "doc_id long, text string, __copy int, _starts int, __ENDS int")
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.strip_repeats(frame).collect()}
    assert left == {1: text, 2: "x"}


def vectors_by_hand(rows):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        v /= np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    n = len(rows)
    links = [
        (i, j)
        for i in range(n)
        for j in range(i)
        if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j])
        and units[i] @ units[j] >= 0.9
    ]
    group = united(range(n), links)
    names = {}
    for k in range(n):
        names[group[k]] = min(names.get(group[k], math.inf), rows[k][0])
    return [
        (rows[k][0], sum(k in link for link in links), names[group[k]], names[group[k]] == rows[k][0]) for k in range(n)
    ]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(300)]
    for k in range(60):
        near = np.array(rows[k % 20][1]) + 0.15 * rng.standard_normal(16)
        rows.append((300 + k, near.tolist()))
    rows += [
        (400, None), (401, []), (402, [0.0] * 16), (403, [math.nan] + [1.0] * 15), (404, [math.inf] * 16),
        (405, [None] + [1.0] * 15), (406, rows[0][1]), (407, rows[0][1]), (408, [1.0, 0.0]), (409, [1.0, 0.1]),
        (410, [1e200] * 16), (411, [1e-200] * 16), (5, rows[5][1]),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, key long")
    found = sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame).collect())
    assert found == sorted(vectors_by_hand(rows))
    empty = frame.limit(0)
    assert embedding_dedup.near_duplicates(empty).collect() == []


def test_graph_recall_with_groups_wider_than_the_beam():
    rng = np.random.default_rng(4)
    points = rng.standard_normal((3000, 32))
    points[:200] = points[0] + 0.2 * rng.standard_normal((200, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    graph = embedding_dedup.Graph.build(points.astype(np.float32), rng.integers(-(2**60), 2**60, 3000))
    assert graph.audit(0.9) >= 0.99
    q, v = (np.concatenate(part) for part in zip(*graph.within(graph.vectors, 0.9), strict=True))
    expected = set(zip(*np.nonzero(graph.vectors @ graph.vectors.T >= 0.9), strict=True))
    assert len(expected & set(zip(q, v, strict=True))) >= 0.99 * len(expected)


def test_graph_with_parts_out_of_reach():
    """A shard whose audit fails at the widest beam is compared vector by vector."""
    rng = np.random.default_rng(6)
    points = rng.standard_normal((600, 16))
    points[300:] = points[:300] + 0.1 * rng.standard_normal((300, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    graph = embedding_dedup.Graph.build(points.astype(np.float32), rng.integers(-(2**60), 2**60, 600))
    members, edges = graph.layers[-1]
    graph.layers[-1] = (members, np.where(edges >= 250, -1, edges))
    assert graph.audit(0.9) >= embedding_dedup.AUDIT_RECALL
    found = {pair for part in graph.within(graph.vectors, 0.9) for pair in zip(*part, strict=True)}
    assert found == set(zip(*np.nonzero(graph.vectors @ graph.vectors.T >= 0.9), strict=True))


def test_links_reduced_to_a_forest_keep_the_components():
    rng = np.random.default_rng(8)
    forest, pairs, kept = embedding_dedup.Forest(400), [], []
    for _ in range(6):
        a, b = rng.integers(0, 400, (2, 45))
        pairs += zip(a.tolist(), b.tolist(), strict=True)
        kept += zip(*(part.tolist() for part in forest.join(a, b)), strict=True)

    def smallest(links):
        name = list(range(400))
        for _ in range(400):
            for a, b in links:
                name[a] = name[b] = min(name[a], name[b])
        return name

    assert smallest(kept) == smallest(pairs) == forest.root.tolist()
    assert len(kept) == 400 - len(set(forest.root.tolist()))


def test_a_large_group_hands_on_counts_and_not_its_pairs(spark, monkeypatch):
    """600 near copies have 179,700 links; counts and components are those of all of them."""
    rng = np.random.default_rng(9)
    points = rng.standard_normal((900, 24))
    points[:600] = points[0] + 0.2 * rng.standard_normal((600, 24))
    points[850:] = points[600:650]  # equal vectors count as often as they occur
    exact = points / np.linalg.norm(points, axis=1, keepdims=True)
    links = exact @ exact.T >= 0.9
    np.fill_diagonal(links, False)
    written = {}
    real = embedding_dedup.stored
    monkeypatch.setattr(embedding_dedup, "stored", lambda df, label: written.setdefault(label, real(df, label)))
    frame = spark.createDataFrame([(i, row) for i, row in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    rows = {r.id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    n_links = links.sum(1)
    assert sum(rows[i].n_links for i in range(900)) >= 0.999 * n_links.sum()
    assert all(rows[i].n_links <= n_links[i] for i in range(900))
    component = np.arange(900)
    for _ in range(900):
        lower = np.minimum(component, np.where(links, component, 900).min(1))
        if (lower == component).all():
            break
        component = lower
    assert [rows[i].component_id for i in range(900)] == component.tolist()
    assert written["found"].count() <= 2 * 8 * 850


def test_graphs_travel_in_pieces_and_are_not_copied(spark, monkeypatch):
    """A row stays small however large a shard is, and no exchange is fed with copies of graphs."""
    rng = np.random.default_rng(10)
    points = rng.standard_normal((3000, 64))
    points[1500:1520] = points[:20] + 0.02 * rng.standard_normal((20, 64))
    monkeypatch.setattr(embedding_dedup, "SHARDS", 1)
    monkeypatch.setattr(embedding_dedup, "QUERIES", 250)
    widest, plans = [], {}
    real = embedding_dedup.stored

    def spied(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        out = real(df, label)
        wide = [F.coalesce(F.length(f.name), F.lit(0)) for f in out.schema if f.dataType.typeName() == "binary"]
        if wide:
            widest.append(out.agg(F.max(sum(wide, F.lit(0)))).first()[0])
        return out

    monkeypatch.setattr(embedding_dedup, "stored", spied)
    frame = spark.createDataFrame([(i, row) for i, row in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    rows = {r.id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    # Before, the graph of 3,000 vectors was a row of 1.9 MB, which a Generate copied for each block.
    assert max(widest) < 1_100_000
    assert "Generate" not in plans["found"]
    exact = points / np.linalg.norm(points, axis=1, keepdims=True)
    links = exact @ exact.T >= 0.9
    np.fill_diagonal(links, False)
    assert [rows[i].n_links for i in range(3000)] == links.sum(1).tolist()
    assert [rows[i].component_id for i in range(1500, 1520)] == list(range(20))


def test_pieces_in_any_order_give_the_same_answers():
    """Single precision where nothing is lost by it, double where something would be."""
    rng = np.random.default_rng(12)
    points = rng.standard_normal((400, 16))
    points[200:] = points[:200] + 0.1 * rng.standard_normal((200, 16))
    keys = np.arange(400, dtype=np.int64)
    exact = points / np.linalg.norm(points, axis=1, keepdims=True)
    links = exact @ exact.T >= 0.9
    np.fill_diagonal(links, False)
    for vectors, double in ((points, True), (points.astype(np.float32).astype(np.float64), False)):
        table = pa.record_batch(
            {
                "dims": pa.array([16] * 400, pa.int32()),
                "shard": pa.array([0] * 400, pa.int32()),
                "key": keys,
                "many": np.ones(400, np.int64),
                "vector": pa.array(vectors.tolist(), pa.list_(pa.float64())),
            }
        )
        pieces = [p.to_pylist()[0] for p in embedding_dedup._build(0.9)(iter([table]))]
        blocks = [p.to_pylist()[0] for p in embedding_dedup._pack(150)(iter([table.select(["dims", "key", "vector"])]))]
        assert {p["double"] for p in pieces} == {b["wide"] for b in blocks} == {double}
        met = [
            {**p, **{c: b[c] if p["start"] == 0 or c in ("block", "wide") else None for c in ("block", "wide", "keys", "vectors")}}
            for b in blocks
            for p in pieces
        ]
        rng.shuffle(met)
        schema = pa.schema({c: pa.int64() for c in ("dims", "shard", "beam", "n", "total", "start", "block")}
                           | {c: pa.binary() for c in ("sizes", "data", "keys", "vectors")}
                           | {c: pa.bool_() for c in ("double", "wide")})
        batch = pa.RecordBatch.from_pylist([{c: m[c] for c in schema.names} for m in met], schema)
        found = np.zeros(400, int)
        for out in embedding_dedup._ask(0.9)(iter([batch])):
            np.add.at(found, out.column("a").to_numpy(), out.column("others").to_numpy())
        assert found.tolist() == links.sum(1).tolist()
        with pytest.raises(RuntimeError):
            list(embedding_dedup._ask(0.9)(iter([batch.slice(1)])))


def test_a_hub_is_linked_in_little_memory():
    """One vector that a whole batch is joined with does not widen the rows of all others."""
    rng = np.random.default_rng(13)
    edges, sims = np.full((20_000, 32), -1, np.int32), np.full((20_000, 32), -np.inf, np.float32)
    a = np.repeat(np.arange(1024), 16).astype(np.int32)
    b = np.where(np.arange(len(a)) % 16 == 0, 19_999, 1024 + rng.integers(0, 18_000, len(a))).astype(np.int32)
    value = rng.random(len(a)).astype(np.float32)
    tracemalloc.start()
    embedding_dedup.Graph._link(edges, sims, a, b, value)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    hub = value[b == 19_999]
    assert np.allclose(sims[19_999], np.sort(hub)[::-1][:32])
    for row in (0, 500, 1023):
        near = {}
        for target, v in zip(b[a == row].tolist(), value[a == row].tolist(), strict=True):
            near[target] = v
        assert set(edges[row][edges[row] >= 0].tolist()) == set(near)
