"""Periodic runs against a slow search, for plain numbers, texts and the query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm.queries import QUERIES
from millrace.llm.runs import WaveletMatrix, find_runs, periodic_runs, suffix_array


def slow_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    smallest = lambda s, n, q: not any(
        all(words[k] == words[k + p] for k in range(s, s + n - p)) for p in range(1, q)
    )
    return sorted((r for r in found if smallest(*r)), key=lambda r: (r[0], r[2]))


def slow_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_of_random_sequences():
    rng = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters = rng.randint(1, 4)
            words = [rng.randrange(letters) for _ in range(rng.randint(0, 70))]
            if words and rng.random() < 0.6:
                a = rng.randrange(len(words))
                p = 1 + rng.randrange(1 + (len(words) - a) // 4)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
                if rng.random() < 0.5:
                    words[rng.randrange(len(words))] = 9
            texts.append(words)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = find_runs(np.array(sum(texts, []), np.int64), first)
        expected = [(int(first[d]) + s, n, q) for d, t in enumerate(texts) for s, n, q in slow_runs(t)]
        assert list(zip(*[c.tolist() for c in found], strict=True)) == expected


@pytest.mark.parametrize("size", [1, 2, 63, 64, 65, 300])
def test_wavelet_matrix(size):
    rng = np.random.default_rng(size)
    values = rng.permutation(size)
    matrix = WaveletMatrix(values)
    low = rng.integers(0, size, 50)
    high = np.array([rng.integers(a + 1, size + 1) for a in low])
    own = np.array([values[rng.integers(a, b)] for a, b in zip(low, high, strict=True)])
    smaller, larger = matrix.neighbours(low, high, own)
    for a, b, x, s, t in zip(low, high, own, smaller, larger, strict=True):
        part = values[a:b]
        assert s == max(part[part < x], default=-1)
        assert t == min(part[part > x], default=-1)


def test_intervals_hold_the_occurrences_of_a_block():
    rng = random.Random(2)
    numbers = np.array([rng.randrange(2) for _ in range(200)], np.int64)
    first = np.array([0, 0, 90, 200])
    order, intervals = suffix_array(numbers, first)
    assert sorted(order.tolist()) == list(range(200))
    for places, low, high, length in intervals:
        for place, a, b in zip(places, low, high, strict=True):
            text = np.searchsorted(first, place, side="right") - 1
            block = numbers[place : place + length].tolist()
            same = [
                i for i in range(first[text], first[text + 1] - length + 1) if numbers[i : i + length].tolist() == block
            ]
            assert sorted(order[a:b].tolist()) == same


def test_texts(spark, frame_of, odd_texts):
    cases = [
        *odd_texts,
        (30, "a a a a a"), (31, " a\ta\na\x0ba\x0ca\ra "), (32, "ab Ab ab Ab ab Ab ab Ab ab"),
        (33, "x y z " * 4 + "x y"), (34, "x y z " * 3 + "x y"), (35, "q " * 5_000 + "r " * 7),
        (36, "a a " * 6), (37, "a a\x1ca " * 6),
    ]
    rows = periodic_runs(frame_of(cases)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    expected = []
    for i, text in cases:
        words = words_of(text)
        runs = slow_runs(words) if len(words) < 4_000 else ([(0, 5_000, 1), (5_000, 7, 1)] if i == 35 else [])
        expected.append((i, len(words), runs, slow_collapse(words, runs)))
    got = [(r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert periodic_runs(frame_of(cases).limit(0)).collect() == []


def test_query(spark, tmp_path, odd_texts):
    rng = random.Random(4)
    cases = [*odd_texts, *[(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90)))) for i in range(100, 260)]]
    cases = [(i, t) for i, t in cases if len(words_of(t)) < 4_000]
    spark.createDataFrame(cases, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected, changed = [], 0
    for i, text in cases:
        words = words_of(text)
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        runs = slow_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append(
            (i, len(runs), *(best or (None,) * 3), best and best[1] * 1000 // best[2],
             hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(slow_collapse(words, runs).encode()).hexdigest())
        )
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert changed > 5 and sum(r[1] > 0 for r in got) > 5
    assert sorted(got, key=repr) == sorted(expected, key=repr)
