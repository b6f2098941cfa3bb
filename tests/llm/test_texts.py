"""Operators on single texts and on the corpus, against brute force and public libraries."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, fingerprints, katz, licenses, mixing, toxicity, urls
from millrace.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def by_id(i):
    return (i is None, i or 0)


# -- URL filters ----------------------------------------------------------------------------


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "example.org/es/": ("", "", None, "allow"),
        "http://Example.ORG/es/x?q#f": ("example.org", "/es/x", "example.org/es/", "block"),
        "http://a.b.example.org/en/12": ("a.b.example.org", "/en/12", "example.org/en/1", "block"),
        "http://a.example.org/en/2": ("a.example.org", "/en/2", "org/", "allow"),
        "http://org": ("org", "", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://com/de/?//": ("com", "/de/", "com/de/", "block"),
        "http://a.com/DE/": ("a.com", "/DE/", None, "allow"),
        "http://a.com:80/de/": ("a.com:80", "/de/", None, "allow"),
        "http://../de/://x": ("..", "/de/://x", None, "allow"),
        "http://" + "a." * 5000 + "com/fr/" + "y" * 50000: ("a." * 5000 + "com", "/fr/" + "y" * 50000, "com/fr/", "allow"),
    }
    rows = [(k, url, url, "r", 1) for k, url in enumerate(cases)] + [(0, None, None, "r", 1), (3, "http://Example.ORG/es/x?q#f", "", "r", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, rule string, labels long")
    found = urls.judge_urls(frame).collect()
    by_key = dict(enumerate(cases.values()))
    assert len(found) == len(rows)
    assert all(tuple(r)[1:] == by_key[r["page_id"]] for r in found)
    assert urls.judge_urls(frame.limit(0)).collect() == []
    assert {r["verdict"] for r in urls.judge_urls(frame, rules=[], default="block").collect()} == {"block"}


# -- mixing ---------------------------------------------------------------------------------


def test_mix_reaches_targets_and_limits(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(1, 9), rng.choice(["a"] * 8 + ["b", "c", None])) for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mixing_plan(frame).collect()
    size = collections.Counter()
    taken, target = collections.Counter(), {}
    for r in plan:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [5, 2, 1, 5], strict=True))
    free, most, total = dict(weight), {s: 3 * n for s, n in size.items()}, sum(size.values())
    expected = {}
    while True:
        share = (total - sum(expected.values())) / sum(free.values())
        full = [s for s, w in free.items() if w * share > most[s]]
        if not full:
            break
        for s in full:
            expected[s] = most[s]
            free.pop(s)
    expected |= {s: w * share for s, w in free.items()}
    for s in size:
        assert target[s] == pytest.approx(expected[s])
        assert taken[s] == pytest.approx(expected[s], rel=0.1)
    assert mixing.mix(frame).count() == sum(r["copies"] for r in plan)
    again = mixing.mixing_plan(frame.repartition(7)).collect()
    assert sorted((r["id"], r["copies"]) for r in again) == sorted((r["id"], r["copies"]) for r in plan)


def test_mix_on_odd_rows(frame_of, odd_texts):
    frame = frame_of(odd_texts)
    mixed = mixing.mix(frame)
    assert mixed.dtypes == frame.dtypes
    plan = mixing.mixing_plan(frame)
    assert plan.count() == len(odd_texts)
    assert mixed.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(frame.limit(0)).collect() == []
    empty = mixing.mixing_plan(frame_of([(1, None), (2, "")])).collect()
    assert {(r["size"], r["target"], r["copies"]) for r in empty} == {(0, 0.0, 0)}


# -- license scans --------------------------------------------------------------------------


def test_licenses(spark, frame_of, odd_texts):
    rows = [
        (1, "some words\nReleased under the MIT License.\nmore words here"),
        (2, "RELEASED -- under the mit license"),
        (3, "Released under the BSD License."),
        (4, licenses.TEMPLATES["MIT text"].replace("restriction", "limitations")),
        (5, "intro text\n\n" + licenses.TEMPLATES["GPL-3.0 header"].replace(". ", ".\n") + "\n\nend"),
        (6, "Released under the MIT License.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."),
        (7, None),
        (8, "word " * 20_000),
    ]
    found = {r["id"]: r for r in licenses.scan_licenses(frame_of(rows)).collect()}
    assert [found[k]["license"] for k in range(1, 9)] == [
        "MIT", "MIT", None, "MIT text", "GPL-3.0 header", "CC-BY-NC-4.0", None, None,
    ]
    assert found[1]["dice"] == found[2]["dice"] == 1.0
    assert found[4]["dice"] < 1.0
    assert found[6]["n_matches"] == 2 and found[7]["n_matches"] == 0
    assert licenses.scan_licenses(frame_of(odd_texts)).count() == len(odd_texts)
    assert licenses.scan_licenses(frame_of([])).collect() == []


def dice_by_hand(text, template):
    """The best coefficient of all stretches of words."""
    grams = lambda words: {*zip(words, words[1:])}
    cut = lambda t: re.sub("[^a-z0-9]+", " ", t.translate(LOWER)).split()
    words, goal, best = cut(text), grams(cut(template)), 0.0
    for i in range(len(words)):
        seen = set()
        for j in range(i + 1, min(len(words), i + 1 + len(goal) * 3 // 2)):
            seen.add((words[j - 1], words[j]))
            best = max(best, 2 * len(seen & goal) / (len(seen) + len(goal)))
    return best


def test_licenses_inside_longer_texts(spark, frame_of):
    """Texts in three paragraphs before code, and a notice that shares its line."""
    rng = random.Random(8)
    code = "\n\n".join("def f%d(x):\n    return x + %d\n# %s" % (k, k, " ".join(rng.choices("abcdefgh", k=30))) for k in range(40))
    cut = {
        "MIT text": ["The above copyright", "THE SOFTWARE IS PROVIDED"],
        "GPL-3.0 header": ["This program is distributed", "You should have received"],
        "Apache-2.0 header": ["Unless required by", "See the License for"],
    }
    rows = []
    for name, marks in cut.items():
        text = licenses.TEMPLATES[name]
        for mark in marks:
            text = text.replace(mark, "\n\n" + mark)
        rows.append((len(rows), "Copyright 2020 A. Person\n\n" + text.replace("software", "program") + "\n\n" + code))
    rows += [
        (3, "This project is released under the MIT License. It has more to it than that, as all can see. " + code),
        (4, code),
        (5, "released under the " * 40 + code + "license the mit " * 40),
    ]
    found = {r["id"]: r for r in licenses.scan_licenses(frame_of(rows), licenses.TEMPLATES).collect()}
    # The first words of the Apache header are a notice as well, and an equal one.
    expected = ["MIT text", "GPL-3.0 header", "Apache-2.0", "MIT"]
    assert [found[k]["license"] for k in range(6)] == [*expected, None, None]
    for k, name in enumerate(expected):
        assert found[k]["dice"] == dice_by_hand(rows[k][1], licenses.TEMPLATES[name]) >= 0.8
    assert [found[k]["n_matches"] for k in range(6)] == [1, 1, 2, 1, 0, 0]


def test_best_stretch_for_every_template(spark, frame_of):
    """All templates against all stretches of words, wherever lines break."""
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choices("alpha beta gamma delta software license the of".split(), k=n))
    mit = licenses.TEMPLATES["MIT text"]
    rows = [
        (0, mit + " " + words(35)),
        (1, mit + "\n\n" + words(35)),
        (2, words(20) + " " + mit.replace("THE SOFTWARE IS PROVIDED", words(9) + "\nTHE SOFTWARE IS PROVIDED")),
    ]
    short = {**licenses.TEMPLATES, **licenses.NOTICES}
    for name in sorted(short):
        text = short[name].split(" ")
        text[len(text) // 2 : len(text) // 2] = words(rng.randrange(3)).split()
        rows.append((len(rows), words(4) + " " + " ".join(text[: 2 * len(text) // 3]) + "\n" + " ".join(text[2 * len(text) // 3 :]) + ". " + words(6)))
    found = {r["id"]: r for r in licenses.scan_licenses(frame_of(rows)).collect()}
    for k, text in rows:
        # Twice the words of a text bound what it shares with a template.
        able = {n: t for n, t in licenses.LICENSES.items() if 2 * len(text.split()) >= 0.6 * len(t.split())}
        best = {n: dice_by_hand(text, t) for n, t in able.items()}
        reached = {n: d for n, d in best.items() if d >= 0.8}
        assert (found[k]["dice"] or 0.0) == max(reached.values(), default=0.0), k
        assert found[k]["license"] == min(reached, key=lambda n: (-reached[n], n), default=None), k
    assert found[0]["dice"] == found[1]["dice"] == 1.0 and found[0]["license"] == "MIT text"


def test_full_license_texts(spark, frame_of):
    """Whole texts with a word changed here and there, in front of code, under their own names."""
    texts = licenses.full_texts()
    code = "\n\ndef f(x):\n    return x" * 20
    rows = []
    for k, text in enumerate(texts.values()):
        words = text.split(" ")
        words[40::60] = ["changed"] * len(words[40::60])
        rows.append((k, " ".join(words) + code))
    found = {r["id"]: r for r in licenses.scan_licenses(frame_of(rows)).collect()}
    best = [max(licenses.LICENSES, key=lambda n, k=k: dice_by_whole(rows[k][1], licenses.LICENSES[n])) for k in range(len(rows))]
    assert best == list(texts)
    for k, name in enumerate(texts):
        assert found[k]["license"] is not None and found[k]["dice"] >= 0.8, name
        assert found[k]["license"].split(" ")[0] == name.split(" ")[0], name


def dice_by_whole(text, template):
    cut = lambda t: re.sub("[^a-z0-9]+", " ", t.translate(LOWER)).split()
    a, b = ({*zip(w, w[1:])} for w in (cut(text), cut(template)))
    return 2 * len(a & b) / (len(a) + len(b))


# -- fingerprints ---------------------------------------------------------------------------


def test_fingerprints_of_odd_rows(frame_of, odd_texts):
    found = fingerprints.fingerprint_documents(frame_of(odd_texts), places=5).collect()
    order = sorted(odd_texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in order]
    expected = []
    for k, (i, _) in enumerate(order):
        edit = fingerprints.edited(texts[k], texts[(k + 1) % len(texts)])
        expected.append((by_id(i), len(texts[k]), hashlib.sha256(edit.encode()).hexdigest()))
    got = [(by_id(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found]
    assert sorted(got) == sorted(expected)
    marks = collections.defaultdict(set)
    for r in found:
        marks[r["fingerprint"]].add(r["n_chars"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(marks) == len(set(texts))
    alone = fingerprints.fingerprint_documents(frame_of([(7, "abcd")])).collect()
    assert alone[0]["near_next"] == 1.0 and alone[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.fingerprint_documents(frame_of([])).collect() == []


def test_spans_and_extensions():
    rng = random.Random(2)
    text = "".join(rng.choices("ab", k=300)) * 2
    hashes = fingerprints.PrefixHashes(fingerprints.code_points(text))
    for _ in range(300):
        i, j = rng.randrange(600), rng.randrange(600)
        n = rng.randint(0, 600 - max(i, j))
        assert hashes.equal(i, j, n) == (text[i : i + n] == text[j : j + n])
        common = next((k for k in range(600 - max(i, j)) if text[i + k] != text[j + k]), 600 - max(i, j))
        assert hashes.longest_common_extension(i, j) == common
    assert fingerprints.longest_common_prefix("abcabc", "abcab") == 5
    assert fingerprints.longest_common_prefix("", "x") == 0
    a, b = fingerprints.fingerprints(["x" * 100 + "y" * 100, "x" * 100 + "z" * 100])
    assert 0.4 < fingerprints.likeness(a, b) <= 0.5
    assert fingerprints.likeness(a, a) == 1.0


# -- language model -------------------------------------------------------------------------


def katz_by_hand(rows, learnt):
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    one, two, heads = collections.Counter(), collections.Counter(), collections.Counter()
    for words, train in zip(tokens, learnt, strict=True):
        for h, w in zip(["<start>", *words], words, strict=False):
            if train:
                one[w] += 1
                two[h, w] += 1
                heads[h] += 1
    total = sum(one.values())

    def discount(counts):
        n = collections.Counter(counts.values())
        tail = 6 * n[6] / n[1] if n[1] else 1
        kept = {}
        for r in range(1, 6):
            kept[r] = r - 0.5
            if n[r] and n[r + 1] and tail < 1:
                factor = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
                if 0 < factor < 1:
                    kept[r] = factor * r
        return lambda c: kept[c] if c <= 5 else c - 0.01

    d1, d2 = discount(one), discount(two)
    unknown = 1 - sum(map(d1, one.values())) / total if total else 1.0

    def lower(w):
        return d1(one[w]) / total if one[w] else unknown

    follow = collections.defaultdict(list)
    for (h, w), c in two.items():
        follow[h].append((w, c))

    def probability(h, w):
        if two[h, w]:
            return d2(two[h, w]) / heads[h]
        if not heads[h]:
            return lower(w)
        left = 1 - sum(d2(c) for _, c in follow[h]) / heads[h]
        return left / (1 - sum(lower(x) for x, _ in follow[h])) * lower(w)

    for h in list(heads)[:20]:
        assert sum(probability(h, w) for w in [*one, "<unknown>"]) == pytest.approx(1)
    out = []
    for (i, _), words in zip(rows, tokens, strict=True):
        score = sum(math.log10(probability(h, w)) for h, w in zip(["<start>", *words], words, strict=False))
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (len(one) + 1))) for w in words)
        out.append((by_id(i), len(words), sum(one[w] > 0 for w in words), total, base, score))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_katz(frame_of, odd_texts, monkeypatch, small):
    if small:  # many chunks, buckets and parts of a frequent first word
        monkeypatch.setattr(katz, "TOKENS_PER_CHUNK", 50)
        monkeypatch.setattr(katz, "ENTRIES_PER_BUCKET", 40)
        monkeypatch.setattr(katz, "OCCURRENCES_PER_BUCKET", 3)
    rng = random.Random(8)
    words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(60)]
    rows = [*[r for r in odd_texts if r[0] != 15], *[(100 + k, " ".join(rng.choices(words, k=40))) for k in range(60)]]
    train = toxicity.checksum("doc_id") % 10 != 0
    found = katz.katz_scores(frame_of(rows), train).collect()
    learnt = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i, _ in rows]
    got = sorted(
        (by_id(r["id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found
    )
    expected = katz_by_hand(rows, learnt)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert np.allclose([g[4:] for g in got], [e[4:] for e in expected], rtol=1e-9)
    assert sorted((by_id(r["id"]), r["held_out"]) for r in found) == sorted(
        (by_id(i), not x) for (i, _), x in zip(rows, learnt, strict=True)
    )


def test_katz_without_training(frame_of):
    frame = frame_of([(1, "a b"), (2, None)])
    assert {r["score"] for r in katz.katz_scores(frame, F.lit(False)).collect()} == {0.0}
    assert katz.katz_scores(frame.limit(0), F.lit(True)).collect() == []


def test_katz_holds_little_of_a_chunk(monkeypatch):
    # The tasks' functions on two chunks, one after the other: bytes of arrays for each token.
    monkeypatch.setattr(katz, "TOKENS_PER_CHUNK", 400_000)
    monkeypatch.setattr(katz, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.zipf(1.3, 999) % 50_000)) for _ in range(1600)]
    batch = pa.RecordBatch.from_pydict({"id": range(len(texts)), "train": [k % 10 != 0 for k in range(len(texts))], "text": texts})

    chunks = pa.Table.from_batches(katz._chunks([batch])).to_pylist()
    size = max(c["length"] for c in chunks)
    assert len(chunks) > 1 and size < 800_000

    def held(function, batches):
        for _ in function(iter(batches)):  # what stays for good, like tables of powers, is there now
            pass
        tracemalloc.start()
        for _ in function(iter(batches)):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / size

    rows = [
        {"chunk": c["chunk"], "kind": kind, "bucket": 0} | ({"answer": c["counts"]} if kind else {k: c[k] for k in ("ids", "sizes", "train", "places", "vocabulary")})
        for c in chunks
        for kind in (0, 1)
    ]
    kinds = {"chunk": pa.int64(), "kind": pa.int32(), "bucket": pa.int32(), "heads": pa.list_(pa.int64()), "weights": pa.list_(pa.float64())}
    schema = pa.schema([(c, kinds.get(c, pa.binary())) for c in katz._ROW])

    def batches(rows):
        rows = sorted(rows, key=lambda r: (r["chunk"], r["kind"]))
        return [pa.RecordBatch.from_pylist([r], schema) for r in rows]

    ask = katz._ask_pairs(1, 1, 1440)
    asked = pa.Table.from_batches(ask(iter(batches(rows)))).to_pylist()
    answers = [{"chunk": a["chunk"], "kind": 2, "bucket": 0, "answer": a["counts"]} for a in asked]
    one_word = katz.OneWord(size, 1000, [500, 200, 100, 50, 20, 10])
    score = katz._score(1, 1, 1440, one_word, katz.Discounts([500, 200, 100, 50, 20, 10]))
    scored = pa.Table.from_batches(score(iter(batches(rows + answers))))
    assert scored.num_rows == len(texts)
    most = [held(katz._chunks, [batch]), held(ask, batches(rows)), held(score, batches(rows + answers))]
    assert max(most) < 50, most


# -- toxicity -------------------------------------------------------------------------------


def test_toxicity_on_held_out_and_misspelt_words(spark, frame_of):
    rng = random.Random(4)
    clean = ["".join(rng.choices("bcdfghklmnprstaeiou", k=rng.randint(2, 8))) for _ in range(800)]
    bad = ["scoundrel", "blockhead", "nincompoop"]

    def text(toxic, spell=lambda w: w):
        words = rng.choices(clean, k=rng.randint(20, 200))
        for _ in range(toxic * (1 + len(words) // 40)):
            words.insert(rng.randrange(len(words)), spell(rng.choice(bad)))
        return " ".join(words)

    rows = [(k, text(k % 5 == 0)) for k in range(1500)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(900)], "doc_id long, toxic int")
    frame = frame_of(rows)
    model = toxicity.train(toxicity.training_sample(frame.filter("doc_id < 900"), labels))
    scored = {r["id"]: r["score"] for r in toxicity.score_documents(frame, model).collect()}
    held_out = range(900, 1500)
    right = [(scored[k] >= toxicity.THRESHOLD) == (k % 5 == 0) for k in held_out]
    assert np.mean(right) > 0.97
    assert all(0 <= s <= 1 for s in scored.values())
    misspelt = [(k, text(1, lambda w: w[:3] + w[3] + w[3:])) for k in range(200)]
    again = toxicity.score_documents(frame_of(misspelt), model).collect()
    assert np.mean([r["score"] >= toxicity.THRESHOLD for r in again]) > 0.8
    kept = toxicity.keep_acceptable(frame, model)
    assert kept.dtypes == frame.dtypes
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k, s in scored.items() if s < 0.7}


def test_toxicity_on_odd_rows(spark, frame_of, odd_texts):
    frame = frame_of(odd_texts)
    labels = spark.createDataFrame(
        [(1, 1), (11, 0), (11, None), (12, 0), (12, 1), (None, 1), (99, 1)], "doc_id long, toxic int"
    )
    model = toxicity.train(toxicity.training_sample(frame, labels))
    scores = toxicity.score_documents(frame, model).collect()
    assert len(scores) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in scores)
    nothing = toxicity.train(toxicity.training_sample(frame, labels.limit(0)))
    assert {round(r["score"], 3) for r in toxicity.score_documents(frame, nothing).collect()} == {0.0}
    assert toxicity.score_documents(frame.limit(0), model).collect() == []
    assert toxicity.keep_acceptable(frame.limit(0), model).collect() == []


def test_toxicity_reads_its_sample_once(spark):
    # The sample's shuffle must outlive the action that starts the iterator over it.
    prepare(spark)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "id long, text string, label int"
    sample = spark.range(0, 400, 1, 8).selectExpr("id", "concat('word', id % 7) AS text", "int(id % 2) AS label")
    toxicity.train(sample.mapInArrow(counted, schema))
    assert seen.value == 400


# -- BPE ------------------------------------------------------------------------------------


def test_bpe_equals_the_library(frame_of, odd_texts):
    library = Tokenizer.from_file(VOCABULARY)
    frame = frame_of(odd_texts)
    found = bpe.encode_documents(frame, VOCABULARY).collect()
    got = sorted((by_id(r["id"]), r["n_tokens"], r["ids"], r["decoded"]) for r in found)
    expected = []
    for i, text in odd_texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((by_id(i), len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected)
    back = bpe.decode_documents(bpe.encode_documents(frame, VOCABULARY), VOCABULARY).collect()
    assert sorted((by_id(r["id"]), r["decoded"]) for r in back) == sorted((e[0], e[3]) for e in expected)
    digests = bpe.encode_documents(frame, VOCABULARY, digest=True).collect()
    assert sorted((by_id(r["id"]), r["ids_sha256"], r["decoded_sha256"]) for r in digests) == sorted(
        (
            e[0],
            hashlib.sha256(" ".join(map(str, e[2])).encode()).hexdigest(),
            hashlib.sha256(e[3].encode()).hexdigest(),
        )
        for e in expected
    )
    assert bpe.encode_documents(frame_of([]), VOCABULARY).collect() == []


def test_bpe_on_random_unicode():
    library = Tokenizer.from_file(VOCABULARY)
    with open(VOCABULARY, encoding="utf-8") as file:
        own = bpe.Vocabulary(file.read())
    rng = random.Random(6)
    for _ in range(1500):
        text = "".join(
            rng.choice([chr(rng.randint(1, 0x2FF)), chr(rng.randint(0x300, 0xD7FF)), chr(rng.randint(0xE000, 0x1FFFF)), " ", "'s", "Σ", "aaa"])
            for _ in range(rng.randint(0, 40))
        )
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_certain():
    """Fragments encoded apart give what the whole word gives, also by the long way."""
    with open(VOCABULARY, encoding="utf-8") as file:
        own = bpe.Vocabulary(file.read())
    rng = random.Random(7)
    cut = 0
    for _ in range(500):
        word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéßжq", k=rng.randint(1, 25))).encode()
        parts = own.fragments_of(word)
        cut += len(parts) > 1
        assert b"".join(p for p, _ in parts) == word
        whole = own._encode_fragment((word, True))
        assert tuple(x for p in parts for x in own._encode_fragment(p)) == whole
        assert own._encode_long((word, True)) == whole
    assert cut > 100
