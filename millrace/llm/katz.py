"""Katz backoff language model: training on one part of the documents, scores for all.

The model has two orders. A word that followed its predecessor ``c`` times in training has
``c`` discounted by Good-Turing, over the predecessor's count; any other word gets the one-word
probability times the predecessor's backoff weight, which is the mass left over divided by the
one-word mass of the words that were not seen after it, so each distribution sums to one. Words
outside the training vocabulary are one word more, with the mass the one-word counts give up.

Counts of at most ``LARGE`` are discounted by Good-Turing; larger ones give up ``SPARE`` of a
count, so that every context has some mass to hand down. Where counts of counts are too thin
for Good-Turing, half a count is given up.

How it runs. Tasks cut the documents into chunks of tokens, each with a vocabulary of its own,
and store them. Chunks ask for the counts of their words, then of their distinct word pairs:
requests are packed arrays dealt to buckets by a hash, a bucket adds up what all chunks sent and
answers in the order of the request. These buckets are the tables of the model. A pair is
counted in the bucket of its first word; a first word with many occurrences is dealt over
several buckets by the second. Backoff weights are an aggregation over the pairs' buckets and go
back to the chunks that need them. Shuffles carry each distinct pair of a chunk once.

Of a chunk, a task holds numbers of four bytes a token and few arrays of eight at a time: words are
numbered piece by piece, what goes by word is looked up by word, and nothing of a chunk or bucket
is kept while the next one comes.

The driver sees counts of counts, of which there are ``LARGE + 1`` an order, and totals.

Defined cases: a null or empty text is its end token alone; a null id's checksum is that of the
empty text; repeated rows all count and are all scored; with no training documents every word is
unknown and has probability 1, so the score is 0; an empty table gives no rows. Only the named
columns are read. A text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, starmap

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted
from millrace.llm.common import Words, mix64, prepare, steps, stored

LARGE = 5
SPARE = 0.01
#: Smoothing of the base score: a fixed value.
BASE = 0.1
#: Tokens of a chunk; entries of a bucket; occurrences of a first word that share a bucket.
TOKENS_PER_CHUNK = 2_000_000
ENTRIES_PER_BUCKET = 500_000
OCCURRENCES_PER_BUCKET = 1_000_000
#: Bytes of text whose words are hashed and numbered at once, unless a single text is longer.
BYTES_PER_PIECE = 256 << 10

_U64 = np.uint64
_END = mix64(np.array([0x0E0D], np.uint64))[0]
_START = mix64(np.array([0x57A27], np.uint64))[0]


# -- chunks ---------------------------------------------------------------------------------

_CHUNK = (
    "chunk long, ids binary, sizes binary, train binary, places binary, vocabulary binary, "
    "counts binary, words long, tokens long, documents long, length long"
)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``(id, train, text)`` to chunks: tokens as places in the chunk's vocabulary."""
    part = TaskContext.get().partitionId()
    number = 0

    def close(pieces, ids, sizes, train):
        ids, sizes, train = np.concatenate(ids), np.concatenate(sizes), np.concatenate(train)
        vocabulary = np.unique(np.concatenate([words for words, *_ in pieces]))
        found, counts = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        at = [np.searchsorted(vocabulary, words) for words, *_ in pieces]
        for here, (_, _, often, learnt) in zip(at, pieces, strict=True):
            found[here] += often
            counts[here] += learnt
        # Frequent words first: their places have small numbers, which compress well.
        order = np.argsort(-found, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        vocabulary, counts = vocabulary[order], counts[order]
        local = np.concatenate([place[here][numbers] for here, (_, numbers, *_) in zip(at, pieces, strict=True)])
        values = [
            [(part << 24) | number],
            [ids.astype("<i8").tobytes()],
            [sizes.astype("<u4").tobytes()],
            [train.astype(np.uint8).tobytes()],
            [_planes(local)],
            [vocabulary.astype("<u8").tobytes()],
            [_planes(counts)],
            [len(vocabulary)],
            [int(counts.sum())],
            [int(train.sum())],
            [len(local)],
        ]
        kinds = [pa.int64(), *[pa.binary()] * 6, *[pa.int64()] * 4]
        names = [c.split()[0] for c in _CHUNK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    held, parts = 0, ([], [], [], [])
    for batch, data, offsets in steps(batches, BYTES_PER_PIECE):
        words = Words(data, offsets)
        # Every text's words and its end.
        sizes = np.diff(words.first) + 1
        train = batch.column("train").to_numpy(zero_copy_only=False)
        stream = np.insert(words.hashes, words.first[1:], _END)
        distinct, numbers = np.unique(stream, return_inverse=True)
        piece = (
            distinct,
            numbers.astype(np.uint32),
            np.bincount(numbers, minlength=len(distinct)),
            np.bincount(numbers[np.repeat(train, sizes)], minlength=len(distinct)),
        )
        for held_part, new in zip(parts, (piece, batch.column("id").to_numpy(zero_copy_only=False), sizes, train), strict=True):
            held_part.append(new)
        held += len(stream)
        if held >= TOKENS_PER_CHUNK:
            yield close(*parts)
            number, held, parts = number + 1, 0, ([], [], [], [])
    if held:
        yield close(*parts)


class Chunk:
    """One chunk's tokens and what has come for it so far."""

    def __init__(self, row: dict) -> None:
        self.number = row["chunk"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.tokens = _counts(row["places"], "<u4")
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        self.first = np.cumsum(self.sizes) - self.sizes

    def add_counts(self, answers: list[tuple[int, bytes]], buckets: int, documents: int) -> None:
        """Training counts of the chunk's words; the last entry stands for the start."""
        order, _ = word_order(self.vocabulary, buckets)
        counts = np.empty(len(order) + 1, np.int64)
        counts[order] = _joined(answers)
        counts[-1] = documents
        self.counts = counts

    def add_pairs(self, buckets: int) -> None:
        """The distinct pairs of predecessor and word, in the order in which they are asked."""
        width = len(self.vocabulary) + 1
        key = np.empty(len(self.tokens), np.int64)
        key[1:] = self.tokens[:-1]
        key[self.first] = len(self.vocabulary)
        key *= width
        key += self.tokens
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.pair_of = np.empty(len(key), np.uint32)
        self.pair_of[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        del order
        key = key[new]
        self.h, self.w = (key // width).astype(np.uint32), (key % width).astype(np.uint32)
        del key, new
        self.hashes = np.append(self.vocabulary, _START)
        shards = (np.maximum(self.counts - 1, 0) // OCCURRENCES_PER_BUCKET + 1).astype(np.uint64)
        # Unsigned numbers of two bytes, if they are enough, are sorted by their digits.
        kind = np.min_scalar_type(buckets)
        bucket = _pair_buckets(self.hashes, _U64(0), buckets).astype(kind)[self.h]
        # The pairs whose first word is dealt over several buckets.
        dealt = np.flatnonzero((shards > 1)[self.h])
        shard = mix64(self.hashes[self.w[dealt]]) % shards[self.h[dealt]]
        bucket[dealt] = _pair_buckets(self.hashes[self.h[dealt]], shard, buckets)
        self.pair_order = np.argsort(bucket, kind="stable").astype(np.uint32)
        self.pair_bucket = bucket[self.pair_order]


def _pair_buckets(heads: np.ndarray, shard: np.ndarray, buckets: int) -> np.ndarray:
    return mix64(heads + shard * _U64(0x9E3779B97F4A7C15)) % _U64(buckets)


def word_order(vocabulary: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (mix64(vocabulary ^ _U64(0x5555)) % _U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _planes(values: np.ndarray) -> bytes:
    """Numbers from 0 on, lowest bytes first: all lowest bytes, then all second ones, packed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    parts = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)[:, :width]
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(parts.T).ravel())


def _counts(data: bytes, kind: str = "<i8") -> np.ndarray:
    parts = np.frombuffer(zstandard.decompress(memoryview(data)[1:]), np.uint8).reshape(data[0], -1)
    values = np.zeros(parts.shape[1], kind)
    values.view(np.uint8).reshape(-1, values.itemsize)[:, : data[0]] = parts.T
    return values


def _short(hashes: np.ndarray) -> bytes:
    """Six bytes of each hash: enough to tell apart the words that follow one word."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _words(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8")[:, 0]


def _joined(answers: list[tuple[int, bytes]]) -> np.ndarray:
    """Counts from the answers of the buckets, in the order of the buckets."""
    return np.concatenate([np.zeros(0, "<i8"), *[_counts(a) for _, a in sorted(answers, key=lambda x: x[0])]])


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else values
    return zip(cut.tolist(), [*cut[1:].tolist(), len(values)], strict=True)


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows with one value in the first column, together. They come sorted by it."""

    def plain(value):
        return value.values.to_numpy() if value.is_valid and pa.types.is_list(value.type) else value.as_py()

    at, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: plain(column[i]) for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            key = row[batch.schema.names[0]]
            if key != at and rows:
                yield at, rows
                rows = []
            at = key
            rows.append(row)
    if rows:
        yield at, rows


# -- words ----------------------------------------------------------------------------------


def _ask_words(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary = np.frombuffer(row["vocabulary"], "<u8")
                counts = _counts(row["counts"])
                order, bucket = word_order(vocabulary, buckets)
                parts = [(int(bucket[a]), order[a:b]) for a, b in _runs(bucket)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in parts], pa.int32()),
                        pa.array([row["chunk"]] * len(parts), pa.int64()),
                        pa.array([vocabulary[o].tobytes() for _, o in parts], pa.binary()),
                        pa.array([_planes(counts[o]) for _, o in parts], pa.binary()),
                    ],
                    names=["bucket", "chunk", "vocabulary", "counts"],
                )

    return run


_STATISTICS = [f"r{r}" for r in range(1, LARGE + 2)]


def _statistics(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, ..., ``LARGE + 1``."""
    small = np.bincount(counts[counts <= LARGE + 1], minlength=LARGE + 2)
    return [int(x) for x in small[1:]]


def _answer_words(batches):
    """A row of statistics for each bucket, and the answers to the chunks."""

    def answer(bucket, rows):
        words = [np.frombuffer(r["vocabulary"], "<u8") for r in rows]
        counts = np.concatenate([_counts(r["counts"]) for r in rows])
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, counts, len(distinct)).astype(np.int64)
        seen = total[total > 0]
        return _answers_batch(bucket, [r["chunk"] for r in rows], [len(w) for w in words], total[place], len(seen), _statistics(seen))

    return starmap(answer, _by_bucket(batches))


def _answers_batch(bucket, chunks, sizes, answers, types, statistics) -> pa.RecordBatch:
    cut = np.cumsum([0, *sizes])
    blobs = [_planes(answers[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    nothing = [None] * len(chunks)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None, *chunks], pa.int64()),
            pa.array([bucket] * (len(chunks) + 1), pa.int32()),
            pa.array([None, *blobs], pa.binary()),
            pa.array([types, *nothing], pa.int64()),
            *[pa.array([s, *nothing], pa.int64()) for s in statistics],
        ],
        names=["chunk", "bucket", "answer", "types", *_STATISTICS],
    )


_ANSWER = "chunk long, bucket int, answer binary, types long, " + ", ".join(f"{s} long" for s in _STATISTICS)


# -- discounts ------------------------------------------------------------------------------


class Discounts:
    """Counts after discounting, by the counts of counts of one order."""

    def __init__(self, statistics: list[int]) -> None:
        n = [0, *statistics]
        self.kept = np.arange(LARGE + 1, dtype=np.float64)
        tail = (LARGE + 1) * n[LARGE + 1] / n[1] if n[1] else 1.0
        for r in range(1, LARGE + 1):
            kept = r - 0.5
            if n[r] and n[r + 1] and tail < 1:
                ratio = (r + 1) * n[r + 1] / (r * n[r])
                factor = (ratio - tail) / (1 - tail)
                if 0 < factor < 1:
                    kept = factor * r
            self.kept[r] = kept

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        small = np.minimum(counts, LARGE)
        return np.where(counts <= LARGE, self.kept[small], counts - SPARE)


class OneWord:
    """One-word probabilities by training count; count 0 is the unknown word."""

    def __init__(self, tokens: int, types: int, statistics: list[int]) -> None:
        self.tokens, self.types = tokens, types
        self.discount = Discounts(statistics)
        small = sum(n * (r - self.discount.kept[r]) for r, n in enumerate(statistics[:LARGE], 1))
        large = (types - sum(statistics[:LARGE])) * SPARE
        self.unknown = (small + large) / tokens if tokens else 1.0

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, self.discount(counts) / self.tokens, self.unknown)


# -- pairs ----------------------------------------------------------------------------------


def _by_chunk(batches: Iterable[pa.RecordBatch], buckets: int, documents: int) -> Iterator[tuple[Chunk, list, dict]]:
    """Chunks with their answers, from rows sorted by chunk and kind."""

    def ready(rows):
        chunk = Chunk(next(r for r in rows if r["kind"] == 0))
        chunk.add_counts([(r["bucket"], r["answer"]) for r in rows if r["kind"] == 1], buckets, documents)
        pairs = [(r["bucket"], r["answer"]) for r in rows if r["kind"] == 2]
        weights = next((r for r in rows if r["kind"] == 3), None)
        rows.clear()
        return chunk, pairs, weights

    for _, rows in _by_bucket(batches):
        yield ready(rows)


def _ask_pairs(word_buckets: int, buckets: int, documents: int):
    def ask(chunk, *_):
        chunk.add_pairs(buckets)
        learnt = np.bincount(chunk.pair_of[np.repeat(chunk.train, chunk.sizes)], minlength=len(chunk.w))
        for a, b in _runs(chunk.pair_bucket):
            o = chunk.pair_order[a:b]
            # Pairs are in the order of their first word: it is sent once.
            lengths = [y - x for x, y in _runs(chunk.h[o])]
            heads = chunk.h[o[np.cumsum([0, *lengths[:-1]])]]
            words = chunk.w[o]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(chunk.pair_bucket[a])], pa.int32()),
                    pa.array([chunk.number], pa.int64()),
                    *[
                        pa.array([x], pa.binary())
                        for x in (
                            chunk.hashes[heads].tobytes(),
                            _planes(chunk.counts[heads]),
                            _planes(np.array(lengths, np.int64)),
                            _short(chunk.hashes[words]),
                            _planes(chunk.counts[words]),
                            _planes(learnt[o]),
                        )
                    ],
                ],
                names=["bucket", "chunk", "h", "h_count", "lengths", "w", "w_count", "counts"],
            )

    def run(batches):
        return chain.from_iterable(starmap(ask, _by_chunk(batches, word_buckets, documents)))

    return run


_CONTEXT = ["h", "h_count", *[f"k{r}" for r in range(1, LARGE + 2)], "mass"]


def _answer_pairs(one_word: OneWord):
    """Answers and statistics, and rows on first words: ``h, h_count, k1.., mass`` and ``needs``.

    ``k1`` to ``k5`` are the words seen so often after ``h``, the last is the words seen more
    often; ``mass`` is their one-word mass. ``needs`` are the chunks that met a word never seen
    after ``h``.
    """

    def answer(bucket, rows):
        lengths = [_counts(r["lengths"]) for r in rows]
        h = np.concatenate([np.repeat(np.frombuffer(r["h"], "<u8"), n) for r, n in zip(rows, lengths, strict=True)])
        h_count = np.concatenate([np.repeat(_counts(r["h_count"]), n) for r, n in zip(rows, lengths, strict=True)])
        w = np.concatenate([_words(r["w"]) for r in rows])
        w_count = np.concatenate([_counts(r["w_count"]) for r in rows])
        counts = np.concatenate([_counts(r["counts"]) for r in rows])
        order = np.lexsort((w, h))
        new = np.concatenate([[True], np.diff(h[order]) != 0])
        new[1:] |= np.diff(w[order]) != 0
        group = np.cumsum(new) - 1
        total = np.bincount(group, counts[order]).astype(np.int64)
        often = np.empty(len(h), np.int64)
        often[order] = total[group]
        first = order[new]
        del w, counts, order, group, new
        sizes = [int(n.sum()) for n in lengths]
        seen = total[total > 0]
        batch = _answers_batch(bucket, [r["chunk"] for r in rows], sizes, often, len(seen), _statistics(seen))
        pad = [pa.nulls(batch.num_rows, pa.int64())] * (len(_CONTEXT) - 1) + [pa.nulls(batch.num_rows, pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *pad], names=[*batch.schema.names, *_CONTEXT])

        # What the first words have been followed by, for those that a chunk needs.
        heads = h[first]
        missed = often == 0
        chunk_of = np.repeat(np.arange(len(rows)), sizes)
        needed = np.unique(h[missed & (h_count > 0)])
        known = (total > 0) & ((h_count[first] > OCCURRENCES_PER_BUCKET) | np.isin(heads, needed))
        if known.any():
            names, place = np.unique(heads[known], return_inverse=True)
            level = np.minimum(total[known], LARGE + 1)
            table = np.zeros((len(names), LARGE + 2), np.int64)
            np.add.at(table, (place, level), 1)
            mass = np.bincount(place, one_word(w_count[first][known]), len(names))
            h_counts = np.zeros(len(names), np.int64)
            h_counts[place] = h_count[first][known]
            yield _context_batch(names, [h_counts, *table[:, 1:].T], mass, None)
        if len(needed):
            pick = missed & (h_count > 0)
            asked = np.unique(np.stack([h[pick].view(np.int64), chunk_of[pick]], 1), axis=0)
            numbers = np.array([r["chunk"] for r in rows])[asked[:, 1]]
            yield _context_batch(asked[:, 0].view(np.uint64), None, None, numbers)

    def run(batches):
        return chain.from_iterable(starmap(answer, _by_bucket(batches)))

    return run


def _context_batch(heads, table, mass, chunks) -> pa.RecordBatch:
    n = len(heads)
    empty = pa.nulls(n, pa.int64())
    columns = [empty if chunks is None else pa.array(chunks, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
    columns += [empty] * (1 + len(_STATISTICS))
    columns.append(pa.array(np.ascontiguousarray(heads).view(np.int64)))
    columns += [empty] * (LARGE + 2) if table is None else [pa.array(np.ascontiguousarray(c)) for c in table]
    columns.append(pa.nulls(n, pa.float64()) if mass is None else pa.array(mass))
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "answer", "types", *_STATISTICS, *_CONTEXT])


_PAIR_ANSWER = _ANSWER + ", " + ", ".join(f"{c} {'double' if c == 'mass' else 'long'}" for c in _CONTEXT)


# -- scores ---------------------------------------------------------------------------------


def _score(word_buckets: int, buckets: int, documents: int, one_word: OneWord, pair: Discounts):
    n, v = one_word.tokens, one_word.types

    def score(chunk, answers, weights):
        chunk.add_pairs(buckets)
        seen = np.empty(len(chunk.w), np.int64)
        seen[chunk.pair_order] = _joined(answers)
        # By word: one-word probability, base score and, for words seen in training, backoff weight.
        lower = one_word(chunk.counts)
        base = np.log10((chunk.counts + BASE) / (n + BASE * (v + 1)))
        alpha = np.ones(len(chunk.hashes))
        if weights is not None:
            order = np.argsort(weights["heads"])
            heads = weights["heads"][order]
            at = np.searchsorted(heads, chunk.hashes.view(np.int64))
            at[at == len(heads)] = 0
            hit = (heads[at] == chunk.hashes.view(np.int64)) & (chunk.counts > 0)
            alpha[hit] = weights["weights"][order][at][hit]
        logs = alpha[chunk.h]
        logs *= lower[chunk.w]
        hit = seen > 0
        logs[hit] = pair(seen[hit]) / chunk.counts[chunk.h[hit]]
        del seen, hit
        np.log10(logs, out=logs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(chunk.ids),
                pa.array(~chunk.train),
                pa.array(chunk.sizes),
                pa.array(np.add.reduceat((chunk.counts > 0)[chunk.tokens], chunk.first, dtype=np.int64)),
                pa.array(np.full(len(chunk.ids), n, np.int64)),
                pa.array(np.add.reduceat(base[chunk.tokens], chunk.first)),
                pa.array(np.add.reduceat(logs[chunk.pair_of], chunk.first)),
            ],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches):
        return starmap(score, _by_chunk(batches, word_buckets, documents))

    return run


_RESULT = (
    "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)

_ROW = ["chunk", "kind", "bucket", "answer", "ids", "sizes", "train", "places", "vocabulary", "heads", "weights"]


def _row_of(df: DataFrame, kind: int) -> DataFrame:
    """The columns of ``_ROW``, null where ``df`` lacks them."""
    kinds = {"bucket": "int", "heads": "array<long>", "weights": "array<double>"}
    have = set(df.columns)
    return df.select(
        *[
            F.lit(kind).alias("kind") if c == "kind"
            else F.col(c) if c in have
            else F.lit(None).cast(kinds.get(c, "binary")).alias(c)
            for c in _ROW
        ]
    )


def _meet(frames: list[DataFrame], places: int) -> DataFrame:
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows.repartition(places, "chunk").sortWithinPartitions("chunk", "kind", "bucket")


def _totals(answers: DataFrame) -> tuple[int, list[int]]:
    row = answers.filter("types IS NOT NULL").agg(*[F.sum(c) for c in ("types", *_STATISTICS)]).first()
    return row[0] or 0, [row[i] or 0 for i in range(1, len(_STATISTICS) + 1)]


def katz_scores(
    docs: DataFrame, training, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per document.

    ``training`` is a boolean column of ``docs``: what the model learns from.
    """
    spark = prepare(docs.sparkSession)
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Null ids keep a place of their own through the arrays.
    nowhere = F.lit((1 << 63) - 1)
    rows = docs.select(
        F.coalesce(F.col(quoted(id_column)).cast("bigint"), nowhere).alias("id"),
        F.coalesce(training, F.lit(False)).alias("train"),
        F.coalesce(F.col(quoted(text_column)).cast("string"), F.lit("")).alias("text"),
    )
    chunks = stored(rows.mapInArrow(_chunks, _CHUNK), "chunks")
    size = chunks.agg(F.sum("words"), F.sum("tokens"), F.sum("documents"), F.sum("length")).first()
    if size[0] is None:
        return spark.createDataFrame([], _RESULT)
    tokens, documents = size[1], size[2]

    word_buckets = max(places, int(size[0] / ENTRIES_PER_BUCKET) + 1)
    words = stored(
        chunks.select("chunk", "vocabulary", "counts")
        .mapInArrow(_ask_words(word_buckets), "bucket int, chunk long, vocabulary binary, counts binary")
        .repartition(places, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_answer_words, _ANSWER),
        "words",
    )
    one_word = OneWord(tokens, *_totals(words))

    buckets = max(places, int(size[3] / 2 / ENTRIES_PER_BUCKET) + 1)
    word_answers = _row_of(words.filter("chunk IS NOT NULL"), 1)
    asked = _meet([_row_of(chunks, 0), word_answers], places).mapInArrow(
        _ask_pairs(word_buckets, buckets, documents),
        "bucket int, chunk long, h binary, h_count binary, lengths binary, w binary, w_count binary, counts binary",
    )
    pairs = stored(
        asked.repartition(places, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_answer_pairs(one_word), _PAIR_ANSWER),
        "pairs",
    )
    discounts = Discounts(_totals(pairs)[1])

    # Backoff weights: the mass left over, by the one-word mass of what was not seen.
    left = sum(F.col(f"k{r}") * float(r - discounts.kept[r]) for r in range(1, LARGE + 1))
    left = (left + F.col(f"k{LARGE + 1}") * SPARE) / F.col("h_count")
    weights = (
        pairs.filter("mass IS NOT NULL")
        .groupBy(F.struct("h").alias("key"))
        .agg(F.max("h_count").alias("h_count"), *[F.sum(c).alias(c) for c in _CONTEXT[2:]])
        .select("key.h", (left / (1 - F.col("mass"))).alias("weight"))
    )
    needs = pairs.filter("h IS NOT NULL AND chunk IS NOT NULL").select("chunk", "h").distinct()
    handed = (
        needs.join(weights, "h")
        .groupBy("chunk")
        .agg(F.collect_list("h").alias("heads"), F.collect_list("weight").alias("weights"))
    )
    pair_answers = _row_of(pairs.filter("answer IS NOT NULL").select("chunk", "bucket", "answer"), 2)
    scored = _meet([_row_of(chunks, 0), word_answers, pair_answers, _row_of(handed, 3)], places).mapInArrow(
        _score(word_buckets, buckets, documents, one_word, discounts), _RESULT
    )
    return scored.withColumn("id", F.nullif("id", nowhere))
