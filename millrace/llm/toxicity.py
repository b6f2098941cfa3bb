"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams and itself, each hashed to a row of one embedding
table. Rows are averaged over a window of words and a linear softmax tells the two labels
apart; embeddings and softmax are trained jointly, in numpy on the driver, on a bounded sample
of labelled documents. A misspelling that was never seen shares most of its n-grams with the
word it stands for, and with them its vector.

A document's score is that of its most toxic window, so long texts do not dilute a passage.
Training follows: windows first carry their document's label; then the model starts anew with,
of a toxic document, only the windows that the first one finds toxic, one at least.

Scoring runs in tasks over all whole texts, with the averaged product of table and softmax as a
vector of bounded size.

Defined cases: a null or empty text gets the score of the bias alone; labels that are null are
left out, of several labels of one document the highest counts; repeated rows score alike; with
no usable labels, or labels of one kind only, the score is that share for every text. Empty
tables give no rows. Labels, language, source and id are not inputs of a score. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted
from millrace.llm.common import Words, discard, mix64, prepare, steps, stored, texts

#: Rows of the embedding table, numbers of a row, and lengths of the n-grams in bytes.
BUCKETS = 1 << 19
DIMENSIONS = 8
GRAMS = (3, 4)
#: Words of a window and distance of window starts.
WINDOW, STRIDE = 8, 4
#: The bound of the training sample, in documents and in words of them.
TRAIN_DOCUMENTS = 3_000
TRAIN_WORDS = 1_500_000
RATE, DECAY, STEP = 0.5, 1e-4, 0.05
#: Documents that a table row must have been seen in to count.
LEAST_DOCUMENTS = 4
WINDOWS_PER_STEP = 512
#: Epochs of each phase, and the least number of steps for small samples.
PHASES = (2, 4)
LEAST_STEPS = 600
THRESHOLD = 0.7

_MARK = np.uint64(0x9AE16A3B2F90404F)
_GRAM_STEP = np.uint64(0x9FB21C651E98DF25)
_LETTERS = mix64(np.arange(1, 259, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def subwords(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the subwords of all words in their order, and each word's first subword.

    A word's n-grams are taken with a mark before and after it; the word itself comes last.
    """
    lengths = words.ends - words.starts
    n = len(lengths)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    # Every word between its marks, one after another.
    at = np.concatenate([[0], np.cumsum(lengths + 2)])
    marked = np.empty(at[-1], np.uint64)
    inside = np.ones(at[-1], bool)
    inside[at[:-1]] = False
    inside[at[1:] - 1] = False
    source = np.repeat(words.starts - (at[:-1] + 1), lengths) + np.flatnonzero(inside)
    marked[inside] = _LETTERS[words.lower[source]]
    marked[at[:-1]] = _LETTERS[256]
    marked[at[1:] - 1] = _LETTERS[257]
    counts = [np.maximum(lengths + 3 - g, 0) for g in GRAMS]
    first = np.concatenate([[0], np.cumsum(sum(counts) + 1)])
    rows = np.empty(first[-1], np.int64)
    mask = np.uint64(BUCKETS - 1)
    offset = first[:-1].copy()
    for g, many in zip(GRAMS, counts, strict=True):
        if len(marked) >= g and many.any():
            code = np.zeros(len(marked) - g + 1, np.uint64)
            for k in range(g):
                code *= _GRAM_STEP
                code += marked[k : k + len(code)]
            word = np.repeat(np.arange(n), many)
            step = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
            rows[offset[word] + step] = (mix64(code[at[word] + step]) & mask).astype(np.int64)
        offset += many
    rows[offset] = (mix64(words.hashes ^ _MARK) & mask).astype(np.int64)
    return rows, first


def windows(first_word: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and text of each window; a text without words has none."""
    many = np.diff(first_word)
    count = np.where(many > 0, 1 + np.maximum(many - WINDOW + stride - 1, 0) // stride, 0)
    owner = np.repeat(np.arange(len(many)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = first_word[owner] + number * stride
    return start, np.minimum(start + WINDOW, first_word[owner + 1]), owner


@dataclass(frozen=True)
class Model:
    """What one subword adds to the logit of the toxic label, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, words: Words) -> np.ndarray:
        """The score of each text: the highest of its windows."""
        logits = np.full(len(words.first) - 1, -np.inf)
        start, end, owner = windows(words.first)
        if len(start):
            rows, first = subwords(words)
            sums = np.concatenate([[0.0], np.cumsum(self.weights[rows])])
            a, b = first[start], first[end]
            np.maximum.at(logits, owner, (sums[b] - sums[a]) / (b - a))
        logits[np.isneginf(logits)] = 0.0
        return 1.0 / (1.0 + np.exp(-(logits + self.bias)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: np.ndarray, bounds: np.ndarray, owner: np.ndarray, label: np.ndarray, seed: int = 1) -> Model:
    """Train on windows: ``rows[bounds[i]:bounds[i + 1]]`` are window i's subwords.

    ``owner`` is the document of a window and ``label`` the label of a document.
    """
    share = float(label.mean()) if len(label) else 0.0
    if not len(owner) or share in (0.0, 1.0):
        edge = np.clip(share, 1e-6, 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(edge / (1 - edge))))
    truth = label[owner].astype(np.float32)
    size = np.diff(bounds)
    chosen = np.arange(len(owner))
    for phase, epochs in enumerate(PHASES):
        if phase:
            logit = np.concatenate(
                [
                    np.add.reduceat(weights[rows[bounds[i] : bounds[min(i + 4096, len(size))]]], bounds[i : i + 4096][: len(size) - i] - bounds[i])
                    for i in range(0, len(size), 4096)
                ]
            ) / size + bias
            order = np.lexsort((-logit, owner))
            top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            chosen = np.union1d(np.flatnonzero((truth == 0) | (logit > 0)), top)
        weights, bias = _descend(rows, bounds, truth, chosen, epochs, seed + phase)
    # Rows that hardly any document touches tell more about those than about the label.
    documents = np.zeros(BUCKETS, np.int32)
    limits = np.append(bounds[np.flatnonzero(np.diff(owner, prepend=-1))], bounds[-1])
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        documents[np.unique(rows[a:b])] += 1
    weights[documents < LEAST_DOCUMENTS] = 0.0
    return Model(weights.astype(np.float32), bias)


def _descend(
    rows: np.ndarray, bounds: np.ndarray, truth: np.ndarray, chosen: np.ndarray, epochs: int, seed: int
) -> tuple[np.ndarray, float]:
    """Embeddings and softmax trained together on the chosen windows, from a fresh start.

    Returns what each table row adds to the toxic logit, and the bias. A table row moves with
    the number of windows that it is in, so n-grams of a few windows stay near zero.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    softmax = rng.uniform(-1, 1, (2, DIMENSIONS)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    size = np.diff(bounds)
    per_epoch = -(-len(chosen) // WINDOWS_PER_STEP)
    epochs = max(epochs, -(-LEAST_STEPS // per_epoch))
    for epoch in range(epochs):
        rate = RATE / (1 + 4 * epoch / epochs)
        order = rng.permutation(chosen)
        for at in range(0, len(order), WINDOWS_PER_STEP):
            batch = np.sort(order[at : at + WINDOWS_PER_STEP])
            many = size[batch]
            starts = np.cumsum(many) - many
            place = np.repeat(bounds[batch] - starts, many) + np.arange(many.sum())
            touched, index = np.unique(rows[place], return_inverse=True)
            vectors = table[touched]
            share = (1.0 / many).astype(np.float32)[:, None]
            mean = np.add.reduceat(vectors[index], starts, axis=0) * share
            p = _sigmoid(mean @ (softmax[1] - softmax[0]) + bias[1] - bias[0])
            error = np.stack([truth[batch] - p, p - truth[batch]], 1)  # of labels 0 and 1
            pull = np.repeat(error @ softmax, many, axis=0)
            change = np.stack(
                [np.bincount(index, pull[:, d], len(touched)) for d in range(DIMENSIONS)], 1
            ).astype(np.float32)
            table[touched] = vectors * (1 - rate * DECAY) - rate * STEP * change
            softmax -= rate * (error.T @ mean / len(batch) + DECAY * softmax)
            bias -= rate * error.mean(0)
    return table @ (softmax[1] - softmax[0]), float(bias[1] - bias[0])


def checksum(id_column: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(quoted(id_column)).cast("string"), F.lit("")))


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str = "toxic",
    id_column: str = "doc_id",
    text_column: str = "text",
    documents: int = TRAIN_DOCUMENTS,
) -> DataFrame:
    """``(text, label)`` of at most ``documents`` labelled documents, by a hash of the id."""
    known = (
        labels.filter(F.col(quoted(label_column)).isNotNull() & F.col(quoted(id_column)).isNotNull())
        .groupBy(F.col(quoted(id_column)).cast("bigint").alias("id"))
        .agg(F.max(F.col(quoted(label_column)).cast("int")).alias("label"))
    )
    rows = texts(docs, id_column, text_column)
    present = rows.select("id").distinct().join(known, "id")
    picked = present.orderBy(F.xxhash64(F.lit(17), "id"), "id").limit(documents)
    # At most ``documents`` rows of two numbers.
    return rows.join(F.broadcast(picked), "id").select("id", "text", "label")


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in steps(batches):
        words = Words(data, offsets)
        rows, first = subwords(words)
        out = []
        for i in range(batch.num_rows):
            a, b = words.first[i], words.first[i + 1]
            out.append(
                (rows[first[a] : first[b]].astype(np.int32).tobytes(), np.diff(first[a : b + 1]).astype("<u4").tobytes())
            )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("label"),
                pa.array([r for r, _ in out], pa.binary()),
                pa.array([s for _, s in out], pa.binary()),
            ],
            names=["id", "label", "rows", "sizes"],
        )


def train(sample: DataFrame, most_words: int = TRAIN_WORDS) -> Model:
    """Train on a bounded sample of ``(id, text, label)``.

    The sample's subwords are stored, and fetched in the order of a hash of the id, until
    ``most_words`` words have come.
    """
    # Stored, as the sort reads its input twice.
    features = stored(sample.mapInArrow(_features, "id long, label int, rows binary, sizes binary"), "features")
    # A query's shuffle files go when its action ends (``prepare``), which for an iterator of a
    # frame is before the first row is read. Those of an RDD stay as long as it does.
    fetched = features.orderBy(F.xxhash64(F.lit(17), "id"), "id", "sizes", "rows").rdd
    # One array that grows in place: the subwords are most of what the driver holds.
    held, filled = np.empty(1 << 20, np.int32), 0
    all_sizes, owner, label, total, n = [], [], [], 0, 0
    for row in fetched.toLocalIterator():
        if total >= most_words:
            break
        rows = np.frombuffer(row["rows"], np.int32)
        per_word = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        total += len(per_word)
        first = np.concatenate([[0], np.cumsum(per_word)])
        start, end, _ = windows(np.array([0, len(per_word)]), WINDOW)
        if filled + len(rows) > len(held):
            held.resize(max(filled + len(rows), len(held) + (1 << 22)), refcheck=False)
        # Windows follow one another without overlap, so the rows are theirs in order.
        held[filled : filled + len(rows)] = rows
        filled += len(rows)
        all_sizes.append(first[end] - first[start])
        owner.append(np.full(len(start), n))
        label.append(row["label"] > 0)
        n += 1
    discard(features)
    sizes = np.concatenate([np.zeros(0, np.int64), *all_sizes])
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    owners = np.concatenate([np.zeros(0, np.int64), *owner])
    return fit(held[:filled], bounds, owners, np.array(label, np.float64))


def score_documents(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(id, score)`` of every text."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch, data, offsets in steps(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(shared.value.scores(Words(data, offsets)), pa.float64())],
                names=["id", "score"],
            )

    return texts(docs, id_column, text_column).mapInArrow(run, "id long, score double")


def keep_acceptable(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            plain = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(batch.num_rows)), batch.column(at).cast(pa.string())],
                names=["row", "text"],
            )
            for part, data, offsets in steps([plain]):
                good = shared.value.scores(Words(data, offsets)) < threshold
                yield batch.take(part.column("row").filter(pa.array(good)))

    return docs.mapInArrow(run, docs.schema)
