"""Runs of words with a period, by internal pattern matching.

A run is a stretch of words with smallest period ``q``, at least ``FEWEST`` words and
``POWER`` times its period long, that no neighbouring word extends. With the exponent at least
four, a run of period ``q`` contains a block of ``L`` words that starts at a multiple of ``L``,
where ``L`` is the largest power of two up to ``2 q``, and the same words again ``q`` places
after or before it. Between the two they do not occur: a nearer occurrence would give the run a
smaller period. So every block asks for its next and previous occurrence in the windows beside
it, and the distance, if it is at least ``L / 2``, is the only period the block can stand for.

The questions go to a suffix array over the words of a batch of texts, each text apart. While it
is sorted by prefix doubling, every round names the interval of each block of that round's
length; a wavelet matrix over the array then finds the successor and predecessor of a place
within an interval. Blocks that follow each other with the same distance are one progression,
which is extended word by word to where the period ends. Words are told apart by themselves and
not by hashes, so results are exact.

A word of a run after its first period is dropped in the collapsed text.

Defined cases: a null text is empty, and a text without words has no runs and collapses to the
empty text; rows that share an id, or have none, are judged one by one; an empty table gives no
rows. Only the named columns are read. A text is held whole by one task (a row is), with some 80
bytes a word beside it; shorter ones come in bounded steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, prepare, steps, texts

#: A run has at least so many words, and so many times its period.
FEWEST, POWER = 6, 4

_U64 = np.uint64
_SHIFT = np.int64(32)


def word_numbers(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of some texts, a number for each that only equal words share, and each text's first."""
    lists = pc.ascii_split_whitespace(texts)
    pieces = lists.flatten()
    full = pc.greater(pc.binary_length(pieces), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    first = before[np.concatenate([[0], np.cumsum(lengths)])]
    words = pieces.filter(full)
    return words, words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), first


def suffix_array(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Places sorted by the words from them on, text by text, and the intervals of blocks.

    The second result holds ``(places, from, to, length)`` of the blocks that occur more than
    once in their text, for each power of two. Order is settled as far as a block can reach.
    """
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    starts, ends = first[:-1][text], first[1:][text]
    order, rank, active = _named(text << _SHIFT | numbers)
    intervals, length = [], 1
    while len(active[0]) and 2 * length <= sizes.max():
        slots, _ = active
        place = order[slots]
        after = place + length
        inside = after < ends[place]
        key = rank[place] << _SHIFT
        key[inside] |= rank[after[inside]] + 1
        inner, heads, active = _named(key, slots)
        order[slots] = place[inner]
        rank[order[slots]] = heads
        length *= 2
        slots, counts = active
        place = order[slots]
        block = ((place - starts[place]) % length == 0) & (place + length <= ends[place])
        place = place[block]
        low = rank[place]
        intervals.append((place, low, low + counts[block], length))
    return order, intervals


def _named(key: np.ndarray, slots: np.ndarray | None = None) -> tuple:
    """Order by ``key``, and what it tells about the ``slots`` that the sorted values go to.

    With no slots: ``(order, rank of each value, (slots, counts))``. Otherwise ranks are by slot.
    A rank is the first slot with the same key; the last part holds the slots whose key is not
    alone, and how often it occurs.
    """
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(key)))
    own = np.arange(len(key)) if slots is None else slots
    heads = np.repeat(own[at], counts)
    many = np.repeat(counts, counts)
    repeated = many > 1
    active = (own[repeated], many[repeated])
    if slots is not None:
        return order, heads, active
    rank = np.empty(len(key), np.int64)
    rank[order] = heads
    return order, rank, active


class WaveletMatrix:
    """A sequence of numbers; ranks and quantiles of its intervals, many at a time."""

    def __init__(self, values: np.ndarray) -> None:
        self.length = len(values)
        self.levels = []
        for bit in reversed(range(int(values.max(initial=0)).bit_length())):
            ones = (values >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view(_U64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((bit, packed, before, self.length - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def _ones(self, packed: np.ndarray, before: np.ndarray, upto: np.ndarray) -> np.ndarray:
        word = upto >> 6
        low = (_U64(1) << (upto & 63).astype(_U64)) - _U64(1)
        return before[word] + np.bitwise_count(packed[word] & low)

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers of each interval are smaller than ``value``."""
        count = np.zeros(len(low), np.int64)
        for bit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            one = (value >> bit & 1).astype(bool)
            count += np.where(one, (high - b) - (low - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return count

    def quantile(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest number of each interval, from 0."""
        found = np.zeros(len(low), np.int64)
        for bit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            smaller = (high - b) - (low - a)
            one = k >= smaller
            k = k - np.where(one, smaller, 0)
            found |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return found

    def neighbours(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> tuple:
        """The next smaller and next larger number than ``value``, itself in the interval; -1 where none."""
        at = self.below(low, high, value)
        smaller, larger = np.full(len(at), -1), np.full(len(at), -1)
        some = at > 0
        smaller[some] = self.quantile(low[some], high[some], at[some] - 1)
        some = at + 1 < high - low
        larger[some] = self.quantile(low[some], high[some], at[some] + 1)
        return smaller, larger


def _progressions(order: np.ndarray, intervals: list[tuple], first: np.ndarray) -> tuple:
    """``(period, from, to)`` of stretches with that period, from neighbouring equal blocks."""
    starts = np.repeat(first[:-1], np.diff(first))
    matrix = WaveletMatrix(order - starts[order])
    periods, lows, highs = [], [], []
    for place, low, high, length in intervals:
        if not len(place):
            continue
        own = place - starts[place]
        smaller, larger = matrix.neighbours(low, high, own)
        for begin, end in ((own, larger), (smaller, own)):
            distance = end - begin
            good = (begin >= 0) & (distance >= length // 2) & (distance < length)
            at, d = begin[good] + starts[place[good]], distance[good]
            periods.append(d)
            lows.append(at)
            highs.append(at + d + length)
    if not periods:
        return (np.zeros(0, np.int64),) * 3
    period, low, high = np.concatenate(periods), np.concatenate(lows), np.concatenate(highs)
    inner = np.lexsort((low, period))
    period, low, high = period[inner], low[inner], high[inner]
    # Stretches of one period are of one length. Where they share a whole period they are one.
    new = np.ones(len(period), bool)
    new[1:] = (period[1:] != period[:-1]) | (low[1:] + period[1:] > high[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(period)) - 1
    return period[new], low[new], high[last] if len(period) else high


def _agree(numbers: np.ndarray, at: np.ndarray, by: np.ndarray, period: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many words from ``at`` on, in steps of ``by``, equal those a period nearer the stretch."""
    total = np.zeros(len(at), np.int64)
    going, width = np.arange(len(at)), period.copy()
    while len(going):
        take = np.minimum(width[going], room[going] - total[going])
        some = take > 0
        going, take = going[some], take[some]
        if not len(going):
            break
        begin = np.cumsum(take) - take
        inside = np.arange(int(take.sum())) - np.repeat(begin, take)
        step = np.repeat(by[going], take)
        place = np.repeat(at[going] + by[going] * total[going], take) + step * inside
        differs = numbers[place] != numbers[place - step * np.repeat(period[going], take)]
        reach = np.minimum.reduceat(np.where(differs, inside, np.repeat(take, take)), begin)
        total[going] += reach
        going = going[reach == take]
        width[going] *= 2
    return total


def find_runs(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs, in the order of start and period.

    ``numbers`` are the words of several texts one after another, ``first`` each text's first
    place and the end of all; starts are places among all of them.
    """
    if not len(numbers):
        return (np.zeros(0, np.int64),) * 3
    period, low, high = _progressions(*suffix_array(numbers, first), first)
    text = np.searchsorted(first, low, side="right") - 1
    one = np.ones(len(low), np.int64)
    start = low - _agree(numbers, low - 1, -one, period, low - first[text])
    end = high + _agree(numbers, high, one, period, first[text + 1] - high)
    length = end - start
    kept = (length >= FEWEST) & (length >= POWER * period)
    start, length, period = start[kept], length[kept], period[kept]
    inner = np.lexsort((period, start))
    start, length, period = start[inner], length[inner], period[inner]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (period[1:] != period[:-1])
    return start[new], length[new], period[new]


RESULT = "id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in steps(batches):
        words, numbers, first = word_numbers(batch.column("text"))
        start, length, period = find_runs(numbers, first)
        text = np.searchsorted(first, start, side="right") - 1
        room = len(numbers) + 1
        change = np.bincount(start + period, minlength=room) - np.bincount(start + length, minlength=room)
        kept = np.cumsum(change[:-1]) == 0
        if len(start):
            words = words.filter(pa.array(kept))
        left = np.concatenate([[0], np.cumsum(kept)])[first]
        lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words)
        runs = pa.StructArray.from_arrays(
            [pa.array(start - first[text]), pa.array(length), pa.array(period)], ["start", "length", "period"]
        )
        places = np.searchsorted(text, np.arange(len(first)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(np.diff(first)),
                pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), runs),
                pc.binary_join(lists, " "),
            ],
            names=["id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of every text: its runs by start and period, and the
    words that no run drops, joined by one space. Nothing is shuffled."""
    prepare(docs.sparkSession)
    return texts(docs, id_column, text_column).mapInArrow(_judge, RESULT)


def with_repeats(text: Column, number: Column) -> Column:
    """``text``, of which a tenth by ``number`` goes on with a period from some word on.

    With ``g = floor(number / 10)``, where ``number`` is divisible by ten and the text has ``n``
    words, word ``i`` from ``a = g % n`` on becomes word ``a + (i - a) % p``, where
    ``p = 1 + floor((n - a) / (3 + g % 8))``. Other texts, and those without a number, stay.
    """
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def repeat(item: Column) -> Column:
        n, g = F.size(item["words"]).cast("bigint"), item["g"]
        a = g % n
        p = F.lit(1).cast("bigint") + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        whole = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(item["words"], place(i)))
        return F.when(n > 0, F.array_join(whole, " "))

    # One array, looked at by one lambda, so that the words are cut once.
    cut = F.array(F.struct(words.alias("words"), F.floor(number / 10).cast("bigint").alias("g")))
    changed = F.element_at(F.transform(cut, repeat), 1)
    return F.when(number % 10 == 0, F.coalesce(changed, text)).otherwise(text)
