"""Conversations as one text with marked turns, checked by reading them back.

A turn is written as ``<|im_start|>role``, a new line, its text, ``<|im_end|>`` and a new line.
A deterministic grammar reads that back: a start mark, a role up to the new line, a text up to
the first mark, which must be an end mark, and a new line. Whatever is written is parsed again
and compared with the turns it came from. Fields that do not come back as they were are escaped,
and that is repeated until the turns are identical; nothing else is escaped, so ordinary texts
stand as they are.

An escape adds a backslash to ``<|`` in a text (``<\\|``, and one more where there are some
already), so that no mark is left in it and taking one away gives the text again. In a role
backslashes, new lines and bars are escaped. The parser takes escapes away everywhere; a field
that holds something like an escape itself does not survive that unescaped, and gets one.

The output is a row for each part of a conversation, at most ``PART`` code points unless one
turn is longer, with the places of the assistant's texts (the loss mask) in it. Parts end with a
turn, so every part can be parsed alone. Rows are dealt to ranges of conversation and turn, so a
conversation with a third of all turns is written by many tasks.

Defined cases: a null text or role is empty. Turns of a conversation are in the order of
``turn``, nulls last; turns with one number by a hash of role and text, then by these. Rows
without a conversation id make up the conversation null. Repeated rows are repeated turns. A
conversation has at least one turn, as its rows are its turns; an empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted
from millrace.llm.common import prepare

START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"
#: Code points of a part, unless one turn is longer.
PART = 1 << 16

_MARK = re.compile(re.escape(START) + "|" + re.escape(END))
_OPENING = re.compile(r"<(\\*)\|")
_OPENING_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPES = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
_ROLE_ESCAPED = re.compile(r"\\([\\np])")
_ROLE_PLAIN = {"\\": "\\", "n": "\n", "p": "|"}


def escape_text(text: str) -> str:
    return _OPENING.sub(r"<\1\\|", text)


def unescape_text(text: str) -> str:
    return _OPENING_ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return "".join(_ROLE_ESCAPES.get(letter, letter) for letter in role)


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda found: _ROLE_PLAIN[found[1]], role)


@dataclass(frozen=True)
class Turn:
    """A turn as the parser finds it: unescaped, with the place of its text as written."""

    role: str
    text: str
    start: int
    end: int


def parse(written: str) -> list[Turn] | None:
    """All turns of a written text, or None where the grammar does not fit it."""
    turns, at = [], 0
    while at < len(written):
        if not written.startswith(START, at):
            return None
        begin = written.find("\n", at)
        if begin < 0:
            return None
        role = written[at + len(START) : begin]
        mark = _MARK.search(written, begin + 1)
        if _MARK.search(role) or mark is None or mark[0] != END or not written.startswith("\n", mark.end()):
            return None
        text = written[begin + 1 : mark.start()]
        turns.append(Turn(unescape_role(role), unescape_text(text), begin + 1, mark.start()))
        at = mark.end() + 1
    return turns


def _same(found: list[Turn] | None, turns: Sequence[tuple[str, str]]) -> bool:
    return found is not None and [(turn.role, turn.text) for turn in found] == list(turns)


def _written(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[Turn]]:
    """The turns as written, and as read back from that.

    Fields start unescaped. While the parse differs from the turns, those that do not come back
    when they are written alone are escaped, the role where an empty text would not mend it.
    """
    fields = list(turns)
    while True:
        written = "".join(_written(role, text) for role, text in fields)
        found = parse(written)
        if _same(found, turns):
            return written, found
        changed = False
        for i, (role, text) in enumerate(turns):
            if _same(parse(_written(*fields[i])), [(role, text)]):
                continue
            better = (
                role if _same(parse(_written(role, "")), [(role, "")]) else escape_role(role),
                text if _same(parse(_written("", text)), [("", text)]) else escape_text(text),
            )
            changed |= better != fields[i]
            fields[i] = better
        if not changed:
            raise AssertionError("turns that come back alone do not come back together")


PARTS = (
    "conv_id bigint, place int, part bigint, n_turns int, text string, "
    "loss array<struct<start: int, end: int>>"
)
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_PARTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("place", pa.int32()),
        ("part", pa.int64()),
        ("n_turns", pa.int32()),
        ("text", pa.string()),
        ("loss", _LOSS),
    ]
)
_BYTES_PER_STEP = 1 << 20


def _part(conv_id: int | None, place: int, part: int, turns: list[tuple[str, str]]) -> tuple:
    written, found = render(turns)
    loss = [{"start": turn.start, "end": turn.end} for turn in found if turn.role == LEARNT_ROLE]
    return conv_id, place, part, len(turns), written, loss


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns come in order, so a conversation's parts do as well."""
    ready, held = [], 0
    now, turns, size, part = None, [], 0, 0

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind.type) for column, kind in zip(zip(*ready, strict=True), _PARTS, strict=True)],
            schema=_PARTS,
        )

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "place", "role", "text")]
        for conv_id, place, role, text in zip(*columns, strict=True):
            more = len(role) + len(text)
            if turns and (conv_id != now[0] or size + more > PART):
                ready.append(_part(*now, part, turns))
                held += size
                part = part + 1 if conv_id == now[0] else 0
                turns, size = [], 0
            now = (conv_id, place)
            turns.append((role, text))
            size += more
            if held >= _BYTES_PER_STEP:
                yield batch_of()
                ready, held = [], 0
    if turns:
        ready.append(_part(*now, part, turns))
    if ready:
        yield batch_of()


def format_conversations(
    turns: DataFrame,
    conversation_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``(conv_id, place, part, n_turns, text, loss)``: written parts, in the order of place and part.

    ``loss`` holds the start and end of each assistant text in ``text``, in code points.
    """
    spark = prepare(turns.sparkSession)
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(
        F.col(quoted(conversation_column)).cast("bigint").alias("conv_id"),
        F.col(quoted(turn_column)).cast("bigint").alias("turn"),
        F.coalesce(F.col(quoted(role_column)).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(quoted(text_column)).cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("tie")]
    dealt = (
        rows.withColumn("tie", F.xxhash64("role", "text"))
        .repartitionByRange(places, *order)
        .sortWithinPartitions(*order, "role", "text")
    )
    return dealt.select("conv_id", F.spark_partition_id().alias("place"), "role", "text").mapInArrow(_format, PARTS)


@dataclass
class _Digest:
    """What has been read of a conversation."""

    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    turns: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    loss: "hashlib._Hash" = field(default_factory=hashlib.sha256)

    def add(self, text: str, loss: list[dict]) -> None:
        found = parse(text)
        if found is None:
            raise ValueError("a part that the grammar does not fit")
        self.n_turns += len(found)
        self.formatted_chars += len(text)
        self.turns.update("".join(f"{t.role}\n{t.text}\n" for t in found).encode("utf-8", "surrogatepass"))
        for span in loss:
            learnt = unescape_text(text[span["start"] : span["end"]])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode("utf-8", "surrogatepass"))

    def row(self, conv_id: int | None) -> tuple:
        return (
            conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars,
        )


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
_ROWS_PER_STEP = 4096


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ready: list[tuple] = []
    now, digest = None, None

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind.type) for column, kind in zip(zip(*ready, strict=True), _DIGESTS, strict=True)],
            schema=_DIGESTS,
        )

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "text", "loss")]
        for conv_id, text, loss in zip(*columns, strict=True):
            if digest is not None and conv_id != now:
                ready.append(digest.row(now))
                digest = None
                if len(ready) >= _ROWS_PER_STEP:
                    yield batch_of()
                    ready = []
            now, digest = conv_id, digest or _Digest()
            digest.add(text, loss)
    if digest is not None:
        ready.append(digest.row(now))
    if ready:
        yield batch_of()


def read_back(parts: DataFrame) -> DataFrame:
    """What the parser finds in written parts, one row a conversation.

    The digests run over a conversation's turns and its texts under the loss mask. They can only
    be taken one part after another, so a task reads a conversation's parts as a stream, of which
    it holds one batch.
    """
    prepare(parts.sparkSession)
    order = ["conv_id", "place", "part"]
    dealt = parts.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select(*order, "text", "loss").mapInArrow(_read, DIGESTS)
