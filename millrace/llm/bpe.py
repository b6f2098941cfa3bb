"""Byte-pair encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that stands inside no token of the vocabulary can never be merged
across, so it marks a certain cut. Words are cut there, the fragments are encoded on their own,
and the ids are put together again. The vocabulary is one of a public tokenizer, of the kind
with word ends; it is read once on the driver and is bounded by the file.

Defined cases: a null text is empty and has no ids; special tokens written in a text are their
own ids; decoding joins the tokens' strings with a space, as this kind of vocabulary without a
decoder does. Repeated rows are encoded alike; an empty table gives no rows. Only the named
columns are read. Texts are encoded whole; words and fragments are kept in caches of bounded
size, which change the speed only.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted
from millrace.llm.common import prepare, texts

#: Entries of the word cache and of the fragment cache of one Python worker.
CACHED = 300_000

#: Code points that Unicode 16 does not have as letters or numbers, while the
#: pattern library in use may; first and last of each range.
NEWER_THAN_16 = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd
a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a
11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128
1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479
3d000-3fc3f
"""
#: Capital letters that Python's tables lack, with their small letters.
NEWER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3,
    0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


def _ranges() -> str:
    pairs = [item.split("-") for item in NEWER_THAN_16.split()]
    return "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in pairs)


#: The split of this vocabulary, with the Unicode tables it was made with.
_LETTER, _NUMBER = (rf"[\p{{{kind}}}--[{_ranges()}]]" for kind in "LN")
WORD_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}"
    rf"|[^\p{{White_Space}}{_LETTER}{_NUMBER}]+"
)
#: For text without code points above these, the classes need no exceptions, which is faster.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_FIRST_NEWER = 0x558


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in signs):
        signs[b] = chr(256 + n)
    return [signs[b] for b in range(256)]


class _Cache(dict):
    """A dictionary that asks a function for what it lacks, and starts anew when full."""

    def __init__(self, make, size: int = CACHED) -> None:
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Vocabulary:
    """Tokens, merges and certain cuts of one vocabulary file."""

    def __init__(self, content: str) -> None:
        document = json.loads(content)
        model = document["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("A BPE vocabulary with word ends is needed.")
        end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in document["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        signs = byte_characters()
        self.sign_of_byte = {b: s for b, s in enumerate(signs)}
        # Merges by the ids of their sides; the result's id and its rank, lower ranks first.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.symbols = [self.ids[s] for s in signs]
        self.last_symbols = [self.ids[s + end] for s in signs]
        # Pairs that stand inside some token, apart from whether the second ends a word.
        byte_of = {s: b for b, s in enumerate(signs)}
        self.inner = [[False] * 256 for _ in range(256)]
        self.ending = [[False] * 256 for _ in range(256)]
        for token in self.ids:
            ends = token.endswith(end) and token != end
            letters = [byte_of[c] for c in (token[: -len(end)] if ends else token) if c in byte_of]
            for i, (a, b) in enumerate(zip(letters, letters[1:])):
                last = ends and i + 2 == len(letters)
                (self.ending if last else self.inner)[a][b] = True
        self.pattern = regex.compile(WORD_PATTERN, regex.V1)
        self.plain = regex.compile(PLAIN_PATTERN)
        self.beyond = regex.compile(f"[{chr(_FIRST_NEWER)}-\U0010ffff]")
        written = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.cut_special = regex.compile(f"({written})") if written else None
        self.words = _Cache(self._encode_word)
        self.fragments = _Cache(self._encode_fragment)

    def fragments_of(self, data: bytes) -> list[tuple[bytes, bool]]:
        """A word's bytes cut at the certain cuts; the flag says which fragment ends it."""
        cuts, inner, n = [0], self.inner, len(data)
        for i in range(1, n - 1):
            if not inner[data[i - 1]][data[i]]:
                cuts.append(i)
        if n > 1 and not self.ending[data[n - 2]][data[n - 1]]:
            cuts.append(n - 1)
        cuts.append(n)
        return [(data[a:b], b == n) for a, b in zip(cuts, cuts[1:])]

    def _encode_word(self, word: str) -> tuple[int, ...]:
        parts = self.fragments_of(word.encode("utf-8", "replace"))
        if len(parts) == 1:
            return self._encode_fragment(parts[0])
        return tuple(chain.from_iterable(map(self.fragments.__getitem__, parts)))

    def _encode_fragment(self, fragment: tuple[bytes, bool]) -> tuple[int, ...]:
        data, ends = fragment
        if len(data) > 256:
            return self._encode_long(fragment)
        ids = [self.symbols[b] for b in data]
        if ends:
            ids[-1] = self.last_symbols[data[-1]]
        known = self.merges.get
        while len(ids) > 1:
            best, pair = None, None
            for found in map(known, zip(ids, ids[1:])):
                if found is not None and (best is None or found < best):
                    best = found
            if best is None:
                break
            made, out, i, n = best[1], [], 0, len(ids)
            while i < n:
                if i + 1 < n and known((ids[i], ids[i + 1])) == best:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return tuple(ids)

    def _encode_long(self, fragment: tuple[bytes, bool]) -> tuple[int, ...]:
        """The same for a long fragment: a heap of merges over a linked list, n log n."""
        import heapq

        data, ends = fragment
        ids = [self.symbols[b] for b in data]
        if ends:
            ids[-1] = self.last_symbols[data[-1]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.merges.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return tuple(x for x in ids if x >= 0)

    def _encode_plain(self, text: str) -> list[int]:
        pattern = self.plain
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if self.beyond.search(text):
                pattern = self.pattern
                text = text.translate(NEWER_CAPITALS)
            # Lower case is taken letter by letter: no final form of sigma.
            text = text.replace("Σ", "σ")
        found = pattern.findall(text.lower())
        return list(chain.from_iterable(map(self.words.__getitem__, found)))

    def encode(self, text: str) -> list[int]:
        if self.cut_special is None or "<" not in text:
            return self._encode_plain(text)
        ids: list[int] = []
        for piece in self.cut_special.split(text):
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                ids += self._encode_plain(piece)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


RESULT = pa.schema(
    [
        ("id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.list_(pa.int32())),
        ("decoded", pa.string()),
    ]
)
DIGEST = pa.schema(
    [
        ("id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
    ]
)


def _encoded(content, digest: bool, decode: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        names = {i: str(i) for i in vocabulary.tokens}
        for batch in batches:
            keys = batch.column("id")
            for start in range(0, batch.num_rows, 32):
                part = batch.slice(start, 32)
                rows = []
                for text in part.column("text").to_pylist():
                    ids = vocabulary.encode(text)
                    decoded = vocabulary.decode(ids) if decode or digest else None
                    if digest:
                        joined = " ".join(map(names.__getitem__, ids))
                        rows.append(
                            (
                                len(ids),
                                hashlib.sha256(joined.encode()).hexdigest(),
                                hashlib.sha256(decoded.encode()).hexdigest(),
                            )
                        )
                    else:
                        rows.append((len(ids), ids, decoded))
                schema = DIGEST if digest else RESULT
                columns = [keys.slice(start, 32)]
                for k in range(3):
                    columns.append(pa.array([r[k] for r in rows], schema.types[k + 1]))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def encode_documents(
    docs: DataFrame,
    vocabulary_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: bool = False,
    decode: bool = True,
) -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` per document, or digests of the last two.

    Without ``decode`` the decoded text is null.

    With ``digest`` the ids in decimal, joined by a space, and the decoded text are hashed where
    they are made, so that long results need not travel.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    schema = (
        "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
        if digest
        else "id long, n_tokens long, ids array<int>, decoded string"
    )
    return texts(docs, id_column, text_column).mapInArrow(_encoded(content, digest, decode), schema)


def decode_documents(
    encoded: DataFrame, vocabulary_path: str, id_column: str = "id", ids_column: str = "ids"
) -> DataFrame:
    """``(id, decoded)`` from lists of ids; a null list decodes to the empty text."""
    spark = prepare(encoded.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())

    def run(batches):
        vocabulary = _vocabulary(content.value)
        for batch in batches:
            decoded = [vocabulary.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(decoded, pa.string())], names=["id", "decoded"]
            )

    rows = encoded.select(
        F.col(quoted(id_column)).cast("bigint").alias("id"), F.col(quoted(ids_column)).alias("ids")
    )
    return rows.mapInArrow(run, "id long, decoded string")
