import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use inside.
    "id long, key long, n long, size long, row long, a long, b long, sign long, copies long, unit string"
)


def sentence(rng, words):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_texts():
    """Ids and texts: nulls, empty and very long texts, ties, repeated rows and planted copies."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    passage = sentence(rng, 40)
    words = base.split(" ")
    near = " ".join(words[:60] + ["CHANGED"] + words[61:])
    rows = [
        (1, base), (2, base), (3, base.upper()), (4, near), (5, None), (6, ""), (7, "  \t\n "),
        (8, "one two"), (9, "One\x0bTWO"), (10, "one two three four five"), (11, sentence(rng, 80)),
        (12, passage + " " + sentence(rng, 30)), (13, sentence(rng, 25) + " " + passage),
        (14, "é" * 30 + passage), (15, sentence(rng, 20_000)), (16, "x" * 3_000), (17, "x" * 1_500),
        (18, "naïve ΣΑΣ It's 12\u00a0x <|endoftext|> ЖЖ 日本語 🙂"), (None, base), (None, "no id at all here"),
        (19, sentence(rng, 60)), (19, sentence(rng, 60)), (20, base), (20, base), (21, near + " tail"),
    ]
    return rows


@pytest.fixture(scope="session")
def frame_of(spark):
    """Documents with columns whose names clash with those inside the operators."""

    def make(pairs):
        rows = [
            (i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), 1, 2, 3, 4, 5, 6, 7, 8, 9, "u")
            for k, (i, t) in enumerate(pairs)
        ]
        return spark.createDataFrame(rows, SCHEMA)

    return make
