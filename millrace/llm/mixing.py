"""Mix sources to target weights by repeating and sampling whole documents.

Sizes are summed per source, a target follows for each source, and a document is emitted
``floor(rate)`` times plus one copy drawn with the fraction as its probability. The draw is a
hash of a seed and the document's id, so reruns and retried tasks agree.

Everything is DataFrame expressions. What meets per source is one row of sums.

Defined cases: a null text has size 0; a null source is a source of its own and the last one;
a source whose documents are all empty has target 0 and nothing of it is emitted; documents
with the same id share their draw, those without one draw by their text; an empty table gives an empty mix. Only the columns named
in the call are looked at, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.sortkeys import SortKey, quoted
from millrace.llm.common import WORD, stored
from millrace.operators.joins import null_safe_join
from millrace.operators.numbering import surrogate_numbering

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """``(source, source_size, weight, target)`` from rows of ``(source, size)``.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes. A target stops at ``max_repeats`` times its source's size; what is over goes to the
    others by weight until none is above. Shares only grow, so a source once at its limit
    stays there, and each round is one aggregation over the table of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = surrogate_numbering(totals, "rank", [SortKey(F.col("source"), nulls_last=True)])
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.select(
        "source",
        "source_size",
        F.element_at(turn, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * max_repeats).alias("most"),
    )
    ranked = stored(ranked, "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(share) > F.col("most")
        now, capped, weight = ranked.agg(
            F.count_if(above),
            F.sum(F.when(above, F.col("most"))),
            F.sum(F.when(~above, F.col("weight"))),
        ).first()
        if now == full or not weight:
            break
        share, full = float(total - (capped or 0)) / weight, now
    return ranked.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("weight") * F.lit(share), F.col("most").cast("double")).alias("target"),
    )


def mixing_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
    keep: Sequence[str] = (),
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per document: ``id, size, source, source_size, target, rate, copies``.

    ``keep`` names columns of ``docs`` that are carried along in a struct ``row``.
    """
    rows = docs.select(
        F.col(quoted(id_column)).alias("id"),
        F.col(quoted(source_column)).cast("string").alias("source"),
        word_count(F.col(quoted(text_column)).cast("string")).alias("size"),
        # What the draw goes by: rows without an id are drawn apart by their texts.
        F.coalesce(
            F.col(quoted(id_column)).cast("string"), F.md5(F.coalesce(F.col(quoted(text_column)).cast("string"), F.lit("")))
        ).alias("drawn_by"),
        *([F.struct(*[F.col(quoted(c)) for c in keep]).alias("row")] if keep else []),
    )
    # Counting words is the dear part: it is done once.
    rows = stored(rows, "sizes")
    targets = source_targets(rows.select("source", "size"), weights, max_repeats)
    joined = null_safe_join(rows, targets, ["source"], "inner")
    rate = F.when(
        F.col("source_size") > 0,
        F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats))),
    ).otherwise(F.lit(0.0))
    key = F.concat(F.lit(f"{seed}:"), F.col("drawn_by"))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.withColumn("rate", rate).withColumn("copies", copies.cast("bigint")).drop("drawn_by")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, copies included, with the columns of ``docs``."""
    plan = mixing_plan(docs, keep=docs.columns, **options)
    copies = plan.filter("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    )
    return copies.select(*[F.col("row")[name].alias(name) for name in docs.columns])
