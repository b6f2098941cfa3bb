"""URL filters by host and path rules, looked up through hashed expressions.

Each url is expanded into host-suffix and path-prefix expressions of the shapes that the rules
have (so many host labels, so many path characters). The expressions meet the rules in an
equi-join on a short hash prefix, full digests are compared after that, and the longest rule
that is left decides. Only DataFrame expressions are used.

Defined cases: a url that is null or has no ``://`` has an empty host and path; no rule fits
it, so it gets the default verdict, which is to allow, as usual for lists of exceptions. Of two
rules of one length and one text the blocking one wins. Repeated rows are judged alike. An
empty table or an empty rule list is fine. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted
from millrace.session import local_frame

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DEFAULT_VERDICT = "allow"
#: Hex digits of the digest that the join goes by.
SHORT = 8

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to ``/``, ``?``, ``#`` or the end; A-Z lowered."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(rule, action, labels, length, digest, short)`` of rules written as host and path."""
    split = [(action, rule, *_cut(rule)) for action, rule in rules]
    frame = local_frame(
        spark,
        {
            "action": [str(action) for action, *_ in split] or [""][:0],
            "rule": [rule for _, rule, *_ in split],
            "labels": [host.count(".") + 1 for *_, host, _ in split],
            "length": [len(path) for *_, path in split],
        },
    ) if split else spark.createDataFrame([], "action string, rule string, labels long, length long")
    return frame.withColumn("digest", F.sha2("rule", 256)).withColumn(
        "short", F.substring("digest", 1, SHORT)
    )


def _cut(rule: str) -> tuple[str, str]:
    at = rule.find("/")
    return (rule, "") if at < 0 else (rule[:at], rule[at:])


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] | DataFrame = RULES,
    default: str = DEFAULT_VERDICT,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``."""
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    rows = pages.select(
        F.col(quoted(id_column)).alias("page_id"),
        F.col(quoted(url_column)).cast("string").alias("url"),
    )
    # Hosts with paths, each once: a url that a third of the pages carry is looked up once.
    parts = rows.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    once = parts.filter("host <> ''").distinct()
    # The shapes of the rules: at most (label counts) x (path lengths), a handful of each.
    shapes = [(r["labels"], r["length"]) for r in table.select("labels", "length").distinct().collect()]
    n_labels = F.length("host") - F.length(F.translate("host", ".", "")) + 1
    expressions = [
        F.when(
            (n_labels >= labels) & (F.length("path") >= length),
            F.concat(
                F.substring_index("host", ".", -int(labels)), F.substring("path", 1, int(length))
            ),
        )
        for labels, length in sorted(shapes)
    ]
    best = None
    if expressions:
        asked = (
            once.withColumn("expression", F.explode(F.array(*expressions)))
            .filter("expression IS NOT NULL")
            .withColumn("asked", F.sha2("expression", 256))
        )
        near = asked.join(table, F.substring("asked", 1, SHORT) == F.col("short"))
        best = (
            near.filter("asked = digest")
            .groupBy(F.struct("host", "path").alias("k"))
            .agg(
                F.max(
                    F.struct(
                        F.length("rule").alias("n"), (F.col("action") == "block").alias("b"), "rule", "action"
                    )
                ).alias("r")
            )
            .select("k.host", "k.path", "r.rule", "r.action")
        )
    judged = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if best is None:
        judged = judged.withColumn("rule", F.lit(None).cast("string")).withColumn(
            "action", F.lit(None).cast("string")
        )
    else:
        judged = judged.join(best, ["host", "path"], "left")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )
