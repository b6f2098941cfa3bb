"""The corpus pipeline: stages over ``documents``, each on all rows the one before kept.

All stages but the last return the columns of ``documents``. Documents that a stage has nothing
against pass it unchanged; the deduplication of strings shortens texts and keeps every row, and
the mix may repeat rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_documents
from millrace.llm.common import prepare, stored
from millrace.llm.mixing import mix
from millrace.llm.ngram_join import one_of_each
from millrace.llm.queries import table, vocabulary_path
from millrace.llm.suffix_dedup import strip_repeats
from millrace.llm.toxicity import checksum, keep_acceptable, train, training_sample

#: A trained classifier has no SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled part of ``docs``."""
    prepare(spark)
    learnt = docs.filter(checksum("doc_id") % 3 != 1)
    return keep_acceptable(docs, train(training_sample(learnt, table(spark, sf_dir, "labels"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    prepare(spark)
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that start in a document with a smaller id are cut out; all documents stay."""
    prepare(spark)
    cut = strip_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned to their target weights."""
    prepare(spark)
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document of the mix, copies included."""
    encoded = encode_documents(docs, vocabulary_path(), decode=False)
    return encoded.select(F.col("id").alias("doc_id"), "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("bpe_codec", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
