"""One key holds a third of the rows and every join is a shuffle join."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import event_log, joins, ledger, ordered

SETTINGS = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
}


@pytest.fixture
def shuffled(spark):
    old = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in old.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def facts(shuffled):
    hot = F.col("id") % 3 == 0
    return shuffled.range(60000, numPartitions=8).select(
        F.col("id").alias("n"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("name"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )


def is_split(df):
    """Run the plan and look for a join whose hot partition was split."""
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_attach_and_denormalize(facts, warehouse):
    warehouse.build_dimension("dim", facts.select("name"), key_column="key")
    keyed = warehouse.attach_dimension("dim", facts, on="name", key_column="key")
    assert is_split(keyed)
    assert keyed.where("key IS NULL").count() == 0
    back = warehouse.denormalize_columns("dim", keyed.drop("name"), key_column="key")
    assert is_split(back)
    assert back.groupBy("name").count().where("name = 'hot'").first()["count"] == 20000


def test_propagation(facts):
    last = ordered.propagate_last_value(facts, "x", "payload", by="name", sort_by="n")
    assert is_split(last)
    assert last.where("name = 'hot'").select("x").distinct().count() == 1


def test_slice_deletion(facts):
    values = facts.where("n < 10").select("name").distinct()
    assert is_split(joins.anti_join_null_safe(facts, values, ["name"]))


def test_cascade_and_error_lookup(facts):
    children = facts.select(F.col("n").alias("id"), F.col("name").alias("run_id"), "payload")
    removed = children.where("id IN (1, 2)").select("run_id")
    assert is_split(ledger.cascade_delete(children, removed))
    steps = children.where("id < 2000").select(
        "id", "run_id", F.lit("s").alias("step_label"), F.lit("failed").alias("status"),
        F.col("payload").alias("error_text"),
    )
    runs = children.where("id < 900").select("run_id", F.lit("bad").alias("error_text"))
    entries = children.withColumn("step_name", F.lit("s"))
    found = event_log.run_error(entries, steps, runs)
    assert is_split(found)
    assert found.count() == 60000
