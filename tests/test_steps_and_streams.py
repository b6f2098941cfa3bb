import pytest
from pyspark.sql import functions as F

from millrace.operators import per_source
from millrace.plans.steps import StepChain
from millrace.sources import outputs
from millrace.streaming import log_cursor as lc


def test_steps_pass_named_frames(spark):
    chain = (
        StepChain()
        .step(lambda s: s.current.where(f"id < {s.parameters['top']}"), save_as="small")
        .step(lambda s: s.current.agg(F.sum("id").alias("x")), save_as="total")
        .step(lambda s: s.current.count(), use="small")
    )
    assert chain.run(spark.range(10), top=4) == 4
    assert chain.preview("total", spark.range(10), top=4).first().x == 6
    assert StepChain().run(spark.range(1)).count() == 1


def test_steps_are_checked():
    for bad in ({"save_as": "current"}, {"use": " "}):
        with pytest.raises(ValueError):
            StepChain().step(lambda s: s, **bad)
    with pytest.raises(ValueError):
        StepChain().step("not a function")
    with pytest.raises(KeyError):
        StepChain().step(lambda s: s, use="missing").run()
    with pytest.raises(KeyError):
        StepChain().preview("missing")


def test_map_batch_sees_one_source_at_a_time(spark):
    df = spark.range(100).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source_key"), "id")

    def total(source, rows):
        assert set(rows["source_key"]) == {source}
        return rows.groupby("source_key", as_index=False)["id"].sum()

    parts = per_source.map_batch(df, total, "source_key string, id bigint")
    got = {r.source_key: r["sum(id)"] for r in parts.groupBy("source_key").sum("id").collect()}
    assert got == {"s0": 1683, "s1": 1617, "s2": 1650}
    with pytest.raises(ValueError):
        per_source.map_batch(df.limit(0), total, "x int")
    with pytest.raises(ValueError):
        per_source.map_batch(df, total, "x int", key="nope")


def test_map_items(spark):
    items = spark.createDataFrame([("b.csv", 4), ("a.csv", 3)], "name string, size_bytes bigint")
    done = per_source.map_items(
        items, lambda item: {"name": item["name"], "double": item["size_bytes"] * 2}, "name string, double bigint",
        partitions=2,
    )
    assert sorted(map(tuple, done.collect())) == [(0, "a.csv", 6), (1, "b.csv", 8)]
    with pytest.raises(ValueError):
        per_source.map_items(items.limit(0), dict, "x int")
    with pytest.raises(ValueError):
        per_source.map_items(items, lambda a, b, c: {}, "x int")
    with pytest.raises(ValueError):
        per_source.map_items(items.withColumn("position", F.lit(1)), dict, "x int")


def test_map_items_whole_in_order_and_packed_by_size(spark, tmp_path):
    """Every file is read whole by one call; a large one has its task nearly to itself."""
    sizes = [40_000, *[100 + i for i in range(60)]]
    for i, size in enumerate(sizes):
        (tmp_path / f"f{i:02d}").write_text("x" * size)
    items = spark.createDataFrame([(f"f{i:02d}", size) for i, size in enumerate(sizes)], "name string, size bigint")

    def read(context, item):
        from pyspark import TaskContext

        with open(f"{context}/{item['name']}") as file:
            return {"name": item["name"], "letters": len(file.read()), "task": TaskContext.get().partitionId()}

    done = per_source.map_items(
        items, read, "name string, letters bigint, task int",
        order_by="name", descending=True, size="size", context=str(tmp_path), partitions=4,
    ).collect()
    assert sorted((r.position, r.name, r.letters) for r in done) == [
        (k, f"f{60 - k:02d}", sizes[60 - k]) for k in range(61)
    ]
    load = {}
    for r in done:
        load[r.task] = load.get(r.task, 0) + 1
    assert len(load) == 4 and max(load.values()) - min(load.values()) <= 1


def test_run_sources(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "source_key string, n int")
    total = [F.sum("n").alias("n")]
    assert {r.source_key: r.n for r in per_source.run_sources(df, total).collect()} == {"a": 3, "b": 5}
    assert per_source.run_sources(df, total, run_as="batch").first().n == 8
    with pytest.raises(ValueError):
        per_source.run_sources(df, total, run_as="other")


def test_outputs(spark, warehouse, tmp_path):
    df = spark.createDataFrame([("a/x.csv", 1), ("a/x.csv", 2), ("y.csv", 3)], "rel string, n int")
    root = outputs.mirror_write(df, str(tmp_path / "m"), "rel", layout="namespaced", name="o.parquet")
    got = {(r.mirror_path, r.n) for r in spark.read.parquet(root).collect()}
    assert got == {("a/x/o.parquet", 1), ("a/x/o.parquet", 2), ("y/o.parquet", 3)}
    with pytest.raises(ValueError):
        outputs.mirror_write(df, root, "rel", layout="file")
    with pytest.raises(ValueError):
        outputs.multi_output(df, {}, root)
    saved = outputs.save_debug_frame(warehouse, df, flow_name="f", name="n", info={"rows": 3})
    outputs.save_debug_frame(warehouse, df, flow_name="f", step_name="s", name="n")
    records = warehouse.frame(outputs.ARTIFACTS)
    assert records.count() == 2 and warehouse.frame(saved).count() == 3
    first = records.where(F.col("artifact_table") == saved).first()
    assert (first.info, first.display_name) == ({"rows": "3"}, "f / Step / n")


def step_runs(spark, *rows):
    return spark.createDataFrame(
        list(rows), "id bigint, flow_name string, step_label string, status string, output_path string"
    )


def test_the_cursor_reads_each_log_file_once(spark, warehouse, tmp_path):
    log, target, cursor = (str(tmp_path / name) for name in ("log", "copy", "cursor"))
    first = step_runs(spark, (1, "f", "s", "success", "/1"), (2, "f", "s", "failed", "/2"))
    first.write.parquet(log)
    for expected, more in ((2, None), (2, None), (3, (3, "f", "s", "success", "/3"))):
        if more:
            step_runs(spark, more).write.mode("append").parquet(log)
        lc.drain(lc.follow_log(spark, log, first.schema), target, cursor)
        assert spark.read.schema(first.schema).parquet(target).count() == expected
    after = lc.follow_log(spark, log, first.schema, after_id=2)
    lc.drain(after, target + "2", cursor + "2")
    assert spark.read.parquet(target + "2").count() == 1


def test_outputs_are_refreshed_from_a_stream(spark, warehouse, tmp_path):
    log, cursor = str(tmp_path / "log"), str(tmp_path / "cursor")
    first = step_runs(spark, (1, "f", "s", "success", "/1"), (2, "f", "t", "success", "/2"))
    for rows in (first, step_runs(spark, (3, "f", "s", "success", "/3"), (4, "f", "t", "failed", "/4"))):
        rows.write.mode("append").parquet(log)
        stream = lc.follow_log(spark, log, first.schema)
        lc.drain_each(stream, lc.refresh_outputs(warehouse, "outputs"), cursor)
    got = sorted((r.step_label, r.id, r.output_path) for r in warehouse.frame("outputs").collect())
    assert got == [("s", 3, "/3"), ("t", 2, "/2")]
