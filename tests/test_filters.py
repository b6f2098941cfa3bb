from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import filters as flt
from millrace.operators import preview


@pytest.fixture
def names(spark):
    return spark.createDataFrame(
        [(1, "alpha"), (2, "beta"), (3, "alphabet"), (4, None), (5, "")], "id int, name string"
    )


def ids(df, *filters):
    return sorted(r.id for r in flt.filter_rows(df, *filters).collect())


@pytest.mark.parametrize(
    "conditions, expected",
    [
        ([("equals", "alpha")], [1]), ([("not_equals", "alpha")], [2, 3, 4, 5]),
        ([("begins_with", "alp")], [1, 3]), ([("ends_with", "bet")], [3]),
        ([("contains", "et")], [2, 3]), ([("not_contains", "a")], [4, 5]),
        ([("contains", "")], [1, 2, 3, 4, 5]), ([("contains", "ph"), ("not_contains", "bet")], [1]),
        ([("contains", ".")], []), ([("equals", "Alpha")], []),
    ],
)
def test_text(names, conditions, expected):
    assert ids(names, flt.TextFilter("name", tuple(conditions))) == expected


def test_text_on_numbers_and_unknown_condition(names):
    assert ids(names, flt.TextFilter("id", (("equals", "3"),))) == [3]
    with pytest.raises(ValueError):
        flt.TextFilter("name", (("sounds_like", "x"),)).expression()


def test_distinct(names):
    assert ids(names, flt.DistinctFilter("name", ("beta", flt.BLANK))) == [2, 4]
    assert ids(names, flt.DistinctFilter("name", (flt.BLANK,))) == [4]
    assert ids(names, flt.DistinctFilter("name", ())) == [1, 2, 3, 4, 5]
    assert ids(names, flt.DistinctFilter("id", ("2", "3"))) == [2, 3]


def test_combined_filters(names):
    both = flt.AllFilter(
        "name", (flt.TextFilter("name", (("begins_with", "a"),)), flt.DistinctFilter("name", ("alphabet", "beta")))
    )
    assert ids(names, both) == [3]
    assert ids(names, both, flt.NumberFilter("id", (("4", ""),))) == []
    with pytest.raises(TypeError):
        flt.AllFilter("name", ("x",)).expression()


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_dates(spark, kind):
    data = [(1, date(2026, 4, 1)), (2, date(2026, 4, 10)), (3, date(2026, 4, 20)), (4, None)]
    df = spark.createDataFrame(data, "id int, d date").withColumn("d", F.col("d").cast(kind))
    if kind != "date":
        df = df.withColumn("d", F.col("d") + F.expr("INTERVAL 23 HOURS"))
    ranges = (("2026-04-01", "2026-04-02"), ("2026-04-30", "2026-04-20"), ("2026-04-10", ""))
    assert ids(df, flt.DateFilter("d", ranges)) == [1, 3]
    assert ids(df, flt.DateFilter("d", (("", ""),))) == [1, 2, 3, 4]


def test_times(spark):
    clock = [(1, "08:00"), (2, "09:30"), (3, "13:15"), (4, "16:45")]
    df = spark.createDataFrame(
        [(i, flt.TimeFilter._micros(t), datetime.fromisoformat(f"2026-01-01T{t}:00.500000")) for i, t in clock],
        "id int, micros bigint, ts timestamp",
    )
    ranges = (("09:00", "10:00"), ("17:00", "16:00"))
    assert ids(df, flt.TimeFilter("micros", ranges)) == [2, 4]
    assert ids(df, flt.TimeFilter("ts", ranges)) == [2, 4]
    assert ids(df, flt.TimeFilter("ts", (("08:00:00.500", "08:00:00.500"),))) == [1]


@pytest.mark.parametrize(
    "ranges, expected",
    [
        ([("10", "20")], [2, 3]), ([("20", "10")], [2, 3]), ([("", "5")], [1]), ([("25.5", "")], [4]),
        ([("0", "5"), ("20", "")], [1, 3, 4]), ([(" ", "")], [1, 2, 3, 4, 5]), ([("x", "")], []),
    ],
)
def test_numbers(spark, ranges, expected):
    df = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, 20.0), (4, 25.5), (5, None)], "id int, v double")
    assert ids(df, flt.NumberFilter("v", tuple(ranges))) == expected
    text = flt.NumberFilter("v", tuple(ranges)).expression(None)
    if text is not None:
        assert sorted(r.id for r in df.where(text).collect()) == expected


def test_numbers_are_typed_by_the_column(spark):
    df = spark.range(10)
    # Not a whole number, so it matches nothing on a whole-number column.
    assert ids(df, flt.NumberFilter("id", (("2.5", ""),))) == []
    assert ids(df, flt.NumberFilter("id", (("8", ""),))) == [8, 9]


def test_booleans(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, b boolean")
    got = {value: ids(df, flt.BooleanFilter("b", value)) for value in ("true", "false", "blank", "")}
    assert got == {"true": [1], "false": [2], "blank": [3], "": [1, 2, 3]}
    with pytest.raises(ValueError):
        flt.BooleanFilter("b", "maybe").expression()


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id AS string) AS s", "timestamp_seconds(id * 100000) AS t").write.parquet(path)
    df = spark.read.parquet(path)
    for part, pushed in [
        (flt.NumberFilter("id", (("5", "7"),)), "GreaterThanOrEqual(id,5)"),
        (flt.TextFilter("s", (("begins_with", "1"),)), "StringStartsWith(s,1)"),
        (flt.DateFilter("t", (("1970-01-02", "1970-01-03"),)), "LessThan(t,1970-01-04"),
        (flt.DistinctFilter("id", ("3", "4")), "In(id, [3,4])"),
    ]:
        plan = flt.filter_rows(df, part)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan, plan


def test_preview(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 9.0), (4, 9.0)], "id int, v double")
    down = preview.top_k(df, [("v", True), ("id", False)], 3)
    assert [r.id for r in down.collect()] == [2, 3, 4]
    assert "TakeOrderedAndProject" in down._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in preview.multi_sort(df, [("v", False), ("id", True)]).collect()] == [2, 1, 4, 3]
    found = preview.filtered_preview(df, [flt.NumberFilter("v", (("1", ""),))], [("id", True)], limit=2)
    assert ([r.id for r in found.rows.collect()], found.row_count, found.column_count) == ([4, 3], 3, 2)
    assert preview.filtered_preview(df, limit=0).rows.count() == 1


def test_distinct_values(spark):
    df = spark.createDataFrame([("Ab", 1), ("cab", 2), (None, 3), ("Ab", 4), ("x", 5)], "s string, n int")
    found = preview.search_distinct(df, "s", search="AB", descending=True, limit=5)
    assert ([r.label for r in found.values.collect()], found.truncated) == (["cab", "Ab"], False)
    listed = preview.search_distinct(df, "s", descending=False, limit=2)
    assert ([r.label for r in listed.values.collect()], listed.truncated) == (["(blank)", "Ab"], True)
    others = [flt.NumberFilter("n", (("2", "3"),)), flt.TextFilter("s", (("equals", "zzz"),))]
    assert preview.search_distinct(df, "s", filters=others).values.count() == 2


@pytest.mark.parametrize("columns", [[("s", True)], [("s", False), ("n", True)], []])
def test_a_large_top_k_is_a_distributed_sort(spark, monkeypatch, columns):
    df = spark.range(3000, numPartitions=6).selectExpr(
        "id AS n", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 > 0 THEN string(id % 20) END AS s"
    )
    small = preview.top_k(df, columns, 1500)
    monkeypatch.setattr(preview, "TOP_K_IN_ONE_TASK", 100)
    large = preview.top_k(df, columns, 1500)
    assert large.columns == df.columns
    kept = [[r.s for r in part.collect()] for part in (small, large)]
    if columns:
        assert kept[0] == kept[1]
    assert len(kept[1]) == 1500


def test_a_sort_on_a_hot_value_uses_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(6000, numPartitions=6).selectExpr("id", "'same' AS s", "map('k', id) AS m")
        sorted_rows = preview.multi_sort(df, [("s", False)])
        sizes = sorted_rows.groupBy(F.spark_partition_id()).count().collect()
        parts = sorted_rows.select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1 and sum(r["count"] for r in sizes) == 6000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def sizes_of_tasks(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("columns", [[("s", True)], [("s", False), ("n", True)], [("n", False)], [("x", True)]])
@pytest.mark.parametrize("k", [1, 7, 400, 1500, 5000])
def test_top_k_by_any_way_has_the_same_rows(spark, monkeypatch, tmp_path, columns, k):
    """Keys first, or in a distributed sort: the rows of a plain sort, copies and nulls included."""
    df = spark.range(3000, numPartitions=6).selectExpr(
        "id % 1100 AS n", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 > 0 THEN string(id % 20) END AS s",
        "CASE WHEN id % 5 = 0 THEN double('NaN') WHEN id % 11 > 0 THEN id % 50 / 10.0D END AS x", "'wide' AS w"
    )
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plain = [str(tuple(r)) for r in preview.multi_sort(df, columns).collect()[:k]]
    assert [str(tuple(r)) for r in preview.top_k(df, columns, k, keys_first=True).collect()] == plain
    monkeypatch.setattr(preview, "TOP_K_IN_ONE_TASK", 5)
    assert [str(tuple(r)) for r in preview.top_k(df, columns, k).collect()] == plain


def test_copies_at_the_limit_of_a_large_top_k(spark, monkeypatch):
    monkeypatch.setattr(preview, "TOP_K_IN_ONE_TASK", 50)
    df = spark.range(900, numPartitions=6).selectExpr("id % 3 AS n", "'same' AS s")
    assert sorted(r.n for r in preview.top_k(df, [("n", True)], 450).collect()) == [1] * 150 + [2] * 300
    assert preview.top_k(df.limit(0), [("n", True)], 450).count() == 0


def test_a_preview_sorts_keys_before_it_reads_wide_columns(spark, tmp_path):
    spark.range(100).selectExpr("id AS n", "id % 9 AS m", "repeat('x', 99) AS wide").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    shown = preview.filtered_preview(df, [flt.NumberFilter("m", (("1", ""),))], [("n", True)], limit=4).rows
    plan = shown._jdf.queryExecution().executedPlan().toString()
    outer, inner = plan.split("Subquery", 1)
    assert "GreaterThanOrEqual(n,ScalarSubquery" in plan
    assert "ReadSchema: struct<n:bigint,m:bigint>" in inner and "wide" not in inner.split("ReadSchema: struct<n:bigint,m:bigint>")[0].split("FileScan")[-1]
    assert [r.n for r in shown.collect()] == [98, 97, 96, 95]


def test_a_large_head_takes_whole_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(preview, "TOP_K_IN_ONE_TASK", 50)
    spark.range(1000, numPartitions=10).selectExpr("id AS n", "id % 2 AS odd").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for frame, n, most in [(df, 730, 730), (df, 5000, 1000), (df.where("odd = 1"), 333, 333), (df, 300, 300)]:
        rows = preview.head(frame, n)
        assert rows.count() == most == rows.distinct().count() and rows.exceptAll(frame).count() == 0
    assert preview.head(spark.range(400).groupBy("id").count(), 120).count() == 120


def test_a_large_head_meets_in_no_task(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(preview, "TOP_K_IN_ONE_TASK", 50)
    monkeypatch.setattr(preview, "materialise", lambda *_: pytest.fail("stored"))
    spark.range(1000, numPartitions=10).write.parquet(str(tmp_path / "t"))
    settings = {"spark.sql.files.openCostInBytes": "134217728"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        sizes = sizes_of_tasks(preview.head(spark.read.parquet(str(tmp_path / "t")), 730))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 730 and max(sizes) == 100


def test_distinct_values_without_a_direction(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "s string")
    found = preview.search_distinct(df, "s", limit=2)
    assert ([r.label for r in found.values.collect()], found.truncated) == (["(blank)", "a"], True)
    assert not preview.search_distinct(df, "s", limit=3).truncated
