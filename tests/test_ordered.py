import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.sortkeys import SortKey, comparable_key, sort_keys
from millrace.operators.numbering import surrogate_numbering
from millrace.operators.ordered import (
    propagate_first_value,
    propagate_last_value,
    running_total,
    visit_counter,
)

CLAIMS = [
    ("a", 1, None), ("a", 2, "ready"), ("a", 3, None),
    ("b", 1, "open"), ("b", 2, "closed"), ("c", 1, None),
]


def result(df, name):
    return {(r.claim_id, r.step_index): r[name] for r in df.collect()}


@pytest.fixture
def claims(spark):
    return spark.createDataFrame(CLAIMS, "claim_id string, step_index int, status string")


def test_last_and_first_known_value(claims):
    last = propagate_last_value(claims, "x", "status", by="claim_id", sort_by="step_index")
    first = propagate_first_value(claims, "x", "status", by="claim_id", sort_by="step_index")
    assert set(last.columns) == {*claims.columns, "x"}
    assert list(result(last, "x").values()).count("closed") == 2
    assert result(last, "x")[("a", 1)] == "ready" and result(last, "x")[("c", 1)] is None
    assert result(first, "x")[("b", 2)] == "open"


def test_nulls_are_kept_on_request(spark):
    df = spark.createDataFrame(
        [("a", 1, "open"), ("a", 2, None), ("b", 1, None), ("b", 2, "done")],
        "claim_id string, step_index int, status string",
    )
    options = {"by": "claim_id", "sort_by": "step_index", "ignore_nulls": False}
    last = result(propagate_last_value(df, "x", "status", **options), "x")
    assert [last[k] for k in sorted(last)] == [None, None, "done", "done"]
    first = result(propagate_first_value(df, "x", "status", **options), "x")
    assert [first[k] for k in sorted(first)] == ["open", "open", None, None]


def test_predicate_and_neighbouring_value(claims):
    where = F.col("status") == "open"
    found = propagate_last_value(
        claims, "x", F.col("step_index") * 10, by="claim_id", sort_by="step_index", where=where
    )
    got = result(found, "x")
    assert got[("b", 2)] == 10
    assert got[("a", 1)] is None and got[("c", 1)] is None


def test_several_groups_orders_and_null_groups(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, 1, "x"), ("a", 1, 2, 1, "y"), ("a", 1, 2, 2, "z"), ("a", 2, 1, 1, "two"),
         (None, 1, 1, 1, "p"), (None, 1, 2, 1, "q")],
        "claim_id string, line int, step_index int, tie int, status string",
    )
    found = propagate_last_value(
        df, "x", "status", by=["claim_id", "line"], sort_by=["step_index", "tie"]
    )
    assert sorted(r.x for r in found.collect()) == ["q", "q", "two", "z", "z", "z"]
    by_expression = propagate_last_value(
        df, "x", "status", by=F.lit(1), sort_by=["claim_id", "line", "step_index", "tie"],
        descending=[True, True, False, True],
    )
    assert by_expression.columns == [*df.columns, "x"]
    # Nulls first in both directions, so the last row is the smallest claim and line.
    assert {r.x for r in by_expression.collect()} == {"y"}


@pytest.mark.parametrize("kind", ["string", "date", "double", "boolean", "timestamp", "decimal(5,2)"])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("nulls_last", [False, True])
def test_comparable_key_sorts_like_order_by(spark, kind, descending, nulls_last):
    values = {
        "string": "array('', 'a', 'ab', 'b', 'ä', '~', null)",
        "date": "array(date'1969-12-30', date'1970-01-01', date'2020-01-01', null)",
        "double": "array(-1.5D, 0D, 2D, double('inf'), double('nan'), double('-inf'), null)",
        "boolean": "array(true, false, null)",
        "timestamp": "array(timestamp'1960-01-01 01:00:00', timestamp'2020-01-01 00:00:01', null)",
        "decimal(5,2)": "array(-1.25BD, 0.00BD, 2.00BD, null)",
    }[kind]
    df = spark.range(1).selectExpr(f"explode({values}) AS v")
    key = SortKey(F.col("v"), descending, nulls_last)
    expected = [str(r.v) for r in df.orderBy(key.expression()).collect()]
    got = [str(r.v) for r in df.orderBy(comparable_key(df, [key])).collect()]
    assert got == expected


def visits(df, **options):
    found = visit_counter(df, "visit", "workflow", by="document_id", sort_by="step_index", **options)
    return [r.visit for r in sorted(found.collect(), key=lambda r: r.step_index)]


def test_visit_counter(spark):
    names = ["w1", "w1", "w1", "w2", "w2", "w1", "w1", "w1"]
    rows = [("doc-1", i, name) for i, name in enumerate(names)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "document_id string, step_index int, workflow string")
    assert visits(df) == [1, 1, 1, 1, 1, 2, 2, 2]
    assert visits(df, descending=True) == [2, 2, 2, 1, 1, 1, 1, 1]


def test_visit_counter_treats_null_as_a_value(spark):
    names = [None, None, "w", None, "w", "w"]
    df = spark.createDataFrame(
        [("d", i, name) for i, name in enumerate(names)],
        "document_id string, step_index int, workflow string",
    )
    assert visits(df) == [1, 1, 1, 2, 2, 2]


def test_visit_counter_with_several_columns(spark):
    df = spark.createDataFrame(
        [("1", "a", 1, 1, "w1"), ("1", "a", 2, 1, "w2"), ("1", "a", 2, 2, "w1"),
         ("1", "a", 3, 1, "w1"), ("1", "b", 1, 1, "w1"), ("2", "a", 1, 1, "w1")],
        "doc string, section string, step int, tie int, workflow string",
    )
    found = visit_counter(df, "v", "workflow", by=["doc", "section"], sort_by=["step", "tie"])
    rows = sorted(found.collect(), key=lambda r: (r.doc, r.section, r.step, r.tie))
    assert [r.v for r in rows] == [1, 1, 2, 2, 1, 1]


def hot_rows(spark):
    """One group holds most rows; a few are small; values and sort keys have NULLs."""
    pick = random.Random(11)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else pick.choice(["a", "b", None])
        value = pick.choice(["x", "x", "x", "y", None])
        rows.append((group, None if i == 17 else pick.random(), i, value, pick.choice([1, 2, None])))
    return spark.createDataFrame(rows, "g string, k double, id int, v string, n bigint").repartition(7)


@pytest.mark.parametrize("descending", [False, True])
def test_a_hot_group_in_many_chunks_gives_the_same_values(spark, descending):
    df = hot_rows(spark).cache()
    options = {"by": "g", "sort_by": ["k", "id"], "descending": descending}

    def both(function, value):
        whole = function(df, "out", value, **options)
        split = function(df, "out", value, **options, chunks=50)
        assert split.columns == whole.columns
        return [sorted((r.id, r.out) for r in part.collect()) for part in (whole, split)]

    for function, value in ((visit_counter, "v"), (running_total, "n")):
        whole, split = both(function, value)
        assert len(whole) == 3000
        assert [(i, str(o)) for i, o in whole] == [(i, str(o)) for i, o in split]


def test_the_input_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(100).selectExpr("id", "id % 3 AS g").mapInArrow(count, "id long, g long")
    assert visit_counter(rows, "v", "g", by="g", sort_by="id").count() == 100
    assert seen.value == 100


def test_chunks_stay_small(spark):
    from millrace.operators.ordered import OrderedGroups

    groups = OrderedGroups(hot_rows(spark), "g", sort_keys(["k", "id"]), chunks=25)
    assert groups.df.select("__chunk").distinct().count() > 10
    largest = groups.df.groupBy("g", "__chunk").count().agg(F.max("count")).first()[0]
    assert largest < 600


def test_running_total_matches_a_cumulative_sum(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 2)], "i int, n bigint")
    found = running_total(df, "t", "n", by=F.lit(0), sort_by="i")
    assert [r.t for r in sorted(found.collect(), key=lambda r: r.i)] == [5, None, 7]


def test_numbering_is_dense_and_ordered(spark):
    names = [f"n{i:04d}" for i in range(500)] + [None]
    random.Random(2).shuffle(names)
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    numbered = surrogate_numbering(df, "key", [SortKey(F.col("name"), nulls_last=True)], 10)
    rows = sorted(numbered.collect(), key=lambda r: r.key)
    assert [r.key for r in rows] == list(range(11, 512))
    assert [r.name for r in rows] == sorted(n for n in names if n) + [None]
