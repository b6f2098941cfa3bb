import pytest
from pyspark.sql import functions as F

from millrace.sources import tables
from millrace.sources.tables import ConcurrentChange


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(v) for v in r))


def members(spark, *data):
    return spark.createDataFrame(list(data), "member_id string, lob string")


def test_dimension_numbers_in_natural_order(spark, warehouse):
    df = members(spark, ("m2", "x"), ("m1", "x"), ("m2", "x"))
    got = warehouse.build_dimension("dim_member", df, key_column="member_key").collect()
    assert [tuple(r) for r in got] == [("m1", "x", 1), ("m2", "x", 2)]


def test_dimension_keys_never_change(spark, warehouse):
    first = spark.createDataFrame([("b", "open"), ("c", "open")], "`group` string, status string")
    second = spark.createDataFrame([("c", "open"), ("a", "open")], "`group` string, status string")
    warehouse.build_dimension("mart.dim_group", first, key_column="group_key")
    mapping = warehouse.build_dimension("mart.dim_group", second, key_column="group_key")
    assert [tuple(r) for r in mapping.collect()] == [("a", "open", 3), ("c", "open", 2)]
    assert warehouse.frame("mart.dim_group").columns == ["group_key", "group", "status"]
    assert warehouse.frame("mart.dim_group").count() == 3
    warehouse.build_dimension("mart.dim_group", second, key_column="group_key")
    assert warehouse.frame("mart.dim_group").count() == 3


def test_null_natural_keys_get_a_key_but_are_not_attached(spark, warehouse):
    df = members(spark, (None, "x"), ("m1", "x"))
    for _ in range(2):
        mapping = warehouse.build_dimension("dim", df, key_column="key")
    assert [tuple(r) for r in mapping.collect()] == [("m1", "x", 1), (None, "x", 2)]
    attached = warehouse.attach_dimension("dim", df, on=["member_id", "lob"], key_column="key")
    assert rows(attached) == [(None, "x", None), ("m1", "x", 1)]


@pytest.mark.parametrize("key", ["member_id", " "])
def test_dimension_key_must_be_a_new_name(spark, warehouse, key):
    with pytest.raises(ValueError):
        warehouse.build_dimension("dim", members(spark, ("a", "b")), key_column=key)


def test_normalize_and_denormalize(spark, warehouse):
    df = spark.createDataFrame(
        [("m1", "x", 10), ("m1", "x", 20), ("m2", "x", 30)], "member_id string, lob string, amount int"
    )
    fact = warehouse.normalize_columns("dim", df, on=["member_id", "lob"], key_column="member_key")
    assert fact.columns == ["amount", "member_key"]
    assert rows(fact) == [(10, 1), (20, 1), (30, 2)]
    back = warehouse.denormalize_columns("dim", fact, key_column="member_key", drop_key=True)
    assert rows(back) == [(10, "m1", "x"), (20, "m1", "x"), (30, "m2", "x")]
    some = warehouse.denormalize_columns("dim", fact, key_column="member_key", select=["lob"])
    assert some.columns == ["amount", "member_key", "lob"]
    mapping = warehouse.normalize_columns(
        "dim", df, on=["member_id", "lob"], key_column="member_key", returns="map"
    )
    assert mapping.count() == 2
    for bad in ({"select": ["nope"]}, {"select": ["member_key"]}, {"key_column": "nope"}):
        with pytest.raises(ValueError):
            warehouse.denormalize_columns("dim", fact, **{"key_column": "member_key", **bad})
    with pytest.raises(ValueError):
        warehouse.normalize_columns("dim", df, on=["lob"], returns="rows")
    with pytest.raises(ValueError):
        warehouse.attach_dimension("dim", df, on=["nope"])


def claims(spark, *data):
    return spark.createDataFrame(list(data), "claim_id bigint, amount bigint")


def test_replacing_one_file_leaves_the_others(spark, warehouse):
    warehouse.replace_rows_by_file("fact", claims(spark, (1, 10), (2, 20)), file_hash="a")
    warehouse.replace_rows_by_file("fact", claims(spark, (3, 30)), file_hash="b")
    tagged = warehouse.replace_rows_by_file("fact", claims(spark, (1, 100), (4, 400)), file_hash="a")
    assert rows(tagged) == [(1, 100, "a"), (4, 400, "a")]
    assert rows(warehouse.frame("fact")) == [(1, 100, "a"), (3, 30, "b"), (4, 400, "a")]


def test_an_empty_file_removes_its_slice(spark, warehouse):
    for key in ("a b/c=1", "b"):
        warehouse.replace_rows_by_file("fact", claims(spark, (1, 10)), file_hash=key)
    warehouse.replace_rows_by_file("fact", claims(spark), file_hash="a b/c=1")
    assert rows(warehouse.frame("fact")) == [(1, 10, "b")]
    warehouse.write("flat", claims(spark, (1, 1)).withColumn("file_key", F.lit("b")))
    warehouse.replace_rows_by_file("flat", claims(spark), file_hash="b")
    assert warehouse.frame("flat").count() == 0


def test_a_table_may_start_with_an_empty_file(spark, warehouse):
    warehouse.replace_rows_by_file("t", claims(spark), file_hash="a")
    assert rows(warehouse.frame("t")) == []
    warehouse.replace_rows_by_file("t", claims(spark, (1, 10)), file_hash="b")
    assert rows(warehouse.frame("t")) == [(1, 10, "b")]


def test_replacing_a_slice_leaves_other_buckets_alone(spark, warehouse):
    for key in "abcdefgh":
        warehouse.replace_rows_by_file("t", claims(spark, (1, 10)), file_hash=key)
    before = warehouse._known("t")["segments"]
    warehouse.replace_rows_by_file("t", claims(spark, (2, 20)), file_hash="c")
    after = warehouse._known("t")["segments"]
    assert sum(before.get(b) != after.get(b) for b in {*before, *after}) == 1
    assert warehouse.frame("t").count() == 8


@pytest.mark.parametrize("partition_by", [[], ["s"], ["n"]])
def test_null_and_empty_text_stay_apart(spark, warehouse, partition_by):
    kind = "s string, n bigint"
    warehouse.write("t", spark.createDataFrame([("", 1), (None, 2), ("x", 3)], kind), partition_by=partition_by)
    for value, number in (("", 10), (None, 20), ("x", 30)):
        warehouse.replace_rows_by_values("t", spark.createDataFrame([(value, number)], kind), column="s")
        assert warehouse.frame("t").count() == 3
    assert {(r.s, r.n) for r in warehouse.frame("t").collect()} == {("", 10), (None, 20), ("x", 30)}


def test_a_frame_made_before_a_change_can_still_be_read(spark, warehouse):
    warehouse.replace_rows_by_file("t", claims(spark, (1, 10)), file_hash="a")
    before = warehouse.frame("t")
    warehouse.replace_rows_by_file("t", claims(spark, (2, 20)), file_hash="a")
    warehouse.evolve_append("t", claims(spark, (3, 30)))
    assert rows(before) == [(1, 10, "a")]


def test_a_change_that_was_overtaken_is_refused(spark, warehouse):
    warehouse.write("t", claims(spark, (1, 10)))
    state = warehouse._state("t")
    warehouse.evolve_append("t", claims(spark, (2, 20)))
    with pytest.raises(ConcurrentChange):
        warehouse._append("t", state, claims(spark, (3, 30)))
    assert rows(warehouse.frame("t")) == [(1, 10), (2, 20)]
    assert warehouse.vacuum("t") == 0


def test_two_dimension_builds_give_no_key_twice(spark, warehouse, monkeypatch):
    build = warehouse.build_dimension
    build("dim", spark.createDataFrame([("a",)], "name string"), key_column="key")
    append, other = warehouse._append, []

    def overtaken(table, state, df):
        if not other:  # the second build comes between reading and publishing
            other.append(1)
            build("dim", spark.createDataFrame([("b",), ("c",)], "name string"), key_column="key")
        return append(table, state, df)

    monkeypatch.setattr(warehouse, "_append", overtaken)
    build("dim", spark.createDataFrame([("c",), ("d",)], "name string"), key_column="key")
    found = [(r["name"], r["key"]) for r in warehouse.frame("dim").collect()]
    assert sorted(n for n, _ in found) == ["a", "b", "c", "d"]
    assert sorted(k for _, k in found) == [1, 2, 3, 4]


def test_replacing_many_files_at_once(spark, warehouse):
    kind = "claim_id bigint, file_key string"
    warehouse.write("flat", spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], kind))
    warehouse.write("t", warehouse.frame("flat"), partition_by=["file_key"])
    keys = spark.createDataFrame([("a",), ("b",), ("d",)], "file_key string")
    new = spark.createDataFrame([(10, "a"), (11, "a"), (40, "d")], kind)
    for table in ("flat", "t"):
        warehouse.replace_files(table, new, keys)
        got = rows(warehouse.frame(table).select("claim_id", "file_key"))
        assert got == [(10, "a"), (11, "a"), (3, "c"), (4, None), (40, "d")]
    with pytest.raises(ValueError):
        warehouse.replace_files("t", new.drop("file_key"), keys)


def test_reading_by_value_reads_selected_columns_only(spark, warehouse):
    warehouse.write("t", claims(spark, (1, 10)).withColumn("text", F.lit("long")))
    found = warehouse.read_rows_by_values("t", column="claim_id", is_in=[1], select=["amount"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<claim_id:bigint,amount:bigint>" in plan


def test_a_new_column_widens_the_table(spark, warehouse):
    warehouse.replace_rows_by_file("fact", claims(spark, (1, 10)), file_hash="a")
    wide = claims(spark, (2, 20)).withColumn("group", F.lit("g"))
    warehouse.replace_rows_by_file("fact", wide, file_hash="b")
    got = warehouse.frame("fact").select("claim_id", "group", "file_key")
    assert rows(got) == [(1, None, "a"), (2, "g", "b")]


@pytest.mark.parametrize("options", [{"file_hash": " "}, {"file_hash": "a", "file_hash_column": "amount"}])
def test_file_slices_need_a_key(spark, warehouse, options):
    with pytest.raises(ValueError):
        warehouse.replace_rows_by_file("fact", claims(spark, (1, 10)), **options)


@pytest.mark.parametrize("parts", [[], ["status"]])
def test_replacing_by_value_includes_null(spark, warehouse, parts):
    kind = "claim_id bigint, status string, amount bigint"
    old = [(1, "open", 10), (2, None, 20), (5, "closed", 50), (6, "closed", 60)]
    new = [(3, None, 30), (4, "closed", 40)]
    warehouse.replace_table("fact", spark.createDataFrame(old, kind), partition_by=parts)
    warehouse.replace_rows_by_values("fact", spark.createDataFrame(new, kind), column="status")
    got = warehouse.frame("fact").select("claim_id", "status", "amount")
    assert rows(got) == [(1, "open", 10), (3, None, 30), (4, "closed", 40)]


def test_replacing_by_value_casts_to_the_stored_type(spark, warehouse):
    warehouse.write("fact", claims(spark, (1, 10), (2, 20)))
    warehouse.replace_rows_by_values(
        "fact", spark.createDataFrame([("2", 7)], "claim_id string, amount int"), column="claim_id"
    )
    assert rows(warehouse.frame("fact")) == [(1, 10), (2, 7)]
    with pytest.raises(ValueError):
        warehouse.replace_rows_by_values("fact", claims(spark), column="claim_id")
    with pytest.raises(ValueError):
        warehouse.replace_rows_by_values("fact", claims(spark, (1, 1)), column="nope")


def test_replace_table_keeps_the_wider_schema(spark, warehouse):
    warehouse.replace_table("t", spark.createDataFrame([(1, "x")], "a int, b string"))
    warehouse.replace_table("t", spark.createDataFrame([(True, 2)], "c boolean, a int"))
    assert warehouse.frame("t").columns == ["a", "b", "c"]
    assert rows(warehouse.frame("t")) == [(2, None, True)]


def test_append_by_name(spark, warehouse):
    warehouse.evolve_append("t", spark.createDataFrame([(1, "x")], "a bigint, b string"))
    warehouse.evolve_append("t", spark.createDataFrame([("y", 2, 0.5)], "b string, a int, c double"))
    assert rows(warehouse.frame("t")) == [(1, "x", None), (2, "y", 0.5)]
    void = spark.sql("SELECT 3 AS a, NULL AS d")
    warehouse.evolve_append("t", void)
    assert warehouse.frame("t").where("a = 3").first().d is None


def test_a_failed_write_leaves_the_old_table(spark, warehouse):
    warehouse.write("t", claims(spark, (1, 10)))
    before = warehouse.folder.children(warehouse.folder.path + "/t")
    broken = claims(spark, (1, 10)).withColumn("amount", F.raise_error(F.lit("no")).cast("bigint"))
    for attempt in (
        lambda: warehouse.write("t", broken),
        lambda: warehouse.replace_table("t", broken),
        lambda: warehouse.replace_rows_by_values("t", broken, column="claim_id"),
    ):
        with pytest.raises(Exception):
            attempt()
    assert rows(warehouse.frame("t")) == [(1, 10)]
    assert warehouse.folder.children(warehouse.folder.path + "/t") == before


def test_a_failed_slice_leaves_the_old_slice(spark, warehouse):
    warehouse.replace_rows_by_file("t", claims(spark, (1, 10)), file_hash="a")
    broken = claims(spark, (2, 20)).withColumn("amount", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception):
        warehouse.replace_rows_by_file("t", broken, file_hash="a")
    assert rows(warehouse.frame("t")) == [(1, 10, "a")]


def test_a_failure_before_the_switch_leaves_the_old_table(spark, warehouse, monkeypatch):
    warehouse.write("t", claims(spark, (1, 10)))

    def fail(*_):
        raise RuntimeError("switch failed")

    warehouse.replace_rows_by_file("s", claims(spark, (1, 10)), file_hash="a")
    with monkeypatch.context() as patch:
        patch.setattr(warehouse.folder, "write_text", fail)
        for attempt in (
            lambda: warehouse.write("t", claims(spark, (2, 20))),
            lambda: warehouse.evolve_append("t", claims(spark, (2, 20))),
            lambda: warehouse.replace_rows_by_values("t", claims(spark, (1, 20)), column="claim_id"),
            lambda: warehouse.replace_rows_by_file("s", claims(spark, (2, 20)), file_hash="a"),
            lambda: warehouse.build_dimension("t", claims(spark, (2, 20)).select("claim_id"), key_column="amount"),
        ):
            with pytest.raises(RuntimeError):
                attempt()
    assert rows(warehouse.frame("t")) == [(1, 10)]
    assert rows(warehouse.frame("s")) == [(1, 10, "a")]


def test_vacuum_removes_old_versions_only(spark, warehouse):
    for i in range(3):
        warehouse.write("t", claims(spark, (i, i)))
    assert warehouse.vacuum("t") == 2
    assert rows(warehouse.frame("t")) == [(2, 2)]


def test_reading(spark, warehouse):
    warehouse.write("mart.fact", claims(spark, (1, 10), (2, 20), (3, 30)))
    got = warehouse.read_table("mart.fact", select=["amount"], where="claim_id > 1", limit=10)
    assert rows(got) == [(20,), (30,)]
    assert warehouse.read_table("mart.fact", limit=0).count() == 0
    assert warehouse.read_sql("SELECT sum(amount) FROM mart_fact").first()[0] == 60
    for bad in (
        lambda: warehouse.read_table("nope"),
        lambda: warehouse.read_table("mart.fact", select=["nope"]),
        lambda: warehouse.read_table("mart.fact", select=[]),
        lambda: warehouse.read_table("mart.fact", limit=-1),
        lambda: warehouse.read_sql(" "),
        lambda: warehouse.frame("a..b"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_keyed_lookup_follows_the_list(spark, warehouse):
    kind = "status string, amount bigint"
    warehouse.write("t", spark.createDataFrame([("ready", 30), (None, 20), ("done", 10)], kind))

    def find(values, select="*"):
        found = warehouse.read_rows_by_values("t", column="status", is_in=values, select=select)
        return [tuple(r) for r in found.collect()]

    assert find([None, "ready", None]) == [(None, 20), ("ready", 30)]
    assert find(["ready", None], select=["amount"]) == [(30,), (20,)]
    assert find([None]) == [(None, 20)]
    empty = warehouse.read_rows_by_values("t", column="status", is_in=[], select="*")
    assert empty.columns == ["status", "amount"] and empty.count() == 0
    with pytest.raises(ValueError):
        warehouse.read_rows_by_values("t", column="nope", is_in=[1])
    numbers = warehouse.read_rows_by_values("t", column="amount", is_in=[10, 30], select="amount")
    assert [r.amount for r in numbers.collect()] == [10, 30]


def test_dropping_null_columns(spark, warehouse):
    nothing = F.lit(None).cast("string")
    warehouse.write("a", claims(spark, (1, 10)).withColumns({"e1": nothing, "e2": nothing}))
    warehouse.write("mart.b", claims(spark, (1, 10)))
    warehouse.write("c", spark.range(2).select(nothing.alias("x"), nothing.alias("y")))
    warehouse.write("d", spark.range(2).select(nothing.alias("only")))
    report = {r.table: (r.dropped_column_count, r.dropped_columns) for r in warehouse.drop_null_columns().collect()}
    assert report == {"a": (2, ["e1", "e2"]), "mart.b": (0, []), "c": (1, ["y"]), "d": (0, [])}
    assert warehouse.frame("a").columns == ["claim_id", "amount"]
    assert warehouse.frame("c").columns == ["x"] and warehouse.frame("c").count() == 2
    with pytest.raises(ValueError):
        warehouse.drop_null_columns(["nope"])
    for i in range(4):
        warehouse.evolve_append("d", spark.range(i, i + 1).select(F.lit("x").alias("only")))
    warehouse.drop_null_columns("d", compact_files=True)
    assert warehouse.frame("d").count() == 6 and len(warehouse.frame("d").inputFiles()) == 1


def test_buckets_follow_the_size_and_a_slice_costs_the_same(spark, warehouse, monkeypatch):
    """Linear hashing: each bucket has one parent, and a table many times larger rewrites no more."""
    monkeypatch.setattr(tables, "BUCKET_BYTES", 4_000)
    kind = "n bigint, text string"

    def slice_of(file, version=0):
        rows = [(i, f"{file}-{version}-{i * 7919 % 1000003}") for i in range(60)]
        return spark.createDataFrame(rows, kind)

    counts, sizes = [], []
    for file in range(24):
        before = warehouse._state("t")
        warehouse.replace_rows_by_file("t", slice_of(file), file_hash=f"f{file}")
        now = warehouse._state("t")
        counts.append(now["buckets"])
        old = {s for names in (before or {"segments": {}})["segments"].values() for s in names}
        new = {s for names in now["segments"].values() for s in names} - old
        sizes.append(warehouse.folder.size(*[f"{warehouse._home('t')}/{s}" for s in new]))
    assert counts == sorted(counts) and counts[-1] >= 5
    # The last writes are no larger than those of a table a quarter the size.
    assert sum(sizes[-6:]) <= 1.6 * sum(sizes[3:9])
    warehouse.replace_rows_by_file("t", slice_of(3, 1), file_hash="f3")
    got = sorted((r["file_key"], r["n"], r["text"]) for r in warehouse.frame("t").collect())
    expected = sorted((f"f{f}", i, f"{f}-{int(f == 3)}-{i * 7919 % 1000003}") for f in range(24) for i in range(60))
    assert got == expected
    state = warehouse._state("t")
    assert state["bytes"] == warehouse.folder.size(*warehouse._paths("t", state["segments"]))


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 13])
def test_a_split_moves_rows_of_one_bucket_only(spark, count):
    rows = spark.range(2_000).withColumn("k", F.col("id") * 31)
    found = rows.select(
        tables.Warehouse._bucket(["k"], count).alias("old"), tables.Warehouse._bucket(["k"], count + 1).alias("new")
    ).distinct().collect()
    parent = tables.Warehouse._split_from(count, count)
    assert {r.old for r in found} == set(range(count)) and {r.new for r in found} == set(range(count + 1))
    assert all(r.new == r.old or (r.new == count and r.old == parent) for r in found)


def test_an_appended_table_is_not_rewritten_for_a_slice(spark, warehouse):
    kind = "day int, v int"
    for day in range(5):
        warehouse.evolve_append("t", spark.createDataFrame([(day, i) for i in range(3)], kind))
    before = set(warehouse._state("t")["segments"][""])
    warehouse.replace_rows_by_values("t", spark.createDataFrame([(2, 100)], kind), column="day")
    after = warehouse._state("t")["segments"]
    assert len(before & set(after[""])) == 4 and len(after) == 2
    warehouse.evolve_append("t", spark.createDataFrame([(2, 101), (9, 9)], kind))
    warehouse.replace_rows_by_values("t", spark.createDataFrame([(9, 10)], kind), column="v")
    warehouse.replace_rows_by_values("t", spark.createDataFrame([(7, 101), (7, 2)], kind), column="v")
    got = sorted(tuple(r) for r in warehouse.frame("t").collect())
    days = [(d, v) for d in (0, 1, 3, 4) for v in (0, 1)]
    assert got == sorted([*days, (2, 100), (9, 9), (9, 10), (7, 101), (7, 2)])
