"""Queries for sources, sinks, joins and dimensions: tables that are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import file_name, source_key
from millrace.operators import joins, per_source
from millrace.plans.registry import Tables, query
from millrace.plans.steps import StepChain
from millrace.plans.warehouse import dimension_snapshot
from millrace.session import local_frame
from millrace.sources import files, outputs
from millrace.sources.tables import Folder, Warehouse


def warehouse(t: Tables) -> Warehouse:
    return Warehouse(t.spark, t.scratch("warehouse"))


def orders(t: Tables) -> DataFrame:
    """Orders with a status that is NULL for open ones."""
    status = F.nullif(F.col("o_orderstatus"), F.lit("O"))
    return t.orders.select(
        "o_orderkey", "o_custkey", status.alias("status"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority"),
    )


ORDERS = """
    o AS (
        SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'O') AS status,
               o_totalprice AS amount, o_orderpriority AS priority
        FROM orders
    )
"""

# -- reading tables ----------------------------------------------------------------------


@query(
    "read_table",
    f"""
    WITH {ORDERS} SELECT o_orderkey, status FROM o
    WHERE amount > 150000 AND status IS NOT NULL
    """,
)
def _(t: Tables):
    store = warehouse(t)
    store.write("mart.orders", orders(t))
    return store.read_table(
        "mart.orders", select=["o_orderkey", "status"],
        where="amount > 150000 AND status IS NOT NULL",
    )


@query(
    "read_sql",
    f"""
    WITH {ORDERS} SELECT priority, count(*) AS orders, count(status) AS closed FROM o
    GROUP BY priority
    """,
)
def _(t: Tables):
    store = warehouse(t)
    store.write("mart.orders", orders(t))
    return store.read_sql(
        "SELECT priority, count(*) AS orders, count(status) AS closed FROM mart_orders "
        "GROUP BY priority"
    )


@query(
    "read_rows_by_values",
    f"""
    WITH {ORDERS}, v(place, value) AS (VALUES (0, NULL), (1, 'P'))
    SELECT o.o_orderkey, o.status, o.amount FROM o JOIN v ON o.status IS NOT DISTINCT FROM v.value
    """,
)
def _(t: Tables):
    store = warehouse(t)
    store.write("orders", orders(t))
    return store.read_rows_by_values(
        "orders", column="status", is_in=[None, "P", None, "none such"],
        select=["o_orderkey", "status", "amount"],
    )


@query(
    "lookup_join_ordered",
    """
    SELECT c_custkey, c_nationkey,
           CASE c_nationkey WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS place
    FROM customer WHERE c_nationkey IN (7, 3, 11)
    """,
)
def _(t: Tables):
    listed = local_frame(t.spark, {"place": [0, 1, 2], "c_nationkey": [7, 3, 11]})
    found = joins.inner_join_null_safe(t.customer, listed, ["c_nationkey"])
    return found.select("c_custkey", "c_nationkey", F.col("place").cast("int")).orderBy("place")


@query(
    "union_all",
    f"""
    WITH {ORDERS}
    SELECT o_orderkey, status FROM o WHERE status = 'F'
    UNION ALL SELECT o_orderkey, status FROM o WHERE status IS NULL
    """,
)
def _(t: Tables):
    rows = orders(t).select("o_orderkey", "status")
    return rows.where("status = 'F'").unionAll(rows.where("status IS NULL"))


# -- files -------------------------------------------------------------------------------


def _split(t: Tables, table: DataFrame, *columns: str) -> str:
    """Write a table as many source files, one or more per value; returns the folder."""
    root = t.scratch("source-files")
    table.write.partitionBy(*columns).parquet(root)
    return root


@query(
    "scan_dataset",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS row_count,
           sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS quantity
    FROM lineitem GROUP BY ALL
    """,
)
def _(t: Tables):
    flags = t.lineitem.withColumn("flag", F.col("l_returnflag"))
    rows = files.scan_dataset(t.spark, _split(t, flags, "flag"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
    )


@query(
    "collect_files",
    """
    SELECT DISTINCT 'all' AS levels, 'source=' || source AS folder, '.parquet' AS suffix, true AS has_size
    FROM documents
    UNION ALL SELECT * FROM (VALUES
        ('all', '', '.PARQUET', true), ('all', '', '.parquet', true),
        ('top', '', '.PARQUET', true), ('top', '', '.parquet', true))
    """,
)
def _(t: Tables):
    """All levels and the top one, with files of other kinds beside those asked for."""
    root = _split(t, t.documents.select("doc_id", "source"), "source")
    for name in ("one.parquet", "TWO.PARQUET", "three.txt", "four"):
        Folder(t.spark, root).write_text(f"{root}/{name}", "text")
    folder = F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1)
    found = [
        files.collect_files(t.spark, ["PARQUET"], root=root, recursive=recursive).select(
            F.lit("all" if recursive else "top").alias("levels"), folder.alias("folder"), "suffix",
            (F.col("size_bytes") > 0).alias("has_size"),
        )
        for recursive in (True, False)
    ]
    return found[0].unionByName(found[1]).distinct()


@query(
    "candidate_files",
    """
    SELECT DISTINCT 'all' AS levels, 'lang=' || lang || '/source=' || source AS folder, NULL AS name
    FROM documents
    UNION ALL SELECT * FROM (VALUES ('all', '', 'kept.parquet'), ('top', '', 'kept.parquet'))
    """,
)
def _(t: Tables):
    """All levels and the top one; temporary files are left out of both."""
    root = _split(t, t.documents.select("doc_id", "lang", "source"), "lang", "source")
    for name in ("kept.parquet", "~$kept.parquet", "kept.parquet.part", "kept.tmp", "kept.parquet~"):
        Folder(t.spark, root).write_text(f"{root}/{name}", "text")
    folder = F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1)
    found = [
        files.candidate_files(t.spark, root, extensions=extensions, recursive=recursive).select(
            F.lit("all" if recursive else "top").alias("levels"), folder.alias("folder"),
            F.when(folder == "", F.col("name")).alias("name"),
        )
        for recursive, extensions in ((True, ".parquet"), (False, None))
    ]
    listed = found[0].unionByName(found[1]).distinct()
    # Spark marks a finished write with a file of its own.
    return listed.where("name IS NULL OR name <> '_SUCCESS'")


@query(
    "source_metadata",
    "SELECT 'lang=' || lang AS folder, count(*) AS row_count, true AS has_metadata FROM documents GROUP BY lang",
)
def _(t: Tables):
    root = _split(t, t.documents.select("doc_id", "lang"), "lang")
    rows = files.with_source(t.spark.read.parquet(root))
    known = (F.col("source_size_bytes") > 0) & F.col("source_modified_at").isNotNull()
    named = known & (F.col("source_name") == file_name(F.col("source_path")))
    folder = F.regexp_extract("source_path", "([^/]*)/[^/]*$", 1)
    return rows.groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("row_count"), F.bool_and(named).alias("has_metadata")
    )


@query(
    "read_many",
    "SELECT event_type, event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events",
)
def _(t: Tables):
    root = t.scratch("source-files")
    kinds = [row[0] for row in t.events.select("event_type").distinct().collect()]
    for kind in kinds:
        # One kind of file lacks a column.
        rows = t.events.where(F.col("event_type") == kind).select("event_type", "event_id", "user_id", "value")
        rows = rows.drop("value") if kind == "error" else rows
        rows.write.parquet(f"{root}/{kind}")
    stacked = files.read_many(t.spark, [f"{root}/{kind}" for kind in kinds])
    return stacked.select("event_type", "event_id", "user_id", "value")


@query(
    "read_sheets",
    """
    SELECT 'customer' AS sheet, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
           c_custkey::VARCHAR AS key FROM customer
    UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL, 's' || s_suppkey FROM supplier
    """,
)
def _(t: Tables):
    sheets = {
        "nation": t.nation,
        "customer": t.customer.select(
            F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"),
        ),
        "supplier": t.supplier.select(
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"),
            F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
        ),
    }
    return files.read_sheets(sheets, ["customer", "supplier"])


@query("source_key", "SELECT doc_id, sha1(lang || '/' || source || '/' || doc_id || '.txt') AS file_key FROM documents")
def _(t: Tables):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return t.documents.select(
        "doc_id", source_key(F.concat_ws("/", "lang", "source", name)).alias("file_key")
    )


# -- sinks -------------------------------------------------------------------------------


@query("write_atomic", f"WITH {ORDERS} SELECT o_orderkey, amount FROM o WHERE amount >= 200000")
def _(t: Tables):
    store = warehouse(t)
    store.write("snapshot", orders(t))
    store.write("snapshot", orders(t).where("amount >= 200000").select("o_orderkey", "amount"))
    store.vacuum("snapshot")
    return store.frame("snapshot")


@query(
    "replace_rows_by_file",
    """
    SELECT doc_id, n_chars, NULL::VARCHAR AS lang, source AS file_key FROM documents
    WHERE source NOT IN ('src3', 'src5')
    UNION ALL
    SELECT doc_id + 1000000, n_chars * 2, lang, 'src3' FROM documents WHERE lang = 'en'
    """,
)
def _(t: Tables):
    store = warehouse(t)
    rows = t.documents.select("doc_id", "n_chars", F.col("source").alias("file_key"))
    store.replace_table("fact", rows, partition_by=["file_key"])
    english = t.documents.where("lang = 'en'").select(
        (F.col("doc_id") + 1000000).alias("doc_id"), (F.col("n_chars") * 2).alias("n_chars"), "lang"
    )
    store.replace_rows_by_file("fact", english, file_hash="src3")
    store.replace_rows_by_file("fact", english.where("false"), file_hash="src5")
    return store.frame("fact").select("doc_id", "n_chars", "lang", "file_key")


@query(
    "replace_rows_by_values",
    f"""
    WITH {ORDERS}
    SELECT o_orderkey, status, amount, NULL::VARCHAR AS note FROM o WHERE status = 'P'
    UNION ALL
    SELECT o_orderkey + 1000000, status, amount, 'new' FROM o
    WHERE (status = 'F' OR status IS NULL) AND amount > 300000
    """,
)
def _(t: Tables):
    store = warehouse(t)
    rows = orders(t).select("o_orderkey", "status", "amount")
    store.replace_table("fact", rows)
    incoming = rows.where("(status = 'F' OR status IS NULL) AND amount > 300000").select(
        (F.col("o_orderkey") + 1000000).alias("o_orderkey"), "status", "amount",
        F.lit("new").alias("note"),
    )
    store.replace_rows_by_values("fact", incoming, column="status")
    return store.frame("fact")


@query(
    "delete_using",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    """,
)
def _(t: Tables):
    poor = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = t.orders.select("o_orderkey", "o_custkey")
    return joins.anti_join_null_safe(rows, poor, ["o_custkey"])


@query(
    "replace_table",
    f"""
    WITH {ORDERS}
    SELECT o_orderkey, o_custkey, status, NULL::DOUBLE AS amount, NULL::VARCHAR AS priority,
           'kept' AS note
    FROM o WHERE status IS NOT NULL
    """,
)
def _(t: Tables):
    store = warehouse(t)
    store.replace_table("mart.orders", orders(t))
    narrow = orders(t).where("status IS NOT NULL").select("status", "o_custkey", "o_orderkey")
    store.replace_table("mart.orders", narrow.withColumn("note", F.lit("kept")))
    return store.frame("mart.orders")


@query(
    "evolve_append",
    """
    SELECT s_suppkey AS key, s_name AS name, NULL::VARCHAR AS segment FROM supplier
    UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer
    """,
)
def _(t: Tables):
    store = warehouse(t)
    store.evolve_append(
        "party", t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    )
    store.evolve_append(
        "party",
        t.customer.select(
            F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"),
            F.col("c_custkey").cast("int").alias("key"),
        ),
    )
    return store.frame("party")


@query(
    "mirror_write",
    """
    SELECT lang || '/' || source || '.parquet' AS mirror_path, count(*) AS row_count,
           sum(n_chars)::BIGINT AS chars
    FROM documents GROUP BY 1
    """,
)
def _(t: Tables):
    relative = F.concat(F.concat_ws("/", "lang", "source"), F.lit(".csv"))
    rows = t.documents.select("doc_id", "n_chars", relative.alias("relative_path"))
    # English sources come a second time, on their own; the others keep their outputs.
    english = F.col("relative_path").startswith("en/")
    stale = rows.withColumn("n_chars", F.when(english, 0).otherwise(F.col("n_chars")))
    root = outputs.mirror_write(stale, t.scratch("mirror"), "relative_path")
    outputs.mirror_write(rows.where(english), root, "relative_path")
    return t.spark.read.parquet(root).groupBy("mirror_path").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("n_chars").alias("chars")
    )


@query(
    "multi_output",
    """
    SELECT 'closed' AS output, o_orderkey FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'open', o_orderkey FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'large', o_orderkey FROM orders WHERE o_totalprice > 300000
    """,
)
def _(t: Tables):
    root = t.scratch("outputs")
    # Named outputs are replaced by the second call, also where it has no rows for one.
    outputs.multi_output(t.orders, {"large": F.lit(True), "none": F.lit(True)}, root)
    outputs.multi_output(
        t.orders,
        {
            "open": F.col("o_orderstatus") == "O",
            "closed": F.col("o_orderstatus") == "F",
            "large": F.col("o_totalprice") > 300000,
            "none": F.col("o_totalprice") < 0,
        },
        root,
    )
    return t.spark.read.parquet(root).select("output", "o_orderkey")


@query(
    "save_debug_frame",
    """
    SELECT 'demo / totals / totals' AS display_name, l_orderkey, l_linenumber, l_partkey,
           l_extendedprice + l_tax AS total
    FROM lineitem
    """,
)
def _(t: Tables):
    store = warehouse(t)
    totals = t.lineitem.withColumn("total", F.col("l_extendedprice") + F.col("l_tax"))
    saved = outputs.save_debug_frame(
        store, totals, flow_name="demo", step_name="totals", name="totals", run_id="run-1"
    )
    record = store.frame(outputs.ARTIFACTS).where(F.col("artifact_table") == saved)
    return store.frame(saved).select(
        record.select("display_name").scalar().alias("display_name"),
        "l_orderkey", "l_linenumber", "l_partkey", "total",
    )


@query(
    "drop_null_columns_table",
    """
    SELECT 'mart.orders' AS table_name, 2::BIGINT AS dropped_column_count,
           'empty_number,empty_text' AS dropped_columns, count(*) AS row_count,
           4::BIGINT AS column_count
    FROM orders
    UNION ALL
    SELECT 'nothing', 1, 'b', count(*), 1 FROM customer
    """,
)
def _(t: Tables):
    store = warehouse(t)
    rows = orders(t).select("o_orderkey", "o_custkey", "status", "amount")
    empty = {"empty_text": F.lit(None).cast("string"), "empty_number": F.lit(None).cast("bigint")}
    store.write("mart.orders", rows.withColumns(empty))
    nothing = F.lit(None).cast("int")
    store.write("nothing", t.customer.select(nothing.alias("a"), nothing.alias("b")))
    report = store.drop_null_columns()
    sizes = None
    for name in store.tables():
        frame = store.frame(name)
        size = frame.agg(
            F.lit(name).alias("table"), F.count(F.lit(1)).alias("row_count"),
            F.lit(len(frame.columns)).cast("bigint").alias("column_count"),
        )
        sizes = size if sizes is None else sizes.unionByName(size)
    listed = F.array_join(F.array_sort("dropped_columns"), ",")
    return report.join(sizes, "table").select(
        F.col("table").alias("table_name"), "dropped_column_count",
        listed.alias("dropped_columns"), "row_count", "column_count",
    )


# -- joins and dimensions ----------------------------------------------------------------

PAIRS = """
    pairs AS (
        SELECT o_orderkey, nullif(c_mktsegment, 'BUILDING') AS segment,
               o_orderpriority AS priority, o_orderdate, o_totalprice
        FROM orders JOIN customer ON c_custkey = o_custkey
    )
"""


def pairs(t: Tables) -> DataFrame:
    """Orders with two natural key columns, one of them nullable."""
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    buyers = t.customer.select(F.col("c_custkey").alias("o_custkey"), segment.alias("segment"))
    return t.orders.join(buyers, "o_custkey").select(
        "o_orderkey", "segment", F.col("o_orderpriority").alias("priority"), "o_orderdate",
        "o_totalprice",
    )


EARLY = "o_orderdate < TIMESTAMP '1995-01-04'"
KEYED = f"""
    {PAIRS},
    early AS (SELECT DISTINCT segment, priority FROM pairs WHERE {EARLY}),
    first_keys AS (
        SELECT segment, priority, row_number() OVER (
                   ORDER BY segment NULLS LAST, priority NULLS LAST) AS key
        FROM early
    ),
    later AS (SELECT segment, priority FROM pairs EXCEPT SELECT segment, priority FROM early),
    dim AS (
        SELECT * FROM first_keys
        UNION ALL
        SELECT segment, priority, (SELECT coalesce(max(key), 0) FROM first_keys)
               + row_number() OVER (ORDER BY segment NULLS LAST, priority NULLS LAST)
        FROM later
    )
"""


def two_batches(t: Tables) -> Warehouse:
    """A dimension built from the early orders and extended with all of them."""
    store = warehouse(t)
    rows = pairs(t)
    early = rows.where(EARLY.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    for batch in (early, rows):
        store.build_dimension("mart.dim", batch.select("segment", "priority"), key_column="key")
    return store


@query("build_dimension", f"WITH {KEYED} SELECT segment, priority, key FROM dim")
def _(t: Tables):
    store = two_batches(t)
    again = store.build_dimension("mart.dim", pairs(t).select("segment", "priority"), key_column="key")
    return again.select("segment", "priority", "key")


@query(
    "attach_dimension",
    f"""
    WITH {KEYED}
    SELECT p.o_orderkey, p.segment, p.priority, d.key
    FROM pairs p LEFT JOIN dim d ON p.segment = d.segment AND p.priority = d.priority
    """,
)
def _(t: Tables):
    rows = pairs(t).select("o_orderkey", "segment", "priority")
    return two_batches(t).attach_dimension("mart.dim", rows, on=["segment", "priority"], key_column="key")


@query(
    "denormalize_columns",
    f"""
    WITH {KEYED}, keyed AS (SELECT o_orderkey, o_orderkey % 40 AS key FROM orders)
    SELECT k.o_orderkey, d.segment, d.priority FROM keyed k LEFT JOIN dim d ON d.key = k.key
    """,
)
def _(t: Tables):
    keyed = t.orders.select("o_orderkey", (F.col("o_orderkey") % 40).alias("key"))
    return two_batches(t).denormalize_columns("mart.dim", keyed, key_column="key", drop_key=True)


@query(
    "normalize_columns",
    f"""
    WITH {PAIRS},
    dim AS (
        SELECT segment, priority, row_number() OVER (ORDER BY segment NULLS LAST, priority) AS key
        FROM (SELECT DISTINCT segment, priority FROM pairs)
    )
    SELECT p.o_orderkey, p.o_totalprice, d.key FROM pairs p
    LEFT JOIN dim d ON p.segment = d.segment AND p.priority = d.priority
    """,
)
def _(t: Tables):
    rows = pairs(t).select("o_orderkey", "segment", "priority", "o_totalprice")
    return warehouse(t).normalize_columns("dim", rows, on=["segment", "priority"], key_column="key")


@query(
    "anti_join_null_safe",
    f"""
    WITH {PAIRS}
    SELECT segment, o_orderdate FROM pairs
    EXCEPT SELECT segment, o_orderdate FROM pairs WHERE o_totalprice > 300000
    """,
)
def _(t: Tables):
    rows = pairs(t)
    names = ["segment", "o_orderdate"]
    return joins.anti_join_null_safe(
        rows.select(*names).distinct(), rows.where("o_totalprice > 300000"), names
    )


@query(
    "inner_join_null_safe",
    f"""
    WITH {PAIRS},
    big AS (SELECT segment, count(*) AS large_orders FROM pairs WHERE o_totalprice > 450000 GROUP BY 1)
    SELECT p.o_orderkey, p.segment, b.large_orders FROM pairs p
    JOIN big b ON p.segment IS NOT DISTINCT FROM b.segment
    """,
)
def _(t: Tables):
    rows = pairs(t)
    large = rows.where("o_totalprice > 450000").groupBy("segment").agg(
        F.count(F.lit(1)).alias("large_orders")
    )
    return joins.inner_join_null_safe(rows.select("o_orderkey", "segment"), large, ["segment"])


@query(
    "scalar_cross_join",
    """
    SELECT c_custkey + (SELECT coalesce(max(s_suppkey), 0) FROM supplier) AS party_key, c_name AS name
    FROM customer
    """,
)
def _(t: Tables):
    highest = t.supplier.agg(F.coalesce(F.max("s_suppkey"), F.lit(0))).scalar()
    return t.customer.select(
        (F.col("c_custkey") + highest).alias("party_key"), F.col("c_name").alias("name")
    )


@query(
    "max_key",
    """
    SELECT (SELECT coalesce(max(o_orderkey), 0) FROM orders) AS highest,
           (SELECT coalesce(max(o_orderkey), 0) FROM orders WHERE o_totalprice < 0) AS of_none
    """,
)
def _(t: Tables):
    key = F.col("o_orderkey")
    negative = F.when(F.col("o_totalprice") < 0, key)
    return t.orders.agg(
        F.coalesce(F.max(key), F.lit(0)).alias("highest"),
        F.coalesce(F.max(negative), F.lit(0)).alias("of_none"),
    )


@query(
    "dimension_snapshot",
    """
    WITH docs AS (
        SELECT DISTINCT o_orderkey AS order_no, c_mktsegment AS segment, o_orderstatus AS order_state,
               o_orderpriority AS priority, c_nationkey AS nation_no
        FROM orders JOIN customer ON c_custkey = o_custkey
    ),
    dim AS (
        SELECT nation_no, segment, row_number() OVER (
                   ORDER BY nation_no NULLS LAST, segment NULLS LAST) AS market_key
        FROM (SELECT DISTINCT nation_no, segment FROM docs)
    )
    SELECT docs.*, market_key FROM docs LEFT JOIN dim USING (nation_no, segment)
    """,
)
def _(t: Tables):
    """Stage, build the dimension, key the fact table, read it back."""
    buyers = t.customer.select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("Segment"),
        F.col("c_nationkey").alias("Nation No"),
    )
    rows = t.orders.join(buyers, "o_custkey").select(
        F.col("o_orderkey").alias(" Order  No"), "Segment",
        F.col("o_orderstatus").alias("Order STATE"), F.col("o_orderpriority").alias("Priority"),
        "Nation No",
    )
    return dimension_snapshot(
        warehouse(t), rows, natural=["nation_no", "segment"],
        key_column="market_key", stage="stage.orders",
        dimension="mart.markets", fact="mart.orders",
    )


# -- author code -------------------------------------------------------------------------


@query(
    "named_steps",
    """
    SELECT o_orderpriority AS priority, count(*) AS orders FROM orders
    WHERE o_totalprice >= 100000 GROUP BY 1
    """,
)
def _(t: Tables):
    chain = (
        StepChain()
        .step(lambda state: t.orders, save_as="raw")
        .step(lambda state: state.current.where(
            F.col("o_totalprice") >= state.parameters["threshold"]), save_as="large")
        .step(lambda state: state.frames["raw"].select("o_orderkey"))
        .step(lambda state: state.current.groupBy(F.col("o_orderpriority").alias("priority")).agg(
            F.count(F.lit(1)).alias("orders")), use="large")
    )
    return chain.run(threshold=100000)


@query("preview", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(t: Tables):
    def never(state):
        raise AssertionError("Steps after the previewed frame are not called.")

    chain = (
        StepChain()
        .step(lambda state: state.current.select("o_orderkey", "o_orderstatus"))
        .step(lambda state: state.current.where("o_orderstatus = 'F'").select("o_orderkey"),
              save_as="closed")
        .step(never)
    )
    return chain.preview("closed", t.orders)


@query(
    "map_batch",
    "SELECT doc_id, source, length(text) - length(replace(text, ' ', '')) + 1 AS words FROM documents",
)
def _(t: Tables):
    def words(source, rows):
        counts = rows["text"].str.count(" ") + 1
        return rows[["doc_id", "source"]].assign(words=counts)

    rows = t.documents.select("doc_id", "source", "text")
    return per_source.map_batch(rows, words, "doc_id bigint, source string, words bigint", key="source")


@query(
    "map_items",
    """
    SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position, doc_id AS item,
           length(text) AS letters, length(text) - length(replace(text, ' ', '')) AS gaps
    FROM documents
    """,
)
def _(t: Tables):
    def measure(context, item):
        text = item["text"]
        return {"item": item["doc_id"], "letters": len(text), "gaps": text.count(context["gap"])}

    return per_source.map_items(
        t.documents.select("doc_id", "text", "n_chars"), measure, "item bigint, letters bigint, gaps bigint",
        order_by=["n_chars", "doc_id"], descending=[True, False], size="n_chars", context={"gap": " "},
    )


@query(
    "run_sources",
    """
    SELECT source AS source_key, count(*) AS row_count, max(n_chars) AS longest,
           count(DISTINCT lang) AS languages
    FROM documents GROUP BY source
    UNION ALL SELECT NULL, count(*), max(n_chars), count(DISTINCT lang) FROM documents
    """,
)
def _(t: Tables):
    rows = t.documents.withColumnRenamed("source", "source_key")
    wanted = [
        F.count(F.lit(1)).alias("row_count"), F.max("n_chars").alias("longest"),
        F.count_distinct("lang").alias("languages"),
    ]
    each = per_source.run_sources(rows, wanted)
    together = per_source.run_sources(rows, wanted, run_as="batch")
    return each.unionByName(together.withColumn("source_key", F.lit(None).cast("string")))
