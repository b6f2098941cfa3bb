"""Queries for the frame operators: schema, filters, windows, sorts, unions, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import business_days as days
from millrace.functions.paths import MirrorPaths
from millrace.functions.sortkeys import SortKey
from millrace.operators import filters as flt
from millrace.operators import ordered, preview, schema, unions
from millrace.operators.numbering import surrogate_numbering
from millrace.plans.registry import Tables, query

# -- projection and schema ---------------------------------------------------------------


@query("select_columns", "SELECT o_orderpriority, o_orderkey FROM orders")
def _(t: Tables):
    return schema.select_columns(t.orders, ["o_orderpriority", "o_orderkey"])


@query("drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(t: Tables):
    return schema.drop_columns(t.customer, ["c_name", "c_acctbal", "no_such_column"])


@query(
    "rename_columns",
    "SELECT s_suppkey AS supplier, s_name AS name, s_nationkey, s_acctbal FROM supplier",
)
def _(t: Tables):
    return schema.rename_columns(t.supplier, {"s_suppkey": "supplier", "s_name": "name"})


@query(
    "cast_columns",
    """
    SELECT o_orderkey::INTEGER AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
           o_totalprice::DECIMAL(18, 2) AS o_totalprice, o_orderdate::DATE AS o_orderdate,
           (o_totalprice > 200000)::VARCHAR AS is_large
    FROM orders
    """,
)
def _(t: Tables):
    rows = t.orders.drop("o_orderpriority").withColumn("is_large", F.col("o_totalprice") > 200000)
    return schema.cast_columns(
        rows,
        {
            "o_orderkey": "int",
            "o_totalprice": "decimal(18,2)",
            "o_orderdate": "date",
            "o_orderstatus": "string",
        },
    )


@query(
    "table_schema",
    """
    SELECT o_orderkey AS order_no, o_orderdate::DATE AS ordered_on, o_orderpriority AS urgency,
           o_custkey::VARCHAR AS buyer
    FROM orders
    """,
)
def _(t: Tables):
    recipe = schema.TableSchema(
        columns=("order_no", "ordered_on", "urgency", "buyer"),
        dtypes={"o_orderkey": "bigint", "o_orderdate": "date"},
        rename={
            "o_orderkey": "order_no",
            "o_orderdate": "ordered_on",
            "o_orderpriority": "urgency",
            "o_custkey": "buyer",
        },
        drop=("o_totalprice", "not_there"),
    )
    return (
        t.orders.transform(recipe.cast)
        .transform(recipe.drop_unwanted)
        .transform(recipe.rename_all)
        .transform(recipe.select)
    )


@query(
    "normalize_column_name",
    r"""
    SELECT p_partkey,
           lower(regexp_replace(regexp_replace(trim('  ' || p_name || '  #  ' || p_brand || ' /  '
               || p_type || '   Mixed  Case - ' || p_size || ' '),
               '\s*([#_\-/\\])\s*', '\1', 'g'), '\s+', '_', 'g')) AS name
    FROM part
    """,
)
def _(t: Tables):
    messy = F.concat(
        F.lit("  "), "p_name", F.lit("  #  "), "p_brand", F.lit(" /  "), "p_type",
        F.lit("   Mixed  Case - "), F.col("p_size").cast("string"), F.lit(" "),
    )
    return t.part.select("p_partkey", schema.normalized_text(messy).alias("name"))


@query(
    "normalize_column_names",
    """
    SELECT o_orderkey AS "order#no", o_custkey AS buyer_no, o_orderstatus AS current_state,
           o_totalprice AS "price/total"
    FROM orders
    """,
)
def _(t: Tables):
    messy = t.orders.select(
        F.col("o_orderkey").alias("Order # No"),
        F.col("o_custkey").alias("Buyer _ No"),
        F.col("o_orderstatus").alias("  Current   State  "),
        F.col("o_totalprice").alias("Price / Total"),
    )
    return schema.normalize_column_names(messy)


@query("remove_null_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t: Tables):
    sparse = t.lineitem.select(
        "l_orderkey",
        F.lit(None).cast("string").alias("note"),
        "l_quantity",
        F.when(F.col("l_quantity") < 0, F.col("l_tax")).alias("refund"),
    )
    return schema.remove_null_columns(sparse)


@query(
    "derive_columns",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice + l_tax AS total,
           CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'medium'
                ELSE 'small' END AS size
    FROM lineitem
    """,
)
def _(t: Tables):
    size = (
        F.when(F.col("l_quantity") >= 40, "large")
        .when(F.col("l_quantity") >= 20, "medium")
        .otherwise("small")
    )
    return t.lineitem.withColumns(
        {"total": F.col("l_extendedprice") + F.col("l_tax"), "size": size}
    ).select("l_orderkey", "l_linenumber", "l_partkey", "total", "size")


@query(
    "combine_datetime",
    """
    SELECT event_id, date_trunc('day', ts) + INTERVAL 1 MICROSECOND * (event_id * 7919 % 86400000000)
               AS from_micros,
           date_trunc('day', ts) + INTERVAL 1 SECOND * (event_id * 7919 % 86400) AS from_text
    FROM events
    """,
)
def _(t: Tables):
    seconds = (F.col("event_id") * 7919) % 86400
    text = F.concat_ws(
        ":",
        F.lpad(F.floor(seconds / 3600).cast("string"), 2, "0"),
        F.lpad((F.floor(seconds / 60) % 60).cast("string"), 2, "0"),
        F.lpad((seconds % 60).cast("string"), 2, "0"),
    )
    rows = t.events.select(
        "event_id",
        F.col("ts").cast("date").alias("day"),
        ((F.col("event_id") * 7919) % 86400000000).alias("micros"),
        text.alias("clock"),
    )
    return rows.select(
        "event_id",
        schema.combine_datetime("day", "micros").alias("from_micros"),
        schema.combine_datetime("day", "clock", text=True).alias("from_text"),
    )


# -- filters -----------------------------------------------------------------------------

LABELLED = """
    labelled AS (
        SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic = 1 AS toxic,
               CASE WHEN l.doc_id IS NULL THEN NULL ELSE d.source END AS checked_source
        FROM documents d LEFT JOIN labels l USING (doc_id)
    )
"""


def labelled(t: Tables):
    """Documents with nullable label columns."""
    known = t.labels.select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic"))
    joined = t.documents.select("doc_id", "lang", "source", "n_chars").join(
        known.withColumn("__known", F.lit(True)), "doc_id", "left"
    )
    checked = F.when(F.col("__known"), F.col("source"))
    return joined.withColumn("checked_source", checked).drop("__known")


@query(
    "filter_distinct",
    f"WITH {LABELLED} SELECT * FROM labelled WHERE quality IN (0) OR quality IS NULL",
)
def _(t: Tables):
    return flt.filter_rows(labelled(t), flt.DistinctFilter("quality", (0, flt.BLANK)))


@query(
    "filter_text",
    f"""
    WITH {LABELLED},
    c AS (SELECT doc_id, coalesce(checked_source, '') AS s FROM labelled)
    SELECT 'equals' AS operation, doc_id FROM c WHERE s = 'src3'
    UNION ALL SELECT 'not_equals', doc_id FROM c WHERE s <> 'src3'
    UNION ALL SELECT 'begins_with', doc_id FROM c WHERE starts_with(s, 'src1')
    UNION ALL SELECT 'ends_with', doc_id FROM c WHERE suffix(s, '9')
    UNION ALL SELECT 'contains', doc_id FROM c WHERE contains(s, 'c1')
    UNION ALL SELECT 'not_contains', doc_id FROM c WHERE NOT contains(s, 'c1')
    """,
)
def _(t: Tables):
    rows, result = labelled(t), None
    for operation, text in [
        ("equals", "src3"), ("not_equals", "src3"), ("begins_with", "src1"),
        ("ends_with", "9"), ("contains", "c1"), ("not_contains", "c1"),
    ]:
        found = flt.filter_rows(rows, flt.TextFilter("checked_source", ((operation, text),)))
        part = found.select(F.lit(operation).alias("operation"), "doc_id")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "filter_text_all",
    f"""
    WITH {LABELLED} SELECT * FROM labelled
    WHERE starts_with(coalesce(checked_source, ''), 'src')
      AND NOT contains(coalesce(checked_source, ''), '1')
    """,
)
def _(t: Tables):
    conditions = (("begins_with", "src"), ("not_contains", "1"), ("equals", ""))
    return flt.filter_rows(labelled(t), flt.TextFilter("checked_source", conditions))


@query(
    "filter_date_ranges",
    """
    SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'
       OR o_orderdate::DATE BETWEEN DATE '1999-12-25' AND DATE '2000-01-05'
    """,
)
def _(t: Tables):
    ranges = (("1996-03-31", "1996-01-01"), ("1999-12-25", "2000-01-05"), ("2001-01-01", ""))
    found = flt.filter_rows(t.orders, flt.DateFilter("o_orderdate", ranges))
    return found.select("o_orderkey", "o_orderdate")


@query(
    "filter_time_ranges",
    """
    SELECT event_id, ts FROM events
    WHERE (ts::TIME BETWEEN TIME '09:00:00' AND TIME '10:00:00')
       OR (ts::TIME BETWEEN TIME '16:00:00' AND TIME '17:30:15.5')
    """,
)
def _(t: Tables):
    ranges = (("10:00", "09:00"), ("16:00", "17:30:15.500"), ("", "12:00"))
    return flt.filter_rows(t.events, flt.TimeFilter("ts", ranges)).select("event_id", "ts")


@query(
    "filter_number_ranges",
    """
    SELECT event_id, value FROM events
    WHERE value BETWEEN 5 AND 7.5 OR value >= 60 OR (value >= 20 AND value <= 21)
    """,
)
def _(t: Tables):
    ranges = (("7.5", "5"), ("60", ""), ("20", "21"), ("abc", "100"), ("", " "))
    return flt.filter_rows(t.events, flt.NumberFilter("value", ranges)).select(
        "event_id", "value"
    )


@query(
    "filter_boolean",
    f"""
    WITH {LABELLED}
    SELECT 'true' AS choice, doc_id FROM labelled WHERE toxic
    UNION ALL SELECT 'false', doc_id FROM labelled WHERE NOT toxic
    UNION ALL SELECT 'blank', doc_id FROM labelled WHERE toxic IS NULL
    """,
)
def _(t: Tables):
    rows = labelled(t)
    parts = [
        flt.filter_rows(rows, flt.BooleanFilter("toxic", choice)).select(
            F.lit(choice).alias("choice"), "doc_id"
        )
        for choice in ("true", "false", "blank")
    ]
    return unions.concat_strict(*parts)


@query(
    "filter_all",
    """
    SELECT event_id, event_type, value FROM events
    WHERE event_type IN ('click', 'view', 'error') AND NOT contains(event_type, 'rr')
      AND value >= 10
    """,
)
def _(t: Tables):
    kinds = flt.AllFilter(
        "event_type",
        (
            flt.DistinctFilter("event_type", ("click", "view", "error")),
            flt.TextFilter("event_type", (("not_contains", "rr"),)),
            flt.TextFilter("event_type", (("equals", ""),)),
        ),
    )
    found = flt.filter_rows(t.events, kinds, flt.NumberFilter("value", (("10", ""),)))
    return found.select("event_id", "event_type", "value")


@query(
    "filter_rows",
    "SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 250000.5",
)
def _(t: Tables):
    return t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") >= 250000.5))


@query(
    "search_distinct",
    """
    WITH found AS (
        SELECT DISTINCT p_name AS value FROM part WHERE p_size >= 10 AND contains(lower(p_name), 'wid'))
    SELECT value, value AS label, (SELECT count(*) FROM found) > 5 AS more FROM found
    ORDER BY 1 LIMIT 5
    """,
)
def _(t: Tables):
    found = preview.search_distinct(
        t.part,
        "p_name",
        filters=[
            flt.NumberFilter("p_size", (("10", ""),)),
            # The filter of the searched column itself does not count.
            flt.TextFilter("p_name", (("equals", "red widget"),)),
        ],
        search=" WID ",
        descending=False,
        limit=5,
    )
    return found.values


# -- aggregates, distinct ----------------------------------------------------------------


@query(
    "group_count",
    "SELECT event_type, count(*) AS row_count FROM events GROUP BY event_type",
)
def _(t: Tables):
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("row_count"))
    return counts.orderBy(F.col("row_count").desc(), "event_type")


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("distinct_on", "SELECT o_custkey, count(*) AS kept FROM (SELECT DISTINCT o_custkey FROM orders) GROUP BY 1")
def _(t: Tables):
    one = t.orders.dropDuplicates(["o_custkey"])
    return one.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "non_null_counts",
    f"""
    WITH {LABELLED}
    SELECT count(doc_id) AS doc_id, count(lang) AS lang, count(source) AS source,
           count(n_chars) AS n_chars, count(quality) AS quality, count(toxic) AS toxic,
           count(checked_source) AS checked_source
    FROM labelled
    """,
)
def _(t: Tables):
    return schema.non_null_counts(labelled(t))


@query("row_count", "SELECT count(*) AS row_count FROM lineitem")
def _(t: Tables):
    counted = preview.row_count(t.lineitem)
    return t.spark.range(1).select(F.lit(counted).cast("bigint").alias("row_count"))


# -- ordered groups ----------------------------------------------------------------------

GAPPY = """
    gappy AS (
        SELECT *, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS amount,
               CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS rank_key
        FROM events
    )
"""


def gappy(t: Tables):
    """Events with NULLs in a value and in a sort column."""
    kind = F.col("event_type")
    return t.events.withColumns(
        {
            "amount": F.when(kind != "view", F.col("value")),
            "rank_key": F.when(kind != "signup", F.col("value")),
        }
    )


@query(
    "propagate_last_value",
    f"""
    WITH {GAPPY}
    SELECT event_id, user_id,
        last_value(amount IGNORE NULLS) OVER w AS last_amount,
        last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER w
            AS last_purchase_at,
        last_value(amount) OVER (PARTITION BY user_id
            ORDER BY rank_key DESC NULLS FIRST, event_id DESC NULLS FIRST
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS smallest_amount
    FROM gappy
    WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def _(t: Tables):
    order = ["ts", "event_id"]
    rows = ordered.propagate(
        gappy(t),
        {
            "last_amount": ordered.Pick("amount", order),
            "last_purchase_at": ordered.Pick(
                "ts", order, where=F.col("event_type") == "purchase"
            ),
            "smallest_amount": ordered.Pick(
                "amount", ["rank_key", "event_id"], descending=True, ignore_nulls=False
            ),
        },
        by="user_id",
    )
    return rows.select("event_id", "user_id", "last_amount", "last_purchase_at", "smallest_amount")


@query(
    "propagate_first_value",
    f"""
    WITH {GAPPY}
    SELECT event_id, user_id,
        first_value(amount IGNORE NULLS) OVER w AS first_amount,
        first_value(CASE WHEN event_type = 'error' THEN amount END IGNORE NULLS) OVER w
            AS first_error_amount,
        first_value(event_type) OVER (PARTITION BY user_id
            ORDER BY event_type DESC NULLS LAST, rank_key ASC NULLS LAST, event_id ASC NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top_type
    FROM gappy
    WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def _(t: Tables):
    order = ["ts", "event_id"]
    rows = gappy(t)
    rows = ordered.propagate_first_value(
        rows, "first_amount", "amount", by="user_id", sort_by=order
    )
    rows = ordered.propagate_first_value(
        rows, "first_error_amount", "amount", by="user_id", sort_by=order,
        where=F.col("event_type") == "error",
    )
    rows = ordered.propagate_first_value(
        rows, "top_type", "event_type", by="user_id",
        sort_by=["event_type", "rank_key", "event_id"], descending=[True, False, False],
        nulls_last=True, ignore_nulls=False,
    )
    return rows.select("event_id", "user_id", "first_amount", "first_error_amount", "top_type")


@query(
    "visit_counter",
    """
    WITH e AS (SELECT event_id, user_id, ts, nullif(event_type, 'view') AS workflow FROM events),
    flagged AS (
        SELECT *, CASE WHEN row_number() OVER w = 1
                         OR workflow IS DISTINCT FROM lag(workflow) OVER w THEN 1 ELSE 0 END AS starts
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    )
    SELECT event_id, user_id, workflow,
           (sum(starts) OVER (PARTITION BY user_id, workflow ORDER BY ts, event_id
                              ROWS UNBOUNDED PRECEDING))::BIGINT AS visit
    FROM flagged
    """,
)
def _(t: Tables):
    workflow = F.nullif(F.col("event_type"), F.lit("view"))
    rows = t.events.select("event_id", "user_id", "ts", workflow.alias("workflow"))
    return ordered.visit_counter(
        rows, "visit", "workflow", by="user_id", sort_by=["ts", "event_id"]
    ).drop("ts")


CALENDAR = """
    holidays AS (
        SELECT unnest(['1995-12-25', '1996-01-01', '1996-07-04', '1997-12-25', '1998-05-29',
            '1999-12-31', '2000-01-03', '2000-12-25', '2001-01-01', '2001-05-06', '2024-01-15',
            '2024-01-16'])::DATE AS d
    ),
    cal AS (
        SELECT d::DATE AS d,
            (isodow(d) <= 5 AND d::DATE NOT IN (SELECT d FROM holidays)) AS open,
            ((isodow(d) <= 4 OR isodow(d) = 7) AND d::DATE NOT IN (SELECT d FROM holidays)) AS open2
        FROM generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2026-12-31', INTERVAL 1 DAY) s(d)
    ),
    idx AS (
        SELECT d, open, open2, sum(open::INT) OVER (ORDER BY d)::BIGINT AS n,
               sum(open2::INT) OVER (ORDER BY d)::BIGINT AS n2
        FROM cal
    ),
    biz AS (SELECT n, d FROM idx WHERE open)
"""
HOLIDAYS = [
    "1995-12-25", "1996-01-01", "1996-07-04", "1997-12-25", "1998-05-29", "1999-12-31",
    "2000-01-03", "2000-12-25", "2001-01-01", "2001-05-06", "2024-01-15", "2024-01-16",
]
SPANS = """
    spans AS (
        SELECT o_orderkey, o_orderdate::DATE AS s,
               CASE WHEN o_custkey % 11 = 0 THEN NULL
                    ELSE o_orderdate::DATE + (o_custkey % 200 - 60)::INTEGER END AS e,
               (o_custkey % 41 - 20)::BIGINT AS m
        FROM orders
    )
"""
FOUR_DAYS_AND_SUNDAY = (True, True, True, True, False, False, True)


def spans(t: Tables):
    """Orders with a start date, a nullable end date and a day offset."""
    start = F.col("o_orderdate").cast("date")
    shift = (F.col("o_custkey") % 200 - 60).cast("int")
    return t.orders.select(
        "o_orderkey",
        start.alias("s"),
        F.when(F.col("o_custkey") % 11 != 0, F.date_add(start, shift)).alias("e"),
        (F.col("o_custkey") % 41 - 20).alias("m"),
    )


@query(
    "running_total",
    f"""
    WITH {CALENDAR},
    e AS (
        SELECT event_id, user_id, ts, event_type IN ('click', 'purchase') AS use_days,
               ts::DATE AS s, ts::DATE + (event_id % 30)::INTEGER AS e
        FROM events
    ),
    counted AS (
        SELECT e.*, CASE WHEN use_days THEN b.n - a.n ELSE 0 END AS days
        FROM e JOIN idx a ON a.d = e.s - 1 JOIN idx b ON b.d = e.e
    )
    SELECT event_id, user_id,
           (sum(days) OVER (PARTITION BY user_id ORDER BY ts, event_id
                            ROWS UNBOUNDED PRECEDING))::BIGINT AS business_days_so_far
    FROM counted
    """,
)
def _(t: Tables):
    until = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 30).cast("int"))
    spent = F.when(
        F.col("event_type").isin("click", "purchase"),
        days.networkdays("ts", until, holidays=HOLIDAYS),
    ).otherwise(0)
    return ordered.running_total(
        t.events, "business_days_so_far", spent, by="user_id", sort_by=["ts", "event_id"]
    ).select("event_id", "user_id", "business_days_so_far")


@query(
    "surrogate_numbering",
    """
    SELECT l_suppkey, l_returnflag, row_number() OVER (
               ORDER BY l_suppkey NULLS LAST, l_returnflag NULLS LAST) + 1000 AS number
    FROM (SELECT DISTINCT l_suppkey, nullif(l_returnflag, 'R') AS l_returnflag FROM lineitem)
    """,
)
def _(t: Tables):
    pairs = t.lineitem.select(
        "l_suppkey", F.nullif(F.col("l_returnflag"), F.lit("R")).alias("l_returnflag")
    ).distinct()
    keys = [SortKey(F.col(c), nulls_last=True) for c in pairs.columns]
    return surrogate_numbering(pairs, "number", keys, start_after=1000)


# -- sort, top-k, unions -----------------------------------------------------------------


@query(
    "multi_sort",
    "SELECT event_id, event_type, value FROM events ORDER BY event_type, value DESC, event_id",
)
def _(t: Tables):
    rows = t.events.select("event_id", "event_type", "value")
    return preview.multi_sort(
        rows, [("event_type", False), ("value", True), ("event_id", False)]
    )


@query(
    "top_k",
    f"""
    WITH {GAPPY} SELECT event_id, event_type, rank_key FROM gappy
    ORDER BY rank_key DESC NULLS FIRST, event_id ASC LIMIT 3000
    """,
)
def _(t: Tables):
    rows = gappy(t).select("event_id", "event_type", "rank_key")
    return preview.top_k(rows, [("rank_key", True), ("event_id", False)], 3000)


@query(
    "filtered_preview",
    """
    WITH m AS (SELECT * FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'P')
    SELECT *, (SELECT count(*) FROM m) AS row_count, 6::INTEGER AS column_count FROM m
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 200
    """,
)
def _(t: Tables):
    found = preview.filtered_preview(
        t.orders,
        [
            flt.NumberFilter("o_totalprice", (("100000", ""),)),
            flt.TextFilter("o_orderstatus", (("not_equals", "P"),)),
        ],
        [("o_totalprice", True), ("o_orderkey", False)],
        limit=200,
    )
    return found.rows.withColumns(
        {
            "row_count": F.lit(found.row_count).cast("bigint"),
            "column_count": F.lit(found.column_count),
        }
    )


@query(
    "top_k_with_ties",
    """
    SELECT l_returnflag, count(*) AS rows_of_flag FROM (
        SELECT l_returnflag FROM lineitem ORDER BY l_returnflag LIMIT 10001)
    GROUP BY l_returnflag
    """,
)
def _(t: Tables):
    """A few sort values and a limit beyond what one task sorts; it has the rows of a smaller one."""
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")
    larger = preview.top_k(rows, [("l_returnflag", False)], 10_001)
    smaller = preview.top_k(rows, [("l_returnflag", False)], 5_000)
    # Rows of the smaller result that the larger one lacks would change the counts.
    both = larger.withColumn("more", F.lit(0)).unionByName(
        smaller.exceptAll(larger).withColumn("more", F.lit(1))
    )
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows_of_flag"))


@query(
    "head",
    "SELECT least(count(*), 1000) AS shown, least(count(*), 1000) AS of_the_table FROM lineitem",
)
def _(t: Tables):
    """So many rows, all of them rows of the table."""
    shown = preview.head(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), 1000)
    known = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").distinct().withColumn("known", F.lit(1))
    found = shown.join(known, ["l_orderkey", "l_linenumber", "l_partkey"], "left")
    return found.agg(F.count(F.lit(1)).alias("shown"), F.count("known").alias("of_the_table"))


@query(
    "concat_strict",
    """
    SELECT c_name AS name, c_nationkey AS nation FROM customer
    UNION ALL SELECT s_name, s_nationkey FROM supplier
    """,
)
def _(t: Tables):
    return unions.concat_strict(
        t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")),
        t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")),
    )


@query(
    "concat_relaxed",
    """
    SELECT c_custkey::BIGINT AS key, c_acctbal::VARCHAR AS label, c_nationkey::DOUBLE AS amount
    FROM customer
    UNION ALL SELECT s_nationkey::BIGINT, s_name, s_acctbal FROM supplier
    """,
)
def _(t: Tables):
    return unions.concat_relaxed(
        t.customer.select(
            F.col("c_custkey").alias("key"),
            F.col("c_acctbal").alias("label"),
            F.col("c_nationkey").alias("amount"),
        ),
        t.supplier.select(
            F.col("s_nationkey").alias("key"),
            F.col("s_name").alias("label"),
            F.col("s_acctbal").alias("amount"),
        ),
    )


# -- calendars and scalars ---------------------------------------------------------------


@query(
    "networkdays",
    f"""
    WITH {CALENDAR}, {SPANS},
    b AS (
        SELECT o_orderkey, s, e, least(s, e) AS lo, greatest(s, e) AS hi,
               CASE WHEN s <= e THEN 1 ELSE -1 END AS sign
        FROM spans
    )
    SELECT o_orderkey, s, e,
        CASE WHEN e IS NOT NULL THEN sign * (h.n - l.n) END AS plain,
        CASE WHEN e IS NOT NULL
             THEN sign * (h.n - l.n + CASE WHEN st.open THEN 0 ELSE 1 END) END AS first_day,
        CASE WHEN e IS NOT NULL THEN sign * (h.n2 - l.n2) END AS other_week
    FROM b LEFT JOIN idx h ON h.d = b.hi LEFT JOIN idx l ON l.d = b.lo - 1
           LEFT JOIN idx st ON st.d = b.s
    """,
)
def _(t: Tables):
    calendar = days.BusinessCalendar(holidays=HOLIDAYS)
    return spans(t).select(
        "o_orderkey", "s", "e",
        calendar.networkdays("s", "e").alias("plain"),
        calendar.networkdays("s", "e", count_first_day=True).alias("first_day"),
        days.networkdays("s", "e", holidays=HOLIDAYS, mask=FOUR_DAYS_AND_SUNDAY).alias(
            "other_week"
        ),
    )


@query(
    "workday",
    f"""
    WITH {CALENDAR}, {SPANS},
    placed AS (SELECT spans.*, idx.open, idx.n FROM spans JOIN idx ON idx.d = spans.s),
    targets AS (
        SELECT *,
            CASE WHEN m = 0 THEN CASE WHEN open THEN n ELSE n + 1 END
                 WHEN m > 0 THEN n + m
                 WHEN open THEN n + m ELSE n + m + 1 END AS plain_n,
            CASE WHEN m = 0 OR (NOT open AND abs(m) = 1) THEN NULL
                 WHEN m > 0 THEN n + m - 1
                 WHEN open THEN n + m + 1 ELSE n + m + 2 END AS first_n
        FROM placed
    )
    SELECT o_orderkey, s, m, p.d AS plain, CASE WHEN first_n IS NULL THEN s ELSE f.d END AS first_day
    FROM targets JOIN biz p ON p.n = plain_n LEFT JOIN biz f ON f.n = first_n
    """,
)
def _(t: Tables):
    calendar = days.BusinessCalendar(holidays=HOLIDAYS)
    return spans(t).select(
        "o_orderkey", "s", "m",
        calendar.workday("s", "m").alias("plain"),
        calendar.workday("s", "m", count_first_day=True).alias("first_day"),
    )


@query(
    "is_business_day",
    f"""
    WITH {CALENDAR}
    SELECT l_orderkey, l_linenumber, l_partkey, open AS is_open, open2 AS other_week
    FROM lineitem JOIN idx ON idx.d = l_shipdate::DATE
    """,
)
def _(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        days.is_business_day("l_shipdate", holidays=HOLIDAYS).alias("is_open"),
        days.is_business_day("l_shipdate", holidays=HOLIDAYS, mask=FOUR_DAYS_AND_SUNDAY).alias(
            "other_week"
        ),
    )


@query(
    "nearest_business_days",
    f"""
    WITH {CALENDAR}
    SELECT l_orderkey, l_linenumber, l_partkey, nx.d AS next_day, pv.d AS previous_day
    FROM lineitem JOIN idx ON idx.d = l_shipdate::DATE
    JOIN biz nx ON nx.n = CASE WHEN open THEN idx.n ELSE idx.n + 1 END
    JOIN biz pv ON pv.n = idx.n
    """,
)
def _(t: Tables):
    calendar = days.BusinessCalendar(holidays=HOLIDAYS)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        calendar.next_business_day("l_shipdate").alias("next_day"),
        calendar.previous_business_day("l_shipdate").alias("previous_day"),
    )


@query(
    "derived_path",
    """
    SELECT doc_id, '/out/' || lang || '/' || source || '/doc.' || doc_id || '.parquet' AS swapped,
           '/out/' || lang || '/' || source || '/summary.csv' AS sibling,
           '/out/' || lang || '/' || source || '/doc.' || doc_id || '/open.parquet' AS namespaced,
           '/out/all.parquet' AS shared
    FROM documents
    """,
)
def _(t: Tables):
    relative = F.concat_ws(
        "/", "lang", "source",
        F.concat(F.lit("doc."), F.col("doc_id").cast("string"), F.lit(".txt")),
    )
    paths = MirrorPaths("/out/", relative)
    return t.documents.select(
        "doc_id",
        paths.with_suffix("parquet").alias("swapped"),
        paths.file("summary.csv").alias("sibling"),
        paths.namespaced_file("open.parquet").alias("namespaced"),
        paths.root_file("all.parquet").alias("shared"),
    )


@query(
    "scalar_basics",
    """
    SELECT page_id, lower(url) AS low, contains(url, '.net') AS is_net,
           starts_with(url, 'https') AS is_secure, ends_with(url, '#top') AS at_top,
           coalesce(nullif(length(html) % 2, 0), -1) AS odd, sha1(url) AS key
    FROM pages
    """,
)
def _(t: Tables):
    odd = F.nullif(F.length("html") % 2, F.lit(0)).cast("bigint")
    return t.pages.select(
        "page_id",
        F.lower("url").alias("low"),
        F.contains("url", F.lit(".net")).alias("is_net"),
        F.startswith("url", F.lit("https")).alias("is_secure"),
        F.endswith("url", F.lit("#top")).alias("at_top"),
        F.coalesce(odd, F.lit(-1)).alias("odd"),
        F.sha1("url").alias("key"),
    )
