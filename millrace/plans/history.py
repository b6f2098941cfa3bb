"""Queries for increments, run history and event-log analytics.

The ledger tables and the event log are derived from the given tables: runs and steps from
orders, logs and events from events, file states from customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import event_log, ledger
from millrace.plans.incremental import STATE_TABLE, refresh_sources
from millrace.plans.registry import Tables, query
from millrace.sources import files
from millrace.sources.tables import Warehouse
from millrace.streaming import log_cursor

# -- derived inputs ----------------------------------------------------------------------


def text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else text(p) for p in parts])


def iso(moment: Column) -> Column:
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


STATUS_SQL = "['started', 'started', 'success', 'failed', 'stopped', 'finished']"
EVENT_LOG = f"""
    event_log AS (
        SELECT event_id AS seq, 'run-' || user_id AS run_id, 'flow-' || (user_id % 7) AS flow_name,
               CASE WHEN event_type IN ('signup', 'purchase') THEN NULL ELSE event_type END AS step_name,
               'file ' || (event_id % 3) || '.csv' AS source_label,
               ({STATUS_SQL})[((event_id * 7 + user_id) // 3 % 6 + 1)::INTEGER] AS status,
               CASE WHEN event_type = 'view' THEN NULL ELSE value END AS elapsed_seconds,
               ts AS created_at
        FROM events
    ),
    event_lines AS (
        SELECT *, 'run=' || run_id || ' flow=' || flow_name
               || coalesce(' step=' || step_name, '')
               || ' source=/data/in put/' || source_label || ' status=' || status
               || coalesce(' elapsed=' || elapsed_seconds::DECIMAL(18, 2)::VARCHAR, '') AS message,
               flow_name || coalesce('  ' || step_name, '') || '  ' || status || '  ' || source_label
                   AS line
        FROM event_log
    )
"""


def events_log(t: Tables) -> DataFrame:
    """Parsed events: users as runs, event types as steps."""
    states = F.array(*[F.lit(s) for s in
                       ("started", "started", "success", "failed", "stopped", "finished")])
    place = F.floor((F.col("event_id") * 7 + F.col("user_id")) / 3) % 6
    kind = F.col("event_type")
    rows = t.events.select(
        F.col("event_id").alias("seq"),
        joined("run-", F.col("user_id")).alias("run_id"),
        joined("flow-", F.col("user_id") % 7).alias("flow_name"),
        F.when(~kind.isin("signup", "purchase"), kind).alias("step_name"),
        joined("file ", F.col("event_id") % 3, ".csv").alias("source_label"),
        F.get(states, place.cast("int")).alias("status"),
        F.when(kind != "view", F.col("value")).alias("elapsed_seconds"),
        F.col("ts").alias("created_at"),
    )
    shown = F.concat_ws("  ", "flow_name", "step_name", "status", "source_label")
    return rows.withColumn("line", shown)


def event_messages(t: Tables) -> DataFrame:
    """The log text the events would have been parsed from."""
    step = F.coalesce(joined(" step=", F.col("step_name")), F.lit(""))
    took = F.coalesce(joined(" elapsed=", F.col("elapsed_seconds").cast("decimal(18,2)")), F.lit(""))
    message = F.concat(
        F.lit("run="), "run_id", F.lit(" flow="), "flow_name", step,
        F.lit(" source=/data/in put/"), "source_label", F.lit(" status="), "status", took,
    )
    return events_log(t).withColumn("message", message)


RUNS = """
    runs AS (
        SELECT 'r' || o_custkey || '-' || o_orderkey AS run_id, o_orderpriority AS flow_name,
               'g' || (o_custkey % 10) AS group_name,
               CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE '/in/' || o_custkey || '.csv' END AS source_path,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'started' END AS status,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started_at_utc,
               CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate
                    + INTERVAL 1 SECOND * (o_custkey % 9 * 86400 + o_orderkey % 1000),
                    '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS finished_at_utc,
               CASE WHEN o_orderstatus = 'P' AND o_custkey % 4 <> 0 THEN 'error ' || o_custkey END AS error_text
        FROM orders
    ),
    step_runs AS (
        SELECT o_orderkey AS id, 'r' || o_custkey || '-' || (o_orderkey - o_orderkey % 2) AS run_id,
               o_orderpriority AS flow_name, 'step ' || (o_orderkey % 4) AS step_label,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'started' END AS status,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started_at_utc,
               CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate
                    + INTERVAL 1 SECOND * (o_orderkey % 5000 - 100),
                    '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS finished_at_utc,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey * 7 END AS elapsed_ms,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 <> 0 THEN 'step error ' || o_orderkey END
                   AS error_text,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/out/' || o_orderkey || '.parquet' END AS output_path
        FROM orders
    )
"""
LOGS = """
    logs AS (
        SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN NULL ELSE 'run-' || user_id END AS run_id,
               CASE WHEN event_type = 'signup' THEN NULL ELSE 'flow-' || (user_id % 7) END AS flow_name,
               event_type AS step_label, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
               props AS message, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at_utc
        FROM events
    )
"""
STATES = """
    file_state AS (
        SELECT 'flow-' || c_mktsegment AS flow_name, '/in/' || c_custkey || '.csv' AS source_path,
               c_custkey * 1000 AS mtime_ns, c_nationkey::BIGINT AS size_bytes,
               CASE WHEN c_custkey % 5 <> 0 THEN 'r' || c_custkey || '-' || (c_custkey * 3) END
                   AS last_success_run_id,
               CASE WHEN c_custkey % 5 <> 0 THEN '2020-01-01T00:00:00+00:00' END AS last_success_at_utc,
               CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'success' END AS last_status,
               CASE WHEN c_custkey % 3 = 0 THEN 'bad file' END AS last_error_text
        FROM customer
    )
"""
LEDGER = ",\n".join([RUNS, LOGS, STATES])


def run_rows(t: Tables) -> DataFrame:
    key, buyer, state = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    ended = F.col("o_orderdate") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (buyer % 9 * 86400 + key % 1000).cast("decimal(18,6)")
    )
    return t.orders.select(
        joined("r", buyer, "-", key).alias("run_id"),
        F.col("o_orderpriority").alias("flow_name"),
        joined("g", buyer % 10).alias("group_name"),
        F.when(buyer % 13 != 0, joined("/in/", buyer, ".csv")).alias("source_path"),
        _status(state).alias("status"),
        iso(F.col("o_orderdate")).alias("started_at_utc"),
        F.when(state != "O", iso(ended)).alias("finished_at_utc"),
        F.when((state == "P") & (buyer % 4 != 0), joined("error ", buyer)).alias("error_text"),
    )


def _status(state: Column) -> Column:
    return F.when(state == "F", "success").when(state == "P", "failed").otherwise("started")


def step_rows(t: Tables) -> DataFrame:
    key, buyer, state = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    ended = F.col("o_orderdate") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (key % 5000 - 100).cast("decimal(18,6)")
    )
    return t.orders.select(
        key.alias("id"),
        joined("r", buyer, "-", key - key % 2).alias("run_id"),
        F.col("o_orderpriority").alias("flow_name"),
        joined("step ", key % 4).alias("step_label"),
        _status(state).alias("status"),
        iso(F.col("o_orderdate")).alias("started_at_utc"),
        F.when(state != "O", iso(ended)).alias("finished_at_utc"),
        F.when(key % 5 != 0, key * 7).alias("elapsed_ms"),
        F.when((state == "P") & (key % 3 != 0), joined("step error ", key)).alias("error_text"),
        F.when(key % 3 == 0, "").otherwise(joined("/out/", key, ".parquet")).alias("output_path"),
    )


def log_rows(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("id"),
        F.when(kind != "signup", joined("run-", F.col("user_id"))).alias("run_id"),
        F.when(kind != "signup", joined("flow-", F.col("user_id") % 7)).alias("flow_name"),
        kind.alias("step_label"),
        F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("props").alias("message"),
        iso(F.col("ts")).alias("created_at_utc"),
    )


def state_rows(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    fine, failed = key % 5 != 0, key % 3 == 0
    return t.customer.select(
        joined("flow-", F.col("c_mktsegment")).alias("flow_name"),
        joined("/in/", key, ".csv").alias("source_path"),
        (key * 1000).alias("mtime_ns"),
        F.col("c_nationkey").cast("bigint").alias("size_bytes"),
        F.when(fine, joined("r", key, "-", key * 3)).alias("last_success_run_id"),
        F.when(fine, "2020-01-01T00:00:00+00:00").alias("last_success_at_utc"),
        F.when(failed, "failed").otherwise("success").alias("last_status"),
        F.when(failed, "bad file").alias("last_error_text"),
    )


def ledger_tables(t: Tables) -> ledger.Tables:
    return {
        "runs": run_rows(t), "step_runs": step_rows(t),
        "logs": log_rows(t), "file_state": state_rows(t),
    }


#: What tells the rows of a table apart, and what an operator may change in them.
TELLING = {
    "runs": ["run_id", "status"],
    "step_runs": ["id", "run_id", "step_label"],
    "logs": ["id", "message"],
    "file_state": ["last_success_run_id"],
}


def counted(tables: ledger.Tables) -> DataFrame:
    """Row count per table, a digest of its rows, and how many file states point to a run."""

    def digest(name: str) -> Column:
        line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in TELLING[name]])
        return F.sum(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")).alias("digest")

    parts = [
        frame.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), digest(name),
            (F.count("last_success_run_id") if name == "file_state" else F.lit(0).cast("bigint"))
            .alias("pointers"),
        )
        for name, frame in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def counted_sql(**names: str) -> str:
    def line(name: str) -> str:
        return "concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '-')" for c in TELLING[name]) + ")"

    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, "
        f"sum(('0x' || substr(md5({line(name)}), 1, 8))::BIGINT)::BIGINT AS digest, "
        + ("count(last_success_run_id)" if name == "file_state" else "0::BIGINT")
        + f" AS pointers FROM {source}"
        for name, source in names.items()
    )


# -- change detection --------------------------------------------------------------------

LISTING = """
    listing AS (
        SELECT '/in/' || c_custkey || '.csv' AS source_path,
               c_custkey * 1000 + CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS mtime_ns,
               CASE WHEN c_nationkey = 4 THEN 99 ELSE c_nationkey END::BIGINT AS size_bytes,
               c_nationkey
        FROM customer WHERE c_nationkey <> 5
    ),
    seen AS (
        SELECT 'flow' AS flow_name, source_path, mtime_ns, size_bytes, last_status FROM file_state
        WHERE size_bytes <> 7
    )
"""


def listing(t: Tables) -> DataFrame:
    """What a directory listing shows now: some files changed, some are gone."""
    nation = F.col("c_nationkey")
    return t.customer.where(nation != 5).select(
        joined("/in/", F.col("c_custkey"), ".csv").alias("source_path"),
        (F.col("c_custkey") * 1000 + F.when(nation == 3, 1).otherwise(0)).alias("mtime_ns"),
        F.when(nation == 4, 99).otherwise(nation).cast("bigint").alias("size_bytes"),
    )


def seen(t: Tables) -> DataFrame:
    """The ledger of one flow; the files of one nation were never seen."""
    return state_rows(t).where("size_bytes <> 7").withColumn("flow_name", F.lit("flow"))


@query(
    "stale_sources",
    f"""
    WITH {STATES}, {LISTING}
    SELECT source_path, mtime_ns, size_bytes FROM listing l
    WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.source_path = l.source_path
                      AND s.mtime_ns = l.mtime_ns AND s.size_bytes = l.size_bytes)
    """,
)
def _(t: Tables):
    return files.stale_sources(listing(t), seen(t), "flow")


@query(
    "stale_batch",
    f"""
    WITH {STATES}, {LISTING}
    SELECT source_path, mtime_ns, size_bytes FROM listing
    EXCEPT SELECT source_path, mtime_ns, size_bytes FROM seen ORDER BY source_path
    """,
)
def _(t: Tables):
    return files.stale_batch(listing(t), seen(t), "flow")


@query(
    "prune_missing",
    f"""
    WITH {STATES}, {LISTING}
    SELECT flow_name, source_path, last_status FROM seen
    WHERE source_path IN (SELECT source_path FROM listing)
    """,
)
def _(t: Tables):
    kept = files.prune_missing(seen(t), listing(t), "flow")
    return kept.select("flow_name", "source_path", "last_status")


@query(
    "except_keys",
    f"""
    WITH {STATES}, {LISTING}
    SELECT flow_name, source_path FROM seen
    WHERE source_path NOT IN (SELECT source_path FROM listing)
    """,
)
def _(t: Tables):
    return files.missing_paths(seen(t), listing(t), "flow")


@query(
    "settled_files",
    """
    WITH polls AS (
        SELECT '/in/' || user_id AS path, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS poll_no,
               max(event_id) // 7 % 2 AS mtime_ns, user_id AS size_bytes
        FROM events GROUP BY ALL
    ),
    marked AS (
        SELECT *, lag(poll_no) OVER w IS DISTINCT FROM poll_no - 1 AS gap,
               lag(mtime_ns) OVER w IS DISTINCT FROM mtime_ns AS changed
        FROM polls WINDOW w AS (PARTITION BY path ORDER BY poll_no)
    ),
    numbered AS (
        SELECT *, sum(gap::INT) OVER w AS visit, sum((gap OR changed)::INT) OVER w AS run
        FROM marked WINDOW w AS (PARTITION BY path ORDER BY poll_no)
    ),
    runs AS (
        SELECT path, visit, run, mtime_ns, size_bytes, min(poll_no) AS first_poll, count(*) AS polls
        FROM numbered GROUP BY ALL
    ),
    ready AS (
        SELECT *, lag(mtime_ns) OVER (PARTITION BY path, visit ORDER BY run) AS last_mtime
        FROM runs WHERE first_poll = 0 OR polls > 1
    )
    SELECT path, (first_poll + 1)::BIGINT AS poll_no, mtime_ns, size_bytes FROM ready
    WHERE first_poll <> 0 AND last_mtime IS DISTINCT FROM mtime_ns
    """,
)
def _(t: Tables):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    polls = t.events.groupBy(
        joined("/in/", F.col("user_id")).alias("path"), day.alias("poll_no"),
        F.col("user_id").alias("size_bytes"),
    ).agg((F.floor(F.max("event_id") / 7) % 2).alias("mtime_ns"))
    return files.settled_files(polls, settle=1)


@query(
    "watch_step",
    f"""
    WITH {STATES}, {LISTING},
    state AS (
        SELECT '/in/' || c_custkey || '.csv' AS path, c_custkey * 1000 AS mtime_ns, c_nationkey::BIGINT AS size_bytes,
               (c_custkey % 3)::BIGINT AS stable_polls,
               CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 1000 END AS told_mtime_ns,
               CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::BIGINT END AS told_size_bytes
        FROM customer WHERE c_nationkey <> 6
    ),
    counted AS (
        SELECT l.source_path AS path, l.mtime_ns, l.size_bytes,
               CASE WHEN s.mtime_ns = l.mtime_ns AND s.size_bytes = l.size_bytes
                    THEN s.stable_polls + 1 ELSE 0 END AS stable_polls, s.told_mtime_ns, s.told_size_bytes
        FROM listing l LEFT JOIN state s ON s.path = l.source_path
    ),
    marked AS (
        SELECT *, stable_polls >= 2 AND (told_mtime_ns IS DISTINCT FROM mtime_ns
                  OR told_size_bytes IS DISTINCT FROM size_bytes) AS settled FROM counted
    )
    SELECT path, mtime_ns, size_bytes, stable_polls,
           CASE WHEN settled THEN mtime_ns ELSE told_mtime_ns END AS told_mtime_ns,
           CASE WHEN settled THEN size_bytes ELSE told_size_bytes END AS told_size_bytes, settled
    FROM marked
    """,
)
def _(t: Tables):
    key, size = F.col("c_custkey"), F.col("c_nationkey").cast("bigint")
    told = key % 2 == 0
    state = t.customer.where("c_nationkey <> 6").select(
        joined("/in/", key, ".csv").alias("path"), (key * 1000).alias("mtime_ns"),
        size.alias("size_bytes"), (key % 3).alias("stable_polls"),
        F.when(told, key * 1000).alias("told_mtime_ns"), F.when(told, size).alias("told_size_bytes"),
    )
    return files.watch_step(state, listing(t).withColumnRenamed("source_path", "path"), settle=2)


@query(
    "refresh_sources",
    """
    SELECT doc_id, lang, n_chars, (SELECT count(DISTINCT lang || '/' || source) FROM documents)::BIGINT AS known_files,
           (SELECT count(DISTINCT lang || '/' || source) FROM documents WHERE lang <> 'en')::BIGINT AS second_files
    FROM documents
    """,
)
def _(t: Tables):
    """Two refreshes of a folder; the second one finds only the files added since."""
    store, root = Warehouse(t.spark, t.scratch("warehouse")), t.scratch("source-files")
    rows = t.documents.select("doc_id", "n_chars", "lang", "source").withColumn("language", F.col("lang"))
    # One file per language and source.
    whole = rows.repartition("language", "source")

    def read(paths):
        return t.spark.read.schema("doc_id bigint, n_chars bigint, lang string").parquet(*paths)

    for batch in (whole.where("lang = 'en'"), whole.where("lang <> 'en'")):
        batch.write.mode("append").partitionBy("language", "source").parquet(root)
        done = refresh_sources(store, root, "fact", flow_name="documents", read=read)
    known = store.frame(STATE_TABLE).agg(F.count(F.lit(1))).scalar()
    second = done.agg(F.count(F.lit(1))).scalar()
    return store.frame("fact").select(
        "doc_id", "lang", "n_chars", known.alias("known_files"), second.alias("second_files")
    )


@query(
    "upsert_file_state",
    f"""
    WITH {STATES},
    changes AS (
        SELECT o_orderkey AS seq, 'flow-' || c_mktsegment AS flow_name,
               '/in/' || (c_custkey + CASE WHEN c_nationkey = 2 THEN 1000000 ELSE 0 END) || '.csv' AS source_path,
               o_orderkey AS mtime_ns, o_custkey AS size_bytes,
               CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'failed' END AS status,
               'u' || o_orderkey AS run_id, 'at ' || o_orderkey AS finished_at_utc,
               CASE WHEN o_orderstatus <> 'F' THEN 'failed ' || o_orderkey END AS error_text
        FROM orders JOIN customer ON c_custkey = o_custkey
    ),
    newest AS (SELECT * FROM changes QUALIFY row_number() OVER (
        PARTITION BY flow_name, source_path ORDER BY seq DESC) = 1),
    ok AS (SELECT * FROM changes WHERE status = 'success' QUALIFY row_number() OVER (
        PARTITION BY flow_name, source_path ORDER BY seq DESC) = 1)
    SELECT coalesce(f.flow_name, n.flow_name) AS flow_name,
           coalesce(f.source_path, n.source_path) AS source_path,
           coalesce(n.mtime_ns, f.mtime_ns) AS mtime_ns,
           coalesce(n.size_bytes, f.size_bytes) AS size_bytes,
           coalesce(ok.run_id, f.last_success_run_id) AS last_success_run_id,
           coalesce(ok.finished_at_utc, f.last_success_at_utc) AS last_success_at_utc,
           CASE WHEN n.seq IS NULL THEN f.last_status ELSE n.status END AS last_status,
           CASE WHEN n.seq IS NULL THEN f.last_error_text ELSE n.error_text END AS last_error_text
    FROM file_state f FULL JOIN newest n ON n.flow_name = f.flow_name AND n.source_path = f.source_path
    LEFT JOIN ok ON ok.flow_name = n.flow_name AND ok.source_path = n.source_path
    """,
)
def _(t: Tables):
    buyers = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    path_key = F.col("o_custkey") + F.when(F.col("c_nationkey") == 2, 1000000).otherwise(0)
    passed = F.col("o_orderstatus") == "F"
    key = F.col("o_orderkey")
    changes = t.orders.join(buyers, "o_custkey").select(
        key.alias("seq"),
        joined("flow-", F.col("c_mktsegment")).alias("flow_name"),
        joined("/in/", path_key, ".csv").alias("source_path"),
        key.alias("mtime_ns"),
        F.col("o_custkey").alias("size_bytes"),
        F.when(passed, "success").otherwise("failed").alias("status"),
        joined("u", key).alias("run_id"),
        joined("at ", key).alias("finished_at_utc"),
        F.when(~passed, joined("failed ", key)).alias("error_text"),
    )
    return ledger.upsert_file_state(state_rows(t), changes)


@query(
    "dedupe_queue",
    """
    WITH jobs AS (
        SELECT event_id AS position, 'flow-' || (user_id % 7) AS flow_name,
               CASE WHEN event_type = 'signup' THEN NULL ELSE '/in/' || user_id END AS source_path,
               CASE WHEN event_type = 'signup' AND event_id % 5 <> 0 THEN '/b/' || (event_id % 50) END AS batch_path,
               CASE WHEN event_type = 'signup' AND event_id % 5 <> 0 THEN event_id END AS mtime_ns,
               CASE WHEN event_type = 'signup' AND event_id % 5 <> 0 THEN user_id END AS size_bytes
        FROM events
    ),
    first AS (
        SELECT flow_name, source_path, min(position) AS position,
               count(DISTINCT batch_path) AS signatures
        FROM jobs GROUP BY ALL
    ),
    newest AS (
        SELECT * FROM jobs WHERE batch_path IS NOT NULL QUALIFY row_number() OVER (
            PARTITION BY flow_name, source_path, batch_path ORDER BY position DESC) = 1
    )
    SELECT f.position, f.flow_name, f.source_path, f.signatures, n.batch_path, n.mtime_ns, n.size_bytes
    FROM first f LEFT JOIN newest n
      ON n.flow_name = f.flow_name AND n.source_path IS NOT DISTINCT FROM f.source_path
    """,
)
def _(t: Tables):
    batch = F.col("event_type") == "signup"
    signed = batch & (F.col("event_id") % 5 != 0)
    jobs = t.events.select(
        F.col("event_id").alias("position"),
        joined("flow-", F.col("user_id") % 7).alias("flow_name"),
        F.when(~batch, joined("/in/", F.col("user_id"))).alias("source_path"),
        F.when(signed, joined("/b/", F.col("event_id") % 50)).alias("batch_path"),
        F.when(signed, F.col("event_id")).alias("mtime_ns"),
        F.when(signed, F.col("user_id")).alias("size_bytes"),
    )
    return files.dedupe_queue(jobs)


@query("log_cursor", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id > 499")
def _(t: Tables):
    """Two polls of an append-only log; the second finds nothing new."""
    target, checkpoint = t.scratch("log-copy"), t.scratch("log-cursor")
    for _ in range(2):
        stream = log_cursor.follow_log(
            t.spark, t.folder, t.events.schema, pattern="events.parquet", after_id=499,
            id_column="event_id",
        ).select("event_id", "user_id", "event_type", "value")
        log_cursor.drain(stream, target, checkpoint)
    return t.spark.read.schema(stream.schema).parquet(target)


# -- ledger upkeep -----------------------------------------------------------------------

CUTOFF = "1998-06-01T00:00:00.000000+00:00"


@query(
    "prune_history",
    f"""
    WITH {LEDGER},
    removed AS (SELECT run_id FROM runs WHERE coalesce(finished_at_utc, started_at_utc) < '{CUTOFF}'),
    kept_runs AS (SELECT * FROM runs WHERE run_id NOT IN (SELECT run_id FROM removed)),
    kept_steps AS (SELECT * FROM step_runs WHERE run_id NOT IN (SELECT run_id FROM removed)),
    kept_logs AS (SELECT * FROM logs WHERE run_id IS NULL OR run_id NOT IN (SELECT run_id FROM removed)),
    kept_states AS (
        SELECT CASE WHEN last_success_run_id NOT IN (SELECT run_id FROM removed)
                    THEN last_success_run_id END AS last_success_run_id FROM file_state
    )
    {counted_sql(runs='kept_runs', step_runs='kept_steps', logs='kept_logs', file_state='kept_states')}
    """,
)
def _(t: Tables):
    return counted(ledger.prune_history(ledger_tables(t), CUTOFF))


@query(
    "cascade_delete",
    f"""
    WITH {RUNS}
    SELECT id, run_id, step_label FROM step_runs
    WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'failed')
    """,
)
def _(t: Tables):
    removed = run_rows(t).where("status = 'failed'")
    kept = ledger.cascade_delete(step_rows(t), removed)
    return kept.select("id", "run_id", "step_label")


@query(
    "reconcile_orphans",
    f"""
    WITH {RUNS}
    SELECT run_id, CASE WHEN status = 'started' THEN 'stopped' ELSE status END AS status,
           CASE WHEN status = 'started' THEN 'now' ELSE finished_at_utc END AS finished_at_utc,
           CASE WHEN status = 'started' THEN coalesce(error_text, 'orphaned') ELSE error_text END AS error_text,
           (SELECT count(*) FROM runs WHERE status = 'started') AS run_orphans,
           (SELECT count(*) FROM step_runs WHERE status = 'started') AS step_orphans
    FROM runs
    """,
)
def _(t: Tables):
    runs = ledger.reconcile_orphans(
        run_rows(t), status="stopped", finished_at_utc="now", error_text="orphaned"
    )
    counts = ledger.orphan_counts({"runs": run_rows(t), "step_runs": step_rows(t)})
    found = {
        name: counts.where(F.col("table_name") == table).agg(F.max("orphans")).scalar()
        for table, name in (("runs", "run_orphans"), ("step_runs", "step_orphans"))
    }
    return runs.select("run_id", "status", "finished_at_utc", "error_text").withColumns(found)


@query(
    "reset_flow",
    f"""
    WITH {LEDGER},
    removed AS (SELECT run_id FROM runs WHERE flow_name = '2-HIGH'),
    kept_runs AS (SELECT * FROM runs WHERE flow_name <> '2-HIGH'),
    kept_steps AS (SELECT * FROM step_runs WHERE flow_name <> '2-HIGH'
                   AND run_id NOT IN (SELECT run_id FROM removed))
    {counted_sql(runs='kept_runs', step_runs='kept_steps', logs='logs', file_state='file_state')}
    """,
)
def _(t: Tables):
    return counted(ledger.reset_flow(ledger_tables(t), "2-HIGH"))


@query(
    "checkpoint_tables",
    f"WITH {LEDGER} {counted_sql(runs='runs', step_runs='step_runs', logs='logs', file_state='file_state')}",
)
def _(t: Tables):
    store = Warehouse(t.spark, t.scratch("ledger"))
    ledger.checkpoint_tables(store, ledger_tables(t))
    return counted(ledger.restore_tables(store))


@query(
    "generation_check",
    """
    WITH marks AS (
        SELECT 'orders' AS name, CASE WHEN o_orderkey >= 0 THEN 'a' END AS g FROM orders
        UNION ALL SELECT 'customer', CASE WHEN c_nationkey = 3 THEN NULL ELSE 'a' END FROM customer
        UNION ALL SELECT 'supplier', 'b' FROM supplier
        UNION ALL SELECT 'part', p_brand FROM part
    ),
    per_table AS (SELECT name, min(g) AS g FROM marks GROUP BY name HAVING count(DISTINCT g) = 1)
    SELECT count(DISTINCT g) AS generations, count(DISTINCT g) <= 1 AS is_consistent FROM per_table
    """,
)
def _(t: Tables):
    mark = ledger.GENERATION
    return ledger.generation_check(
        {
            "orders": t.orders.select(F.when(F.col("o_orderkey") >= 0, "a").alias(mark)),
            "customer": t.customer.select(F.when(F.col("c_nationkey") != 3, "a").alias(mark)),
            "supplier": t.supplier.select(F.lit("b").alias(mark)),
            "part": t.part.select(F.col("p_brand").alias(mark)),
        }
    )


@query(
    "log_tail",
    f"WITH {LOGS} SELECT * FROM logs WHERE flow_name = 'flow-3' AND id > 100 ORDER BY id DESC LIMIT 500",
)
def _(t: Tables):
    return ledger.log_tail(log_rows(t), flow_name="flow-3", after_id=100, limit=500)


@query(
    "history_list",
    f"""
    WITH {RUNS}
    SELECT 'all' AS list, run_id, started_at_utc FROM runs WHERE flow_name = '1-URGENT'
    UNION ALL SELECT 'active', run_id, started_at_utc FROM runs WHERE status = 'started'
    UNION ALL SELECT 'steps', run_id, started_at_utc FROM step_runs WHERE id > 20
    """,
)
def _(t: Tables):
    lists = {
        "all": ledger.history_list(run_rows(t), flow_name="1-URGENT"),
        "active": ledger.active_runs(run_rows(t)),
        "steps": ledger.step_list(step_rows(t), after_id=20),
    }
    result = None
    for name, rows in lists.items():
        part = rows.select(F.lit(name).alias("list"), "run_id", "started_at_utc")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "latest_outputs",
    f"""
    WITH {RUNS}
    SELECT flow_name, step_label, id, output_path FROM step_runs
    WHERE status = 'success' AND output_path <> ''
    QUALIFY row_number() OVER (PARTITION BY flow_name, step_label ORDER BY id DESC) = 1
    """,
)
def _(t: Tables):
    rows = step_rows(t)
    # An older result merged with the rows after its cursor gives the whole result.
    known = event_log.latest_outputs(rows.where("id <= 700"))
    return event_log.latest_outputs(rows.where("id > 700"), known=known)


# -- event log ---------------------------------------------------------------------------

RUN_STATUS = f"""
    {EVENT_LOG},
    flow_events AS (
        SELECT *, status IN ('success', 'finished') AS passed FROM event_lines WHERE step_name IS NULL
    ),
    other AS (SELECT * FROM flow_events WHERE NOT passed
              QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1),
    good AS (SELECT * FROM flow_events WHERE passed
             QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1),
    last AS (SELECT * FROM flow_events
             QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1),
    first AS (SELECT * FROM event_lines
              QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) = 1),
    run_states AS (
        SELECT f.flow_name, f.run_id, f.seq AS first_seq, f.source_label, f.created_at AS first_created_at,
               last.elapsed_seconds,
               CASE WHEN o.seq IS NULL OR (o.status NOT IN ('failed', 'stopped') AND g.seq > o.seq)
                    THEN g.status ELSE o.status END AS summary_status,
               CASE WHEN o.seq IS NULL OR (o.status NOT IN ('failed', 'stopped') AND g.seq > o.seq)
                    THEN g.created_at ELSE o.created_at END AS summary_created_at,
               CASE WHEN o.seq IS NULL OR (o.status NOT IN ('failed', 'stopped') AND g.seq > o.seq)
                    THEN g.line ELSE o.line END AS summary_line
        FROM first f LEFT JOIN other o USING (run_id) LEFT JOIN good g USING (run_id)
        LEFT JOIN last USING (run_id)
    ),
    run_status AS (
        SELECT *, coalesce(summary_status, 'started') AS status FROM run_states
    )
"""


@query(
    "parse_event",
    f"""
    WITH {EVENT_LOG}
    SELECT seq, CASE WHEN step_name = 'error' THEN NULL ELSE run_id END AS run_id,
           CASE WHEN step_name = 'error' THEN NULL ELSE flow_name END AS flow_name,
           CASE WHEN step_name = 'error' THEN NULL ELSE step_name END AS step_name,
           CASE WHEN step_name = 'error' THEN NULL ELSE source_label END AS source_label,
           CASE WHEN step_name = 'error' THEN NULL ELSE status END AS status,
           CASE WHEN step_name = 'error' THEN NULL
                ELSE elapsed_seconds::DECIMAL(18, 2)::DOUBLE END AS elapsed_seconds,
           CASE WHEN step_name = 'error' THEN 'moved ' || source_label || ' to out after ' || seq
                ELSE line END AS line
    FROM event_lines
    """,
)
def _(t: Tables):
    broken = F.col("step_name").eqNullSafe(F.lit("error"))
    moved = F.concat(
        F.lit("moved /data/in/"), "source_label", F.lit(" to /data/out/ after "), text("seq")
    )
    message = F.when(broken, moved).otherwise(F.col("message"))
    rows = event_messages(t).select("seq", message.alias("message"))
    return rows.select(
        "seq", event_log.parse_event(F.col("message")).alias("e"),
        event_log.short_line(F.col("message")).alias("line"),
    ).select("seq", "e.*", "line")


@query(
    "typed_log",
    f"""
    WITH {EVENT_LOG}
    SELECT seq, CASE WHEN step_name = 'view' THEN 'system' ELSE 'flow' END AS kind, line, run_id,
           step_name, source_label, status, created_at::TIMESTAMP AS created_at
    FROM event_lines WHERE step_name IS DISTINCT FROM 'view' AND flow_name = 'flow-2'
    """,
)
def _(t: Tables):
    named = F.when(~F.col("step_name").eqNullSafe(F.lit("view")), F.col("flow_name"))
    logs = event_messages(t).select(
        F.col("seq").alias("id"), named.alias("flow_name"), "message",
        iso(F.col("created_at")).alias("created_at_utc"),
    )
    typed = event_log.typed_log(logs, flow_name="flow-2")
    return typed.select(
        "seq", "kind", "line", "run_id", "step_name", "source_label", "status",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query(
    "run_status",
    f"""
    WITH {RUN_STATUS}
    SELECT flow_name, run_id, first_seq, source_label, status, elapsed_seconds, first_created_at,
           summary_created_at, summary_line,
           strftime(coalesce(summary_created_at, first_created_at), '%Y-%m-%d %I:%M:%S %p') AS display_label
    FROM run_status
    """,
)
def _(t: Tables):
    return event_log.run_status(events_log(t))


STEP_STATUS = f"""
    {EVENT_LOG},
    moves AS (
        SELECT *, CASE WHEN status = 'started' THEN 1
                       WHEN status IN ('success', 'failed', 'stopped') THEN -1 ELSE 0 END AS change
        FROM event_log WHERE step_name IS NOT NULL
    ),
    sums AS (
        SELECT *, sum(change) OVER (PARTITION BY run_id, flow_name, step_name, source_label
                                    ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM moves
    ),
    depths AS (
        SELECT *, coalesce(lag(depth) OVER (PARTITION BY run_id, flow_name, step_name, source_label ORDER BY seq), 0)
                  AS depth_before
        FROM (SELECT *, s - least(0, min(s) OVER (PARTITION BY run_id, flow_name, step_name, source_label
                                                  ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS depth FROM sums)
    ),
    step_status AS (
        SELECT d.* FROM depths d
        WHERE d.status <> 'started' OR NOT EXISTS (
            SELECT 1 FROM depths l
            WHERE l.run_id = d.run_id AND l.flow_name = d.flow_name AND l.step_name = d.step_name
              AND l.source_label = d.source_label AND l.seq > d.seq AND l.depth < d.depth)
    )
"""


@query(
    "step_status",
    f"""
    WITH {STEP_STATUS}
    SELECT run_id, flow_name, step_name, source_label,
           CASE WHEN change = -1 AND depth_before > 0 THEN (
               SELECT max(o.seq) FROM depths o
               WHERE o.run_id = s.run_id AND o.flow_name = s.flow_name AND o.step_name = s.step_name
                 AND o.source_label = s.source_label AND o.seq < s.seq AND o.status = 'started'
                 AND o.depth = s.depth + 1) ELSE seq END AS first_seq,
           seq, status, elapsed_seconds, created_at
    FROM step_status s
    """,
)
def _(t: Tables):
    return event_log.step_status(events_log(t))


@query(
    "run_rollup",
    f"""
    WITH {RUN_STATUS}, {STEP_STATUS.replace(EVENT_LOG, '').strip().lstrip(',')}
    SELECT r.run_id, r.status, count(s.seq) AS step_rows,
           count(CASE WHEN s.status = 'started' THEN 1 END) AS open_steps
    FROM run_status r LEFT JOIN step_status s ON s.run_id = r.run_id
    GROUP BY r.run_id, r.status
    """,
)
def _(t: Tables):
    rolled = event_log.run_rollup(events_log(t))
    steps = rolled["steps"].groupBy("run_id").agg(
        F.count(F.lit(1)).alias("step_rows"), F.count_if(F.col("status") == "started").alias("open_steps")
    )
    return rolled["runs"].join(steps, "run_id", "left").select(
        "run_id", "status", F.coalesce("step_rows", F.lit(0)).alias("step_rows"),
        F.coalesce("open_steps", F.lit(0)).alias("open_steps"),
    )


@query(
    "run_duration",
    f"""
    WITH {RUN_STATUS}
    SELECT run_id, CASE WHEN status IN ('started', 'stopping')
             THEN (epoch_us(TIMESTAMP '2024-02-01 00:00:00.25') - epoch_us(first_created_at))::DOUBLE / 1e6
             ELSE elapsed_seconds END AS duration_seconds
    FROM run_status
    """,
)
def _(t: Tables):
    now = F.lit("2024-02-01 00:00:00.25").cast("timestamp_ntz")
    shown = event_log.run_duration(event_log.run_status(events_log(t)), now)
    return shown.select("run_id", "duration_seconds")


@query(
    "ledger_duration",
    f"""
    WITH {RUNS}
    SELECT run_id, (epoch_us(left(finished_at_utc, 26)::TIMESTAMP) - epoch_us(left(started_at_utc, 26)::TIMESTAMP))::DOUBLE / 1e6
           AS elapsed_seconds
    FROM runs
    """,
)
def _(t: Tables):
    return event_log.ledger_duration(run_rows(t)).select("run_id", "elapsed_seconds")


@query(
    "run_error",
    f"""
    WITH {RUNS},
    entries AS (
        SELECT o_orderkey AS seq, 'r' || o_custkey || '-' || (o_orderkey - o_orderkey % 2) AS run_id,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'step ' || (o_orderkey % 4) END AS step_name
        FROM orders
    ),
    failed AS (SELECT * FROM step_runs WHERE status = 'failed' QUALIFY row_number() OVER (
        PARTITION BY run_id, step_label ORDER BY id) = 1)
    SELECT e.seq, e.run_id, e.step_name,
           CASE WHEN f.id IS NOT NULL THEN e.step_name || ' Error' ELSE 'Run Error' END AS error_title,
           coalesce(f.error_text, r.error_text) AS error_text
    FROM entries e LEFT JOIN failed f ON f.run_id = e.run_id AND f.step_label = e.step_name
    LEFT JOIN runs r ON r.run_id = e.run_id
    """,
)
def _(t: Tables):
    key = F.col("o_orderkey")
    entries = t.orders.select(
        key.alias("seq"),
        joined("r", F.col("o_custkey"), "-", key - key % 2).alias("run_id"),
        F.when(key % 7 != 0, joined("step ", key % 4)).alias("step_name"),
    )
    return event_log.run_error(entries, step_rows(t), run_rows(t))


@query(
    "fingerprint_dedupe",
    f"""
    WITH {EVENT_LOG},
    entries AS (
        SELECT seq, 'flow' AS kind, flow_name AS log_flow_name, flow_name || ' ' || status AS line,
               CASE WHEN step_name = 'error' THEN NULL ELSE run_id END AS run_id, flow_name, step_name,
               source_label, status, (seq % 2)::DOUBLE AS elapsed_seconds,
               date_trunc('day', created_at) AS created_at
        FROM event_log
    )
    SELECT * FROM entries QUALIFY row_number() OVER (
        PARTITION BY kind, log_flow_name, line, run_id, flow_name, step_name, source_label, status,
            elapsed_seconds, CASE WHEN run_id IS NULL THEN created_at END ORDER BY seq) = 1
    """,
)
def _(t: Tables):
    entries = events_log(t).select(
        "seq", F.lit("flow").alias("kind"), F.col("flow_name").alias("log_flow_name"),
        F.concat_ws(" ", "flow_name", "status").alias("line"),
        F.when(~F.col("step_name").eqNullSafe(F.lit("error")), F.col("run_id")).alias("run_id"),
        "flow_name", "step_name", "source_label", "status",
        (F.col("seq") % 2).cast("double").alias("elapsed_seconds"),
        F.col("created_at").cast("date").cast("timestamp_ntz").alias("created_at"),
    )
    return event_log.fingerprint_dedupe(entries)


@query(
    "run_summary",
    f"""
    WITH {RUN_STATUS}
    SELECT flow_name, run_id, source_label,
           CASE WHEN status IN ('success', 'failed', 'stopped') THEN status ELSE 'running' END AS state,
           first_created_at AS started_at,
           CASE WHEN status IN ('success', 'failed', 'stopped') THEN summary_created_at END AS finished_at,
           elapsed_seconds, CASE WHEN status = 'failed' THEN summary_line END AS error_text
    FROM run_status ORDER BY first_seq DESC LIMIT 50
    """,
)
def _(t: Tables):
    return event_log.run_summary(event_log.run_status(events_log(t)), limit=50)


@query(
    "run_logs",
    f"""
    WITH {EVENT_LOG}
    SELECT seq, run_id, flow_name, CASE WHEN status = 'failed' THEN 'error' ELSE 'info' END AS level,
           created_at, line
    FROM event_lines WHERE run_id = 'run-8' ORDER BY seq DESC LIMIT 500
    """,
)
def _(t: Tables):
    return event_log.run_logs(events_log(t), "run-8", limit=500)


@query(
    "step_tracker",
    f"""
    WITH {RUNS},
    latest AS (SELECT * FROM step_runs QUALIFY row_number() OVER (
        PARTITION BY flow_name, step_label ORDER BY id DESC) = 1)
    SELECT flow_name, step_label,
           CASE status WHEN 'started' THEN 'running' WHEN 'success' THEN 'idle' ELSE status END AS state,
           CASE WHEN status <> 'started' THEN greatest(0.0::DOUBLE, coalesce(elapsed_ms::DOUBLE / 1000,
               (epoch_us(left(finished_at_utc, 26)::TIMESTAMP) - epoch_us(left(started_at_utc, 26)::TIMESTAMP))::DOUBLE / 1e6))
               END AS elapsed_seconds,
           CASE WHEN status = 'started' THEN started_at_utc END AS started_at_utc,
           id = max(id) OVER (PARTITION BY flow_name) AS is_current
    FROM latest
    """,
)
def _(t: Tables):
    return event_log.step_tracker(step_rows(t))


@query(
    "latest_run",
    f"""
    WITH {RUNS}
    SELECT flow_name, run_id, started_at_utc, finished_at_utc, error_text FROM runs
    QUALIFY row_number() OVER (PARTITION BY flow_name ORDER BY started_at_utc DESC, run_id DESC) = 1
    """,
)
def _(t: Tables):
    return event_log.latest_run(run_rows(t))


@query(
    "ledger_summary",
    f"""
    WITH {RUNS}, logged AS (SELECT DISTINCT run_id FROM step_runs),
    shown AS (
        SELECT *, CASE WHEN status IN ('success', 'failed', 'stopped') THEN status ELSE 'started' END AS state,
               coalesce(o.custkey || '.csv', '-') AS label
        FROM runs LEFT JOIN (
            SELECT 'r' || o_custkey || '-' || o_orderkey AS run_id, o_custkey AS custkey FROM orders
            WHERE o_custkey % 13 <> 0) o USING (run_id)
        WHERE run_id NOT IN (SELECT run_id FROM logged)
    )
    SELECT flow_name, run_id, label AS source_label, state AS status,
           (epoch_us(left(finished_at_utc, 26)::TIMESTAMP) - epoch_us(left(started_at_utc, 26)::TIMESTAMP))::DOUBLE / 1e6
               AS elapsed_seconds,
           CASE WHEN state = 'failed' AND trim(error_text) <> '' THEN error_text
                ELSE flow_name || '  ' || state || '  ' || label END AS summary_line
    FROM shown
    """,
)
def _(t: Tables):
    rows = event_log.ledger_summary(run_rows(t), step_rows(t))
    return rows.drop("created_at")


@query(
    "run_groups",
    f"""
    WITH {RUN_STATUS},
    ledger AS (
        SELECT 'run-' || (o_custkey % 400) AS run_id, max('flow-' || (o_custkey % 5)) AS flow_name,
               max('/in/' || o_custkey || '.csv') AS source_path,
               CASE WHEN count(*) % 2 = 0 THEN 'success' ELSE 'odd' END AS status
        FROM orders GROUP BY 1
    )
    SELECT flow_name, run_id, source_label, status, elapsed_seconds, summary_line FROM run_status
    UNION ALL
    SELECT flow_name, run_id, source_path[5:], CASE status WHEN 'success' THEN status ELSE 'started' END, NULL,
           flow_name || '  ' || CASE status WHEN 'success' THEN status ELSE 'started' END || '  ' || source_path[5:]
    FROM ledger WHERE run_id NOT IN (SELECT run_id FROM run_status)
    """,
)
def _(t: Tables):
    even = F.count(F.lit(1)) % 2 == 0
    buyer = F.col("o_custkey")
    runs = t.orders.groupBy(joined("run-", buyer % 400).alias("run_id")).agg(
        F.max(joined("flow-", buyer % 5)).alias("flow_name"),
        F.max(joined("/in/", buyer, ".csv")).alias("source_path"),
        F.when(even, "success").otherwise("odd").alias("status"),
        F.lit("2024-01-01T00:00:00+00:00").alias("started_at_utc"),
        F.lit(None).cast("string").alias("finished_at_utc"),
        F.lit(None).cast("string").alias("error_text"),
    )
    return event_log.run_groups(events_log(t), runs).drop("created_at")
