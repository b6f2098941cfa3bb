"""Run history from an event log: parsing, run and step status, summaries, tails.

Parsed events have the columns ``seq, run_id, flow_name, step_name, source_label, status,
elapsed_seconds, created_at, line``; ``step_name`` is NULL for events of the whole run.
Everything per run is an aggregation that combines before the shuffle, so a run that owns
a large share of the log is no burden for one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.paths import source_label
from millrace.functions.sortkeys import sort_keys
from millrace.operators.joins import one_row_per_key
from millrace.operators.ordered import OrderedGroups
from millrace.operators.preview import top_k
from millrace.session import materialise

# The words of a message, ``run=.. flow=.. [step=..] source=.. status=.. [elapsed=..]``,
# and the states a run or step can be in.
RUN, FLOW, STEP, SOURCE, STATUS, ELAPSED = "run=", " flow=", " step=", " source=", " status=", " elapsed="
PASSED = ["success", "finished"]
BROKEN = ["failed", "stopped"]
TERMINAL = ["success", "failed", "stopped"]
RUNNING = ["started", "stopping"]


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one moment (timestamp or ISO text) to another."""
    first, last = (F.unix_micros(moment.cast("timestamp")) for moment in (start, end))
    return (last - first) / F.lit(1e6)


def _token(name: str) -> str:
    """A whole word that has ``name`` and a value in it, as group 1.

    It begins where a word does, and whatever it takes it keeps, so a text is gone through once.
    """
    return rf"(?<!\S)(?=\S*?{name}\S)(\S++)"


def _value(word: Column, name: str) -> Column:
    """What follows the first ``name`` in a word."""
    return F.substr(word, F.locate(name, word) + len(name))


@dataclass(frozen=True)
class _Form:
    """One form of a message: whole words at its head, perhaps a step, a source and a status.

    The leftmost head of a line is the only one to look at: had a later one all that has to
    follow, the leftmost would have it too. The same goes for the first ``source=`` after it.
    So no part is looked for twice, and time grows with the length of the text.
    """

    head: tuple[str, ...]  # patterns with one group each
    step: bool

    def group(self, line: Column, i: int) -> Column:
        last = STEP if self.step else SOURCE
        return F.regexp_extract(line, "(?s)" + "".join(self.head) + last + "(.*)", i)

    def tail(self, line: Column) -> Column:
        return self.group(line, len(self.head) + 1)

    def step_name(self, line: Column) -> Column:
        return F.substr(self.tail(line), F.lit(1), self._source_at(line) - 1)

    def _source_at(self, line: Column) -> Column:
        # A step has one letter at least.
        return F.locate(SOURCE, self.tail(line), 2)

    def after(self, line: Column) -> Column:
        """From the source on; empty where there is none."""
        if not self.step:
            return self.tail(line)
        at = self._source_at(line)
        return F.when(at > 0, F.substr(self.tail(line), at + len(SOURCE))).otherwise("")

    def fits(self, line: Column) -> Column:
        return _source_length(self.after(line)) > 0

    def line(self, message: Column) -> Column:
        """The first line of a message that has this form; it stands in one line."""
        fitting = F.filter(F.split(message, "\n"), self.fits)
        return F.when(F.contains(message, F.lit("\n")), F.get(fitting, F.lit(0))).otherwise(message)


def _source_length(after: Column) -> Column:
    """Of the source that a text begins with, 0 where no status follows one."""
    return F.regexp_instr(F.substr(after, F.lit(2)), F.lit(STATUS + r"\S"))


def _either(message: Column, with_step: _Form, without: _Form, fields) -> Column:
    """``fields`` of the form that a message has, NULL where it has neither.

    ``fields`` gets the words of the head, the step, the source and the rest from the status on.
    Everything but the choice is computed whether or not it is needed, so that Spark computes
    what several parts share once.
    """
    step_line, other_line = with_step.line(message), without.line(message)
    is_step = F.coalesce(with_step.fits(step_line), F.lit(False))
    pick = lambda a, b: F.when(is_step, a).otherwise(b)
    words = [
        pick(with_step.group(step_line, i), without.group(other_line, i)) for i in range(1, len(with_step.head) + 1)
    ]
    after = pick(with_step.after(step_line), without.after(other_line))
    length = _source_length(after)
    step = F.when(is_step, with_step.step_name(step_line))
    shown = fields(words, step, F.substr(after, F.lit(1), length), F.substr(after, length + 1))
    return F.get(F.array(shown), F.when(length > 0, F.lit(0)))


_STATUS_WORD = "^" + STATUS + r"(\S++)"


def parse_event(message: Column) -> Column:
    """A struct with the event in a log message, NULL where it holds none."""

    def event(words: list[Column], step: Column, source: Column, rest: Column) -> Column:
        elapsed = F.regexp_extract(rest, _STATUS_WORD + ELAPSED + r"(\S++)", 2)
        return F.struct(
            _value(words[0], RUN).alias("run_id"),
            words[1].alias("flow_name"),
            step.alias("step_name"),
            source_label(source).alias("source_label"),
            F.regexp_extract(rest, _STATUS_WORD, 1).alias("status"),
            F.when(elapsed != "", elapsed.cast("double")).alias("elapsed_seconds"),
        )

    head = (_token(RUN), FLOW + r"(\S++)")
    return _either(message, _Form(head, True), _Form(head, False), event)


def short_line(message: Column) -> Column:
    """A log message as one compact line."""
    gap = "  "
    # Every other path in the text shrinks to its last component.
    names_only = F.regexp_replace(message, r"/(?=[^ ])[^ ]*?([^ /]*)/*(?= |\z)", "$1")

    def line(words: list[Column], step: Column, source: Column, rest: Column) -> Column:
        status = F.regexp_extract(rest, _STATUS_WORD, 1)
        return F.concat_ws(gap, _value(words[0], FLOW[1:]), step, status, source_label(source))

    head = (_token(FLOW[1:]),)
    return F.coalesce(_either(message, _Form(head, True), _Form(head, False), line), names_only)


def typed_log(
    logs: DataFrame, *, flow_name: str | None = None, run_id: str | None = None
) -> DataFrame:
    """Ledger log rows with their parsed event and compact line."""
    event = parse_event(F.col("message"))
    if run_id is not None and "run_id" in logs.columns:
        # Cheaper than the run in the message, and it reaches the scan.
        logs = logs.where(F.col("run_id") == run_id)
    typed = logs.select(
        F.col("id").alias("seq"),
        F.when(F.col("flow_name").isNotNull(), "flow").otherwise("system").alias("kind"),
        F.col("flow_name").alias("log_flow_name"),
        short_line(F.col("message")).alias("line"),
        F.col("created_at_utc").cast("timestamp").alias("created_at"),
        event.alias("event"),
    ).select("seq", "kind", "log_flow_name", "line", "created_at", "event.*")
    if flow_name is not None:
        typed = typed.where(F.col("log_flow_name") == flow_name)
    if run_id is not None:
        typed = typed.where(F.col("run_id") == run_id)
    return typed


def run_status(events: DataFrame) -> DataFrame:
    """One row per run, numbered by nothing but ``first_seq``, its first appearance.

    The last status of the run as a whole wins, but success never overrides a failure or a
    stop. A run with step events only counts as started.
    """
    whole = F.col("step_name").isNull()
    passed = F.col("status").isin(PASSED)
    state = F.struct("seq", "status", "created_at", "line")

    def last(condition: Column, value: Column) -> Column:
        return F.max_by(F.when(condition, value), F.when(condition, F.col("seq")))

    runs = (
        events.where(F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(
            F.min("seq").alias("first_seq"),
            F.min_by(F.struct("flow_name", "source_label", "created_at"), "seq").alias("first"),
            last(whole & ~passed, state).alias("other"),
            last(whole & passed, state).alias("passed"),
            last(whole, F.struct("elapsed_seconds")).alias("last"),
        )
    )
    use_passed = F.col("passed").isNotNull() & (
        F.col("other").isNull()
        | (~F.col("other.status").isin(BROKEN) & (F.col("passed.seq") > F.col("other.seq")))
    )
    summary = F.when(use_passed, F.col("passed")).otherwise(F.col("other"))
    shown_at = F.coalesce(F.col("summary.created_at"), F.col("first.created_at"))
    return runs.withColumn("summary", summary).select(
        F.col("first.flow_name").alias("flow_name"),
        "run_id",
        "first_seq",
        F.col("first.source_label").alias("source_label"),
        F.coalesce(F.col("summary.status"), F.lit("started")).alias("status"),
        F.col("last.elapsed_seconds").alias("elapsed_seconds"),
        F.col("first.created_at").alias("first_created_at"),
        F.col("summary.created_at").alias("summary_created_at"),
        F.col("summary.line").alias("summary_line"),
        F.date_format(shown_at, "yyyy-MM-dd hh:mm:ss a").alias("display_label"),
    )


def _carried_starts(groups: OrderedGroups) -> DataFrame:
    """``(__chunk, __opened, __after)``: how many starts are open where a chunk's first group goes
    on, and the fewest that are open later on in its last one.

    Each chunk is summed up by its balance and its lowest balance.
    """
    first, last = F.col("__first"), F.col("__last")
    chunks = groups.per_chunk(
        balance=F.max_by(F.when(last, F.col("__sum")), F.when(last, groups.order)),
        low=F.min(F.when(last, F.col("__low"))),
        first_low=F.min(F.when(first, F.col("__low"))),
    )
    # A window of a window is a step of its own.
    before, after = groups.so_far(), groups.so_far(backwards=True)
    chunks = chunks.withColumn("total", F.sum("balance").over(before))
    chunks = chunks.withColumn("lowest", F.min(F.col("total") - F.col("balance") + F.col("low")).over(before))
    open_after = F.col("total") - F.least(F.lit(0), F.col("lowest"))
    chunks = chunks.withColumn("opened", groups.handed_on(open_after))
    fewest = F.greatest(F.col("opened") + F.col("first_low"), F.lit(0))
    chunks = chunks.withColumn("fewest", F.min(fewest).over(after))
    return chunks.select(
        "__chunk", F.col("opened").alias("__opened"), groups.handed_on(F.col("fewest"), backwards=True).alias("__after")
    )


def step_status(events: DataFrame, *, chunks: int | None = None) -> DataFrame:
    """The step rows of every run: an end replaces the latest matching open start.

    Starts and ends of one step and source nest like brackets. With the number of open
    starts after each event (never below zero), a start was left open when that number does
    not fall below its own level later on. Ends, open starts and other rows remain;
    ``first_seq`` is their place in the run, for an end that of its start.
    """
    step = ["run_id", "flow_name", "step_name", "source_label"]
    started = F.col("status") == "started"
    terminal = F.col("status").isin(TERMINAL)
    change = F.when(started, 1).when(terminal, -1).otherwise(0).cast("bigint")
    rows = events.where(F.col("run_id").isNotNull() & F.col("step_name").isNotNull())
    groups = OrderedGroups(rows, step, sort_keys("seq"), chunks)
    so_far = groups.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups.with_column("__sum", F.sum(change).over(so_far))
    groups.with_column("__low", F.min("__sum").over(so_far))
    if groups.one_chunk:
        groups.df = groups.df.withColumns({"__opened": F.lit(0), "__after": F.lit(None).cast("bigint")})
    else:
        groups.df = groups.df.join(_carried_starts(groups), "__chunk")
        groups.with_column("__opened", F.when(F.col("__first"), F.coalesce("__opened", F.lit(0))).otherwise(0))
    groups.with_column("__open", F.col("__sum") + F.greatest(F.col("__opened"), -F.col("__low")))
    rest = groups.window(backwards=True).rowsBetween(Window.unboundedPreceding, -1)
    groups.with_column("__later", F.min("__open").over(rest))
    stays = F.col("__later").isNull() | (F.col("__later") >= F.col("__open"))
    later = F.when(F.col("__last"), F.col("__after"))
    left_open = stays & (later.isNull() | (later >= F.col("__open")))
    # An end takes the place of the start it closes: the latest one of the level above it.
    # Where nothing was open before an end, it closes nothing and has a place of its own.
    before = F.coalesce(F.lag("__open").over(groups.window()), F.col("__opened"))
    groups.with_column("__closes", terminal & (before > 0))
    groups.with_column("__level", F.when(started, F.col("__open")).otherwise(F.col("__open") + 1))
    latest = groups.window(["__level"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups.with_column("__start", F.max(F.when(started, F.col("seq"))).over(latest))
    groups.with_column("__kept", ~started | left_open)
    own = F.when(F.col("__closes"), F.col("__start")).otherwise(F.col("seq"))
    shown = [*step, "seq", "status", "elapsed_seconds", "created_at"]
    columns = [*step, "first_seq", *shown[len(step) :]]
    if groups.one_chunk:
        return groups.with_column("first_seq", own).df.where("__kept").select(columns)
    # The few ends whose start is in a chunk before, and the starts that a chunk leaves open.
    groups.with_column("__asks", F.col("__closes") & F.col("__start").isNull())
    groups.with_column("__offers", started & stays & F.col("__last"))
    flags = ["__level", "__start", "__closes", "__asks", "__offers", "__kept"]
    found = materialise(groups.df.where("__kept OR __offers").select(*shown, *flags), "steps")
    across = (
        Window.partitionBy(*step, "__level").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offered = F.max(F.when(F.col("__offers"), F.col("seq"))).over(across)
    asking = found.where("__asks OR __offers").withColumn("first_seq", offered).where("__asks")
    alone = found.where("__kept AND NOT __asks").withColumn("first_seq", own)
    return alone.select(columns).unionByName(asking.select(columns))


def run_rollup(events: DataFrame, *, chunks: int | None = None) -> dict[str, DataFrame]:
    """Event log to one row per run and one row per step."""
    return {"runs": run_status(events), "steps": step_status(events, chunks=chunks)}


def run_duration(runs: DataFrame, now: Column) -> DataFrame:
    """Add the seconds to show: so far for a run under way, else its elapsed time."""
    so_far = F.greatest(seconds_between(F.col("first_created_at"), now), F.lit(0.0))
    return runs.withColumn(
        "duration_seconds",
        F.when(F.col("status").isin(RUNNING), so_far).otherwise(F.col("elapsed_seconds")),
    )


def ledger_duration(rows: DataFrame) -> DataFrame:
    """Add finished minus started in seconds."""
    elapsed = seconds_between(F.col("started_at_utc"), F.col("finished_at_utc"))
    return rows.withColumn("elapsed_seconds", elapsed)


def run_error(entries: DataFrame, step_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Error title and text of log entries: the failed step's own, else the run's."""
    failed = (
        step_runs.where(F.col("status") == "failed")
        .groupBy(F.struct("run_id", F.col("step_label").alias("step_name")).alias("__step"))
        .agg(F.min_by(F.struct("error_text"), "id").alias("step_error"))
        .select("__step.*", "step_error")
    )
    texts = one_row_per_key(
        runs.select("run_id", F.col("error_text").alias("run_error_text")), ["run_id"]
    )
    found = F.col("step_error").isNotNull()
    return (
        entries.join(failed, ["run_id", "step_name"], "left")
        .join(texts, "run_id", "left")
        .withColumn(
            "error_title",
            F.when(found, F.concat("step_name", F.lit(" Error"))).otherwise("Run Error"),
        )
        .withColumn("error_text", F.coalesce("step_error.error_text", "run_error_text"))
        .drop("step_error", "run_error_text")
    )


def fingerprint_dedupe(entries: DataFrame) -> DataFrame:
    """The first entry of each visible identity.

    The time is part of the identity only where the entry belongs to no run.
    """
    identity = [
        "kind", "log_flow_name", "line", "run_id", "flow_name", "step_name", "source_label",
        "status", "elapsed_seconds",
    ]
    moment = F.when(F.col("run_id").isNull(), F.col("created_at"))
    first = entries.groupBy(*identity, moment.alias("__moment")).agg(
        F.min_by(F.struct("seq", "created_at"), "seq").alias("__first")
    )
    return first.select("__first.*", *identity)


def _newest(rows: DataFrame, order: str, limit: int | None) -> DataFrame:
    return rows if limit is None or limit < 0 else top_k(rows, [(order, True)], limit)


def run_summary(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """The runs of ``run_status``, the newest ``limit`` if given, with start, end, state and error, oldest first."""
    ended = F.col("status").isin(TERMINAL)
    newest = _newest(runs, "first_seq", limit)
    return newest.orderBy("first_seq").select(
        "flow_name",
        "run_id",
        F.when(~F.col("source_label").isin("", "-"), F.col("source_label")).alias("source_label"),
        F.when(ended, F.col("status")).otherwise("running").alias("state"),
        F.col("first_created_at").alias("started_at"),
        F.when(ended, F.col("summary_created_at")).alias("finished_at"),
        "elapsed_seconds",
        F.when(F.col("status") == "failed", F.col("summary_line")).alias("error_text"),
    )


def run_logs(entries: DataFrame, run_id: str, limit: int | None = None) -> DataFrame:
    """The log entries of one run, the last ``limit`` if given, with their level, oldest first."""
    mine = entries.where(F.col("run_id") == run_id)
    return _newest(mine, "seq", limit).orderBy("seq").select(
        "seq",
        "run_id",
        "flow_name",
        F.when(F.col("status") == "failed", "error").otherwise("info").alias("level"),
        "created_at",
        "line",
    )


def step_tracker(step_runs: DataFrame, operations: DataFrame | None = None) -> DataFrame:
    """The latest state of every step, and whether it is the one its flow touched last.

    ``operations`` (``flow_name``, ``step_label``) names the steps the flows have now: others
    are left out and those without a run are idle. A successful step shows as idle with its
    elapsed time.
    """
    status = F.lower(F.trim("status"))
    rows = step_runs.where(status.isin("started", *TERMINAL))
    if operations is not None:
        rows = rows.join(operations, ["flow_name", "step_label"], "left_semi")
    latest = rows.groupBy("flow_name", "step_label").agg(
        F.max("id").alias("last_id"),
        F.max_by(
            F.struct(status.alias("status"), "elapsed_ms", "started_at_utc", "finished_at_utc"),
            "id",
        ).alias("__state"),
    )
    touched = latest.groupBy("flow_name").agg(F.max("last_id").alias("__touched"))
    seconds = F.coalesce(
        F.col("__state.elapsed_ms") / F.lit(1000.0),
        seconds_between(F.col("__state.started_at_utc"), F.col("__state.finished_at_utc")),
    )
    running = F.col("__state.status") == "started"
    shown = (
        F.when(running, "running")
        .when(F.col("__state.status") == "success", "idle")
        .otherwise(F.col("__state.status"))
    )
    tracked = latest.join(touched, "flow_name").select(
        "flow_name",
        "step_label",
        shown.alias("state"),
        F.when(~running & seconds.isNotNull(), F.greatest(seconds, F.lit(0.0))).alias(
            "elapsed_seconds"
        ),
        F.when(running, F.col("__state.started_at_utc")).alias("started_at_utc"),
        (F.col("last_id") == F.col("__touched")).alias("is_current"),
    )
    if operations is None:
        return tracked
    # Steps that never ran are idle.
    listed = operations.select("flow_name", "step_label").distinct()
    return listed.join(tracked, ["flow_name", "step_label"], "left").withColumns(
        {
            "state": F.coalesce("state", F.lit("idle")),
            "is_current": F.coalesce("is_current", F.lit(False)),
        }
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """Start, end and error of the newest run of every flow."""
    newest = F.max_by(
        F.struct("run_id", "started_at_utc", "finished_at_utc", "error_text"),
        F.struct("started_at_utc", "run_id"),
    )
    return runs.groupBy("flow_name").agg(newest.alias("run")).select("flow_name", "run.*")


def ledger_summary(runs: DataFrame, logged: DataFrame | None = None) -> DataFrame:
    """Ledger runs in the shape of ``run_status``, for runs that left no log events.

    ``logged`` holds the ``run_id`` of runs known from the log; they are left out.
    """
    if logged is not None:
        runs = runs.join(logged.select("run_id"), "run_id", "left_anti")
    ended = F.col("status").isin(TERMINAL)
    status = F.when(ended, F.col("status")).otherwise("started")
    rows = ledger_duration(runs)
    created = F.coalesce("started_at_utc", "finished_at_utc").cast("timestamp")
    label = source_label(F.col("source_path"))
    told = (F.col("status") == "failed") & (F.trim("error_text") != "")
    # The compact form of the message such a run would have logged.
    line = F.concat_ws("  ", "flow_name", status, label)
    return rows.select(
        "flow_name",
        "run_id",
        label.alias("source_label"),
        status.alias("status"),
        "elapsed_seconds",
        created.alias("created_at"),
        F.when(told, F.col("error_text")).otherwise(line).alias("summary_line"),
    )


def run_groups(events: DataFrame, runs: DataFrame) -> DataFrame:
    """All runs: from the log where it knows them, from the ledger otherwise."""
    logged = run_status(events)
    known = [
        "flow_name", "run_id", "source_label", "status", "elapsed_seconds", "summary_line",
        F.coalesce("summary_created_at", "first_created_at").cast("timestamp").alias("created_at"),
    ]
    return logged.select(*known).unionByName(ledger_summary(runs, logged))


def latest_outputs(
    step_runs: DataFrame,
    operations: DataFrame | None = None,
    existing: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """The newest successful output of every step.

    ``operations`` limits the steps, ``existing`` (``path``) the outputs to files that are
    there, and ``known`` is an earlier result that newer rows are merged into.
    """
    rows = step_runs.where(
        (F.col("status") == "success") & (F.coalesce("output_path", F.lit("")) != "")
    ).select("id", "flow_name", "step_label", "output_path")
    if operations is not None:
        rows = rows.join(operations, ["flow_name", "step_label"], "left_semi")
    if existing is not None:
        paths = existing.select(F.col("path").alias("output_path"))
        rows = rows.join(paths, "output_path", "left_semi")
    if known is not None:
        rows = rows.unionByName(known.select("id", "flow_name", "step_label", "output_path"))
    return rows.groupBy("flow_name", "step_label").agg(
        F.max("id").alias("id"), F.max_by("output_path", "id").alias("output_path")
    )
