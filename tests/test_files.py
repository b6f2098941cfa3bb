import os
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from millrace.functions.paths import MirrorPaths, is_temporary_file, normalised_extensions
from millrace.plans.incremental import refresh_sources
from millrace.sources import files


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in put"
    (root / "sub" / "k=v").mkdir(parents=True)
    for name in ["b.CSV", "a.csv", "c.txt", "~$a.csv", "d.csv.part", "sub/e.csv", "sub/k=v/f.csv", "g.csv~", "no_suffix"]:
        (root / name).write_text("id\n1\n")
    return str(root)


def names(df):
    return [r.relative_path for r in df.collect()]


def test_collect_files(spark, folder, tmp_path):
    assert names(files.collect_files(spark, ["csv"], root=folder)) == ["a.csv", "b.CSV", "~$a.csv"]
    deep = names(files.collect_files(spark, (".csv",), root=folder, recursive=True))
    assert deep == ["a.csv", "b.CSV", "sub/e.csv", "sub/k=v/f.csv", "~$a.csv"]
    row = files.collect_files(spark, ".txt", root=folder).first()
    assert (row["name"], row.suffix, row.size_bytes) == ("c.txt", ".txt", 5)
    missing = files.collect_files(spark, "csv", root=str(tmp_path / "nope"))
    assert missing.columns == row.__fields__ and missing.count() == 0
    with pytest.raises(ValueError):
        normalised_extensions([" "])


def test_candidate_files(spark, folder, tmp_path):
    assert names(files.candidate_files(spark, folder, extensions="csv")) == ["a.csv", "b.CSV", "sub/e.csv", "sub/k=v/f.csv"]
    assert names(files.candidate_files(spark, folder, recursive=False)) == ["a.csv", "b.CSV", "c.txt", "no_suffix"]
    assert names(files.candidate_files(spark, f"{folder}/a.csv")) == ["a.csv"]
    with pytest.raises(ValueError):
        files.candidate_files(spark, str(tmp_path / "nope"))
    assert files.candidate_files(spark, str(tmp_path / "nope"), allow_missing=True).count() == 0


def test_temporary_names(spark):
    wanted = {"x.csv": False, "/a/.hidden": True, "~$x": True, "x~": True, "X.TMP": True, "a.b.crdownload": True,
              "x.swp": True, "._x": True, ".~lock.x#": True, "tmp": False, "a.part/x": False}
    df = spark.createDataFrame([(n,) for n in wanted], "n string")
    assert {r.n: r.t for r in df.select("n", is_temporary_file(F.col("n")).alias("t")).collect()} == wanted


def test_mirror_paths(spark):
    df = spark.createDataFrame([("a/b.c/x.tar.gz",), ("top.csv",), ("d/.env",)], "rel string")
    paths = MirrorPaths("/out", F.col("rel"))
    got = [tuple(r) for r in df.select(
        paths.with_suffix("PARQUET"), paths.namespaced_file("o.parquet"), paths.file("s.csv"), paths.root_file("r"), paths.namespace()
    ).collect()]
    assert got[0] == ("/out/a/b.c/x.tar.parquet", "/out/a/b.c/x.tar/o.parquet", "/out/a/b.c/s.csv", "/out/r", "/out/a/b.c/x.tar")
    assert got[1][:3] == ("/out/top.parquet", "/out/top/o.parquet", "/out/s.csv")
    assert got[2][0] == "/out/d/.env.parquet"
    for bad in ("/abs", " "):
        with pytest.raises(ValueError):
            paths.file(bad)


def test_reading_many_with_provenance(spark, tmp_path):
    root = str(tmp_path / "many")
    spark.range(3).write.parquet(f"{root}/x/one")
    spark.range(2).withColumn("extra", F.lit("e")).write.parquet(f"{root}/y/two")
    stacked = files.read_many(spark, [f"{root}/x/one", f"{root}/y/two"])
    assert stacked.count() == 5 and stacked.where("extra = 'e'").count() == 2
    assert files.scan_dataset(spark, root, stacked.schema).count() == 5
    meta = files.source_metadata(files.scan_dataset(spark, root, stacked.schema))
    assert meta.where("size_bytes > 0 AND modified_at IS NOT NULL").count() == meta.count() >= 2
    with pytest.raises(ValueError):
        files.read_many(spark, [])


def test_sheets(spark):
    frames = {"one": spark.createDataFrame([(1, "x")], "k int, v string"), "two": spark.createDataFrame([("y",)], "k string")}
    assert [tuple(r) for r in files.read_sheets(frames).collect()] == [("one", 1, "x")]
    both = files.read_sheets(frames, ["two", "one"])
    assert sorted(tuple(r[c] for c in ("sheet", "k", "v")) for r in both.collect()) == [("one", "1", "x"), ("two", "y", None)]
    with pytest.raises(ValueError):
        files.read_sheets(frames, ["three"])


def signatures(spark, *rows):
    return spark.createDataFrame(list(rows), "source_path string, mtime_ns bigint, size_bytes bigint")


def test_stale_and_missing(spark):
    ledger = spark.createDataFrame(
        [("f", "same", 1, 1, "success"), ("f", "failed", 1, 1, "failed"), ("f", "grown", 1, 1, "success"),
         ("f", "gone", 1, 1, "success"), ("g", "gone", 1, 1, "success"), ("g", "new", 1, 1, "success")],
        "flow_name string, source_path string, mtime_ns bigint, size_bytes bigint, last_status string",
    )
    now = signatures(spark, ("same", 1, 1), ("failed", 1, 1), ("grown", 1, 2), ("new", 1, 1))
    assert [r.source_path for r in files.stale_batch(now, ledger, "f").collect()] == ["grown", "new"]
    kept = files.prune_missing(ledger, now, "f")
    assert sorted((r.flow_name, r.source_path) for r in kept.collect()) == [
        ("f", "failed"), ("f", "grown"), ("f", "same"), ("g", "gone"), ("g", "new")
    ]


def watch_model(polls, settle):
    """One poll after another: count unchanged polls, report what settled with a new signature."""
    known, calm, told, found = dict(polls[0]), dict.fromkeys(polls[0], 0), dict(polls[0]), set()
    for number, listing in enumerate(polls[1:], 1):
        calm = {p: calm.get(p, 0) + 1 if known.get(p) == s else 0 for p, s in listing.items()}
        told = {p: s for p, s in told.items() if p in listing}
        for path, signature in listing.items():
            if told.get(path) != signature and calm[path] >= settle:
                told[path] = signature
                found.add((path, number, *signature))
        known = listing
    return found


@pytest.mark.parametrize("settle, chunk", [(0, None), (1, None), (2, None), (1, 15)])
def test_settled_files_against_a_watch_loop(spark, settle, chunk):
    pick = random.Random(settle)
    polls = [
        {f"p{i}": (pick.choice([1, 1, 1, 2]), 7) for i in range(12) if pick.random() < 0.85} for _ in range(25)
    ]
    rows = [(path, n, *sig) for n, listing in enumerate(polls) for path, sig in listing.items()]
    df = spark.createDataFrame(rows, "path string, poll_no bigint, mtime_ns bigint, size_bytes bigint")
    got = files.settled_files(df, settle, chunks=chunk).collect()
    assert sorted(map(tuple, got)) == sorted(watch_model(polls, settle))
    with pytest.raises(ValueError):
        files.settled_files(df, -1)


@pytest.mark.parametrize("settle", [0, 2])
def test_watching_poll_by_poll_against_a_watch_loop(spark, settle):
    pick = random.Random(settle)
    polls = [{f"p{i}": (pick.choice([1, 1, 2]), 7) for i in range(8) if pick.random() < 0.85} for _ in range(8)]

    def listing(number):
        rows = [(path, *signature) for path, signature in polls[number].items()]
        return spark.createDataFrame(rows, "path string, mtime_ns bigint, size_bytes bigint")

    state, found = files.start_watch(listing(0)), set()
    for number in range(1, len(polls)):
        state = files.watch_step(state, listing(number), settle)
        rows = state.collect()
        found |= {(r.path, number, r.mtime_ns, r.size_bytes) for r in rows if r.settled}
        state = spark.createDataFrame(rows, state.schema)
    assert found == watch_model(polls, settle)


def test_refreshing_changed_files_only(spark, warehouse, folder):
    reads = []

    def read(paths):
        reads.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        return spark.read.schema("id bigint").csv(paths, header=True)

    def refresh():
        refresh_sources(warehouse, folder, "fact", flow_name="f", read=read, extensions="csv",
                        transform=lambda rows: rows.withColumn("twice", F.col("id") * 2))
        return sorted((r.id, r.twice) for r in warehouse.frame("fact").collect())

    assert refresh() == [(1, 2)] * 4
    with open(os.path.join(folder, "a.csv"), "a") as out:
        out.write("5\n")
    assert refresh() == [(1, 2)] * 4 + [(5, 10)]
    with open(os.path.join(folder, "a.csv"), "w") as out:
        out.write("id\n")
    assert refresh() == [(1, 2)] * 3
    os.remove(os.path.join(folder, "b.CSV"))
    assert refresh() == [(1, 2)] * 3
    assert reads == [["a.csv", "b.CSV", "e.csv", "f.csv"], ["a.csv"], ["a.csv"]]
    states = warehouse.frame("ledger.file_state").collect()
    assert sorted(r.source_path.rsplit("/", 1)[1] for r in states) == ["a.csv", "e.csv", "f.csv"]


def test_a_file_that_cannot_be_read_is_recorded_and_the_others_are_done(spark, warehouse, folder):
    def read(paths):
        return spark.read.schema("id bigint").csv(paths, header=True)

    def shape(rows):
        bad = F.col("_metadata.file_name") == "e.csv"
        return rows.withColumn("id", F.when(bad, F.raise_error(F.lit("broken file"))).otherwise(F.col("id")))

    refresh_sources(warehouse, folder, "fact", flow_name="f", read=read, extensions="csv", transform=shape)
    states = {r.source_path.rsplit("/", 1)[1]: r for r in warehouse.frame("ledger.file_state").collect()}
    assert {n: r.last_status for n, r in states.items()} == {
        "a.csv": "success", "b.CSV": "success", "e.csv": "failed", "f.csv": "success"
    }
    assert "broken file" in states["e.csv"].last_error_text
    assert warehouse.frame("fact").count() == 3


def test_an_unreadable_file_costs_one_more_job_and_only_itself(spark, warehouse, tmp_path):
    folder, reads = tmp_path / "many files", []
    spark.range(60).repartition(12).write.parquet(str(folder))
    (folder / "broken + 1.parquet").write_bytes(b"no parquet file, but long enough to look like one")

    def read(paths):
        reads.append(len(paths))
        return spark.read.schema("id bigint").parquet(*paths)

    refresh_sources(warehouse, str(folder), "fact", flow_name="f", read=read, extensions="parquet")
    assert reads == [13, 12]
    states = {r.source_path.rsplit("/", 1)[1]: r for r in warehouse.frame("ledger.file_state").collect()}
    assert [n for n, r in states.items() if r.last_status == "failed"] == ["broken + 1.parquet"]
    assert "not a Parquet file" in states["broken + 1.parquet"].last_error_text
    assert warehouse.frame("fact").count() == 60


def test_several_files_that_an_author_function_fails_on(spark, warehouse, folder):
    written = []
    real = warehouse.replace_files

    def replace(*args, **options):
        written.append(1)
        return real(*args, **options)

    warehouse.replace_files = replace

    def read(paths):
        return spark.read.schema("id bigint").csv(paths, header=True)

    def shape(rows):
        bad = F.col("_metadata.file_name").isin("e.csv", "a.csv")
        return rows.withColumn("id", F.when(bad, F.raise_error(F.lit("broken file"))).otherwise(F.col("id")))

    refresh_sources(warehouse, folder, "fact", flow_name="f", read=read, extensions="csv", transform=shape)
    states = warehouse.frame("ledger.file_state").collect()
    assert sorted(r.source_path.rsplit("/", 1)[1] for r in states if r.last_status == "failed") == ["a.csv", "e.csv"]
    assert warehouse.frame("fact").count() == 2 and len(written) == 2


def test_a_failure_that_is_no_file_s_is_raised(spark, warehouse, folder):
    def replace(*args, **options):
        raise Py4JJavaError("written", spark._jvm.java.io.IOException("No space left on device"))

    warehouse.replace_files = replace
    with pytest.raises(Py4JJavaError):
        refresh_sources(warehouse, folder, "fact", flow_name="f", extensions="csv",
                        read=lambda paths: spark.read.schema("id bigint").csv(paths, header=True))
    assert not warehouse.exists("ledger.file_state")


def test_queue(spark):
    jobs = spark.createDataFrame(
        [(1, "f", "a", None, None, None), (2, "f", None, "x", 1, 1), (3, "f", "a", None, None, None),
         (4, "f", None, "x", 2, 2), (5, "f", None, "y", 1, 1), (6, "g", None, None, None, None)],
        "position bigint, flow_name string, source_path string, batch_path string, mtime_ns bigint, size_bytes bigint",
    )
    got = sorted(tuple(r) for r in files.dedupe_queue(jobs).collect() if r.batch_path is None)
    assert got == [(1, "f", "a", 0, None, None, None), (6, "g", None, 0, None, None, None)]
    batch = sorted(tuple(r)[4:] for r in files.dedupe_queue(jobs).where("batch_path IS NOT NULL").collect())
    assert batch == [("x", 2, 2), ("y", 1, 1)]


def test_a_changed_file_is_seen_through_the_manifest(spark, folder):
    def listing():
        found = files.candidate_files(spark, folder, extensions="csv")
        return found.select(
            F.col("path").alias("source_path"), (F.unix_micros("modified_at") * 1000).alias("mtime_ns"), "size_bytes"
        )

    ledger = spark.createDataFrame(listing().collect()).withColumn("flow_name", F.lit("f"))
    assert files.stale_sources(listing(), ledger, "f").count() == 0
    with open(os.path.join(folder, "a.csv"), "a") as out:
        out.write("2\n")
    assert [r.source_path.rsplit("/", 1)[1] for r in files.stale_sources(listing(), ledger, "f").collect()] == ["a.csv"]
