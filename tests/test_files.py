"""Real folders and archives on disk, limits, traversal, artifacts, batches."""

import io
import json
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from logyield.plans import artifact, ingest, parse, parse_lines
from logyield.sources import archives, batches, folders, paths
from logyield.streaming import jobs

LOG = "[2025-11-28 09:01:15 INF] scan file content:\nSERIALNUMBER={sn}\nPRODUCTCODE=K/1\n\n[2025-11-28 09:01:20 INF] done file content:\n{done}"
BAD = "Result=FAIL\nErrorcode=E7\nErrorMsg=Voltage fault\n"


def zipped(**members):
    return zipped_items(members.items())


def zipped_items(items):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as zf:
        for name, data in items:
            zf.writestr(name, data)
    return buffer.getvalue()


def put(root, name, data):
    target = root / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture(scope="module")
def batch(tmp_path_factory):
    root = tmp_path_factory.mktemp("batch")
    put(root, "STC_1/ftrunnerlog01.txt", LOG.format(sn="SN1", done="Result=PASS\n").encode() + b"\xff\xfe")
    put(root, "STC_1/pass.zip", zipped_items([("debuglog.txt", "not read")]))
    put(root, "day/run2/MY_FTRunner.TXT", LOG.format(sn="SN2", done=BAD))
    nested = zipped_items([("inner.zip", zipped_items([("Seq/DebugLog.txt", "TOKEN=abc E7 at 10.0.0.1")]))])
    put(root, "day/run2/trace.zip", nested)
    put(root, "day/run2/a_broken.zip", b"zip?")
    put(root, "day/run3/randomfile.bin", b"\0")
    put(root, "day/run4/debuglog.txt", "x")
    put(root, "day/run5/NoLotId.zip", zipped_items([("Sequencer 1/DebugLog.txt", "x")]))
    put(root, "day/run6/only_nested.zip", nested)
    put(root, "_tool_extracted/some.bin", b"\0")
    return str(root)


def test_ingest_folder(spark, batch):
    runs, steps, warnings = ingest.ingest_folder(spark, batch)
    assert "steps" not in runs.columns and steps.count() == 0
    rows = {r.serial_number: r for r in runs.collect()}
    assert set(rows) == {"SN1", "SN2"}
    assert (rows["SN1"].result, rows["SN1"].has_debuglog, rows["SN1"].run_folder, rows["SN1"].lot_id) == ("PASS", False, "STC_1", "STC")
    assert rows["SN2"].has_debuglog and rows["SN2"].debug_excerpt == "TOKEN=[REDACTED] E7 at [REDACTED_IP]"
    assert {r.run_folder for r in warnings.collect()} == {"day/run3", "day/run6"}
    # Only folders of exactly the given names are skipped.
    fewer = ingest.ingest_folder(spark, batch, skip=("run3", "run", "day/run6")).warnings
    assert {r.run_folder for r in fewer.collect()} == {"day/run6"}


def test_large_logs_are_read_in_splits(spark, tmp_path):
    """The same folder parsed as whole texts and as lines of many small splits."""
    stamp = "[2025-11-28 09:{:02d}:{:02d} INF] "
    for n in range(3):
        body = "".join(
            f"{stamp.format(i % 60, n)}***Step{i} test start.***\n{'noise ' * 20}\n"
            f"{'Test failed.' if i == 30 + n else 'TEST PASSED' if i % 2 else 'value'}\n"
            + (f"***Step{i} test end.***\nTest time(hh\\mm\\ss): 00:00:{i:02d}\n" if i % 3 else "")
            for i in range(60)
        )
        head = f"{stamp.format(0, 0)}scan file content:\n\nSERIALNUMBER=SN{n}\nPRODUCTCODE=K\nPRODUCTCODE=K{n}\n\ntestmode: APSE\r\n"
        tail = f"{stamp.format(59, 59)}done file content:\nResult=FAIL\nErrorcode=E{n}\n" if n else ""
        put(tmp_path, f"day/run{n}/ftrunnerlog01.txt", head + body + tail)
    put(tmp_path, "day/run0/ftrunnerlog00.txt", "small\n")
    root, old = str(tmp_path), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        chosen = folders.first_logs(folders.list_files(spark, root).filter("size >= 1000"))
        lines = parse_lines.read_log_lines(spark, root, at_least=1000)
        assert lines.select("block").distinct().count() > 5
        runs, steps = parse_lines.parse_lines(lines, chosen)
        got_steps = {(r.unit_id, r.step_no): (r.name, r.result, r.duration_s) for r in steps.collect()}
        got = {r.run_folder: r for r in runs.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    logs = folders.read_logs(spark, root).filter("file_name = 'ftrunnerlog01.txt'")
    whole = parse.parse_logs(logs)
    want_steps = {(r.unit_id, r.step_no): (r.name, r.result, r.duration_s) for r in parse.steps_table(whole).collect()}
    want = {r.run_folder: r for r in whole.collect()}
    assert got_steps == want_steps and len(want_steps) == 180
    assert set(got) == set(want)
    for folder, row in want.items():
        for column in whole.columns:
            if column != "steps":
                assert got[folder][column] == row[column], (folder, column)
    # Together: the first log by name wins, whichever way it was read.
    merged = ingest.ingest_folder(spark, root, row_bytes=1000).runs
    assert {r.run_folder: r.source_files for r in merged.collect()} == {
        "day/run0": ["ftrunnerlog00.txt"], "day/run1": ["ftrunnerlog01.txt"], "day/run2": ["ftrunnerlog01.txt"],
    }


def test_one_result_for_every_size_and_name(spark, tmp_path):
    """Blanks, per cents and umlauts in names; each log read whole, as lines, or by its size."""
    for n, folder in enumerate(["day 1/run a", "day%201/50% done", "tag/größe+1", "plain"]):
        steps = "".join(f"***Step{i} test start.***\nTEST PASSED\n***Step{i} test end.***\n" for i in range(n * 40 + 1))
        put(tmp_path, f"{folder}/ftrunnerlog 0{n}%41.txt", steps + LOG.format(sn=f"SN{n}", done=BAD))
        put(tmp_path, f"{folder}/trace 1.zip", zipped_items([("debuglog.txt", f"E7 of {n}")]))
    found = []
    for row_bytes in (1, 3000, 1 << 30):
        batch = ingest.ingest_folder(spark, str(tmp_path), row_bytes=row_bytes)
        runs = {r.run_folder: r.asDict() for r in batch.runs.collect()}
        found.append((runs, sorted(map(tuple, batch.steps.collect())), batch.warnings.collect()))
    assert found[0] == found[1] == found[2]
    runs, steps, warnings = found[0]
    assert set(runs) == {"day 1/run a", "day%201/50% done", "tag/größe+1", "plain"} and not warnings
    assert all(r["has_debuglog"] and r["debug_excerpt"].startswith("E7 of") for r in runs.values())
    assert len(steps) == sum(n * 40 + 1 for n in range(4))


def test_relative_root(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    put(tmp_path, "data/data/run/ftrunnerlog01.txt", LOG.format(sn="S", done=BAD))
    base = f"file:{tmp_path}/data"
    assert folders.qualified(spark, base + "/") == base
    assert [r.run_folder for r in folders.list_files(spark, base).collect()] == ["data/run"]


def test_only_bad_bytes_are_left_out(spark):
    rows = [(b"a\xef\xbf\xbdb", "a\ufffdb"), (b"a\xef\xbf\xbd\xffb\xfe", "a\ufffdb"), (b"\xff", ""), (None, "")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "content binary")
    assert [r[0] for r in df.select(folders.decoded(F.col("content"))).collect()] == [b for _, b in rows]


def test_read_errors_are_no_bad_archives(spark, tmp_path):
    put(tmp_path, "bad.zip", b"PK nonsense")
    put(tmp_path, "cut.zip", zipped_items([("a.txt", "x" * 1000)])[:-30])
    ok = spark.createDataFrame([("b", f"file:{tmp_path}/bad.zip"), ("c", f"file:{tmp_path}/cut.zip")], "archive string, path string")
    assert {r.error for r in archives.list_members(ok).collect()} == {archives.BAD_ZIP}
    gone = spark.createDataFrame([("g", f"file:{tmp_path}/gone.zip")], "archive string, path string")
    strange = spark.createDataFrame([("s", "nosuchscheme://x/y.zip")], "archive string, path string")
    for df in (gone, strange):
        for job in (archives.list_members, archives.expand, lambda d: archives.find_debug_logs(d.withColumn("run_folder", F.lit("r")))):
            with pytest.raises(Exception, match="Error|Invalid"):
                job(df).collect()


def test_archives_by_path(spark, tmp_path):
    put(tmp_path, "good 1%.zip", zipped_items([("a/b.txt", "hello"), ("debuglog.txt", "log")]))
    damaged = bytearray(zipped_items([("a.txt", "first"), ("b.txt", "y" * 500)]))
    damaged[-400] ^= 0xFF
    put(tmp_path, "damaged.zip", bytes(damaged))
    files = folders.list_files(spark, str(tmp_path)).select(F.col("file_name").alias("archive"), "path", "run_folder")
    rows = archives.expand(files).collect()
    assert {(r.archive, r.target, r.error) for r in rows} == {
        ("good 1%.zip", "a/b.txt", None), ("good 1%.zip", "debuglog.txt", None), ("damaged.zip", None, archives.BAD_ZIP),
    }
    assert [(r.archive, r.text) for r in archives.find_debug_logs(files).collect()] == [("good 1%.zip", "log")]


def test_listing_without_content(spark, batch):
    plan = folders.list_files(spark, batch)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_stream_from_files(spark, batch, tmp_path):
    query = jobs.ingest_runs(jobs.log_stream(spark, batch, max_files=1), f"{tmp_path}/runs", f"{tmp_path}/cp")
    query.awaitTermination()
    assert {r.serial_number for r in jobs.ingested_runs(spark, f"{tmp_path}/runs").collect()} == {"SN1", "SN2"}


def test_stream_gives_one_result_for_every_size(spark, tmp_path):
    """Small and large logs, together in a batch or not, with and without steps; two large ones in a folder."""
    root = tmp_path / "logs"
    for n, folder in enumerate(["STC_none", "day [1]/run {a,b}", "day%201/50% done", "größe *"]):
        steps = "".join(f"***Step{i} test start.***\nTEST PASSED\n***Step{i} test end.***\n" for i in range(n * 12))
        put(root, f"{folder}/ftrunnerlog 0{n}%41.txt", steps + LOG.format(sn=f"SN{n}", done=BAD))
    put(root, "größe */ftrunnerlog 99.txt", LOG.format(sn="later by name", done=BAD) * 9)
    put(root, "day%201/50% done/ftrunnerlog 00.txt", LOG.format(sn="SN2", done=BAD))  # first by name, arriving before or after
    found = []
    for n, (row_bytes, max_files) in enumerate([(1 << 30, 10), (1, 10), (900, 10), (900, 1)]):
        logs = jobs.log_stream(spark, str(root), max_files, row_bytes)
        jobs.ingest_runs(logs, f"{tmp_path}/runs{n}", f"{tmp_path}/cp{n}").awaitTermination()
        runs = jobs.ingested_runs(spark, f"{tmp_path}/runs{n}").drop("micro_batch").collect()
        steps = jobs.ingested_steps(spark, f"{tmp_path}/runs{n}").collect()
        assert len({r.run_folder for r in runs}) == len(runs) == 4
        found.append(({r.run_folder: r.asDict() for r in runs}, sorted(map(tuple, steps))))
    assert found[0] == found[1] == found[2] == found[3]
    assert len(found[0][1]) == 12 + 36
    assert {r["serial_number"] for r in found[0][0].values()} == {f"SN{n}" for n in range(4)}


def test_tables_of_a_repeating_job_are_removed(spark, tmp_path):
    from logyield import session

    df = spark.range(3).toDF("n")
    outer = session.stored(df, "outer")
    with session.temporary_tables(spark):
        inner = session.stored(df, "inner")
        assert inner.count() == 3
    assert outer.count() == 3 and not os.path.exists(inner.stored_path.removeprefix("file:"))


def archive_rows(spark, items):
    return spark.createDataFrame(items, "archive string, content binary")


def test_expand_limits_and_traversal(spark):
    good = zipped_items([("a/b.txt", "hello"), ("c.txt", "x" * 50)])
    df = archive_rows(spark, [
        ("good", good), ("bad", b"nope"), ("up", zipped_items([("../e.txt", "x")])), ("drive", zipped_items([("C:/e.txt", "x")])),
        ("back", zipped_items([("a\\..\\..\\e.txt", "x")])), ("empty", zipped_items([])),
    ])
    rows = archives.expand(df).collect()
    assert {(r.archive, r.target, bytes(r.content or b"")) for r in rows if r.error is None} == {
        ("good", "a/b.txt", b"hello"), ("good", "c.txt", b"x" * 50),
    }
    assert {r.archive for r in rows if r.error} == {"bad", "up", "drive", "back"}
    for limit, reason in (({"max_files": 1}, "too many files"), ({"max_member": 20}, "member too large"),
                          ({"max_total": 52}, "too large after extraction")):
        rows = archives.expand(archive_rows(spark, [("good", good)]), **limit).collect()
        assert [r.error for r in rows] == [reason]


def test_debug_log_depth_and_order(spark):
    def wrap(data, times):
        for i in range(times):
            data = zipped_items([(f"n{i}.zip", data)])
        return data

    leaf = zipped_items([("x/debuglog.txt", "leaf")])
    rows = [
        ("d1", "a.zip", leaf), ("d3", "a.zip", wrap(leaf, 2)), ("d4", "a.zip", wrap(leaf, 3)),
        ("order", "a.zip", zipped_items([("n.zip", leaf), ("my_DebugLog.TXT", "direct")])),
        ("slip", "a.zip", zipped_items([("../debuglog.txt", "out"), ("n.zip", leaf)])),
        ("bad_inner", "a.zip", zipped_items([("n.zip", b"broken"), ("m.zip", leaf)])),
    ]
    df = spark.createDataFrame(rows, "run_folder string, archive string, content binary")
    got = {r.run_folder: r.text for r in archives.find_debug_logs(df).collect()}
    assert got == {"d1": "leaf", "d3": "leaf", "order": "direct", "slip": "leaf", "bad_inner": "leaf"}


def test_paths(spark):
    cases = {"a/b.txt": None, "\\x\\y": None, "/z": None, "../e": "parent folder", "..\\e": "parent folder",
             "C:/W": "colon", "": "empty", "a/": "trailing slash", "./.": "empty", None: "empty", "a//./b": None}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.reason for r in paths.checked(df).collect()} == cases
    assert {r.target for r in paths.split_valid(df)[0].collect()} == {"a/b.txt", "x/y", "z", "a/b"}


def test_single_archive_needs_no_folder(spark):
    files = spark.createDataFrame(
        [("one", 0, "My logs.zip"), ("one", 1, "d/x.zip"), ("two", 0, "a.zip"), ("two", 3, "b b.ZIP"), ("two", 4, ".zip")],
        "batch_id string, seq bigint, path string",
    )
    got = {(r.batch_id, r.seq): r.folder for r in paths.root_archives(files).collect()}
    assert got == {("one", 0): "", ("two", 0): "zip_0_a", ("two", 3): "zip_3_b_b", ("two", 4): "zip_4_.zip"}


def test_manifest_numbers_across_slices(spark, monkeypatch):
    monkeypatch.setattr(paths, "SLICE_ROWS", 7)
    files = spark.range(100).select(
        F.lit("b").alias("batch_id"), F.col("id").alias("seq"), F.concat(F.lit("f"), F.col("id"), F.lit(".txt")).alias("name"),
        F.lit(None).cast("string").alias("rel_path"), F.col("id").alias("size"), F.lit(0).alias("mtime"),
    )
    got = [r.upload_path for r in paths.select_files(files).orderBy("seq").collect()]
    assert got == [f"run_{i}/f{i}.txt" for i in range(100)]


def runs_frame(spark):
    rows = [
        ("u1", "SN1", "FAIL", "K/1", "host=a limit", [("Thermal", "FAIL", 2.0)]),
        ("u2", "SN2", "PASS", "K/1", None, []),
        ("u3", "SN3", "PASS", None, None, []),
    ]
    df = spark.createDataFrame(
        rows, "unit_id string, serial_number string, result string, product_code string, error_message string,"
        " steps array<struct<name:string,result:string,duration_s:double>>",
    )
    nulls = ["lot_id", "op_id", "station_id", "host", "error_code", "failing_step", "ftrunner_snippet", "debug_excerpt"]
    return df.withColumns(
        {**{c: F.lit(None).cast("string") for c in nulls}, "run_folder": F.col("unit_id"), "duration_s": F.lit(0.0),
         "start_time": F.lit("2026-01-01 10:00:00").cast("timestamp_ntz"), "end_time": F.lit(None).cast("timestamp_ntz")}
    )


def test_unit_json(spark):
    rows = artifact.unit_rows(runs_frame(spark)).select("product", artifact.unit_json().alias("doc")).collect()
    docs = {(r.product, json.loads(r.doc)["serial_number"]): json.loads(r.doc) for r in rows}
    assert docs[("K/1", "SN1")] == {
        "unit_id": "u1", "serial_number": "SN1", "result": "FAIL", "start_time": "2026-01-01T10:00:00", "duration_s": 0.0,
        "steps": [{"name": "Thermal", "result": "FAIL", "duration_s": 2.0}], "error_message": "host=[REDACTED_HOST] limit",
    }
    assert docs[("K/1", "SN2")] == {
        "serial_number": "SN2", "result": "PASS", "start_time": "2026-01-01T10:00:00", "duration_s": 0.0,
    }
    legacy = artifact.unit_rows(runs_frame(spark), compact=False).select(artifact.unit_json(compact=False)).collect()
    legacy = {json.loads(r[0])["serial_number"]: json.loads(r[0]) for r in legacy}
    assert list(legacy["SN1"]) == [*artifact.FAIL_FIELDS, "root_cause", "suggested_solution"]
    assert list(legacy["SN2"]) == list(artifact.OTHER_FIELDS) and legacy["SN2"]["host"] is None


def test_artifact_files(spark, tmp_path):
    path = f"{tmp_path}/out"
    artifact.write_artifact(runs_frame(spark), path, F.lit("2026-01-02 00:00:00").cast("timestamp_ntz"))
    docs = {r.product: json.loads(r.value) for r in artifact.read_summaries(spark, path).collect()}
    import hashlib

    name = "K_1-" + hashlib.sha1(b"K/1").hexdigest()[:8]  # apart from a product named K_1
    assert set(docs) == {name, "UNKNOWN"}
    assert docs[name]["schema_version"] == 2 and docs[name]["product_code"] == "K/1"
    assert docs[name]["generated_at"] == "2026-01-02T00:00:00Z" and docs[name]["warnings"] == []
    assert docs[name]["summary"] == {"total": 2, "pass": 1, "fail": 1, "unknown": 0, "fpy": 50.0, "run_count": 2, "retests": 0}
    sizes = {r.product: r.bytes for r in artifact.written_bytes(spark, path).collect()}
    units = artifact.read_units(spark, path).filter(F.col("product") == name).collect()
    assert sizes[name] == sum(len(r.value.encode()) + 1 for r in units)
    pretty = f"{tmp_path}/pretty"
    at = F.lit("2026-01-02 00:00:00").cast("timestamp_ntz")
    artifact.write_artifact(runs_frame(spark), pretty, at, pretty=True, warnings=F.array(F.lit("w1")))
    shown = [json.loads(r.value) for r in artifact.read_units(spark, pretty, pretty=True).collect()]
    plain = [json.loads(r.value) for r in artifact.read_units(spark, path).collect()]
    assert sorted(map(str, shown)) == sorted(map(str, plain)) and len(shown) == 3
    assert [json.loads(r.value)["warnings"] for r in artifact.read_summaries(spark, pretty).collect()] == [["w1"]] * 2


def test_expired_batches_go_as_a_whole(spark, tmp_path):
    import datetime as dt

    path, schema = f"{tmp_path}/kept", "n int, created_at timestamp_ntz, batch_id string"
    old, new = dt.datetime(2026, 1, 1), dt.datetime(2026, 3, 1)
    rows = [(1, old, "a b"), (2, old, "a b"), (3, old, "c/d"), (4, new, "c/d"), (5, new, "e")]
    batches.write_batches(spark.createDataFrame(rows, schema), path)
    at = F.lit("2026-03-05 00:00:00").cast("timestamp_ntz")
    assert batches.drop_expired(spark, path, schema, at) == 1
    assert {r.n for r in batches.read_batches(spark, path, schema).collect()} == {3, 4, 5}


def test_batch_states(spark):
    runs = spark.createDataFrame(
        [("a", "FAIL", "s", True), ("a", "FAIL", "s", False), ("b", "FAIL", "t", True), ("c", "PASS", None, False)],
        "batch_id string, result string, signature string, ok boolean",
    )
    warnings = spark.createDataFrame([("c", "w"), ("d", "w"), ("d", "v")], "batch_id string, warning string")
    got = {r.batch_id: (r.status, r.processed, r.total, r.signatures, r.warnings)
           for r in batches.interrupted(batches.batch_states(runs, F.col("ok"), warnings)).collect()}
    assert got == {"a": ("error", 1, 2, 1, 0), "b": ("done", 1, 1, 1, 0), "c": ("done", 0, 0, 0, 1), "d": ("error", 0, 0, 0, 2)}


def test_batch_replaced_as_a_whole(spark, tmp_path):
    path = f"{tmp_path}/batches"
    schema = "n int, batch_id string"
    batches.write_batches(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema), path)
    batches.write_batches(spark.createDataFrame([(9, "a")], schema), path)
    assert {(r.n, r.batch_id) for r in batches.read_batches(spark, path, schema).collect()} == {(9, "a"), (3, "b")}


def test_a_reader_sees_one_snapshot_whole(spark, tmp_path):
    """A frame made before a rewrite, and one pinned to its number, read the old batch whole; later ones the new batch."""
    path, schema = f"{tmp_path}/pinned", "n int, batch_id string"
    first = batches.write_batches(spark.createDataFrame([(n, "a/1") for n in range(50)] + [(1, "b")], schema), path)
    begun = batches.read_batches(spark, path, schema)
    second = batches.write_batches(spark.createDataFrame([(-1, "a/1"), (-2, None)], schema), path)
    assert batches.snapshot(spark, path) == second > first
    assert begun.count() == 51 and batches.read_batches(spark, path, schema, first).count() == 51
    want = {(-1, "a/1"), (1, "b"), (-2, None)}
    assert {tuple(r) for r in batches.read_batches(spark, path, schema).collect()} == want
    assert batches.remove_old(spark, path, keep=2) == 0 and begun.count() == 51
    assert batches.remove_old(spark, path) == 1  # the replaced batch
    assert {tuple(r) for r in batches.read_batches(spark, path, schema).collect()} == want
    # A write that fails, or is not yet published, shows nothing.
    (tmp_path / "pinned/files/stored_as=vhalf/batch_id=b").mkdir(parents=True)
    assert {tuple(r) for r in batches.read_batches(spark, path, schema).collect()} == want
    assert batches.read_batches(spark, f"{tmp_path}/nothing", schema).count() == 0


def test_age_of_batches_from_footers(spark, tmp_path):
    """The footers tell the newest row of a batch; with every data page destroyed they still do."""
    import datetime as dt

    import pyarrow.parquet as pq

    path, schema = f"{tmp_path}/aged", "n int, created_at timestamp_ntz, batch_id string"
    at = dt.datetime(2026, 1, 1)
    rows = [(i, at + dt.timedelta(hours=i % 50), f"b {i % 3}%") for i in range(3000)] + [(1, at, None), (2, None, "nulls")]
    batches.write_batches(spark.createDataFrame(rows, schema), path)
    batches.write_batches(spark.createDataFrame([(9, at + dt.timedelta(days=90), "b 0%")], schema), path)
    for file in (tmp_path / "aged").rglob("*.parquet"):
        footer = int.from_bytes(file.read_bytes()[-8:-4], "little") + 8
        raw = file.read_bytes()
        file.write_bytes(b"PAR1" + b"\0" * (len(raw) - footer - 4) + raw[-footer:])
        assert pq.read_metadata(file).num_rows
    got = {r.folder: (r.newest, r.known) for r in batches.newest_in_footers(spark, path, "created_at").collect()}
    assert got == {
        "batch_id=b 0%25": (at + dt.timedelta(days=90), True), "batch_id=b 1%25": (at + dt.timedelta(hours=49), True),
        "batch_id=b 2%25": (at + dt.timedelta(hours=49), True), "batch_id=__HIVE_DEFAULT_PARTITION__": (at, True),
        "batch_id=nulls": (None, False),
    }


def manifest_by_hand(rows):
    """(title, labels) per batch, file by file."""
    out = {}
    for batch in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == batch)
        names, all_paths = [r[1] for r in own], [r[2] for r in own]
        roots = list(dict.fromkeys(p.split("/")[0] for p in all_paths if "/" in p))
        more = lambda first, n, most: first[:most] + ([f"+ {n - most} more"] if n > most else [])
        if len(own) == 1 and all_paths[0].lower().endswith(".zip"):
            title, labels = all_paths[0], all_paths
        elif roots:
            labels = more(roots, len(roots), 3)
            title = ", ".join(labels)
        else:
            numbered = [f"{x} #{names[: i + 1].count(x)}" if names.count(x) > 1 else x for i, x in enumerate(names)]
            labels = more(numbered, len(own), 20)
            title = f"{names[0]} ×{len(own)}" if len(set(names)) == 1 else ", ".join(more(all_paths, len(own), 3))
        out[batch] = title, labels
    return out


def test_manifest_views_of_large_and_odd_batches(spark):
    rows = [("hot", i, f"n{i % 700}.txt", f"n{i % 700}.txt") for i in range(4000)]  # a batch with most of the files
    rows += [("late", i, f"n{min(i, 30)}.txt", f"n{min(i, 30)}.txt") for i in range(50)]  # names met again beyond the shown
    rows += [("twice", i, f"n{i % 25}.txt", f"n{i % 25}.txt") for i in range(26)]
    rows += [("folders", i, "a.txt", f"top{i // 40}/a.txt" if i else "a.txt") for i in range(300)]
    rows += [("zip", 7, "a.ZIP", "a.ZIP"), ("in", 1, "b.zip", "x/b.zip"), ("one", 1, "a.txt", "a.txt"), ("", 1, "", "")]
    rows += [("same", i, "a.txt", "a.txt") for i in range(21)] + [("twenty", i, f"{i}.txt", f"{i}.txt") for i in range(20)]
    frame = spark.createDataFrame(rows, "batch_id string, seq long, name string, path string").repartition(5)
    want = manifest_by_hand(rows)
    got = {}
    for r in paths.manifest_items(frame).collect():
        got.setdefault(r.batch_id, {})[r.position] = r.label
    assert {b: [x[k + 1] for k in range(len(x))] for b, x in got.items()} == {b: x for b, (_, x) in want.items()}
    assert {r.batch_id: r.title for r in paths.manifest_summary(frame).collect()} == {b: t for b, (t, _) in want.items()}
    assert paths.manifest_items(frame.limit(0)).collect() == [] == paths.manifest_summary(frame.limit(0)).collect()


def test_manifest_items_reads_the_files_twice(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [("b", i, f"n{i}", f"n{i}") for i in range(50)]
    spark.createDataFrame(rows, "batch_id string, seq long, name string, path string").write.parquet(path)
    items = paths.manifest_items(spark.read.parquet(path))
    items.collect()
    final = items._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?:FileScan|Scan) parquet", final)) == 2
    assert len([line for line in final.split("\n") if "Exchange hash" in line and "Reused" not in line]) == 3
    assert "WindowGroupLimit" in final


def test_tree_is_listed_in_tasks_as_spark_lists_it(spark, tmp_path, monkeypatch):
    files = {
        "a b%25/run1/FTRunner 1%.txt": "OPID=1", "a b%25/run1/ftrunner2.txt": "x", "a b%25/run2/ftrunner.txt": "", "a b%25/run2/o.txt": "q",
        "_hid/run/ftrunner.txt": "x", ".dot/ftrunner.txt": "x", "_a=b/ftrunner.txt": "eq", "r/.ftrunner.txt": "x", "r/_ftrunner.txt": "x",
        "r/_metadata_ftrunner.txt": "m", "r/ftrunner.txt._COPYING_": "x", "[g]*{x}/ftrünner.txt": "x", "[g]*{x}/ftrunner.txt": "OPID=2\r\n" * 500,
        "ftrunnerlog.txt": "top", "skipped/ftrunner.txt": "x",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (tmp_path / "empty").mkdir()
    columns = ["path", "size", "run_folder", "file_name"]
    one, other = (f(spark, str(tmp_path), skip=("skipped",)).select(columns).collect() for f in (folders.list_files, folders.list_tree))
    assert sorted(one) == sorted(other) and len(one) == 7

    def on_the_driver(*args, **kwargs):
        raise AssertionError("Spark's readers hold every file of a tree on the driver")

    for module, name in ((folders, "list_files"), (ingest, "read_log_lines")):
        monkeypatch.setattr(module, name, on_the_driver)
    batch = ingest.ingest_folder(spark, str(tmp_path), row_bytes=1000, skip=("skipped",))
    assert sorted(r.run_folder for r in batch.runs.collect()) == [".", "[g]*{x}", "_a=b", "a b%25/run1"]


def test_lines_belong_to_the_split_they_begin_in(monkeypatch):
    dice = random.Random(4)
    for _ in range(2000):
        data = bytes(dice.choice(b"ab\n\r\n\r") for _ in range(dice.randint(0, 40)))
        if dice.random() < 0.1:
            data = parse_lines.BOM + data
        monkeypatch.setattr(parse_lines, "CHUNK_BYTES", dice.randint(4, 9))
        size = dice.randint(4, 15)
        want = re.split(b"\r\n|\r|\n", data.removeprefix(parse_lines.BOM))
        got = []
        for start in range(0, len(data), size):
            end = start + size if start + size < len(data) else 1 << 62
            got += [line for lines in parse_lines.lines_from(io.BytesIO(data), start, end) for line in lines]
        assert got == (want if want[-1] else want[:-1])
