"""Literal logs with the results they must give."""

import datetime as dt
import hashlib

import pytest

from logyield.functions import kv
from logyield.plans import parse

AT = "[2025-11-28 09:01:15 INF]"
END = "[2025-11-28 09:01:20 INF]"


def log(scan="", body="", done=""):
    return f"{AT} scan file content:\n{AT} \n{scan}\n{body}\n{done}"


def done(*pairs):
    return f"{END} done file content:\n{END} \n" + "".join(p + "\n" for p in pairs)


PASSED = done("Result=PASS", "EndTime=20251128090120")
FAILED = done("Result=FAIL", "EndTime=20251128090120", "Errorcode=E001", "ErrorMsg=Voltage out of range")
STEP = "{at} ***{name} test start.***\n{at} {text}\n{at} ***{name} test end.***\n{at} Test time(hh\\mm\\ss): {time}\n"


def step(name, text, time):
    return STEP.format(at=AT, name=name, text=text, time=time)


LOGS = {
    "STC_WW4622_V401___20251128090115": log("SERIALNUMBER=SN100\nPRODUCTCODE=K77469-400\nSTATIONID=ST01\n", "", PASSED),
    "day/fail": log("SERIALNUMBER=SN101\n", "", FAILED),
    "implicit_pass": log("SERIALNUMBER=SN102\n\n", f"{END} All tests complete."),
    "implicit_fail": "09:01:20 ERR] Something failed in the station\n",
    "colours": f"\x1b[32m{AT}\x1b[0m scan file content:\n\x1b[32m{AT}\x1b[0m \n\x1b[32mSERIALNUMBER=SN103\x1b[0m\n"
    f"\x1b[32mPRODUCTCODE=K1\x1b[0m\n\n[34mtestmode: x[0m\n{PASSED}",
    "prefixed_keys": f"scan file content:\n{AT} \n{AT} SERIALNUMBER=SN002\n{AT} PRODUCTCODE=K2\n\nOPID=LATE\n",
    "blank_ends_block": "SCAN FILE CONTENT:\n\nSERIALNUMBER=SN003\n\nPRODUCTCODE=IGNORED\n",
    "text_ends_block": "scan file content:\nSERIALNUMBER=SN004\nno pair here\nPRODUCTCODE=IGNORED\n",
    "last_wins": "scan file content:\nSERIALNUMBER=A\nSERIALNUMBER = B \nHost=\nHOST=h2\n",
    "long_block": "scan file content:\n" + "\n" * 70 + "".join(f"K{chr(65 + i % 26)}=1\n" for i in range(300)) + "SERIALNUMBER=FAR\n",
    "text_after_header": "scan file content: now\nSERIALNUMBER=NO\n",
    "two_steps": log(
        "SERIALNUMBER=SN105\n",
        step("VoltageTest", "TEST PASSED", "00:00:05") + step("ThermalTest", "Test failed.", "01:02:04"),
        done("Result=FAIL", "Errorcode=E003", "ErrorMsg=Thermal limit exceeded"),
    ),
    "adjacent_markers": log(
        "",
        f"{AT} ***A test start.***\n{AT} passed.\n{AT} ***A test end.***\n{AT} ***B test start.***\n{AT} failed.\n",
        PASSED,
    ),
    "dangling_last": log("", f"{AT} ***mb_pan_test test start.***\n{AT} bin lookup\n", FAILED),
    "pan_hint": log("", f"{AT} Running hst_et flow\n", PASSED),
    "testapp": log("", f"{AT} TestMode : TestApp\n", PASSED),
    "odd_result": log("", "", done("Result=ABORT", "Errorcode=E9")),
    "times": "Test start time: 20251128090000\nTest end time: 20251128090130\nLotID=;L7,;\n",
    "bad_time": "Test start time: 20259928090000\n[2025-11-28 09:00:00 INF] a\n[2025-11-28 09:00:09 INF] b\n",
    "bad_end": log("", step("S", "passed", "00:00:03"), done("Result=PASS", "EndTime=2025")),
    "crlf": log("SERIALNUMBER=SN9\nPRODUCTCODE=K9\n", step("W", "passed", "00:01:00"), PASSED).replace("\n", "\r\n"),
    "start_after_done": log("", step("X", "passed", "00:00:01"), PASSED) + f"{AT} ***Late test start.***\n{AT} failed\n",
    "lots/NoLotId_7": "x\n",
    "lot_in_text": "info lotid = AB12;CD\n",
    "empty": "",
}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(folder, "ftrunnerlog01.txt", text) for folder, text in LOGS.items()]
    logs = spark.createDataFrame(rows, "run_folder string, file_name string, text string")
    return {r.run_folder: r for r in parse.parse_logs(logs).collect()}


def test_identity_and_times(runs):
    r = runs["STC_WW4622_V401___20251128090115"]
    assert (r.serial_number, r.product_code, r.station_id, r.result) == ("SN100", "K77469-400", "ST01", "PASS")
    assert r.unit_id == hashlib.sha1(r.run_folder.encode()).hexdigest()[:16]
    assert r.lot_id == "STC" and r.end_time_raw == "20251128090120"
    assert r.end_time == dt.datetime(2025, 11, 28, 9, 1, 20) and r.start_time == dt.datetime(2025, 11, 28, 9, 1, 15)
    assert (r.duration_s, r.duration_basis) == (5.0, "clock")


def test_verdicts(runs):
    r = runs["day/fail"]
    assert (r.result, r.error_code, r.error_message) == ("FAIL", "E001", "Voltage out of range")
    assert r.ftrunner_snippet == "Result: FAIL\nErrorcode: E001\nErrorMsg: Voltage out of range"
    assert (runs["implicit_pass"].result, runs["implicit_pass"].error_code) == ("PASS", None)
    r = runs["implicit_fail"]
    assert (r.result, r.error_code, r.has_done_block) == ("FAIL", "UNKNOWN", False)
    assert "error" in r.error_message
    assert (runs["odd_result"].result, runs["odd_result"].error_code) == ("UNKNOWN", None)
    assert runs["empty"].result == "PASS" and runs["empty"].start_time is None


def test_key_blocks(runs):
    assert (runs["colours"].serial_number, runs["colours"].product_code, runs["colours"].test_mode) == ("SN103", "K1", "x")
    assert (runs["prefixed_keys"].serial_number, runs["prefixed_keys"].op_id) == ("SN002", None)
    assert (runs["blank_ends_block"].serial_number, runs["blank_ends_block"].product_code) == ("SN003", None)
    assert (runs["text_ends_block"].serial_number, runs["text_ends_block"].product_code) == ("SN004", None)
    assert (runs["last_wins"].serial_number, runs["last_wins"].host) == ("B", "h2")
    assert runs["long_block"].serial_number == "FAR"
    assert runs["text_after_header"].serial_number is None
    assert (runs["crlf"].serial_number, runs["crlf"].product_code, runs["crlf"].step_duration_s) == ("SN9", "K9", 60.0)


def test_steps(runs):
    r = runs["two_steps"]
    assert [(s.name, s.result, s.duration_s) for s in r.steps] == [
        ("VoltageTest", "PASS", 5.0),
        ("ThermalTest", "FAIL", 3724.0),
    ]
    assert r.failing_step == "ThermalTest" and r.device_class == "aic"
    r = runs["adjacent_markers"]
    assert [(s.name, s.result) for s in r.steps] == [("A", "PASS"), ("B", "FAIL")] and r.failing_step == "B"
    assert r.ftrunner_snippet is None
    r = runs["dangling_last"]
    assert [(s.name, s.result) for s in r.steps] == [("mb_pan_test", "FAIL")] and r.device_class == "pan"
    r = runs["start_after_done"]
    assert [(s.name, s.result) for s in r.steps] == [("X", "PASS"), ("Late", "PASS")]


def test_device_and_lot(runs):
    assert runs["pan_hint"].device_class == "pan" and runs["testapp"].device_class == "aic"
    assert runs["implicit_pass"].device_class == "unknown"
    assert runs["times"].lot_id == ";L7"  # only the end is stripped
    assert runs["lots/NoLotId_7"].lot_id == "NoLotId" and runs["lot_in_text"].lot_id == "AB12"


def test_time_sources(runs):
    r = runs["times"]
    assert (r.start_time, r.end_time, r.duration_s) == (
        dt.datetime(2025, 11, 28, 9, 0), dt.datetime(2025, 11, 28, 9, 1, 30), 90.0,
    )
    assert runs["bad_time"].duration_s == 9.0
    r = runs["bad_end"]
    assert (r.end_time, r.end_time_raw, r.duration_s, r.duration_basis) == (None, "2025", 3.0, "steps")


def test_block_longer_than_the_near_lines(spark):
    for n in (1, kv.NEAR_LINES - 2, kv.NEAR_LINES - 1, kv.NEAR_LINES, kv.NEAR_LINES + 1, 500):
        text = "done file content:\n" + "".join(f"K{'A' * i}=v{i}\n" for i in range(n)) + "\nLATE=1\n"
        df = spark.createDataFrame([(text,)], "t string")
        got = kv.with_kv_entries(df, "t", kv.DONE_HEADER, "e").first().e
        assert [e.value for e in got] == [f"v{i}" for i in range(n)], n


def test_first_log_by_name(spark):
    logs = spark.createDataFrame(
        [("f", "ftrunner_b.txt", "scan file content:\nSERIALNUMBER=B\n"), ("f", "ftrunner_a.txt", "scan file content:\nSERIALNUMBER=A\n")],
        "run_folder string, file_name string, text string",
    )
    rows = parse.one_log_per_folder(parse.parse_logs(logs)).collect()
    assert [(r.serial_number, r.source_files) for r in rows] == [("A", ["ftrunner_a.txt"])]


PATTERNS = [
    "Test start time: 20240301080000", "Test end time:\t20240301090000", "Total Test time(s): 12.5", "testmode : APSE",
    "lotid = LOT77;x", "LotID=;Z9", "08:00:00 ERR] bad", "***Power test start.***", "***Power test end.***",
    "Test time(hh\\mm\\ss): 00:00:07", "TEST PASSED", "Test failed.", "scan file content: A=1", "SERIALNUMBER = S1",
    "Host=h", "HOST=k", "done file content:", "Result = FAIL", "Errorcode=E1", "EndTime=20240301091500", "", " \t",
    "[2024-03-01 08:00:01 INF] mb_pan_test", "[2024-03-01 08:00:09] OPID=O", "noise x\x0bOPID=P", "***A test start.******B test start.***",
]


def random_log(dice):
    """Lines of patterns, some broken at blanks, colons and equals signs."""
    out = []
    for line in dice.choices(PATTERNS, k=dice.randint(1, 25)):
        if dice.random() < 0.5:
            line = "".join(c + "\n" * dice.choice([0, 0, 1, 1, 2]) if c in ":= ])" else c for c in line)
        if dice.random() < 0.2:
            line = "".join(c + "\n" if dice.random() < 0.05 else c for c in line)
        out.append(line)
    return "\n".join(out)


def test_whole_texts_and_lines_give_the_same(spark):
    """Every pattern broken at any line end, in blocks of one line and more, against the parse of whole texts."""
    import random

    from logyield.plans import parse_lines

    dice = random.Random(11)
    texts = [random_log(dice) for _ in range(400)]
    for line in PATTERNS[:10]:  # each field with its value on the next line, and behind blank ones
        for gap in ("\n", "\n\n \n", "\n[2024-03-01 08:00:01 INF] "):
            for mark in (":", "=", " "):
                texts.append("first\n" + line.replace(mark, mark + gap) + "\nlast")
                texts.append(line.replace(mark, gap + mark + gap) + "\n***Late test start.***\n" + line.replace(mark, mark + gap))
    logs = spark.createDataFrame(
        [(f"NoLotId_{i}", "ftrunnerlog.txt", t) for i, t in enumerate(texts)], "run_folder string, file_name string, text string"
    ).cache()
    whole = parse.parse_logs(logs).cache()
    want = {r.run_folder: r.asDict() for r in whole.drop("steps").collect()}
    want_steps = {(r.unit_id, r.step_no): (r.name, r.result, r.duration_s) for r in parse.steps_table(whole).collect()}
    chosen = logs.selectExpr("run_folder AS file_key", "run_folder", "file_name")
    for block_lines in (1, 2, 7, 1000):
        runs, steps = parse_lines.parse_lines(parse_lines.lines_of(logs, block_lines), chosen)
        got = {r.run_folder: r.asDict() for r in runs.drop("steps").collect()}
        assert got.keys() == want.keys()
        for folder, row in want.items():
            text = texts[int(folder.split("_")[1])]
            assert got[folder] == row, (block_lines, text, {c: (got[folder][c], row[c]) for c in row if got[folder][c] != row[c]})
        got_steps = {(r.unit_id, r.step_no): (r.name, r.result, r.duration_s) for r in steps.collect()}
        assert got_steps == want_steps


def test_lines_stay_in_their_task(spark):
    from logyield.plans import parse_lines

    logs = spark.createDataFrame([("f", "ftrunnerlog.txt", "a\nb")], "run_folder string, file_name string, text string")
    plan = parse_lines.summaries(parse_lines.lines_of(logs, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_texts_are_searched_only_where_a_pattern_can_match(monkeypatch):
    """Fixed parts of the patterns decide it; what is found stays the same."""
    import random

    from logyield.plans import log_pieces

    dice = random.Random(5)
    texts = [random_log(dice).split("\n") for _ in range(300)]
    keys = {"scan": ("SERIALNUMBER", "OPID", "Host"), "done": ("Result", "Errorcode")}
    said = [log_pieces.piece_of(lines, keys) for lines in texts]
    with monkeypatch.context() as m:  # parts that every text holds: all patterns are searched everywhere
        m.setattr(log_pieces, "FIRST_PARTS", dict.fromkeys(log_pieces.FIRST_PARTS, ""))
        m.setattr(log_pieces, "HEADER_PARTS", dict.fromkeys(log_pieces.HEADER_PARTS, ""))
        for name in ("ERROR_PART", "START_PART", "END_PART", "TIME_PART"):
            m.setattr(log_pieces, name, "")
        m.setattr(log_pieces, "OPEN_END_PARTS", ("",))
        assert said == [log_pieces.piece_of(lines, keys) for lines in texts]

    class Unsearched:
        def search(self, *_):
            raise AssertionError("searched in vain")

        finditer = search

    for name in ("ERROR", "STEP_START", "STEP_END", "STEP_TIME", "OPEN_END"):
        monkeypatch.setattr(log_pieces, name, Unsearched())
    monkeypatch.setattr(log_pieces, "FIRST", {n: Unsearched() for n in log_pieces.FIRST})
    monkeypatch.setattr(log_pieces, "HEADERS", {n: Unsearched() for n in log_pieces.HEADERS})
    log_pieces.piece_of(["noise of the tester"] * 9, keys)


def test_unread_columns_are_not_parsed(spark):
    logs = spark.createDataFrame(
        [("f", "ftrunner.txt", "testmode: APSE\n***A test start.***\nfailed")] * 2 + [(None, "ftrunner.txt", "x")],
        "run_folder string, file_name string, text string",
    )
    runs = parse.one_log_per_folder(parse.parse_logs(logs))
    assert sorted(str(r.test_mode) for r in runs.collect()) == ["APSE", "None"]
    tied = spark.createDataFrame([("f", "ftrunner.txt", f"testmode: M{i}") for i in range(5)], logs.schema).coalesce(1)
    assert [r.test_mode for r in parse.one_log_per_folder(parse.parse_logs(tied)).collect()] == ["M4"]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "test start" in plan(runs.select("unit_id", "failing_step"))
    assert "test start" not in plan(runs.select("unit_id", "test_mode"))


@pytest.mark.parametrize("near", (5, 64))
def test_blocks_end_where_they_did(spark, monkeypatch, near):
    monkeypatch.setattr(kv, "NEAR_LINES", near)
    stamp = "[2024-03-01 08:00:00 a=b] "
    texts = {
        "head:\nA=1\nB=2\nno\nC=3": ["A", "B"],
        f"head:\n{stamp}\n\n{stamp}A=1\n{stamp}B=2\n{stamp}\nC=3": ["A", "B"],
        f"head:\n{stamp}\n\nA=1\nB=2\nC=3\nD=4\nE=5\nF=6": list("ABCDEF"),
        "head:\nno\nA=1": [],
        "head:\n1=2\nA=1": [],
        "A=1": [],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in kv.with_kv_entries(df, "t", "head:", "e").collect():
        assert [e.key for e in row.e] == texts[row.t], row.t


def test_a_piece_walks_its_leading_pairs_once(monkeypatch):
    from logyield.plans import log_pieces

    walks, walk = [], log_pieces.run_of
    monkeypatch.setattr(log_pieces, "run_of", lambda lines: walks.append(lines) or walk(lines))
    piece, _ = log_pieces.piece_of(["", "OPID=1", "Result = PASS ", "", "OPID=2"], {"scan": ("OPID",), "done": ("Result",)})
    waiting, inside = piece["blocks"]["done"]["leads"]
    assert waiting == {"phase": log_pieces.OVER, "pairs": 2, "values": {"Result": "PASS"}}
    assert inside == {"phase": log_pieces.OVER, "pairs": 0, "values": {}}
    assert len(walks) == 1
