"""What keeps cost in step with the input: tasks, plans and expressions built."""

import re

from pyspark.sql import functions as F

from logyield import session
from logyield.functions import redaction
from logyield.operators import client_events
from logyield.plans import parse
from logyield.queries import events, files
from logyield.sources import folders
from logyield.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_stream_session_has_few_tasks_and_the_same_settings(spark):
    with session.setting(spark, "spark.sql.shuffle.partitions", "64"):
        own = session.stream_session(spark)
    assert own.conf.get("spark.sql.shuffle.partitions") == str(spark.sparkContext.defaultParallelism)
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert int(own.conf.get(session.LISTING_TASKS)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get(session.LISTING_TASKS) == "10000"


def test_first_log_of_a_folder_is_kept_without_python(spark, tmp_path):
    plan = analyzed(jobs.log_stream(spark, str(tmp_path)))
    assert "Aggregate" in plan and "Pandas" not in plan


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    for n in range(60):
        (tmp_path / f"run{n}").mkdir()
        (tmp_path / f"run{n}/ftrunner.txt").write_text("x")
    spark.sparkContext.setJobGroup("listing", "")
    try:
        assert folders.list_files(spark, str(tmp_path)).select("run_folder").distinct().count() == 60
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism


def test_parse_expressions_are_built_once(spark):
    application = spark.sparkContext.applicationId
    logs = [spark.createDataFrame([(f"r{n}", "ftrunner.txt", f"scan file content:\nOPID={n}\n")], "run_folder string, file_name string, text string") for n in (1, 2)]
    first = parse.parse_logs(logs[0]).first().op_id
    steps = parse.parse_steps(application)
    assert (first, parse.parse_logs(logs[1]).first().op_id) == ("1", "2") and parse.parse_steps(application) is steps


def test_tester_logs_are_written_by_many_tasks(spark):
    assert files.tester_logs(spark, SMALL).rdd.getNumPartitions() == 4


def test_trim_walks_a_context_once(spark):
    walks = [analyzed(f(spark, SMALL)).count("[REDACTED]") for f in (events.client_scrub, events.client_trim)]
    assert walks[0] == walks[1] > 0


def test_lists_of_numbers_are_cut_like_others(spark):
    def scrubbed(text):
        df = spark.createDataFrame([(text,)], "c string")
        return df.select(client_events.scrubbed(F.col("c"))).first()[0]

    many = lambda n: ",".join(map(str, range(n)))
    for n in (0, 1, 49, 50, 51, 200):
        assert scrubbed(f'{{"a":[{many(n)}]}}') == f'{{"a":[{many(min(n, 50))}]}}'
    for same in ('{"a":[-15,null,true]}', '{"a":[-1,23456789012345678901234567890]}', '{"a":["1,2",3]}', '{"a":[[1,2],[3]]}', '{"token":"[1]"}'.replace("token", "t")):
        assert scrubbed(same) == same
    assert scrubbed('{"a": [ 1 , 2 ]}') == '{"a":[1,2]}'
    assert scrubbed('{"a":{"b":{"c":{"d":[1,2]}}}}') == '{"a":{"b":{"c":{"d":["[MAX_DEPTH]","[MAX_DEPTH]"]}}}}'
    assert scrubbed('{"a":{"b":{"c":[1,2]}}}') == '{"a":{"b":{"c":[1,2]}}}'
    assert scrubbed('{"tokens":[1]}') == '{"tokens":"[REDACTED]"}'


ODD = [
    "paſſword=a PASSWORD : b xpassword=c épwd=d pwd=é toKen=k ſecret=x", "uſer=a user =b USERİD=c uıd=d superuser=e",
    "hoſt=a HOST=b teſtserver : c ghost=d", "serial=1 ſerial=2 child_ſn=3 CHILD_SN:4 serialnumber = 5 aserial=6",
    "00:1A:2b:3C:4d:5E x00-1A-2b-3C-4d-5E 00:1A:2b:3C:4d:5Eé 000:1A:2b:3C:4d:5E", "10.0.0.1 x10.0.0.1 1234.5.6.7 ١.٢.٣.٤ 1.2.3.4.5",
    "RMA1000000 XRMA1000000 RMAB123456 RMABC123456 RMA12345é ÉRMA123456", "", "-u a -p b -P  c", "́pwd=x ápwd=y",
]


def test_rules_match_as_without_the_look_ahead(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    ahead = re.compile(r"^(\(\?i?U\))\(\?=[^)]*\)(?=\\b)")
    for _, pattern, mask in redaction.rules():
        bare = ahead.sub(r"\1", pattern)
        assert not re.match(r"\(\?i?U\)\\b", pattern)  # no rule tries a word boundary at every character
        both = df.select(F.regexp_replace("t", pattern, mask), F.regexp_replace("t", bare, mask)).collect()
        assert all(a == b for a, b in both), pattern
