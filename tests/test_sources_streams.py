import datetime as dt
import json

from pyspark.sql import functions as F

from tessella.sources import readers, sinks
from tessella.streaming import windows


def test_submissions_keep_files_of_one_name(spark, tmp_path):
    for d, body in (("a", "x = 1\n"), ("b", "y = 2\n")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "main.py").write_text(body)
    (tmp_path / "a" / "notes.md").write_text("no")
    rows = readers.submissions(spark, str(tmp_path)).collect()
    assert sorted(r["content"] for r in rows) == ["x = 1\n", "y = 2\n"] and {r["language"] for r in rows} == {"python"} and len({r["sub_id"] for r in rows}) == 2


def test_labelled_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text('code,label,problem_id,source\n"a\n""q""",AI,p1,s\nb,,p1,s\n,1,p1,s\n')
    (tmp_path / "r.jsonl").write_text(json.dumps({"code": "c", "label": "human"}) + "\n")
    assert [(r["code"], r["label"]) for r in readers.labelled_csv(spark, str(tmp_path / "r.csv")).collect()] == [('a\n"q"', 1), ("b", None)]
    assert [(r["code"], r["label"]) for r in readers.labelled_jsonl(spark, str(tmp_path / "r.jsonl")).collect()] == [("c", 0)]
    for d in ("ai", "human"):
        (tmp_path / "tree" / d).mkdir(parents=True)
        (tmp_path / "tree" / d / "1.txt").write_text(d)
    assert {(r["code"], r["label"]) for r in readers.labelled_folders(spark, str(tmp_path / "tree")).collect()} == {("ai", 1), ("human", 0)}


def test_first_of_each(spark):
    df = spark.createDataFrame([(2, "x"), (1, "x"), (3, "y")], "i long, t string")
    assert {(r["i"], r["t"]) for r in readers.first_of_each(df, "t", ["i"]).collect()} == {(1, "x"), (3, "y")}


def test_tool_reports(spark, tmp_path):
    (tmp_path / "m.html").write_text("<TABLE><TR><TD><A HREF=x>a/ (81%)</A>\n<TD><A HREF=y>b/ (79%)</A>\n<TD ALIGN=right>42\n</TABLE>")
    assert [tuple(r) for r in readers.moss_report(spark, str(tmp_path / "m.html")).collect()] == [("a/", "b/", 81, 79, 42)]
    (tmp_path / "j.json").write_text(json.dumps({"firstSubmissionId": "a", "secondSubmissionId": "b", "similarity": 0.5}))
    assert [tuple(r) for r in readers.jplag_report(spark, str(tmp_path / "j.json")).collect()] == [("a", "b", 0.5)]
    (tmp_path / "c.xml").write_text('<clones><class classid="1" similarity="90"><source file="a.c" startline="1" endline="9"/><source file="b.c" startline="3" endline="11"/></class></clones>')
    assert {tuple(r) for r in readers.clone_report(spark, str(tmp_path / "c.xml")).collect()} == {(1, 90.0, "a.c", 1, 9), (1, 90.0, "b.c", 3, 11)}
    (tmp_path / "log.txt").write_text("abc\tAda\ta@x\t1700000000\tfirst\tline\n")
    assert readers.commits(spark, str(tmp_path / "log.txt")).first()["message"] == "first\tline"


def test_pairs_and_report(spark, tmp_path):
    (tmp_path / "p.csv").write_text("file_a,file_b,label\nb,a,1\na,b,3\nc,c,9\n")
    pairs = readers.pair_list(spark, str(tmp_path / "p.csv"))
    assert {tuple(r) for r in pairs.collect()} == {("a", "b", 3), ("c", "c", 9)}
    assert tuple(readers.validate_pairs(pairs).first()) == (2, 1, 0, 1, 0)
    scored = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.2)], "id_a long, id_b long, score double")
    assert tuple(sinks.report(scored, str(tmp_path / "out"), 0.5).first()) == (2, 1, 0.5)
    assert spark.read.parquet(f"{tmp_path}/out/pairs").filter("suspicious = 'true'").count() == 1


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    done = q.awaitTermination(60)
    q.stop()
    assert done


START = dt.datetime(2024, 1, 1)


def test_limiter_forgets_rejected_requests():
    assert windows._accept([0, 1, 2, 60, 61.5], [], ((60, 2),)) == [True, True, False, True, True]


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [(k, START + dt.timedelta(seconds=s), i, 1.0) for i, (k, s) in enumerate([(1, 0), (1, 10), (1, 20), (2, 0), (1, 70), (1, 75), (2, 500)])]
    df = spark.createDataFrame(rows, "key long, ts timestamp, id long, value double")
    limits = ((60, 2),)
    want = {(r["id"], r["accepted"]) for r in windows.rate_limit(df, limits).collect()}
    assert want == {(0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (6, True)}
    # two files, taken one after the other: the state carries over
    df.filter("ts < timestamp '2024-01-01 00:00:30'").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    df.filter("ts >= timestamp '2024-01-01 00:00:30'").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run(windows.rate_limit_stream(stream, limits), "limited", "append")
    assert {(r["id"], r["accepted"]) for r in spark.table("limited").collect()} == want
    for name, op, mode in (("bursts", lambda d: windows.typing_bursts(d.withWatermark("ts", "1 minute"), "1 minute", "30 seconds", 3), "complete"), ("months", windows.monthly_usage, "complete"), ("runs", lambda d: windows.sessions(d.withWatermark("ts", "1 minute"), "1 minute"), "append")):
        run(op(stream), name, mode)
    assert spark.table("bursts").count() == windows.typing_bursts(df, "1 minute", "30 seconds", 3).count() == 2
    assert {(r["key"], r["n"]) for r in spark.table("months").collect()} == {(1, 5), (2, 2)}
    assert {(r["key"], r["n"]) for r in windows.sessions(df, "1 minute").collect()} == {(1, 5), (2, 1)}


def test_rate_limit_streams_each_key(spark):
    """No group of a key is one frame, and pauses of the longest horizon change nothing."""
    import random
    from datetime import datetime, timedelta

    rng, limits = random.Random(4), ((5, 2), (20, 4))
    rows, at = [], 0
    for i in range(600):
        at += rng.choice((0, 1, 1, 2, 3, 19, 20, 21)) if i % 7 == 0 else rng.randrange(3)
        rows.append((i % 3 % 2, datetime(2024, 1, 1) + timedelta(seconds=at), i))
    df = windows.rate_limit(spark.createDataFrame(rows, "key long, ts timestamp, id long").repartition(5), limits)
    assert "InPandas" not in df._jdf.queryExecution().toString()
    want, logs = {}, {}
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        log = logs.setdefault(key, [])
        want[i] = all(sum((ts - x).total_seconds() < s for x in log) < n for s, n in limits)
        log += [ts] * want[i]
    assert {r["id"]: r["accepted"] for r in df.collect()} == want
