"""Files: marks, broken lines, listed recordings; streams with late rows and a restart."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from wavecohort.sources import tables as T
from wavecohort.streaming import epochs as E


def test_results_start_with_the_mark(spark, tmp_path):
    df = spark.createDataFrame([("Größe", 1.5), ("b", None)], "name string, v double")
    T.write_results(df, str(tmp_path / "a"))
    (file,) = glob.glob(str(tmp_path / "a" / "*.csv"))
    raw = open(file, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfname,v\n") and "Größe,1.5" in raw.decode("utf-8-sig")
    T.write_results(df, str(tmp_path / "b"), mark=False)
    assert open(glob.glob(str(tmp_path / "b" / "*.csv"))[0], "rb").read().startswith(b"name,v\n")
    assert spark.read.schema("name string, v double").csv(str(tmp_path / "a"), header=True).count() == 2


def test_behavior_keeps_broken_lines_apart(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("﻿id,score,note\n1,3.5,fine\n2,,\nx,4,no number\n3,1\n4,2,a,b\n,,\n5,7.0,\"quoted, text\"\n".encode())
    good, bad = T.read_behavior(spark, str(tmp_path / "b.csv"), "id int, score double, note string", "score")
    assert sorted((r["id"], r["score"]) for r in good.collect()) == [(1, 3.5), (5, 7.0)]
    assert sorted(r["record"] for r in bad.collect()) == ["3,1", "4,2,a,b", "x,4,no number"]


def test_subjects_are_discovered_in_folders(spark, tmp_path):
    for p in ("td/001-epo.parquet", "td/002-epo.parquet", "td/notes.txt", "com/007-epo.parquet", "com/sub/deep-epo.parquet"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = {(r["grp"], r["subject_id"]) for r in T.discover_subjects(T.list_files(spark, str(tmp_path))).collect()}
    assert got == {("td", "001"), ("td", "002"), ("com", "007"), ("sub", "deep")}


def test_recordings_are_files_of_their_own(spark, tmp_path):
    """A file for each subject, not a folder of Spark's for each; a subject of more rows than a batch holds has them all."""
    rows = [("a", f"{i}-epo.parquet", float(i)) for i in range(90)] + [("b", "7-epo.parquet", float(i)) for i in range(12_000)]
    df = spark.createDataFrame([*rows, (None, "8-epo.parquet", 1.0), ("a", "notes.txt", 2.0), ("a", None, 3.0)], "grp string, file string, v double")
    T.write_recordings(df.repartition(3), "grp", "file", str(tmp_path / "rec"))
    files = [f for f in glob.glob(str(tmp_path / "rec" / "**"), recursive=True) if "." in f.rsplit("/", 1)[1]]
    assert len(files) == 93 and all(f.count("/") == files[0].count("/") for f in files)
    got = spark.read.parquet(str(tmp_path / "rec" / "grp=b" / "7-epo.parquet"))
    assert sorted(r["v"] for r in got.collect()) == [float(i) for i in range(12_000)]
    listed = T.list_files(spark, str(tmp_path / "rec"))
    assert listed.count() == 93 and listed.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert T.discover_subjects(listed).count() == 92


def test_recordings_where_arrow_does_not_reach(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "_arrow_reaches", lambda path: False)
    df = spark.createDataFrame([("a", "1-epo.parquet", 1.0), ("a", "2-epo.parquet", 1.0), ("b", "3.txt", 1.0)], "grp string, file string, v double")
    T.write_recordings(df, "grp", "file", str(tmp_path / "rec"))
    assert {tuple(r) for r in T.discover_subjects(T.list_files(spark, str(tmp_path / "rec"))).collect()} == {("a", "1"), ("a", "2")}


def test_sliding_stream_equals_batch_with_late_rows_and_a_restart(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    day = lambda x: dt.datetime(2024, 1, 1) + dt.timedelta(days=x)
    first = [("a", day(0.1 * i), float(i % 5)) for i in range(60)] + [("b", day(2.0), 9.0), ("b", day(2.5), 90.0), ("b", day(5.1), 3.0), ("b", day(5.2), 4.0)]
    second = [("a", day(5.95), 2.0), ("a", day(0.5), 1000.0), *(("a", day(6 + 0.1 * i), float(i % 7)) for i in range(80)), ("b", day(13.9), 1.0)]  # the second row is too late
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    args = (["k"], "ts", "v", "2 days", "1 day", 2, 50.0, "4 days")
    for rows in (first, second):  # the second run goes on from the first one's state
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        E.run_to_folder(E.epoch_summaries(spark.readStream.schema(schema).parquet(src), *args, late="6 hours"), out, state)
    read = lambda df: sorted((r["k"], r["start"], r["n_epochs"], r["n"], round(r["mean"], 9), round(r["m2"], 6)) for r in df.collect())
    batch = E.epoch_summaries(spark.createDataFrame([r for r in first + second if r[2] != 1000.0], schema), *args)
    end = day(13.9) - dt.timedelta(hours=6)
    want = read(batch.filter(F.col("start") + F.expr("INTERVAL 4 DAYS") <= F.lit(end)))
    assert len(want) >= 4 and read(spark.read.parquet(out)) == want
    assert any(r[0] == "b" for r in want) and all(r[5] >= 0 for r in want)
