"""Reports written and read back; streams against the same question asked of the whole table."""

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedline.functions import text
from reedline.sources import reports
from reedline.streaming import gaps

SF = "/root/testdata/sf0.001"


def _findings(spark):
    rows = [
        ("b.wav", "dropout", 44100, 44100, 44200, "dropout: 2.3 ms, \"odd\"", 3, {"silence_ms": "2.3", "empty": ""}),
        ("a.wav", "hum", 48000, 48000 * 3661 + 24, 48000 * 3662, "=hum", 1, {"level_dbfs": "-50"}),
        ("a.wav", "breaths", 48000, 0, 480, "quiet breath", 0, {}),
        ("a.wav", "breaths", 48000, 1, 480, "unknown", None, None),
    ]
    return spark.createDataFrame(rows, "file string, check string, sample_rate int, start long, stop long, problem string, severity int, measures map<string,string>")


def test_report_comes_back(spark, tmp_path):
    pauses = spark.createDataFrame([("a.wav", 48000, 0, 4800, "head", "head"), ("a.wav", 48000, 9600, 19200, "internal", "short"), ("a.wav", 48000, 48000, 96000, "internal", "long")], "file string, sample_rate int, start long, stop long, kind string, guess string")
    files = spark.createDataFrame([("a.wav",), ("b.wav",), ("c.wav",)], "file string")
    reports.write(str(tmp_path / "r"), files, _findings(spark), pauses)
    issues = spark.read.option("escape", '"').csv(str(tmp_path / "r/issues"), header=True).orderBy("file").collect()
    assert [tuple(r) for r in issues] == [
        ("a.wav", "1:01:01.001", "1:01:02.000", "'=hum", "1", "hum", "level_dbfs=-50"),
        ("b.wav", "0:00:01.000", "0:00:01.002", "dropout: 2.3 ms, \"odd\"", "3", "dropout", "silence_ms=2.3"),
    ]
    listed = spark.read.csv(str(tmp_path / "r/pauses"), header=True).collect()
    assert [(r["guess"], r["duration_s"]) for r in listed] == [("head", "0.1"), ("long", "1.0")]
    whole = {d["file"]: d for d in (json.loads(r[0]) for r in spark.read.text(str(tmp_path / "r/report")).collect())}
    assert set(whole) == {"a.wav", "b.wav", "c.wav"} and len(whole["a.wav"]["findings"]) == 3 and whole["b.wav"]["tally"] == "1 × sev 3, 0 × sev 2, 0 × sev 1"


def test_empty_report(spark, tmp_path):
    none = _findings(spark).where("false")
    reports.write(str(tmp_path / "r"), none.select("file"), none, none.select("file", "sample_rate", "start", "stop", F.lit("").alias("kind"), F.lit("").alias("guess")))
    assert spark.read.text(str(tmp_path / "r/report")).count() == 0


def test_guard_can_be_undone(spark):
    texts = ["=1", "'", "'=1", "plain", "", "-", None, "it's"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", text.cell(F.col("t")))
    assert all(r["t"] == r["p"] for r in df.withColumn("p", text.plain(F.col("c"))).collect())


def _stream(spark, tmp_path, build):
    """What a query gives append by append, over events in three files by time; a far later event closes everything."""
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    last = events.agg(F.max("ts")).first()[0]
    third = F.ntile(3).over(W.partitionBy(F.lit(1)).orderBy("ts"))
    parts = events.withColumn("_n", third).cache()
    for n in (1, 2, 3):
        parts.where(F.col("_n") == n).drop("_n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), (F.lit(last) + F.expr("interval 400 days")).alias("ts"), F.lit(0.0).alias("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = build(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    assert run.awaitTermination(120)
    return events, spark.read.parquet(str(tmp_path / "out")).where("user_id >= 0")


def test_streamed_spans_equal_the_whole_tables(spark, tmp_path):
    def build(s):
        return gaps.sound_spans(s, ["user_id"], "ts", F.col("value") >= 60, "6 hours", "1 day")

    events, got = _stream(spark, tmp_path, build)
    want = build(events)
    assert got.count() == want.count() > 10 and got.exceptAll(want).count() == 0


def test_streamed_counts_equal_the_whole_tables(spark, tmp_path):
    def build(s):
        return gaps.window_counts(s, ["user_id"], "ts", "1 day", "1 day", F.max("value").alias("top"))

    events, got = _stream(spark, tmp_path, build)
    want = build(events)
    assert got.count() == want.count() > 10 and got.exceptAll(want).count() == 0


def test_listings_skipped_files_and_a_csv_for_each_file(spark, tmp_path):
    schema = "file string, check string, sample_rate int, start long, stop long, problem string, severity int, measures map<string,string>"
    findings = spark.createDataFrame([("a\nb.wav", "hum", 1000, 5000, 6000, "=hum", 1, {"k": "v"}), ("a\nb.wav", "noise", 1000, 2000, 6000, "noisy", 3, None), ("a\nb.wav", "breaths", 1000, 100, 200, "quiet breath", 0, None)], schema)
    files = spark.createDataFrame([("a\nb.wav", None, ["mono"]), ("c.wav", "not a WAV file", [])], "file string, error string, notes array<string>")
    found = spark.createDataFrame([("a\nb.wav", 1000, 0, 100, "head", "short head"), ("a\nb.wav", 1000, 3000, 3400, "internal", "x"), ("a\nb.wav", 1000, 3000, 4500, "internal", "long")], "file string, sample_rate int, start long, stop long, kind string, guess string")
    lines = [r.line for r in reports.issue_lines(files, findings, 2).collect()]
    assert lines == ["== a\\nb.wav — 1 × sev 3, 0 × sev 2, 1 × sev 1", "   note: mono", "   0:00:02.000  sev 3  noisy", "== c.wav — 0 × sev 3, 0 × sev 2, 0 × sev 1"]
    assert [r.line for r in reports.pause_lines(found).collect()] == ["== a\\nb.wav", "   0:00:00.000    0.10 s  short head", "   0:00:03.000    1.50 s  long"]
    listed = [(r.file, r.event, r.severity) for r in reports.issues_with_skipped(files, findings, 3).collect()]
    assert listed == [("a\nb.wav", "noisy", 3), ("c.wav", "skipped: not a WAV file", None)]
    rows = [(r.section, r.event) for r in reports.file_rows(files.select("file", "error"), findings, found).where("file <> 'c.wav'").collect()]
    assert rows == [(0, "error: "), (1, "noisy"), (1, "'=hum"), (2, "pause 0.10 s — short head"), (2, "quiet breath"), (2, "pause 1.50 s — long")]
    names = spark.createDataFrame([("a\nb.wav", "a.csv"), ("c.wav", "c.csv")], "file string, name string")
    reports.write_files(str(tmp_path / "r"), names, reports.file_rows(files.select("file", "error"), findings))
    back = spark.read.csv(str(tmp_path / "r/name=a.csv"), header=True, multiLine=True).collect()
    assert [r.event for r in back] == ["error: ", "noisy", "'=hum", "quiet breath"]
    assert (tmp_path / "r" / "name=c.csv").is_dir()


def test_long_files_have_more_json_lines(spark):
    findings = spark.range(2500).selectExpr("'a' AS file", "'hum' AS check", "1000 AS sample_rate", "id AS start", "id + 1 AS stop", "'x' AS problem", "2 AS severity", "map('k', 'v') AS measures")
    none = findings.where("false").selectExpr("file", "sample_rate", "start", "stop", "'' AS kind", "'' AS guess")
    got = [json.loads(r.report) for r in reports.documents(spark.createDataFrame([("a",), ("b",)], "file string"), findings, none).orderBy("file", "chunk").collect()]
    assert [(d["file"], d["chunk"], len(d.get("findings", []))) for d in got] == [("a", 0, 1000), ("a", 1, 1000), ("a", 2, 500), ("b", 0, 0)]
    assert got[0]["tally"] == "0 × sev 3, 2500 × sev 2, 0 × sev 1" and [f["start"] for d in got[:3] for f in d["findings"]] == list(range(2500))


def test_names_are_numbered_past_those_taken(spark):
    files = spark.createDataFrame([("/x/A.wav",), ("/y/a.WAV",), ("/z/a.wav",), ("/x/b.wav",), ("/x/" + "n" * 252 + ".wav",)], "file string")
    taken = spark.createDataFrame([("a (2).csv",), ("B.csv",), ("b (3).csv",)], "name string")
    got = {r.file: (r.name, r.error) for r in reports.numbered(files, taken).collect()}
    assert [got[f][0] for f in ("/x/A.wav", "/y/a.WAV", "/z/a.wav", "/x/b.wav")] == ["A.csv", "a (3).csv", "a (4).csv", "b (2).csv"]
    assert got["/x/" + "n" * 252 + ".wav"] == (None, "the numbered name is too long")


def test_names_are_shown_with_escapes(spark):
    names = ["plain é 中", "a\nb\tc\rd", "x\x07y", "no​space ", "\U000e0001", None, ""]
    want = ["".join(c if c.isprintable() else c.encode("unicode_escape").decode() for c in n) if n is not None else None for n in names]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.printable(F.col("n")).alias("p"))
    assert [r.p for r in df.collect()] == want
