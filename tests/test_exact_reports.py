"""Names that never meet, exact files that are whole or absent, and whole reports read back."""

import csv
import io
import json
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from reedline.sources import exact_files, reports

FINDINGS = "file string, check string, sample_rate int, start long, stop long, problem string, severity int, measures map<string,string>"
PAUSES = "file string, sample_rate int, start long, stop long, kind string, guess string"


def named(spark, files, taken=(), **more):
    got = reports.numbered(spark.createDataFrame([(f,) for f in files], "file string"), spark.createDataFrame([(t,) for t in taken], "name string"), **more).collect()
    return {r.file: (r.name, r.error) for r in got}


def test_a_file_that_is_numbered_itself_keeps_out_of_the_way(spark):
    files = ["a/x.wav", "b/x.wav", "c/x (2).wav", "d/Straße.wav", "e/STRASSE.wav"]
    got = named(spark, files)
    assert [got[f][0] for f in files] == ["x.csv", "x (2).csv", "x (2) (2).csv", "Straße.csv", "STRASSE (2).csv"]
    composed, parts = "café", unicodedata.normalize("NFD", "café")
    two = named(spark, [f"a/{composed}.wav", f"b/{parts}.wav"], ["X.CSV", "x (3).csv"])
    assert sorted(n for n, _ in two.values()) == sorted([f"{composed}.csv", f"{parts} (2).csv"])
    assert [n for n, _ in named(spark, ["a/x.wav", "b/x.wav"], ["X.CSV", "x (3).csv"]).values()] == ["x (2).csv", "x (4).csv"]


@pytest.mark.parametrize("seed", range(3))
def test_names_equal_one_after_another_and_never_meet(spark, seed):
    r = random.Random(seed)
    stems = ["x", "X", "x (2)", "x (2) (2)", "y", "ß", "SS", "ss (3)", "é", "é", "(2)", " (2)"]
    files = [f"{k:03d}/{r.choice(stems)}.wav" for k in range(80)]
    taken = r.sample(["x.csv", "X (4).csv", "Y.csv", "ss (2).csv", "other.txt"], 3)
    seen, want = {reports.name_key(t) for t in taken}, {}
    for f in sorted(files):
        stem = f.split("/")[1][:-4]
        k = 1
        while reports.name_key(name := f"{stem}.csv" if k == 1 else f"{stem} ({k}).csv") in seen:
            k += 1
        seen.add(reports.name_key(name))
        want[f] = (name, None)
    got = named(spark, files, taken)
    assert got == want and len({reports.name_key(n) for n, _ in got.values()}) == len(files)


def test_names_beside_their_files(spark):
    got = named(spark, ["/a/x.wav", "/b/x.wav", "/b/y.wav", "/b/y.bwf"], ["/b/x.csv"], beside=True)
    assert got["/a/x.wav"][0] == "x.csv" and got["/b/x.wav"][0] == "x (2).csv" and {got["/b/y.wav"][0], got["/b/y.bwf"][0]} == {"y (2).csv", "y (3).csv"}


def lines_of(spark, table):
    return spark.createDataFrame([(p, k, line) for p, lines in table.items() for k, line in enumerate(lines)], "path string, k int, line string").repartition(4)


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), newline="").read() for d, _, names in os.walk(root) for f in names}


def test_files_are_exact_and_told_of(spark, tmp_path):
    table = {f"d{k % 3}/f{k}.txt": [f"{j}\n" for j in range(k)] for k in range(1, 9)} | {"é.csv": ["﻿a,b\r\n", "no end"]}
    exact_files.write(lines_of(spark, table), str(tmp_path / "out"), ["k"], str(tmp_path / "progress"))
    assert tree(tmp_path / "out") == {p: "".join(x) for p, x in table.items()}
    told = [json.loads(x) for x in open(tmp_path / "progress")]
    assert {t["file"]: t["bytes"] for t in told} == {p: len("".join(x).encode()) for p, x in table.items()}


def test_failed_and_clashing_jobs_leave_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    exact_files.write(lines_of(spark, {"a.txt": ["one\n"]}), out, ["k"])
    for table in ({"b.txt": ["x"], "a.txt": ["two\n"], "c.txt": ["y"]}, {"b.txt": ["x"], "../away.txt": ["y"]}):
        with pytest.raises(Exception):
            exact_files.write(lines_of(spark, table), out, ["k"])
        assert tree(out) == {"a.txt": "one\n"} and not (tmp_path / "away.txt").exists()
    slow = lines_of(spark, {f"f{k}.txt": [str(j) for j in range(50)] for k in range(20)})
    failing = slow.withColumn("line", F.when((F.col("path") == "f7.txt") & (F.col("k") == 40), F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception):
        exact_files.write(failing, out, ["k"])
    assert tree(out) == {"a.txt": "one\n"}


def report(spark):
    files = spark.createDataFrame(
        [("/in/a\nb.wav", 1000, 24, 1, 9000, -20.25, None, ["mono"], None, {"breaths": 7, "breaths_listed": 2, "quiet_breaths": 1}), ("/in/c.wav", None, None, None, None, None, None, [], "not a WAV file", None)],
        "file string, sample_rate int, bit_depth int, channels int, n_samples long, narration_db double, noise_floor_db double, notes array<string>, error string, counts map<string,long>",
    )
    findings = spark.createDataFrame([("/in/a\nb.wav", "hum", 1000, 5000, 6000, "=hum", 1, {"k": "v, w"}), ("/in/a\nb.wav", "noise", 1000, 2000, 6000, 'noisy "bit"', 3, None), ("/in/a\nb.wav", "breaths", 1000, 100, 200, "quiet breath", 0, None), ("/in/a\nb.wav", "breaths", 1000, 300, 400, "breath cut off into silence", 0, None)], FINDINGS)
    found = spark.createDataFrame([("/in/a\nb.wav", 1000, 0, 100, "head", "short head"), ("/in/a\nb.wav", 1000, 3000, 3400, "internal", "x"), ("/in/a\nb.wav", 1000, 3000, 4500, "internal", "long")], PAUSES)
    return files, findings, found


def cells(raw):
    return list(csv.reader(io.StringIO(raw.removeprefix("﻿"), newline="")))


def test_the_csv_of_a_file(spark, tmp_path):
    files, findings, found = report(spark)
    names = spark.createDataFrame([("/in/a\nb.wav", "a.csv"), ("/in/c.wav", "c.csv")], "file string, name string")
    reports.write_file_reports(str(tmp_path / "r"), files, findings, names, found, {"version": "1", "rules": "standard"})
    got = tree(tmp_path / "r")
    assert set(got) == {"a.csv", "c.csv"} and got["a.csv"].startswith("﻿Reedline report,1\r\n")
    rows = cells(got["a.csv"])
    assert rows[1:9] == [
        ["file", "a\nb.wav"], ["folder", "/in"], ["format", "24-bit", "1 kHz", "1 channel"], ["duration", "0:00:09.000"], ["problem events", "2", "1 × sev 3", "0 × sev 2", "1 × sev 1"],
        ["informational events", "4", "1 quiet breaths", "2 pauses", "1 breaths cut off into silence"], ["breaths", "7", "2 problems", "0 mouth-click inhales", "1 quiet"], ["narration level", "−20.3 dBFS"],
    ]
    assert rows[9:12] == [["noise floor", "n/a"], ["rules", "standard"], ["notes", "", "", "mono"]]
    at = rows.index(reports.ISSUE_COLUMNS)
    assert [r[3:6] for r in rows[at + 1 : at + 3]] == [['noisy "bit"', "3", "noise"], ["'=hum", "1", "hum"]] and rows[at + 2][6] == "k=v, w"
    second = rows.index(reports.ISSUE_COLUMNS, at + 1)
    assert [r[3] for r in rows[second + 1 :]] == ["pause 0.10 s — short head", "quiet breath", "breath cut off into silence", "pause 1.50 s — long"]
    with pytest.raises(Exception):
        reports.write_file_reports(str(tmp_path / "r"), files, findings, names)
    assert tree(tmp_path / "r") == got
    reports.write_file_reports(str(tmp_path / "s"), files, findings, names)
    assert cells(tree(tmp_path / "s")["c.csv"])[-1][3] == reports.NO_PAUSES


def test_the_five_files_of_a_run(spark, tmp_path):
    files, findings, found = report(spark)
    reports.write_run(str(tmp_path / "r"), files, findings, found, 2, {"version": "1", "breath model": "on"})
    got = tree(tmp_path / "r")
    assert sorted(got) == sorted(reports.RUN_FILES)
    issues = cells(got["issues.csv"])
    assert got["issues.csv"].startswith("﻿file,") and issues == [reports.ISSUE_COLUMNS, ["/in/a\nb.wav", "0:00:02.000", "0:00:06.000", 'noisy "bit"', "3", "noise", ""], ["/in/c.wav", "", "", "skipped: not a WAV file", "", "file", ""]]
    assert cells(got["pauses.csv"]) == [reports.PAUSE_COLUMNS, ["/in/a\nb.wav", "0:00:00.000", "0.10", "short head", "head"], ["/in/a\nb.wav", "0:00:03.000", "1.50", "long", "internal"]]
    lines = got["issues.txt"].split("\n")
    assert lines[0] == "Reedline report 1 — rules: standard" and "Breath model: on." in lines and "Listing severity 2 and above only." in lines
    assert lines[-6:] == ["== /in/a\\nb.wav — 1 × sev 3, 0 × sev 2, 1 × sev 1", "   note: mono", '   0:00:02.000  sev 3  noisy "bit"', "", "== /in/c.wav — 0 × sev 3, 0 × sev 2, 0 × sev 1", ""]
    assert got["pauses.txt"].endswith("\n\n== /in/a\\nb.wav\n   0:00:00.000    0.10 s  short head\n   0:00:03.000    1.50 s  long\n")
    whole = json.loads(got["report.json"])
    assert {f["file"] for f in whole["files"]} == {"/in/a\nb.wav", "/in/c.wav"} and whole["context"]["breath model"] == "on" and whole["settings"]["hum"]["tracks"]["least_s"] == 3.0
    assert [f["problem"] for f in whole["files"][0]["findings"]] == ["quiet breath", "breath cut off into silence", 'noisy "bit"', "=hum"]
