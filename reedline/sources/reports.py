"""Reports: the five files of a run and a CSV a file as exact files, or folders that Spark writes. Nothing is collected; an existing report is not overwritten.

Findings have file, check, sample_rate, start, stop, problem, severity (0: informational) and measures (map of texts); pauses have file,
sample_rate, start, stop, kind and guess. More columns are left out. Null severity counts as 0.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedline.functions import text
from reedline.sources import exact_files

#: Fixed value: inner pauses from so many seconds are listed, those at head and tail always.
PAUSE_LISTED_S = 0.5
#: Findings in one JSON line; a file with more has more lines.
CHUNK = 1000
#: The sections of a file's CSV, in order.
SUMMARY, PROBLEMS, INFORMATIONAL = 0, 1, 2


def tunables() -> dict:
    """All values that change what is found, by check: what a report says of how it was made."""
    from reedline.operators import breaths, defects, hum, sound, voice

    return {
        "activity": voice.ACTIVITY, "speech": voice.SPEECH, "pauses": voice.RULES | {"paragraphs": voice.PARAGRAPHS}, "dropouts": sound.DROPOUT, "invalid": sound.INVALID, "gates": sound.GATES,
        "clicks": defects.CLICK, "ticks": defects.TICK, "noise": defects.NOISE, "plosives": defects.POP | {"clip_start": defects.CLIP_START}, "clip_ends": defects.CLIP_END,
        "hum": {"lines": hum.LINE, "tracks": hum.TRACK, "harmonics": hum.HARMONIC, "pauses": hum.PAUSE, "filled": hum.FILLED, "hidden": hum.HIDDEN, "edges": hum.EDGE},
        "breaths": {"loudness": breaths.LOUD_DB, "click": breaths.CLICK, "confirm": breaths.CONFIRM, "cut": breaths.CUT},
    }


def issues(findings: DataFrame, least: int = 1) -> DataFrame:
    """Rows of the issue list: severities of least and more, in order of file, start, and worst first; severity 0 is blank."""
    s = F.coalesce("severity", F.lit(0))
    rate = F.col("sample_rate")
    return findings.where(s >= least).orderBy("file", "start", s.desc(), "check", "problem").select(
        text.cell(F.col("file")).alias("file"), text.clock(F.col("start"), rate).alias("start_time"), text.clock(F.col("stop"), rate).alias("end_time"),
        text.cell(F.col("problem")).alias("event"), F.when(s > 0, s).alias("severity"), "check", text.cell(text.measures(F.col("measures"))).alias("measures"),
    )


def issues_with_skipped(files: DataFrame, findings: DataFrame, least: int = 1) -> DataFrame:
    """The issue list with a row for each file that couldn't be read, its reason as the event. files: file and error (null: readable)."""
    none = F.lit("")
    skipped = files.where("error is not null").select(
        text.cell(F.col("file")).alias("file"), none.alias("start_time"), none.alias("end_time"), text.cell(F.concat(F.lit("skipped: "), "error")).alias("event"),
        F.lit(None).cast("int").alias("severity"), F.lit("file").alias("check"), none.alias("measures"),
    )
    return skipped.unionByName(issues(findings, least)).orderBy("file", "start_time")


def issue_lines(files: DataFrame, findings: DataFrame, least: int = 1) -> DataFrame:
    """The text listing, one row a line (file, place, line): a heading with the tally of all severities, notes, then the issues listed. files: file, notes (array)."""
    s = F.coalesce("severity", F.lit(0))
    tallies = files.select("file", "notes").join(findings.groupBy("file").agg(text.tally(F.col("severity")).alias("tally")), "file", "left")
    nothing = F.lit("0 × sev 3, 0 × sev 2, 0 × sev 1")
    heads = tallies.select("file", F.lit(0).cast("long").alias("place"), F.concat(F.lit("== "), text.printable(F.col("file")), F.lit(" — "), F.coalesce("tally", nothing)).alias("line"))
    notes = files.select("file", F.posexplode("notes").alias("n", "note")).select("file", (F.col("n") + 1).cast("long").alias("place"), F.concat(F.lit("   note: "), "note").alias("line"))
    at = text.clock(F.col("start"), F.col("sample_rate"))
    rows = findings.where(s >= least).select("file", (F.col("start") + (1 << 20)).alias("place"), F.concat(F.lit("   "), at, F.format_string("  sev %d  ", s), "problem").alias("line"))
    return heads.unionByName(notes).unionByName(rows).orderBy("file", "place", "line")


def pause_lines(found: DataFrame) -> DataFrame:
    """The pause map as text, one row a line (file, place, line)."""
    listed = _listed(found)
    heads = found.select("file").distinct().select("file", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("== "), text.printable(F.col("file"))).alias("line"))
    seconds = F.round((F.col("stop") - F.col("start")) * 1000 / F.col("sample_rate")) / 1000
    rows = listed.select("file", F.col("start").alias("place"), F.concat(F.lit("   "), text.clock(F.col("start"), F.col("sample_rate")), F.format_string("  %6.2f s  ", seconds), "guess").alias("line"))
    return heads.unionByName(rows).orderBy("file", "place")


def file_rows(files: DataFrame, findings: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """What the CSV of each file holds, in order: file, section, start, file_cell, start_time, end_time, event, severity, check, measures.

    Sections: SUMMARY (names and values of files' columns), PROBLEMS (severity 1 and more), INFORMATIONAL (severity 0, and listed pauses if found is given).
    """
    s = F.coalesce("severity", F.lit(0))
    rate, none = F.col("sample_rate"), F.lit("")
    known = F.create_map(*[x for c in files.columns if c != "file" for x in (F.lit(c), F.col(c).cast("string"))])
    facts = files.select("file", F.posexplode(F.map_entries(known)).alias("n", "fact"))
    facts = facts.select("file", F.lit(SUMMARY).alias("section"), F.col("n").cast("long").alias("start"), none.alias("start_time"), none.alias("end_time"), F.concat_ws(": ", "fact.key", F.coalesce("fact.value", none)).alias("event"), none.alias("severity"), none.alias("check"), none.alias("measures"))
    rows = findings.select(
        "file", F.when(s > 0, PROBLEMS).otherwise(INFORMATIONAL).alias("section"), "start", text.clock(F.col("start"), rate).alias("start_time"), text.clock(F.col("stop"), rate).alias("end_time"),
        text.cell(F.col("problem")).alias("event"), F.when(s > 0, s.cast("string")).otherwise("").alias("severity"), "check", text.cell(text.measures(F.col("measures"))).alias("measures"),
    )
    out = facts.unionByName(rows)
    if found is not None:
        seconds = (F.col("stop") - F.col("start")) / rate
        out = out.unionByName(_listed(found).select(
            "file", F.lit(INFORMATIONAL).alias("section"), "start", text.clock(F.col("start"), rate).alias("start_time"), text.clock(F.col("stop"), rate).alias("end_time"),
            F.format_string("pause %.2f s — %s", seconds, "guess").alias("event"), none.alias("severity"), F.lit("pause").alias("check"), F.format_string("kind=%s; duration_s=%.3f", "kind", seconds).alias("measures"),
        ))
    return out.withColumn("file_cell", text.cell(F.col("file"))).orderBy("file", "section", "start", "event")


def write_files(path: str, names: DataFrame, rows: DataFrame) -> None:
    """A folder for each file under path, with its CSV: rows is file_rows, names (file, name) as numbered() gives them. Existing ones are not touched."""
    named = rows.join(names.select("file", "name"), "file").drop("file").withColumnRenamed("file_cell", "file")
    ordered = named.repartition("name").sortWithinPartitions("name", "section", "start", "event").drop("start")
    ordered.write.mode("errorifexists").partitionBy("name").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)


#: Fixed value: bytes of a name that file systems take.
LONGEST_NAME, MOST_NUMBERED = 255, 10_000


def name_key(name: str) -> str:
    """What file systems that pass over case and Unicode forms take for the same name."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", name).casefold())


def numbered(files: DataFrame, taken: DataFrame, suffix: str = ".csv", beside: bool = False) -> DataFrame:
    """A name of its own for each file's report: file, name, error. 'x.csv', or 'x (2).csv' and so on, the first that neither an earlier file (by path) has nor taken (name) holds.

    Names are compared without regard to case and Unicode form, and over all files together: the numbered name of one file is never another's, though that one be called 'x (2)' itself. Only names that are one once
    their numbers are taken off can meet, so those are one group, of which only names are kept in memory. beside: reports lie in the folder of their file, so names are told apart by
    folder, and a name that is another sound file's own is passed over. A name beyond LONGEST_NAME bytes or MOST_NUMBERED tries is an error instead.
    """
    path = F.col("file")
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    folder = F.regexp_replace(path, "[^/]*$", "") if beside else F.lit("")
    own = files.select(folder.alias("folder"), base.alias("base"), "file")
    held = taken.select((F.regexp_replace("name", "[^/]*$", "") if beside else F.lit("")).alias("folder"), F.element_at(F.split("name", "/"), -1).alias("base"), F.lit(None).cast("string").alias("file"))

    def keyed(batches):
        for batch in batches:
            stems = batch["base"].where(batch["file"].notna(), batch["base"].str.removesuffix(suffix).str.replace(r"\.[^.]*$", "", regex=True))
            yield batch.assign(root=[re.sub(r"( \(\d+\))+$", "", name_key(x)) for x in stems])

    def named(part: pd.DataFrame) -> pd.DataFrame:
        mine = part[part["file"].notna()].sort_values("file")
        seen = {name_key(x) for x in part.loc[part["file"].isna(), "base"]}
        stems: dict[str, int] = {}
        for x in mine["base"]:
            stems[name_key(x)] = stems.get(name_key(x), 0) + 1
        start: dict[str, int] = {}
        rows = []
        for file, stem in zip(mine["file"], mine["base"]):
            key = name_key(stem)
            name, why = None, "no free name"
            for k in range(start.get(key, 1), MOST_NUMBERED):
                tried = stem if k == 1 else f"{stem} ({k})"
                start[key] = k + 1
                if len((tried + suffix).encode()) > LONGEST_NAME:
                    why = "the numbered name is too long"
                    break
                others = stems.get(name_key(tried), 0) - (name_key(tried) == key) if beside else 0
                if name_key(tried + suffix) not in seen and not others:
                    name, why = tried + suffix, None
                    break
            if name:
                seen.add(name_key(name))
            rows.append((file, name, why))
        return pd.DataFrame(rows, columns=["file", "name", "error"])

    both = own.unionByName(held).mapInPandas(keyed, "folder string, base string, file string, root string")
    return both.groupBy("folder", "root").applyInPandas(named, "file string, name string, error string")


#: Fixed texts of a file's CSV and of the listings.
MARKER = "Reedline report"
PROBLEM_LABEL, PROBLEM_NOTE = "PROBLEM EVENTS", "severity 3 = worst, 2 = likely to draw a note, 1 = worth a listen"
INFORMATIONAL_LABEL, INFORMATIONAL_NOTE = "INFORMATIONAL EVENTS", "quiet breaths, breaths cut off into silence and, when asked for, the pause map; no severity"
NO_PAUSES = "pause map not included (pause rows are off)"
CUT_OFF = "breath cut off into silence"
ISSUE_COLUMNS = ["file", "start_time", "end_time", "event", "severity", "check", "measures"]
PAUSE_COLUMNS = ["file", "start_time", "duration_s", "guess", "kind"]
LEGEND = ["Severity 3 = worst, 2 = likely to draw a note, 1 = worth a listen.", "Nothing here fails a delivery: it tells you where to listen first.", "Times are from the start of each file (H:MM:SS.mmm)."]
PAUSE_LEGEND = ["Informational. The kind of each pause is a GUESS from its length alone;", "the tool cannot see headings, sections or paragraphs."]
CONTEXT = ["rules", "chopped-word check", "breath model", "analysed"]
BOM = "\ufeff"
RUN_FILES = ["issues.txt", "issues.csv", "pauses.txt", "pauses.csv", "report.json"]


def _cells(*cells) -> Column:
    return text.csv_line(F.array(*[c.cast("string") if isinstance(c, Column) else F.lit(c).cast("string") for c in cells]))


def summary_lines(files: DataFrame, findings: DataFrame, found: DataFrame | None = None, context: dict | None = None) -> DataFrame:
    """The summary block of each file's CSV: file, place, line. A label, then one short fact a cell.

    files: file, and of sample_rate, bit_depth, channels, n_samples, narration_db, noise_floor_db, breath_model, notes (array) and counts (a map: breaths, breaths_listed, mouth_click_inhales, quiet_breaths,
    breaths_cut_off, breaths_not_confirmed) what there is. context: version, and values of CONTEXT.
    """
    context = context or {}
    s = F.coalesce("severity", F.lit(0))
    cut = (s == 0) & (F.col("problem") == CUT_OFF)
    sums = findings.groupBy("file").agg(F.count_if(s > 0).alias("_problems"), *[F.count_if(s == k).alias(f"_sev{k}") for k in (3, 2, 1)], F.count_if((s == 0) & ~cut).alias("_quiet"), F.count_if(cut).alias("_cut"))
    rows = files.join(sums, "file", "left")
    if found is not None:
        rows = rows.join(_listed(found).groupBy("file").agg(F.count("*").alias("_pauses")), "file", "left")

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    def of(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in files.columns else F.lit(None).cast(kind)

    def said(number: Column, what: str) -> Column:
        return F.concat(number.cast("string"), F.lit(what))

    def counted(name: str) -> Column:
        return F.coalesce(F.try_element_at("counts", F.lit(name)), F.lit(0)) if "counts" in files.columns else F.lit(0)

    rate, channels = of("sample_rate", "int"), of("channels", "int")
    khz = F.regexp_replace(F.format_string("%.3f", rate / 1000), r"\.?0+$", "")
    facts = [F.concat(of("bit_depth", "string"), F.lit("-bit")), F.concat(khz, F.lit(" kHz")), F.concat(channels.cast("string"), F.when(channels == 1, F.lit(" channel")).otherwise(F.lit(" channels")))]
    pauses = n("_pauses") if found is not None else F.lit(0)
    model = F.coalesce(of("breath_model", "string"), F.lit(context.get("breath model")))
    optional = [F.when(n("_cut") > 0, said(n("_cut"), " breaths cut off into silence"))]
    breaths = [F.lit("breaths"), counted("breaths").cast("string"), said(counted("breaths_listed"), " problems"), said(counted("mouth_click_inhales"), " mouth-click inhales"), said(counted("quiet_breaths"), " quiet")]
    breaths += [F.when(counted("breaths_cut_off") > 0, said(counted("breaths_cut_off"), " cut off into silence")), F.when(counted("breaths_not_confirmed") > 0, said(counted("breaths_not_confirmed"), " not confirmed by the breath model"))]
    has_breaths = F.coalesce(F.map_contains_key("counts", F.lit("breaths")), F.lit(False)) if "counts" in files.columns else F.lit(False)

    def line(*cells) -> Column:
        return text.csv_line(F.array_compact(F.array(*cells)))

    name, folder = F.element_at(F.split("file", "/"), -1), F.regexp_replace("file", "/?[^/]*$", "")
    notes = F.array_join(of("notes", "array<string>"), "; ")
    lines = [
        _cells(MARKER, context.get("version", "")), _cells("file", text.cell(name)), _cells("folder", text.cell(folder)), line(F.lit("format"), *facts), _cells("duration", F.coalesce(text.clock(of("n_samples", "long"), rate), F.lit(""))),
        _cells("problem events", n("_problems"), *[said(n(f"_sev{k}"), f" × sev {k}") for k in (3, 2, 1)]),
        line(F.lit("informational events"), (n("_quiet") + n("_cut") + pauses).cast("string"), said(n("_quiet"), " quiet breaths"), said(pauses, " pauses") if found is not None else F.lit("pause rows off"), *optional),
        F.when(has_breaths, line(*breaths)), _cells("narration level", text.dbfs(of("narration_db", "double"))), _cells("noise floor", text.dbfs(of("noise_floor_db", "double"))),
        *[F.when(F.length(value) > 0, _cells(label, text.cell(value))) for label, value in ((c, model if c == "breath model" else F.lit(context.get(c)).cast("string")) for c in CONTEXT)],
        F.when(F.length(notes) > 0, _cells("notes", "", "", text.cell(notes))),
    ]
    return rows.select("file", F.posexplode(F.array(*lines)).alias("place", "line")).where("line is not null").select("file", F.col("place").cast("long").alias("place"), "line")


def file_lines(files: DataFrame, findings: DataFrame, names: DataFrame, found: DataFrame | None = None, context: dict | None = None) -> DataFrame:
    """The CSV of each file, for exact_files.write: path, section, place, line. names: file and name, as numbered() gives them; files without a name have none."""
    spacer = text.csv_line(F.array(*[F.lit("")] * len(ISSUE_COLUMNS)))
    header = _cells(*ISSUE_COLUMNS)
    fixed = [(1, [spacer, _cells(PROBLEM_LABEL, "", "", PROBLEM_NOTE), spacer, header]), (3, [spacer, spacer, _cells(INFORMATIONAL_LABEL, "", "", INFORMATIONAL_NOTE), spacer, header])]
    if found is None:
        fixed.append((5, [_cells("", "", "", NO_PAUSES)]))
    known = files.select("file").distinct()
    out = summary_lines(files, findings, found, context).withColumn("section", F.lit(0))
    for section, lines in fixed:
        out = out.unionByName(known.select("file", F.posexplode(F.array(*lines)).alias("place", "line")).select("file", F.col("place").cast("long").alias("place"), "line", F.lit(section).alias("section")))
    rows = file_rows(files.select("file"), findings, found).where(F.col("section") != SUMMARY)
    body = rows.select("file", F.col("start").alias("place"), text.csv_line(F.array("file_cell", *ISSUE_COLUMNS[1:])).alias("line"), F.when(F.col("section") == PROBLEMS, 2).otherwise(4).alias("section"))
    out = out.unionByName(body)
    first = (F.col("section") == 0) & (F.col("place") == 0)
    named = out.join(names.where("name is not null").select("file", F.col("name").alias("path")), "file")
    return named.select("path", "section", "place", F.when(first, F.concat(F.lit(BOM), "line")).otherwise(F.col("line")).alias("line"))


def run_lines(files: DataFrame, findings: DataFrame, found: DataFrame, least: int = 1, context: dict | None = None, settings: dict | None = None) -> DataFrame:
    """The five files of a whole run (RUN_FILES), for exact_files.write: path, section, file, place, line.

    files: file, and notes (array) and error where there are. report.json holds the settings (tunables() by default), the context, and for each file its chunks (see documents).
    """
    context = context or {}
    spark = files.sparkSession
    with_error = files if "error" in files.columns else files.withColumn("error", F.lit(None).cast("string"))
    with_notes = with_error if "notes" in files.columns else with_error.withColumn("notes", F.array().cast("array<string>"))
    columns = ["path", "section", "file", "place", "line"]

    def heads(path: str, lines: list[str], end: str) -> DataFrame:
        return spark.createDataFrame([(path, 0, "", k, line + end) for k, line in enumerate(lines)], "path string, section int, file string, place long, line string")

    title = f"{MARKER} {context.get('version', '')}".strip()
    rules = f"rules: {context.get('rules', 'standard')}"
    told = [f"{title} — {rules}", *LEGEND, f"Breath model: {context.get('breath model', 'off')}."] + ([f"Listing severity {least} and above only."] if least > 1 else [])
    issue_text = issue_lines(with_notes, findings, least)
    spaced = F.when(F.col("place") == 0, F.concat(F.lit("\n"), "line", F.lit("\n"))).otherwise(F.concat("line", F.lit("\n")))
    pause_text = pause_lines(found)
    spaced_pauses = F.when(F.col("place") == -1, F.concat(F.lit("\n"), "line", F.lit("\n"))).otherwise(F.concat("line", F.lit("\n")))
    skipped = with_error.where("error is not null").select("file", F.lit(-1).cast("long").alias("place"), _cells(text.cell(F.col("file")), "", "", text.cell(F.concat(F.lit("skipped: "), "error")), "", "file", "").alias("line"))
    s = F.coalesce("severity", F.lit(0))
    rate = F.col("sample_rate")
    listed = findings.where(s >= least).select("file", F.col("start").alias("place"), _cells(text.cell(F.col("file")), text.clock(F.col("start"), rate), text.clock(F.col("stop"), rate), text.cell(F.col("problem")), F.when(s > 0, s), F.col("check"), text.cell(text.measures(F.col("measures")))).alias("line"))
    seconds = (F.col("stop") - F.col("start")) / rate
    gaps = _listed(found).select("file", F.col("start").alias("place"), _cells(text.cell(F.col("file")), text.clock(F.col("start"), rate), F.format_string("%.2f", seconds), F.col("guess"), F.col("kind")).alias("line"))
    reports_ = documents(files, findings, found)
    first = reports_.agg(F.min(F.struct("file", "chunk")).alias("first"))
    texts = reports_.join(F.broadcast(first)).select("file", F.col("chunk").alias("place"), F.concat(F.when(F.struct("file", "chunk") == F.col("first"), "").otherwise(","), "report", F.lit("\n")).alias("line"))  # one row
    top = json.dumps({"context": context, "settings": settings if settings is not None else tunables()}, ensure_ascii=False)[:-1]
    parts = [
        heads("issues.txt", told, "\n"), heads("pauses.txt", [f"{title} — pause map — {rules}", *PAUSE_LEGEND], "\n"), heads("issues.csv", [BOM + ",".join(ISSUE_COLUMNS)], "\r\n"), heads("pauses.csv", [BOM + ",".join(PAUSE_COLUMNS)], "\r\n"), heads("report.json", [top + ', "files": ['], "\n"),
        issue_text.select(F.lit("issues.txt").alias("path"), F.lit(1).alias("section"), "file", "place", spaced.alias("line")), pause_text.select(F.lit("pauses.txt").alias("path"), F.lit(1).alias("section"), "file", "place", spaced_pauses.alias("line")),
        skipped.unionByName(listed).select(F.lit("issues.csv").alias("path"), F.lit(1).alias("section"), "file", "place", "line"), gaps.select(F.lit("pauses.csv").alias("path"), F.lit(1).alias("section"), "file", "place", "line"),
        texts.select(F.lit("report.json").alias("path"), F.lit(1).alias("section"), "file", "place", "line"), heads("report.json", ["]}"], "\n").withColumn("section", F.lit(2)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*columns)


def write_run(folder: str, files: DataFrame, findings: DataFrame, found: DataFrame, least: int = 1, context: dict | None = None, progress: str | None = None) -> None:
    """The five files of a run as exact files: all of them, or none."""
    exact_files.write(run_lines(files, findings, found, least, context), folder, ["section", "file", "place", "line"], progress)


def write_file_reports(folder: str, files: DataFrame, findings: DataFrame, names: DataFrame, found: DataFrame | None = None, context: dict | None = None, progress: str | None = None) -> None:
    """A CSV for each file that has a name, as exact files; none that exists is touched."""
    exact_files.write(file_lines(files, findings, names, found, context), folder, ["section", "place", "line"], progress)


def _listed(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind").isin("head", "tail") | ((F.col("stop") - F.col("start")) / F.col("sample_rate") >= PAUSE_LISTED_S))


def pauses(found: DataFrame) -> DataFrame:
    """Rows of the pause list."""
    seconds = (F.col("stop") - F.col("start")) / F.col("sample_rate")
    start = text.clock(F.col("start"), F.col("sample_rate")).alias("start_time")
    return _listed(found).orderBy("file", "start").select(text.cell(F.col("file")).alias("file"), start, F.round(seconds, 3).alias("duration_s"), "guess", "kind")


def documents(files: DataFrame, findings: DataFrame, found: DataFrame) -> DataFrame:
    """file, chunk and report, a JSON text with tally, findings and pauses in order; every severity is in it, and files without findings are too.

    A file's findings, and its pauses, come CHUNK at a time: chunk 0 has the first of both and the tally of all, so no row grows with a file.
    """
    tallies = findings.groupBy("file").agg(text.tally(F.col("severity")).alias("tally"))
    order = W.partitionBy("file").orderBy("start", "stop")
    chunk = F.floor((F.row_number().over(order) - 1) / CHUNK).alias("chunk")
    some = findings.select("file", chunk, F.struct("start", "stop", "check", "severity", "problem", F.to_json("measures").alias("measures")).alias("one"))
    by_sample = some.groupBy("file", "chunk").agg(F.sort_array(F.collect_list("one")).alias("findings"))
    gaps = found.select("file", chunk, F.struct("start", "stop", "kind", "guess").alias("one")).groupBy("file", "chunk").agg(F.sort_array(F.collect_list("one")).alias("pauses"))
    first = files.select("file", F.lit(0).cast("long").alias("chunk")).distinct().join(tallies, "file", "left")
    rows = first.join(by_sample, ["file", "chunk"], "full").join(gaps, ["file", "chunk"], "full")
    return rows.select("file", "chunk", F.to_json(F.struct("file", "chunk", "tally", "findings", "pauses")).alias("report"))


def write(path: str, files: DataFrame, findings: DataFrame, found: DataFrame, least: int = 1) -> None:
    """Folders issues, pauses (CSV) and report (JSON lines) under path. Each is whole or absent, by Spark's committer."""
    listed = issues_with_skipped(files, findings, least) if "error" in files.columns else issues(findings, least)
    for name, rows in (("issues", listed), ("pauses", pauses(found))):
        rows.write.mode("errorifexists").option("escape", '"').csv(f"{path}/{name}", header=True)
    documents(files, findings, found).select("report").write.mode("errorifexists").text(f"{path}/report")
