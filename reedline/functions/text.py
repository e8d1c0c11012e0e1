"""Texts of reports as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cell that begins with one of these gets a quote before it. The quote is among them, so that plain() finds every guard.
FORMULA_START = ["=", "+", "-", "@", "\t", "\r", "'"]


def clock(sample: Column, rate: Column) -> Column:
    """H:MM:SS.mmm of a sample; milliseconds are rounded half up. Null or no rate: null."""
    ms = F.floor((sample * 2000 + rate) / (rate * 2)).cast("long")
    at = F.when(rate > 0, ms)
    return F.when(at.isNotNull(), F.format_string("%d:%02d:%02d.%03d", F.floor(at / 3_600_000), F.floor(at / 60_000) % 60, F.floor(at / 1000) % 60, at % 1000))


def cell(text: Column) -> Column:
    """A text that no spreadsheet takes for a formula."""
    return F.when(F.substring(text, 1, 1).isin(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def plain(text: Column) -> Column:
    """The text that cell() was given."""
    guarded = text.startswith("'") & F.substring(text, 2, 1).isin(FORMULA_START)
    return F.when(guarded, F.substring(text, 2, 2**31 - 1)).otherwise(text)


def printable(text: Column) -> Column:
    """A name for a line of a report: characters that can't be printed (controls, formats, separators other than the blank) as escapes of their code."""
    code = F.ascii  # the code point of a text's first character

    def shown(c: Column) -> Column:
        width = F.when(code(c) < 256, F.format_string("\\x%02x", code(c))).when(code(c) < 65_536, F.format_string("\\u%04x", code(c))).otherwise(F.format_string("\\U%08x", code(c)))
        named = F.when(c == "\n", "\\n").when(c == "\t", "\\t").when(c == "\r", "\\r").otherwise(width)
        return F.when(c.rlike(r"[\p{C}\p{Z}&&[^ ]]"), named).otherwise(c)

    return F.when(text.rlike(r"[\p{C}\p{Z}&&[^ ]]"), F.array_join(F.transform(F.split(text, ""), shown), "")).otherwise(text)


def tally(severity: Column) -> Column:
    """How many rows of a group have each severity, worst first."""
    return F.concat_ws(", ", *[F.concat(F.count_if(severity == s).cast("string"), F.lit(f" × sev {s}")) for s in (3, 2, 1)])


def measures(values: Column) -> Column:
    """A map of texts as k=v; k=v, keys in order; empty and null values are left out."""
    shown = F.filter(F.map_entries(values), lambda e: e["value"] != "")
    return F.array_join(F.transform(F.array_sort(shown), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")


def csv_line(cells: Column) -> Column:
    """A line of CSV of an array of texts (null: empty), quoted where it must be, with its ending."""
    shown = F.transform(cells, lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))))
    return F.concat(F.array_join(shown, ","), F.lit("\r\n"))


def dbfs(level: Column) -> Column:
    """A level with a true minus, which no spreadsheet takes for a formula; n/a where there is none."""
    return F.when(level.isNotNull(), F.concat(F.replace(F.format_string("%.1f", level), F.lit("-"), F.lit("\u2212")), F.lit(" dBFS"))).otherwise("n/a")
