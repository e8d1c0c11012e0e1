"""Classes and severities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def pause_guess(gap: Column) -> Column:
    """What a pause of that many microseconds is likely to be: sections last a day, within two hours."""
    return (
        F.when(gap.between(22 * HOUR, 26 * HOUR), "section").when(gap > 26 * HOUR, "longer").when(gap > 12 * HOUR, "between").when(gap >= 6 * HOUR, "paragraph").otherwise("shorter")
    )


def decibels(power: Column, least: float = 1e-20) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(least)))


def amplitude_decibels(amplitude: Column, least: float = 1e-10) -> Column:
    return 20 * F.log10(F.greatest(amplitude, F.lit(least)))
