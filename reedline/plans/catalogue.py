"""All queries of the reference's operators, bound to the test tables."""

from reedline.plans import relations, sequence, sound, spectral
from reedline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "relations", "sequence", "sound", "spectral"]
