"""Small column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_word(col: Column | str) -> Column:
    """What remains up to the first white space after leading white space is dropped;
    null stays null, a blank text gives ''."""
    return F.regexp_extract(col, r"^\s*(\S*)", 1)


def clean_residues(col: Column | str) -> Column:
    """Upper case, letters A to Z only; letters are picked before they are raised, as upper()
    turns some characters into several. Null becomes ''."""
    return F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), "[^A-Za-z]", ""))
