"""Terms and bags of review records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that do not belong to a term when they surround it.
BLANKS = " \t"


def term(ts: Column) -> Column:
    """lower(ts) without surrounding blanks and tabs; null stays null."""
    return F.btrim(F.lower(ts), F.lit(BLANKS))


def counts_in_bag(ts: Column, tfreq: Column) -> Column:
    """True for an entry that adds to its record's bag: a term that is not blank and a frequency of 1 or more."""
    return F.coalesce((term(ts) != "") & (tfreq >= 1), F.lit(False))
