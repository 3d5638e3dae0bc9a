"""Text helpers of the exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xml_escape(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def pad_end(c: Column, width: int) -> Column:
    """Pad with spaces to a width; longer strings stay whole."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(c))))


def two_decimals(c: Column) -> Column:
    """A number with at most two decimals and no zeros behind."""
    scaled = F.floor(c * F.lit(100.0) + F.lit(0.5)).cast("decimal(18,2)") / F.lit(100)
    return F.regexp_replace(F.regexp_replace(scaled.cast("decimal(18,2)").cast("string"), "0+$", ""), "\\.$", "")


def file_name(c: Column) -> Column:
    """A safe file name; 'pattern' if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")), F.lit("")), F.lit("pattern"))
