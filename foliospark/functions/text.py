"""Numbers out of broker text. Column expressions only, so they stay inside the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _parse(s: Column) -> Column:
    # the pattern keeps out what the JVM would also read as a number: nan, infinity, 5d, 5f
    return F.when(s.rlike(_PLAIN_NUMBER), s.try_cast("double"))


def clean_numeric(c: Column, blank: float | None = 0.0) -> Column:
    """Broker number text to double; ``(x)`` is negative, %, currency and commas go; bad text gives ``blank``.

    The text is used once in the expression: pushed-down filters repeat it, and generated code must stay small.
    Most cells are plain digits, which one look finds out faster than two replacements.
    """
    def number(s: Column) -> Column:
        kept = F.regexp_replace(F.regexp_replace(s, r"(?s)^\((.*)\)$", r"-$1"), r"[^0-9.\-]", "")
        return F.coalesce(F.when(s.rlike(r"\A[0-9.\-]*+\z"), s).otherwise(kept).try_cast("double"), F.lit(blank).cast("double"))
    return F.transform(F.array(c), number)[0]


def safe_float(c: Column, blank: float | None = 0.0) -> Column:
    """As ``clean_numeric`` but brackets anywhere mean negative, % stays (and so fails), letters fail."""
    s = F.regexp_replace(c, "[₹$€£, \"'\\t\\r\\n]", "")
    s = F.regexp_replace(s, r"^([^()]*)\(([^()]*)\)([^()]*)$", r"-$1$2$3")
    return F.coalesce(_parse(s), F.lit(blank).cast("double"))
