"""Small building blocks of column expressions: names for intermediate values, running sums, matches with offsets, normal tails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def running_sums(values: Column) -> Column:
    """Sum of values[0..i] for each i, by blocks, so that long arrays do not take quadratic time."""
    block = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda j: total(F.slice(a, j * _BLOCK + 1, F.lit(_BLOCK))))
    before = lambda a: F.aggregate(block(a), F.array(F.lit(0).cast("bigint")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    inside = lambda a, i: F.floor(i / _BLOCK).cast("int")
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(values, lambda a: let(before(a), lambda b: F.transform(
        a, lambda x, i: F.get(b, inside(a, i)) + total(F.slice(a, inside(a, i) * _BLOCK + 1, i - inside(a, i) * _BLOCK + 1))))))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern: array of (start, end, part), offsets in code points, part = the group's text."""
    kind = "array<struct<start: bigint, end: bigint, part: string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    rows = lambda m: let(part if group else m, lambda g: let(running_sums(F.transform(between, lambda p: F.length(p).cast("bigint"))), lambda gaps: let(
        running_sums(F.transform(m, lambda x: F.length(x).cast("bigint"))), lambda done: F.transform(m, lambda x, i: F.struct(
            (F.get(gaps, i) + F.get(done, i) - F.length(x)).alias("start"), (F.get(gaps, i) + F.get(done, i)).alias("end"), F.get(g, i).alias("part"))))))
    return let(found, lambda m: F.when(F.size(m) > 0, rows(m)).otherwise(F.array().cast(kind))).cast(kind)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, by a five-term approximation (error below 1e-7)."""
    # Coefficients of the approximation.
    b1, b2, b3, b4, b5, scale = 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429, 0.2316419
    def positive(x: Column) -> Column:
        t = 1 / (1 + scale * x)
        return F.exp(-x * x / 2) * 0.3989422804014327 * t * (b1 + t * (b2 + t * (b3 + t * (b4 + t * b5))))
    return F.greatest(F.when(z >= 0, positive(z)).otherwise(1 - positive(-z)), F.lit(1e-18))
