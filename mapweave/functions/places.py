"""Where the matches of a pattern lie in a text, inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(amounts: Column) -> Column:
    """Sum of the amounts before each position. Sums are carried block by block, so a long array takes about 64 steps a position."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def blocks(a: Column) -> Column:
        last = F.floor((F.size(a) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        bases = _let(sums, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: total(F.slice(s, F.lit(1), b))))
        return _let(bases, lambda base: F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda j: _let(
            F.floor(j / BLOCK).cast("int"), lambda b: F.get(base, b) + total(F.slice(a, b * BLOCK + 1, j - b * BLOCK)))))

    return _let(amounts, lambda a: F.when(F.size(a) > 0, blocks(a)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, token) of all matches in order; start counts characters from 0."""
    def placed(tokens: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(tokens)), tokens, lambda g, t: F.length(g) + F.length(t))
        return F.transform(
            F.arrays_zip(running_sums(steps).alias("before"), F.slice(gaps, F.lit(1), F.size(tokens)).alias("gap"), tokens.alias("token")),
            lambda x: F.struct((x["before"] + F.length(x["gap"])).alias("start"), x["token"].alias("token")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: _let(F.split(text, pattern, -1), lambda g: placed(t, g)))
