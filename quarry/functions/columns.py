"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_of(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern in the list that matches."""
    return F.coalesce(*(found(text, p, group) for p in patterns))


def chain(cases: list[tuple[Column, object]], default=None) -> Column:
    """The value of the first case that holds."""
    out = None
    for when, value in cases:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(default)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))

