"""Column helpers that the operators on DataFrame functions alone share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """All matches of pattern in text, in order; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def gaps(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches: one more than there are matches."""
    return F.split(text, pattern, -1)


def starts(found: Column, between: Column) -> Column:
    """The character offset of each match.

    Lengths are summed in blocks of about the root of their number, then the blocks' sums, so that a text with very
    many matches does not cost the square of their number."""
    none = F.array().cast("array<int>")
    running = lambda first, steps: F.aggregate(steps, F.array(first), lambda acc, d: F.array_append(acc, F.element_at(acc, -1) + d))

    def placed(found: Column, between: Column) -> Column:
        n = F.size(found)
        size = F.greatest(F.lit(1), F.sqrt(n.cast("double")).cast("int"))
        steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(between, i + 1)))
        parts = let(steps, lambda s: F.transform(F.sequence(F.lit(1), n, size), lambda at: F.slice(s, at, size)))
        total = lambda p: F.aggregate(p, F.lit(0), lambda a, d: a + d)

        def joined(parts: Column) -> Column:
            bases = running(F.length(F.get(between, F.lit(0))), F.transform(parts, total))
            inner = lambda p, base: F.slice(running(base, p), F.lit(1), F.size(p))
            return let(bases, lambda b: F.flatten(F.transform(parts, lambda p, k: inner(p, F.get(b, k)))))

        return let(parts, joined)

    return let(found, lambda f: F.when(F.size(f) > 0, let(between, lambda b: placed(f, b))).otherwise(none))
