"""Column functions on arrays: what would take a window over exploded rows, within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one step of a running sum copies at most, but for a sum for each such step.
STEP = 32


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column) -> Column:
    """Sums of the first 0, 1, ... numbers, as longs: one more than there are numbers. Sums go in two levels, so that long arrays aren't copied for each element."""

    def sums(part: Column, base: Column) -> Column:
        return F.aggregate(part, F.array(base.cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def levels(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / STEP).cast("int")), lambda i: F.slice(a, i * STEP + 1, STEP))
        total = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc + x)
        inner = lambda ps, bases: F.flatten(F.transform(ps, lambda p, i: let(sums(p, F.get(bases, i)), lambda s: F.slice(s, 1, F.size(s) - 1))))
        both = lambda ps, bases: F.array_append(inner(ps, bases), F.element_at(bases, -1))
        return let(parts, lambda ps: let(sums(F.transform(ps, total), F.lit(0)), lambda bases: both(ps, bases)))

    return let(numbers, lambda a: F.when(F.size(a) <= STEP, sums(a, F.lit(0))).otherwise(levels(a)))
