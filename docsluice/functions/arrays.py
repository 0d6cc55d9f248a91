"""Folds over the elements of an array, in time about linear in their number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are put together one by one. The state of a fold is copied at every step, so no fold here has a list for its
#: state that grows with the array: n elements cost about n * PART + (n / PART) ** 2 steps.
PART = 128


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once: a one-element array binds a value inside an expression."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The values of a list so far, put together by an associative op: running sums or maxima, each with its own value."""
    total = lambda xs: F.aggregate(xs, zero, op)

    def inside(part: Column, before: Column) -> Column:
        return F.transform(part, lambda _, i: op(before, total(F.slice(part, F.lit(1), i + 1))))

    def over(parts: Column) -> Column:
        sums = F.transform(parts, total)
        return bound(sums, lambda t: F.flatten(F.transform(parts, lambda part, k: bound(total(F.slice(t, F.lit(1), k)), lambda before: inside(part, before)))))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda k: F.slice(v, k * PART + 1, F.lit(PART)))

    return bound(values, lambda v: F.when(F.size(v) == 0, v).otherwise(bound(cut(v), over)))


#: Characters of a text that are cut off at once where many short stretches are wanted: a place in a text is found from its beginning.
CHUNK = 4096


def chunks(text: Column) -> Column:
    """A text in parts of CHUNK characters."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda k: F.substr(text, k * CHUNK + 1, F.lit(CHUNK)))


def stretch(parts: Column, a: Column, z: Column) -> Column:
    """Characters a to z of a text, from its chunks."""
    first, last = F.floor(a / CHUNK).cast("int"), F.floor((z - 1) / CHUNK).cast("int")
    return F.when(z <= a, "").otherwise(F.substr(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), (a - first * CHUNK + 1).cast("int"), (z - a).cast("int")))
