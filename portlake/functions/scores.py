"""Expressions over an array<double> of class scores; class k is element k (zero based)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, fn) -> Column:
    """`fn(c)` with `c` evaluated once per row, however often `fn` uses it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def argmax(a: Column) -> Column:
    """Index of the largest score, lowest index on a tie."""
    return let(a, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def ranked_score(a: Column, k: int) -> Column:
    """k-th largest score (k from 1)."""
    return F.element_at(F.sort_array(a, asc=False), k)


def margin(a: Column) -> Column:
    return let(F.sort_array(a, asc=False), lambda s: F.element_at(s, 1) - F.element_at(s, 2))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    def spread(x):
        return let(F.array_max(x), lambda top: let(F.transform(x, lambda v: F.exp((v - top) / temperature)), scale))

    def scale(e):
        return let(total(e), lambda t: F.transform(e, lambda v: v / t))

    return let(a, spread)


def normalise(a: Column) -> Column:
    """Scale to sum one; a row that sums to zero stays as it is."""
    return let(a, lambda x: let(total(x), lambda s: F.when(s > 1e-12, F.transform(x, lambda v: v / s)).otherwise(x)))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda v: v * F.log(v + 1e-12)))


def energy(a: Column) -> Column:
    """log(sum(exp(score)))."""
    return let(F.array_max(a), lambda top: top + F.log(total(F.transform(a, lambda v: F.exp(v - top)))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column, weight: Column | float = 1.0) -> Column:
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return F.zip_with(a, b, lambda x, y: x + w * y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def masked(v: Column, mask: Column) -> Column:
    """Values with unsupported entries null (missing is never zero)."""
    return F.zip_with(v, mask, lambda x, m: F.when(m, x))


def class_scores(classes: int, at) -> Column:
    """Array of one expression per class."""
    return F.array(*[at(k) for k in range(classes)])
