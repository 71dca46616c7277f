"""Arrays of numbers as vectors and as probabilities, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with `value` in the expression, and evaluated, once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def unit(v: Column) -> Column:
    """`v` of length 1; zero vectors stay."""
    length = norm(v)
    return F.when(length > 0, F.transform(doubles(v), lambda x: x / length)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """exp(x/T) by its sum, shifted by the maximum; -Infinity has probability 0."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    exps = let(logits, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / t))))
    return let(exps, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_sum_exp(logits: Column, temperature: float = 1.0) -> Column:
    """T * log(sum(exp(x/T)))."""
    t = F.lit(float(temperature))
    return let(logits, lambda v: let(F.array_max(v), lambda top: top + t * F.log(total(F.transform(v, lambda x: F.exp((x - top) / t))))))


def places(parents: list[int]) -> Column:
    return F.array(*map(F.lit, parents))


def group_sums(probs: Column, parents: list[int], groups: int) -> Column:
    """Sums of the probabilities of each group's members."""
    return let(probs, lambda v: F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: total(F.zip_with(v, places(parents), lambda p, c: F.when(c == g, p).otherwise(0.0)))))


def within_group(probs: Column, general: Column, parents: list[int]) -> Column:
    """Each member's share of its group."""
    return let(general, lambda g: F.zip_with(probs, places(parents), lambda p, c: p / F.greatest(g[c], F.lit(1e-12))))


def argmax(v: Column) -> Column:
    """0-based place of the first maximum."""
    return let(v, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))
