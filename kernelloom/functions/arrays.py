"""Column expressions over ``array<double>`` series.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(v: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(INF))


def observed(x: Column) -> Column:
    """``x`` with null for every value that isn't finite."""
    return F.transform(x, lambda v: F.when(finite(v), v))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def square_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def std_pop(x: Column) -> Column:
    """Population standard deviation in one pass: the fold carries count, mean and squared deviations."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(acc: Column, v: Column) -> Column:
        m = acc["m"] + (v - acc["m"]) / (acc["n"] + 1)
        return F.struct((acc["n"] + 1).alias("n"), m.alias("m"), (acc["s"] + (v - acc["m"]) * (v - m)).alias("s"))

    return F.aggregate(x, zero, step, lambda acc: F.when(acc["n"] > 0, F.sqrt(acc["s"] / F.nullif(acc["n"], F.lit(0.0)))))


def at(x: Column, i: Column) -> Column:
    """The value at 0-based ``i``; null outside."""
    return F.get(x, i.cast("int"))


def indices(n: Column) -> Column:
    """0, 1, ..., n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def tail(x: Column, n: int) -> Column:
    """The last n values, or all where there are fewer; n > 0."""
    if n <= 0:
        raise ValueError("a window has a positive length")
    return F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), F.lit(n))


def head(x: Column, n: int) -> Column:
    if n <= 0:
        raise ValueError("a window has a positive length")
    return F.slice(x, F.lit(1), F.lit(n))


def tile_to(x: Column, n: Column) -> Column:
    """``x`` repeated up to length n."""
    return F.transform(indices(n), lambda i: at(x, F.pmod(i, F.size(x))))
