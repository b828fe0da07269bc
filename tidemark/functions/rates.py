"""Column functions for rates, intervals and tests; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantile of a 95 % interval; the sample from which a rate counts as reliable.
Z95, SMALL_SAMPLE = 1.959963984540054, 200


def rate(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator; null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def with_rate(numerator: Column, denominator: Column, small: int = SMALL_SAMPLE) -> list[Column]:
    """The four columns that every rate is reported with."""
    return [numerator.cast("long").alias("numerator"), denominator.cast("long").alias("denominator"),
        F.round(rate(numerator, denominator), 9).alias("rate"), (denominator < small).alias("small_sample")]


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval."""
    p, n = rate(successes, n), n.cast("double")
    middle, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, (middle - spread) / scale), F.when(n > 0, (middle + spread) / scale)


# Coefficients of the Chebyshev fit to the complementary error function (relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(poly - x * x)


def two_sided_p_sql(z: str) -> str:
    """The same in SQL text."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + {x} / 2))"
    poly = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({poly} * {t} + ({c}))"
    return f"{t} * exp({poly} - {x} * {x})"


def hash_unit(key: Column, seed: str) -> Column:
    """A reproducible number in [0, 1) for each key, the same in other engines: the first 12 digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)


def hash_unit_sql(key: str, seed: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 12)) AS BIGINT) / {float(16**12)})"
