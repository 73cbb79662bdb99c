"""Rank score, cost normalisation, clamping and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeyard.fixed_values import RANK_GRADES
from routeyard.runtime import finite

_INF = float("inf")


def _log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x)).when(x == 0, F.lit(-_INF)).otherwise(F.lit(float("nan")))


def _clip(x: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, low), high))


def log_cost(avg_cost: Column, cmin: Column, cmax: Column, eps: float = 1e-12) -> Column:
    """Cheapness in [0, 1] on a log scale: 1 at ``cmin``, 0 at ``cmax``."""
    span = _log2(cmax) - _log2(cmin) + F.lit(eps)
    return _clip((_log2(cmax) - _log2(_clip(avg_cost, cmin, cmax))) / span, 0.0, 1.0)


def rank_score(accuracy: Column, avg_cost: Column, cmin: Column, cmax: Column,
               beta: float = 0.1, eps: float = 1e-12) -> Column:
    """Weighted harmonic mean of accuracy and cheapness."""
    a = _clip(accuracy, 0.0, 1.0)
    c = log_cost(avg_cost, cmin, cmax, eps)
    return _clip(F.lit(1 + beta) * a * c / (F.lit(beta) * a + c + F.lit(eps)), 0.0, 1.0)


def rank_breakdown(accuracy: Column, avg_cost: Column, cmin: Column, cmax: Column,
                   beta: float = 0.1) -> Column:
    """The parts of a rank score, with the verbal grade."""
    score = rank_score(accuracy, avg_cost, cmin, cmax, beta)
    relative = F.when(cmax > cmin, (avg_cost - cmin) / (cmax - cmin)).otherwise(F.lit(0.5))
    grade = F.lit(RANK_GRADES[-1][1])
    for bound, label in reversed(RANK_GRADES[:-1]):
        grade = F.when(score >= bound, F.lit(label)).otherwise(grade)
    return F.struct(score.alias("rank_score"),
                    log_cost(avg_cost, cmin, cmax).alias("normalized_cost"),
                    relative.alias("relative_cost"),
                    grade.alias("grade"))


def normalize_cost(cost: Column, cmin: Column, cmax: Column) -> Column:
    """Linear cost in [0, 1]; NULL and NaN count as 1, equal bounds give 0."""
    unit = (cost - cmin) / F.nullif(cmax - cmin, F.lit(0.0))
    return (F.when(cmax <= cmin, F.lit(0.0))
            .when(cost.isNull() | F.isnan(cost), F.lit(1.0))
            .otherwise(F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0))))


def clamp(x: Column, low: float = 0.0, high: float = 2.0) -> Column:
    """Clip a finite value; anything else becomes 0."""
    return F.when(finite(x), F.least(F.greatest(x, F.lit(low)), F.lit(high))).otherwise(F.lit(0.0))


def hash_bucket(s: Column) -> Column:
    """The first 32 bits of the MD5 of a string, as a bigint.

    Independent of partitioning and engine, so any random choice built on it
    can be repeated anywhere.
    """
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("bigint")


def stable_unit(value: Column, salt: str = "") -> Column:
    """A repeatable number in [0, 1] from (value, salt); 52 hash bits."""
    digest = F.md5(F.concat_ws("|", value, F.lit(salt)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2 ** 52 - 1))


def unit_sql(expr: str, salt: str) -> str:
    return (f"(('0x' || substr(md5({expr} || '|{salt}'), 1, 13))::BIGINT::DOUBLE"
            f" / {float(2 ** 52 - 1)!r}::DOUBLE)")
