"""Noise as a pure function of (secret seed, key): never re-drawn when a plan is evaluated again.

md5 keeps draws reproducible in other SQL engines; pass ``secret()`` as the seed in production.
Floating-point Laplace noise is open to least-significant-bit attacks; round what you publish.
"""

from __future__ import annotations

import math
import secrets as _secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def secret() -> str:
    return _secrets.token_hex(32)


def _digest(seed: str, *key: Column | str) -> Column:
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts))


def uniform(seed: str, *key: Column | str) -> Column:
    """In (0, 1), from 52 bits of md5('seed|key|key...')."""
    return (F.conv(F.substring(_digest(seed, *key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def laplace(eps: float | Column, seed: str, *key: Column | str) -> Column:
    """Laplace noise of sensitivity 1 and scale 1/eps by the inverse distribution function."""
    u = uniform(seed, *key) - 0.5
    return -(F.lit(1.0) / (F.lit(eps) if isinstance(eps, (int, float)) else eps)) * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def laplace_may_reach(value: float, eps: float, seed: str, *key: Column | str) -> Column:
    """False where :func:`laplace` is surely below ``value``, seen from the digest's first digits alone; most of those above reach it."""
    if value <= 0:
        return F.lit(True)
    least = int((1 - 0.5 * math.exp(-eps * value)) * 2**52) - 2**20  # more than rounding can matter
    return _digest(seed, *key) >= F.lit(f"{max(least, 0):013x}")


def gumbel(seed: str, *key: Column | str) -> Column:
    return -F.ln(-F.ln(uniform(seed, *key)))


def in_box(lo: Column, hi: Column, seed: str, *key: Column | str) -> Column:
    return lo + uniform(seed, *key) * (hi - lo)


def choice(values: list, seed: str, *key: Column | str) -> Column:
    """One of a few values, uniformly."""
    return F.element_at(F.array(*map(F.lit, values)), (1 + F.floor(len(values) * uniform(seed, *key))).cast("int"))


def weighted_sample(df: DataFrame, weight: str, k: int, seed: str, *key: str) -> DataFrame:
    """k rows without replacement, in proportion to weight (exponential races)."""
    return df.orderBy((-F.ln(uniform(seed, *key)) / F.col(weight)).asc(), *key).limit(k)


def exponential_mechanism(candidates: DataFrame, utility: str, eps: float, seed: str, *key: str, sensitivity: float = 1.0) -> DataFrame:
    """The one candidate drawn with odds exp(eps * utility / (2 * sensitivity)), by Gumbel maximum."""
    return candidates.withColumn("score", eps * F.col(utility) / (2 * sensitivity) + gumbel(seed, *key)).orderBy(F.col("score").desc(), *key).limit(1)


@dataclass
class BudgetLedger:
    """What each step spends; spending beyond the budget raises."""

    total: float
    spent: list[tuple[str, float]] = field(default_factory=list)

    def spend(self, what: str, eps: float) -> float:
        self.spent.append((what, eps))
        if self.used() > self.total * (1 + 1e-9):
            raise ValueError(f"budget of {self.total} exceeded by {what}: {self.used()}")
        return eps

    def used(self) -> float:
        return sum(e for _, e in self.spent)
