"""Repeatable random numbers as column expressions.

A draw is a hash of key columns and a salt, so it does not depend on the partitioning, on the order of
rows or on the attempt number of a task.  Keys must be integers or strings: their text form is the
same in every engine, that of doubles is not.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 4294967296.0  # 2^32


def _cols(keys: Sequence) -> list[Column]:
    return [k if isinstance(k, Column) else F.col(k) for k in keys]


def uniform(keys: Sequence, salt) -> Column:
    """Uniform in (0, 1) from the md5 of the keys and the salt; any SQL engine can repeat it."""
    salt = salt if isinstance(salt, Column) else F.lit(salt)
    digest = F.md5(F.concat_ws(",", *[c.cast("string") for c in _cols(keys)], salt))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(_SPAN)


def uniform_fast(keys: Sequence, seed: int) -> Column:
    """Uniform in (0, 1) from xxhash64: keys of any type, several times cheaper than md5."""
    bits = F.pmod(F.xxhash64(*_cols(keys), F.lit(seed)), F.lit(int(_SPAN)))
    return (bits.cast("double") + 0.5) / F.lit(_SPAN)


def normal(keys: Sequence, salt: str) -> Column:
    """Standard normal draw (Box-Muller on two uniforms)."""
    u1 = uniform(keys, F.concat(F.lit(salt), F.lit("/r")))
    u2 = uniform(keys, F.concat(F.lit(salt), F.lit("/a")))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gaussian(mean: Column, ratio: float, n: Column) -> Column:
    """`mean` moved by a normal draw `n` whose deviation is `ratio` of the mean."""
    return mean + n * F.lit(ratio) * F.abs(mean)


def gaussian_trimmed(mean: Column, ratio: float, n: Column, limit: float = 3.0) -> Column:
    """As `gaussian`, cut at `limit` deviations on both sides."""
    reach = F.abs(mean) * F.lit(ratio * limit)
    return F.greatest(F.least(gaussian(mean, ratio, n), mean + reach), mean - reach)


def gaussian_nonnegative(mean: Column, ratio: float, n: Column, limit: float = 3.0) -> Column:
    """As `gaussian_trimmed`, never below zero."""
    return F.greatest(gaussian_trimmed(mean, ratio, n, limit), F.lit(0.0))
