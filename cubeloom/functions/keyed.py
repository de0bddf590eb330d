"""Reproducible draws: every random number is a hash of a seed and a key, so it is the same whatever the partitioning.

Each builder has a twin that writes the same expression in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586


def _key(parts) -> Column:
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str | int) else p.cast("string") for p in parts))


def uniform(seed: str, *key) -> Column:
    """Uniform on [0, 1) from the first 32 bits of an MD5 of seed and key parts (columns, strings or integers)."""
    return F.conv(F.substring(F.md5(_key((seed, *key))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: str, *key) -> Column:
    """Standard normal by Box and Muller on two uniforms."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(seed + "a", *key))) * F.cos(F.lit(TWO_PI) * uniform(seed + "b", *key))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def sql_uniform(seed: str, *key: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def sql_normal(seed: str, *key: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {sql_uniform(seed + 'a', *key)})) * cos({TWO_PI}::DOUBLE * {sql_uniform(seed + 'b', *key)}))"


def sql_rounded(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {digits}) + 0.0)"
