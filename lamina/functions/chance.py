"""Seeded random columns that another engine can reproduce bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 32 bits of the key's md5."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def uniform_sql(key: str) -> str:
    return f"((cast('0x'||substr(md5({key}),1,8) as bigint)+0.5::double)/4294967296::double)"


def gumbel(key: Column) -> Column:
    return -F.log(-F.log(uniform(key)))


def gumbel_sql(key: str) -> str:
    return f"(-ln(-ln({uniform_sql(key)})))"


def distance_seed(base: int, distance: int, salt: int = 0) -> int:
    return base + distance * 1_000_003 + salt
