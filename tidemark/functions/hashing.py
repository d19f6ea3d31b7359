"""Randomness as pure functions of (seed, stable key): independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5 over seed and key parts."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_sql(seed: str, *parts: str) -> str:
    inner = ", ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {inner})), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE)"


def beacon_seed(*parts: Column) -> Column:
    """Unsigned 64-bit seed (as a decimal string) from the head of a SHA-256 digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10)


def crc_bag(salt: Column, key: Column, frac: float) -> Column:
    """Bag membership by CRC-32 of ``salt:key``: the published membership rule."""
    return F.crc32(F.concat(salt.cast("string"), F.lit(":"), key)) % 10_000 < int(frac * 10_000)


def md5_bag(salt: Column, key: Column, frac: float) -> Column:
    return F.floor(uniform("bag", salt, key) * 10_000) < int(frac * 10_000)
