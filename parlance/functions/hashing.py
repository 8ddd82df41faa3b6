"""Reproducible draws: uniforms in [0, 1) taken from md5 of a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bits(*key: Column) -> Column:
    """First 32 bits of md5 over the ':'-joined key, as BIGINT."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(*key: Column) -> Column:
    return hash_bits(*key) / F.lit(4294967296.0)


def pick(options: list[str], u: Column) -> Column:
    """Element of a literal list chosen by a uniform."""
    index = F.floor(u * len(options)).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), index + 1)
