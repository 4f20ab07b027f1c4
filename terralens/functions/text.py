"""Tolerant parsing and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def number(text: Column) -> Column:
    """The number that a text holds entirely, else null."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def parse_int(text: Column) -> Column:
    """Truncated towards zero; null where it isn't a number."""
    n = number(text)
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).try_cast("int")


def safe_int(text: Column) -> Column:
    """As parse_int, but negative whole numbers are null."""
    n = parse_int(text)
    return F.when(n >= 0, n)


def city_key(sample_id: Column) -> Column:
    got = F.regexp_extract(sample_id, r"^(.*)_[0-9]+$", 1)
    return F.when(got == "", sample_id).otherwise(got)


def sid_from_path(path: Column) -> Column:
    """Sample id of a view's file name."""
    return F.regexp_extract(path, r"([^/]+?)(?:_along_fwd|_along_bwd|_cross_left|_cross_right)?\.[^.]*$", 1)


def hash_key(*parts: Column | str) -> Column:
    """Order that stands for a seeded shuffle: the same on every run and for every partitioning."""
    return F.md5(F.concat_ws("_", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))
