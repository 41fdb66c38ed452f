"""Casts that never fail, and tolerant JSON reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(F.floor(F.abs(text.try_cast("double"))).try_cast("int") * F.signum(text.try_cast("double")).cast("int"), F.lit(default))


def safe_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def safe_bool(text: Column, default: bool = False) -> Column:
    low = F.lower(F.trim(text.cast("string")))
    return F.coalesce(low.isin("true", "1", "yes", "y"), F.lit(default))


def clean_json(text: Column) -> Column:
    """Without byte order mark and code fences."""
    bare = F.trim(F.replace(text, F.lit("﻿"), F.lit("")))
    return F.trim(F.regexp_replace(bare, r"(?s)^\s*```\w*\s*|\s*```\s*$", ""))


def tolerant_json(text: Column) -> Column:
    """The text's JSON value as a variant: as it stands, else its outermost object; null where there is none."""
    bare = clean_json(text)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))
