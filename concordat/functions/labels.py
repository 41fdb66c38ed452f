"""Spelling-blind keys for names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spelling_key(name: Column | str) -> Column:
    """Letters and digits of a name in lower case; null where none are left."""
    text = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{N}]", ""), F.lit(""))
