"""Deterministic row tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "v1"


def stable_token(kind: str, *parts: Column | str) -> Column:
    """32 hex digits that depend only on the kind and the parts; string parts name columns."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", F.lit(VERSION), F.lit(kind), *[c.cast("string") for c in columns])
    return F.substring(F.sha1(text), 1, 32)
