"""Spans of matches: their SQL type, counts and digests by built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,stop:int,base:boolean>"
"""Kind, first code point, code point after the last, and whether a base rule found it."""


def ordered(spans: list[tuple[str, int, int, bool]], kinds: Sequence[str]) -> list[dict]:
    """By start, then kind as listed, as rows of the SQL type."""
    rank = {k: i for i, k in enumerate(kinds)}
    spans = sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2], not s[3]))
    return [{"kind": k, "start": a, "stop": b, "base": base} for k, a, b, base in spans]


def count(spans: str, kind: str) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def text_of(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return F.array_join(parts, ",")


def digest(spans: str) -> Column:
    """SHA-256 of the base spans' text."""
    return F.sha2(text_of(F.filter(spans, lambda s: s["base"])), 256)
