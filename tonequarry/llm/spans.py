"""Spans of text, kind:start:end in code points, end exclusive: lists, their string and its digest."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, int]


def line(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """spans (start, rank of kind, end) by start, then kind as listed, joined by commas."""
    return ",".join(f"{kinds[k]}:{start}:{end}" for start, k, end in sorted(spans))


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode("ascii")).hexdigest()
