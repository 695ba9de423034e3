"""Helpers for operators that find spans in texts (code points, end exclusive)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

Span = tuple[str, int, int]


def join_spans(spans: Iterable[Span], kinds: Sequence[str]) -> str:
    """kind:start:end, ordered by start, then kind as listed, then end; comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()
