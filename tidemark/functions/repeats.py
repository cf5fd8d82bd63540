"""Texts that come again: filings reach both venues, and companies file by templates."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

#: Readings that a worker keeps of each function, and the letters of a text up to which it does.
KEPT, SHORT = 2048, 2000


def remembered(read: Callable) -> Callable:
    """`read` with its last readings of short texts kept, so that the same text is read once; what it returns is not to be changed."""
    kept = lru_cache(KEPT)(read)

    @wraps(read)
    def out(*args):
        return kept(*args) if sum(len(a) for a in args if isinstance(a, str)) <= SHORT else read(*args)

    return out
