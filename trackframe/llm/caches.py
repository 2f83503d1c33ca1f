"""A bounded cache that keeps what is met again."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any
from weakref import WeakSet

_filled: WeakSet = WeakSet()


def release() -> None:
    """Empty all caches that earlier tasks of this worker filled, before a task of another kind takes memory."""
    for cache in list(_filled):
        cache.young, cache.old = {}, {}
    _filled.clear()


class TwoGenerations:
    """A cache of at most twice ``limit`` keys, or of one request's keys if those are more.

    A full young generation becomes the old one, and keys of the old one that
    are asked for move up.  So frequent keys stay, however many rare ones come.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[Any, Any] = {}
        self.old: dict[Any, Any] = {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` that the caller must add to ``young``; the others are there after this call."""
        _filled.add(self)
        new = keys - self.young.keys()
        if len(self.young) + len(new) > self.limit:
            self.old, self.young, new = self.young, {}, keys
        known = new & self.old.keys()
        self.young.update((k, self.old[k]) for k in known)
        return list(new - known)

    def add(self, items: Iterable[tuple[Any, Any]]) -> None:
        self.young.update(items)
