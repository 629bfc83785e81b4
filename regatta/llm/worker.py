"""What a Python worker keeps between tasks: one large object at most, and no freed memory.

Workers are used again by later steps, each with encoders, scorers and arrays
of its own; an executor pays for all that its workers still hold.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object under ``key``, made once; the one of another key is dropped before."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Drop what is kept and give free memory back to the system."""
    _kept.clear()
    trimmed()


def trimmed() -> None:
    """Give the memory that is free in this process back to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
