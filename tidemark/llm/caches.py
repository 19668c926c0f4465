"""What a Python worker remembers between tasks.

Workers outlive tasks and may serve several operators in turn. An operator claims the worker's memory
when a task of it starts, and what other operators remembered is dropped.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_CLEAR: dict[str, Callable[[], None]] = {}


def register(name: str, clear: Callable[[], None]) -> None:
    _CLEAR[name] = clear


def claim(name: str) -> None:
    """Drop all that is remembered under other names, and give freed memory back to the system."""
    for other, clear in _CLEAR.items():
        if other != name:
            clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
