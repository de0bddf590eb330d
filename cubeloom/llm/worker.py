"""What a Python worker keeps from task to task: one thing at a time, so its memory is that of one operator.

Workers outlive tasks and stages. An operator's word table is worth keeping while its tasks follow each other; the
next operator's tasks drop it. What an earlier task freed goes back to the system as well: allocators keep freed pages for
reuse, and a worker that has run several operators would otherwise hold the largest needs of each.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: list[Any] = [None, None]


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The object of key, made where this worker does not hold it."""
    if _held[0] != key:
        released()
        _held[:] = [key, make()]
    return _held[1]


def released() -> None:
    """Drops what is held, and gives freed memory back to the system."""
    _held[:] = [None, None]
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: malloc_trim of the C library, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
