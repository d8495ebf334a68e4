"""What a Python worker keeps from task to task: one user's tables at a time.

Workers outlive stages. Without this the tables of a stage that is over stay beside those of the next.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_now: list[tuple[str, Callable[[], None]]] = []


def claim(user: str, release: Callable[[], None] = lambda: None) -> None:
    """From now on user keeps tables, until another user claims: then release is called."""
    if _now and _now[0][0] == user:
        return
    before = _now[:]
    _now[:] = [(user, release)]
    for _, let_go in before:
        let_go()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc: freed memory goes back at its leisure
            pass
