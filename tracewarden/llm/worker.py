"""What a worker process remembers between batches: for one operator at a time."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa

_OWNER: list = [None, None]


def release() -> None:
    """Give memory that is free back to the system. Workers wait between tasks and stages with what they once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def claim(owner: object, drop: Callable[[], None] | None = None) -> None:
    """The worker works for ``owner`` from now on; what it remembers for another one goes.

    Workers outlive stages, so in a pipeline the caches of all its stages would add up. An owner that remembers
    nothing claims the worker too, before it takes memory of its own.
    """
    owner = sys.intern(owner) if isinstance(owner, str) else owner  # a name is one owner in every task
    if _OWNER[0] is not owner:
        if _OWNER[1] is not None:
            _OWNER[1]()
            release()
        _OWNER[:] = [owner, drop]
