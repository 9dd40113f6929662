"""Memory of Python workers, which stay for the next task, and of the batches that they are sent."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
