"""Memory of the Python workers."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa


def release() -> None:
    """Give the memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
