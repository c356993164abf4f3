"""Python workers live on between tasks; what a task no longer needs goes back to the system."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys

import pyarrow as pa


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def returning(run):
    """``run``, a generator over batches, that ends with ``release``."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
