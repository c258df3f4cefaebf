"""Memory of Python workers, which Spark uses again for task after task of any operator."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa

_caches: dict = {}


def keep_cache(owner: str, clear) -> None:
    """Names a cache of this worker process and the way to empty it."""
    _caches[owner] = clear


def give_back() -> None:
    """Returns freed memory to the system, which Arrow's pool and the C library would else keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def calm(owner: str) -> None:
    """For a task of an operator: empties the caches that other operators have left in this worker process, and lets Python's cycle
    collector run rarely, which would walk the large caches, which hold no cycles, again and again."""
    for name, clear in _caches.items():
        if name != owner:
            clear()
    gc.set_threshold(200_000, 50, 100)


def task(owner: str):
    """Makes of a function over Arrow batches one that begins calm and gives its memory back at the end."""

    def wrap(run):
        @functools.wraps(run)
        def go(batches):
            calm(owner)
            try:
                yield from run(batches)
            finally:
                give_back()

        return go

    return wrap
