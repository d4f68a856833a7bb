"""What Python workers keep from one task to the next."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa


def worker_store(kind: str, name: str, make: Callable[[], Any]) -> Any:
    """The object ``name`` of this process, made on first use; of a kind only the last one is kept.

    Functions reach a worker by value, so that globals of their module last for one task
    only.  Use this for caches that don't change results.
    """
    kept = sys.modules.setdefault("_tesserae_worker", types.ModuleType("_tesserae_worker")).__dict__
    if kept.get(kind, ("",))[0] != name:
        kept.pop(kind, None)
        kept[kind] = name, make()
    return kept[kind][1]


@contextmanager
def no_collection() -> Iterator[None]:
    """Without the cyclic garbage collector, for code that holds many objects and makes no cycles."""
    gc.freeze()
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.unfreeze()


def release_memory() -> None:
    """Give freed memory back to the system, as a worker outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # another C library
