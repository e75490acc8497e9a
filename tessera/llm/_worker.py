"""What a Python worker process keeps between tasks, and how it gives memory back.

Spark reuses worker processes across stages, so what one operator remembers
would stay beside the next operator's batches and the executor's heap.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa

Made = TypeVar("Made")
_HELD: dict[tuple[str, str], object] = {}


def held(owner: str, key: str, make: Callable[[], Made]) -> Made:
    """What ``owner`` keeps under ``key`` in this process, made where it is absent."""
    if (owner, key) not in _HELD:
        _HELD[owner, key] = make()
    return _HELD[owner, key]


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def enter(owner: str) -> None:
    """Drop what operators other than ``owner`` left in this process."""
    others = [k for k in _HELD if k[0] != owner]
    for k in others:
        del _HELD[k]
    if others:
        give_back()


def task(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task of ``owner``, which ends with its freed memory given back."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return bounded
