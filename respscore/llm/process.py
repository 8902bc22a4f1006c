"""What a Python worker keeps from one task to the next: loaded tokenizers and bounded caches of words."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, once in the life of this process (a module of its own holds it: functions that are
    sent to workers by value bring their globals anew with each task)."""
    held = sys.modules.setdefault("_respscore_llm_process", types.ModuleType("_respscore_llm_process"))
    store = held.__dict__.setdefault("store", {})
    if key not in store:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back at once, so slices don't add up
        store[key] = make()
    return store[key]
