"""Equi-joins against derived tables; Spark picks the strategy from its own size estimates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def key_join(big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, as grouping has it; the key columns come once, from
    ``big``.  A plain join: broadcast only under Spark's own threshold, else both sides are shuffled
    and AQE may split a hot key."""
    keys = [on] if isinstance(on, str) else list(on)
    if not keys:
        raise ValueError("a join needs key columns")
    other = small.select(*[small[c].alias(f"_j_{c}") if c in keys else small[c] for c in small.columns])
    same = reduce(lambda a, b: a & b, [big[k].eqNullSafe(other[f"_j_{k}"]) for k in keys])
    out = big.join(other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_j_{k}" for k in keys])
