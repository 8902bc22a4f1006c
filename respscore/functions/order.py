"""Input-order keys.

The reference processes records as an ordered list.  On Spark the order is
given by columns (``created_at desc, id desc`` for a history scan, a
position for an id list).  ``order_code`` folds those columns into one
DECIMAL(38,0) that is ascending in input order, so "first"/"last"
occurrence is a plain min/max that stays in HashAggregate (a struct
min/max falls back to a sort-based aggregate).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D = "decimal(38,0)"


def _shift64() -> Column:
    """Offset that maps a signed 64-bit value into [0, 2^64)."""
    return F.expr(f"cast('9223372036854775808' as {_D})")


def _wide() -> Column:
    """Multiplier for the leading key: above 2^64, so the trailing key never carries."""
    return F.expr(f"cast('20000000000000000000' as {_D})")


def _integral(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _lead_value(c: Column, dt: T.DataType) -> Column | None:
    """A bounded integer for the leading key (|v| * 2e19 must fit 38 digits)."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast(_D)
    if isinstance(dt, T.TimestampNTZType):
        # microseconds since the epoch; Spark timestamps span years 1-9999,
        # so |v| < 2.6e17 and v * 2e19 < 5.2e36
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, c).cast(_D)
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c).cast(_D)
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast(_D)
    return None


# below every coded value: a null key sorts first ascending, last descending, as Spark sorts it
_NULL_LEAD = -10 ** 18


def order_code(df: DataFrame, cols: Sequence[str], descending: bool) -> Column | None:
    """DECIMAL(38,0) ascending in input order, or None when the key columns
    cannot be packed (then callers use a struct)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if len(cols) == 1 and _integral(types[cols[0]]):
        code = F.coalesce(F.col(cols[0]).cast(_D), -_shift64() - 1)
    elif len(cols) == 1 and _lead_value(F.col(cols[0]), types[cols[0]]) is not None:
        code = F.coalesce(_lead_value(F.col(cols[0]), types[cols[0]]), F.lit(_NULL_LEAD).cast(_D))
    elif len(cols) == 2 and _integral(types[cols[1]]):
        lead = _lead_value(F.col(cols[0]), types[cols[0]])
        if lead is None:
            return None
        code = F.coalesce(lead, F.lit(_NULL_LEAD).cast(_D)) * _wide() + F.coalesce(F.col(cols[1]).cast(_D) + _shift64(), F.lit(-1).cast(_D))
    else:
        return None
    # not ``-code``: Spark negates a DECIMAL of more than 34 digits with rounding, a difference is exact
    return F.lit(0).cast(_D) - code if descending else code


def order_struct(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def sort_exprs(cols: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]
