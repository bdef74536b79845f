"""Scalar column functions (F1-F9, K1/K2, P6).  All are built-in Spark expressions, so
they stay inside whole-stage codegen; nothing here runs Python per row."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH_SUFFIX = "_epochtime"


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                           T.DoubleType, T.DecimalType, T.BooleanType))


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType))


def epoch_micros(c: Column, dt: T.DataType) -> Column:
    """Microseconds since 1970-01-01 for a timestamp, timestamp_ntz or date column.

    ``TIMESTAMP_NTZ`` is converted without any time zone (wall clock read as UTC), so
    the value does not depend on the session zone."""
    if isinstance(dt, T.TimestampNTZType):
        # from the wall-clock fields: independent of the session time zone (a zone-based
        # conversion would move values across daylight-saving changes)
        days = F.unix_date(c.cast("date")).cast("long")
        secs = F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60
        frac = (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long")
        return days * F.lit(86_400_000_000) + secs * F.lit(1_000_000) + frac
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(86_400_000_000)
    return F.unix_micros(c)


def epoch_ns(c: Column, dt: T.DataType) -> Column:
    """datetime -> int64 nanoseconds since epoch (null stays null)."""
    return (epoch_micros(c, dt) * F.lit(1000)).cast("long")


def key_to_string(c: Column, dt: T.DataType) -> Column:
    """K1/K2: canonical string form of a key.

    Integral values print without a fraction; a float that holds an integer (``1.0``) prints
    as ``1``; NaN and null become null; other floats keep their plain string form."""
    if isinstance(dt, T.StringType):
        return c
    if is_integral_type(dt) and not isinstance(dt, T.BooleanType):
        return c.cast("string")
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        as_long = d.try_cast("long")
        return (F.when(d.isNull() | F.isnan(d), F.lit(None).cast("string"))
                .when(as_long.cast("double") == d, as_long.cast("string"))
                .otherwise(c.cast("string")))
    return c.cast("string")


def sanitize_name(name: str) -> str:
    """``(``->``_``, ``)``->'', ``.``->``_``, collapse runs of ``_``, strip ``_``."""
    s = name.replace("(", "_").replace(")", "").replace(".", "_")
    s = re.sub(r"_{2,}", "_", s)
    return s.strip("_")


def shift_time(c: Column, seconds: int = 1) -> Column:
    """move a time column by a fixed number of seconds."""
    return c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def argmax_label(probs: Column, classes: Column) -> Column:
    """label of the largest probability (first one on ties)."""
    idx = F.array_position(probs, F.array_max(probs))
    return F.element_at(classes, idx.cast("int"))
