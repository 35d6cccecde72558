"""Series from the columns of any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def millis(df: DataFrame, time: str) -> Column:
    """A time column as epoch ms: timestamps without zone are UTC, numbers are taken as they are."""
    kind = df.schema[time].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(F.col(time))
    if isinstance(kind, T.TimestampNTZType):
        at = F.col(time)
        if df.sparkSession.conf.get("spark.sql.session.timeZone") != "UTC":
            at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), at)
        return F.unix_millis(at.cast("timestamp"))
    return F.col(time).cast("long")


def as_series(df: DataFrame, series: str | Column, time: str, value: str | Column,
              between: tuple[int, int] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Points ``(series, t, v)`` and ``keep`` from a table; rows without series, time or value are no points.

    ``between`` (epoch ms, both ends included) is also tested on the time column itself, so that the
    scan skips row groups.
    """
    if between is not None:
        kind = df.schema[time].dataType
        if isinstance(kind, T.TimestampNTZType | T.TimestampType):
            # whole milliseconds of the source: the end's last microsecond is still inside
            df = df.filter((F.col(time) >= _literal(between[0], kind)) &
                           (F.col(time) < _literal(between[1] + 1, kind)))
        else:
            df = df.filter(F.col(time).between(*between))
    name = series if isinstance(series, Column) else F.col(series)
    v = value if isinstance(value, Column) else F.col(value)
    return df.filter(name.isNotNull() & F.col(time).isNotNull() & v.isNotNull()).select(
        name.cast("string").alias("series"), millis(df, time).alias("t"), v.alias("v"), *keep)


def _literal(ms: int, kind: T.DataType) -> Column:
    seconds, rest = divmod(ms, 1000)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_millis(F.lit(ms))
    return F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(seconds + rest / 1000).cast("decimal(18,6)"))
