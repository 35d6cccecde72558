"""Calendar scales: truncation, steps, tick spines, labels and rollups in a time zone.

Times are epoch milliseconds throughout; local time is the epoch time plus the zone's offset at that
instant, so nothing depends on the session's time zone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, floor_to, idiv, spec_of

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
# Unit lengths in ms; year and month are nominal
UNIT_MS = {"year": 365 * DAY_MS, "month": 30 * DAY_MS, "day": DAY_MS, "hour": HOUR_MS, "minute": 60_000,
           "second": 1000, "millisecond": 1}
# The unit above, inside which a field is counted
_ENCLOSING_MS = {"minute": HOUR_MS, "second": 60_000, "millisecond": 1000}
_ZONE = "'['zzz / X']'"


@dataclass(frozen=True)
class CalendarScale:
    """Ticks every ``step`` units. A scale with a ``prefix`` pattern can give context to finer ones."""

    name: str
    unit: str
    step: int
    postfix: str
    prefix: str | None = None
    span_ms: int | None = None

    @property
    def nominal_ms(self) -> int:
        return self.span_ms if self.span_ms is not None else UNIT_MS[self.unit] * self.step

    @property
    def is_elapsed(self) -> bool:
        """Whether steps are elapsed time; days and longer step on the calendar."""
        return self.unit not in ("year", "month", "day")


# The scales from coarse to fine with their label patterns
_YEAR = {"postfix": "yyyy 'y'", "prefix": f"yyyy {_ZONE}"}
SCALES: tuple[CalendarScale, ...] = (
    CalendarScale("year_1000", "year", 1000, **_YEAR),
    CalendarScale("year_100", "year", 100, **_YEAR),
    CalendarScale("year_10", "year", 10, **_YEAR),
    CalendarScale("year_1", "year", 1, **_YEAR),
    CalendarScale("month", "month", 1, "MMM", f"yyyy MMM {_ZONE}"),
    CalendarScale("day", "day", 1, "d 'd' (EEE)", f"yyyy MMM d (EEE) {_ZONE}"),
    CalendarScale("hour_6", "hour", 6, "HH 'h'"),
    CalendarScale("hour", "hour", 1, "HH 'h'", f"yyyy MMM d (EEE)  HH 'h' {_ZONE}"),
    CalendarScale("minute_10", "minute", 10, "mm 'm'"),
    CalendarScale("minute", "minute", 1, "mm 'm'", f"yyyy MMM d (EEE)  HH:mm {_ZONE}"),
    CalendarScale("second_10", "second", 10, "ss 's'"),
    CalendarScale("second", "second", 1, "ss 's'", f"yyyy MMM d (EEE)  HH:mm:ss {_ZONE}"),
    CalendarScale("ms_100", "millisecond", 100, "SSS 'ms'"),
    CalendarScale("ms_10", "millisecond", 10, "SSS 'ms'"),
    CalendarScale("ms", "millisecond", 1, "SSS 'ms'", f"yyyy MMM d (EEE)  HH:mm:ss.SSSS {_ZONE}"),
)
BY_NAME = {s.name: s for s in SCALES}

Scale = str | CalendarScale | Column


def _scaled(scale: Scale, fn: Callable[[CalendarScale], Column]) -> Column:
    """``fn`` of a scale, or of the scale each row names (one of ``SCALES``; null for another name)."""
    if isinstance(scale, str):
        return fn(BY_NAME[scale])
    if isinstance(scale, CalendarScale):
        return fn(scale)
    chosen = F.when(scale == SCALES[0].name, fn(SCALES[0]))
    for s in SCALES[1:]:
        chosen = chosen.when(scale == s.name, fn(s))
    return chosen


def to_local(t: Column, zone: str) -> Column:
    """Milliseconds on the zone's wall clock."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(t), zone))


def from_local(local: Column, zone: str) -> Column:
    """Epoch ms of a wall-clock time; the earlier one where a clock change repeats it."""
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(local), zone))


def to_zoned(t: Column, zone: str) -> Column:
    """Epoch ms as a wall-clock timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit("1970-01-01").cast("timestamp_ntz")
                              + F.make_dt_interval(secs=(t / 1000).cast("decimal(18,6)")))


def from_zoned(wall: Column, zone: str) -> Column:
    """Epoch ms of a wall-clock timestamp without zone; anything finer than a millisecond is dropped."""
    seconds = F.hour(wall) * 3600 + F.minute(wall) * 60
    millis = (F.date_part(F.lit("second"), wall) * 1000).cast("long")
    return from_local(_midnight(wall.cast("date")) + seconds.cast("long") * 1000 + millis, zone)


def _date(local: Column) -> Column:
    return F.date_from_unix_date(idiv(floor_to(local, DAY_MS), DAY_MS).cast("int"))


def _midnight(date: Column) -> Column:
    return F.unix_date(date).cast("long") * DAY_MS


def _trunc(t: Column, scale: CalendarScale, zone: str) -> Column:
    local, n = to_local(t, zone), scale.step
    if scale.unit == "year":
        year = idiv(F.year(_date(local)), n) * n
        return from_local(_midnight(F.make_date(year.cast("int"), F.lit(1), F.lit(1))), zone)
    if scale.unit == "month":
        month = idiv(F.month(_date(local)) - 1, n) * n + 1
        return from_local(_midnight(F.make_date(F.year(_date(local)), month.cast("int"), F.lit(1))), zone)
    if scale.unit == "day":
        back = (F.dayofmonth(_date(local)) - 1) % n
        return from_local(floor_to(local, DAY_MS) - back.cast("long") * DAY_MS, zone)
    if scale.unit == "hour":
        midnight = floor_to(local, DAY_MS)
        return from_local(midnight + floor_to(local - midnight, n * HOUR_MS), zone)
    # finer fields keep the offset of the time itself
    within = F.pmod(local, F.lit(_ENCLOSING_MS[scale.unit]).cast("long"))
    return t - F.pmod(within, F.lit(n * UNIT_MS[scale.unit]).cast("long"))


def _advance(t: Column, scale: CalendarScale, steps: Column | int, zone: str) -> Column:
    steps = steps if isinstance(steps, Column) else F.lit(steps).cast("long")
    if scale.is_elapsed:
        return t + steps * (scale.step * UNIT_MS[scale.unit])
    local = to_local(t, zone)
    clock = F.pmod(local, F.lit(DAY_MS).cast("long"))
    if scale.unit == "day":
        return from_local(local + steps * (scale.step * DAY_MS), zone)
    months = (steps * (scale.step * (12 if scale.unit == "year" else 1))).cast("int")
    return from_local(_midnight(F.add_months(_date(local), months)) + clock, zone)


def calendar_trunc(t: Column, scale: Scale, zone: str = "UTC") -> Column:
    """The last tick not after ``t``, on the zone's calendar."""
    return _scaled(scale, lambda s: _trunc(t, s, zone))


def calendar_advance(t: Column, scale: Scale, steps: Column | int = 1, zone: str = "UTC") -> Column:
    """``t`` moved by ``steps`` ticks, keeping its offset inside a tick."""
    return _scaled(scale, lambda s: _advance(t, s, steps, zone))


def _tick_count(begin: Column, end: Column, scale: CalendarScale, zone: str) -> Column:
    """At least as many steps as lead from ``begin`` to just before ``end``."""
    if scale.is_elapsed:
        width = scale.step * UNIT_MS[scale.unit]
        return F.greatest(idiv(end - begin + width - 1, width) - 1, F.lit(0).cast("long"))
    first, last = _date(to_local(begin, zone)), _date(to_local(end, zone))
    if scale.unit == "day":
        return idiv(F.date_diff(last, first).cast("long"), scale.step) + 1
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    return idiv(months.cast("long"), scale.step * (12 if scale.unit == "year" else 1)) + 1


_BLOCK = 4096


def _steps(ranges: DataFrame, count: Column) -> DataFrame:
    """A row per step 0..count, from two short sequences: no array grows with the range."""
    blocks = ranges.withColumn("_count", count).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), idiv(F.col("_count"), _BLOCK))))
    # the blocks of a few long ranges are spread over the tasks that fill them; a given number is not merged again
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(tasks, *[F.col(c) for c in (*ranges.columns, "_block")])
    first = F.col("_block") * _BLOCK
    steps = F.sequence(first, F.least(first + (_BLOCK - 1), F.col("_count")))
    return blocks.withColumn("_step", F.explode(steps)).drop("_block", "_count")


def tick_spine(ranges: DataFrame, scale: Scale, zone: str = "UTC", start: str = "start", end: str = "end",
               prior: bool = False) -> DataFrame:
    """Ticks of every range as column ``tick``: strictly after the range's first truncation and before its end.

    ``prior`` adds that truncation itself, the tick at or before the start.
    """
    begun = ranges.withColumn("_begin", calendar_trunc(F.col(start), scale, zone))
    count = _scaled(scale, lambda s: _tick_count(F.col("_begin"), F.col(end), s, zone))
    ticks = _steps(begun, count).withColumn(
        "tick", F.when(F.col("_step") == 0, F.col("_begin")).otherwise(
            calendar_advance(F.col("_begin"), scale, F.col("_step"), zone)))
    inside = (F.col("_step") > 0) & (F.col("tick") < F.col(end))
    ticks = ticks.filter(inside | (F.col("_step") == 0) if prior else inside)
    return ticks.drop("_begin", "_step")


def best_scale(span: Column) -> Column:
    """Name of the finest scale whose nominal span is above ``span`` ms, else of the coarsest."""
    chosen = F.lit(SCALES[0].name)
    for scale in SCALES:
        chosen = F.when(F.lit(scale.nominal_ms) > span, F.lit(scale.name)).otherwise(chosen)
    return chosen


def _neighbour(scale: Column, candidates: Callable[[int], Sequence[CalendarScale]]) -> Column:
    chosen = None
    for i, s in enumerate(SCALES):
        name = F.lit(candidates(i)[0].name)
        chosen = F.when(scale == s.name, name) if chosen is None else chosen.when(scale == s.name, name)
    return chosen


def context_scale(scale: Column) -> Column:
    """The next coarser scale that can give context, else the coarsest."""
    return _neighbour(scale, lambda i: [s for s in reversed(SCALES[:i]) if s.prefix] or [SCALES[0]])


def finer_scale(scale: Column) -> Column:
    """The next finer scale that can give context, else the finest."""
    return _neighbour(scale, lambda i: [s for s in SCALES[i + 1:] if s.prefix] or [SCALES[-1]])


def _format(t: Column, pattern: str, zone: str) -> Column:
    # a one-column CSV row is the one formatter that takes a zone per call; patterns give nothing to quote
    return F.to_csv(F.struct(F.timestamp_millis(t)), {"timestampFormat": pattern, "timeZone": zone})


def tick_label(t: Column, scale: Scale, zone: str = "UTC", full: bool = False) -> Column:
    """Short label of a tick, or the full one with everything coarser and the zone."""
    def label(s: CalendarScale) -> Column:
        pattern = s.prefix if full else s.postfix
        return F.lit(None).cast("string") if pattern is None else _format(t, pattern, zone)
    return _scaled(scale, label)


def label_midpoints(ranges: DataFrame, scale: Scale, zone: str = "UTC") -> DataFrame:
    """Context labels: ``tick`` names the interval, ``mid`` is the middle of its part inside the range."""
    ticks = tick_spine(ranges, scale, zone, prior=True)
    left = F.greatest(F.col("tick"), F.col("start"))
    right = F.least(calendar_advance(F.col("tick"), scale, 1, zone), F.col("end"))
    return ticks.withColumn("mid", idiv(left + right, 2))


def calendar_rollup(points: DataFrame, scale: Scale, kind: str | AggregateSpec = "num",
                    zone: str = "UTC") -> DataFrame:
    """State per series and calendar bucket ``t``, with the empty buckets between first and last present.

    An empty bucket has a null state, and 0 for its count ``n``.
    """
    spec = spec_of(kind)
    rows = spec.prepared(points).withColumn("_bucket", calendar_trunc(F.col("t"), scale, zone))
    rolled = spec.of_points(rows, "series", "_bucket", spans=False).withColumnRenamed("_bucket", "t")
    spans = points.groupBy("series").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"))
    # ticks of hours are elapsed time and may sit beside a bucket's start after a clock change
    ticks = tick_spine(spans, scale, zone, prior=True)
    spine = ticks.select("series", calendar_trunc(F.col("tick"), scale, zone).alias("t")).distinct()
    dense = spine.join(rolled, ["series", "t"], "full")
    return dense.fillna(0, ["n"]) if "n" in spec.state else dense
