"""Time and size columns: overlaps, bounds, cadences, forecasts. Nulls give nulls unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes a second of output where nothing is known, least and greatest forecast.
FALLBACK_RATES = {"short": 1_500_000.0, "medium": 400_000.0, "long": 250_000.0}
LEAST_BYTES, MOST_BYTES = 64 << 20, 5 << 30


def forecast_bytes(seconds: Column, duration_class: Column, rate: Column, safety: float = 1.5, most: int = MOST_BYTES) -> Column:
    """Forecast size of an output: its length at the known rate of its class, or a fallback, times a margin, within bounds."""
    known = F.coalesce(rate, *[F.when(duration_class == k, F.lit(v)) for k, v in FALLBACK_RATES.items()])
    size = F.floor(F.greatest(F.lit(1.0), F.coalesce(seconds, F.lit(0.0))) * known * max(1.0, safety)).cast("long")
    return F.least(F.lit(most).cast("long"), F.greatest(F.lit(LEAST_BYTES).cast("long"), size))


def bundle_bytes(packets: Column, request_bytes: int, reserve: int) -> Column:
    return packets * request_bytes + reserve


def intersection(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Share of the shorter interval that both cover; 0 where a time is null."""
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
    return F.when(known, intersection(a0, a1, b0, b1) / F.greatest(F.lit(1).cast("long"), F.least(a1 - a0, b1 - b0))).otherwise(0.0)


def shift_words(words: Column, offset_ms: Column) -> Column:
    """An array of structs with start_ms and end_ms, moved."""
    return F.transform(words, lambda w: w.withField("start_ms", w["start_ms"] + offset_ms).withField("end_ms", w["end_ms"] + offset_ms))


def clipped_end(provenance: Column, start: Column, end: Column, duration: Column) -> Column:
    """Whether a source's cue begins inside the media and ends behind it."""
    return F.coalesce(provenance.startswith("source_") & (start >= 0) & (start < duration) & (duration < end), F.lit(False))


def periodic_times(duration_ms: Column, interval_seconds: float = 30.0, guard_ms: int = 250) -> Column:
    """Times every interval, one near the end if what is left exceeds the interval; none in the last guard_ms, where the last one moves to its edge."""
    step = max(1, round(interval_seconds * 1000))
    every = F.when(duration_ms <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(duration_ms - 1, F.lit(0)), F.lit(step).cast("long")))
    last = F.element_at(every, -1)
    every = F.when(duration_ms - last > step, F.array_append(every, F.greatest(duration_ms - 1, F.lit(0)))).otherwise(every)
    edge = F.greatest(duration_ms - guard_ms, F.lit(0).cast("long"))
    moved = F.array_distinct(F.array_append(F.filter(every, lambda t: t <= edge), edge))
    return F.when((duration_ms > 0) & (duration_ms - F.element_at(every, -1) < guard_ms), moved).otherwise(every)


def periodic_interval(duration_ms: Column, scenes: Column, motion: Column, configured: float = 30.0, strict: bool = True) -> Column:
    """Seconds between safety samples: shorter where scenes are dense or motion strong, never below 2 (or the configured)."""
    upper = min(configured, 30.0) if strict else configured
    density = scenes / F.greatest(duration_ms / 60_000, F.lit(1 / 60))
    pressure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), density / 12.0) + F.greatest(F.lit(0.0), motion) * 0.5)
    return F.greatest(F.lit(min(2.0, upper)), upper * (1.0 - 0.6 * F.least(pressure, F.lit(0.9))))


def spread_index(count: Column, most: int) -> Column:
    """Indexes (from 0) of at most ``most`` of count items, evenly spread, ends kept; halves go to even."""
    if most == 1:
        return F.when(count > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), lambda i: F.bround(i * (count - 1) / (most - 1), 0).cast("long")))
    every = F.when(count > 0, F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(count > most, spread).otherwise(every)


def survey_point(actual: Column, requested: Column, duration_ms: Column) -> Column:
    """The measured time, else the requested one, within the media."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.coalesce(actual, requested), duration_ms - 1))
