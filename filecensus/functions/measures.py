"""Progress, rate and unit expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GIB = 1024 ** 3
MIB = 1024 ** 2


def round_even(value: Column, digits: int) -> Column:
    """Round half to even on the binary value, without a detour over decimals; never minus zero."""
    scale = F.lit(float(10 ** digits))
    return F.rint(value * scale) / scale + F.lit(0.0)


def in_units(size: Column, unit: int, digits: int) -> Column:
    """Bytes in a larger unit, rounded half to even."""
    return round_even(size.cast("double") / F.lit(float(unit)), digits)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.lit(100.0) * part / whole).otherwise(0.0)


def percent_bytes(effective: Column, expected_bytes: Column, done: Column, expected: Column) -> Column:
    return F.when(expected_bytes != 0, F.lit(100.0) * effective / expected_bytes).otherwise(percent(done, expected))


def run_rate(rate_bps: Column, bytes_written: Column, elapsed_s: Column) -> Column:
    """The stated rate, else the mean since the start."""
    mean = F.when(elapsed_s > 0, bytes_written / elapsed_s).otherwise(0.0)
    return F.coalesce(rate_bps, mean)


def resumed_rate(effective: Column, start_bytes: Column, elapsed_s: Column) -> Column:
    """Rate of this run alone: bytes a resume started from do not count."""
    return F.when(elapsed_s > 0, F.greatest(F.lit(0.0), (effective - start_bytes) / elapsed_s)).otherwise(0.0)


def remaining_bytes(expected_bytes: Column, effective: Column, bytes_written: Column, done: Column,
                    expected: Column) -> Column:
    mean_size = F.when(done != 0, bytes_written / done).otherwise(0.0)
    known = F.greatest(F.lit(0), expected_bytes - effective).cast("double")
    return F.when(expected_bytes != 0, known).otherwise(F.greatest(F.lit(0), expected - done) * mean_size)


def eta_text(remaining: Column, rate_bps: Column) -> Column:
    seconds = F.floor(remaining / rate_bps).cast("bigint")
    hours = F.floor(seconds / 3600).cast("bigint")
    minutes = F.floor((seconds % 3600) / 60).cast("bigint")
    return (
        F.when(F.coalesce(rate_bps, F.lit(0.0)) <= 0, "?")
        .when(hours > 0, F.format_string("%dh%02dm", hours, minutes))
        .when(minutes > 0, F.format_string("%dm%02ds", minutes, seconds % 60))
        .otherwise(F.format_string("%ds", seconds))
    )
