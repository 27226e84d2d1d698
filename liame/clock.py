"""The engine's clock: a fixed anchor instead of the wall clock, and local calendar days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR = "2026-09-01 00:00:00"
ZONE = "America/Sao_Paulo"


def anchor(at: str = ANCHOR) -> Column:
    """The instant that counts as now, UTC without zone like the stored times."""
    return F.lit(at).cast("timestamp_ntz")


def before(days: int, at: str = ANCHOR) -> Column:
    """``days`` elapsed days before the anchor."""
    return anchor(at) - F.expr(f"interval {int(days)} days")


def local_day(ts: Column, zone: str = ZONE) -> Column:
    """Calendar day of a UTC time in ``zone``."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts))


def folded_day(ts: Column, at: str = ANCHOR, zone: str = ZONE) -> Column:
    """Local calendar day, a future day counted as today."""
    return F.least(local_day(ts, zone), local_day(anchor(at), zone))


def day_start(day: Column, zone: str = ZONE) -> Column:
    """UTC instant at which a local calendar day begins."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))
