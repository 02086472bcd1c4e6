"""Julian dates as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modified Julian date of 1970-01-01, its offset from the Julian date, and J2000.
UNIX_MJD, MJD_JD, J2000 = 40587.0, 2400000.5, 2451545.0


def mjd(t: Column) -> Column:
    """Modified Julian date (days, double) of a date or timestamp in UTC; null stays null."""
    return F.unix_micros(t.cast("timestamp")) / F.lit(86_400_000_000.0) + F.lit(UNIX_MJD)


def jd(t: Column) -> Column:
    return mjd(t) + F.lit(MJD_JD)


def from_mjd(days: Column) -> Column:
    """The timestamp of a modified Julian date."""
    return F.timestamp_micros(F.round((days - F.lit(UNIX_MJD)) * F.lit(86_400_000_000.0)).cast("long"))


def julian_epoch(t: Column) -> Column:
    """Years of 365.25 days, J2000.0 being noon of 2000-01-01."""
    return F.lit(2000.0) + (jd(t) - F.lit(J2000)) / F.lit(365.25)
