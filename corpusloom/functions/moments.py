"""Time-zone helpers: values without a zone are read as UTC, whatever the session's zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import Cols, _c


def as_utc(value: Cols) -> Column:
    """The moment a zone-less timestamp names in UTC."""
    return F.from_utc_timestamp(_c(value).cast("timestamp"), F.current_timezone())


def utc_clock(moment: Cols) -> Column:
    """The zone-less UTC clock reading of a moment."""
    return F.to_utc_timestamp(_c(moment), F.current_timezone()).cast("timestamp_ntz")
