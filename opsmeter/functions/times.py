"""Timestamps without zone, durations and month keys."""

from __future__ import annotations

# The first and last moments that count as a valid timestamp
# (the range of 64-bit nanoseconds around 1970).
EARLIEST = "1677-09-21 00:12:43.145225"
LATEST = "2262-04-11 23:47:16.854775"

MICROS_PER_HOUR = 3_600_000_000


# behind the clock time something other than digits: an offset or a zone
_ZONED = r":[0-9]{1,2}([.][0-9]*)?[ ]*[^0-9.: ]"


def _in_range(parsed: str) -> str:
    return (
        f"IF({parsed} >= TIMESTAMP_NTZ '{EARLIEST}' AND {parsed} <= TIMESTAMP_NTZ '{LATEST}', "
        f"{parsed}, NULL)"
    )


def parse_timestamp(value: str, is_text: bool = True) -> str:
    """Zone-less timestamp of an ISO date or ISO timestamp, null when it is neither.

    Every value is read on its own; one column may mix dates and timestamps. A text with an
    offset or a zone is converted to UTC, whatever the session's zone. ``is_text=False``
    spares a column of timestamps the look at its text.
    """
    parsed = f"try_cast({value} AS TIMESTAMP_NTZ)"
    if not is_text:
        return _in_range(parsed)
    micros = f"unix_micros(try_cast({value} AS TIMESTAMP))"
    in_utc = (
        f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({micros} AS DECIMAL(20,0)) / 1000000)"
    )
    return f"CASE WHEN CAST({value} AS STRING) RLIKE '{_ZONED}' THEN {_in_range(in_utc)} ELSE {_in_range(parsed)} END"


def micros_between(start: str, end: str) -> str:
    """Whole microseconds, the same in every session time zone."""
    seconds = f"CAST(CAST({end} - {start} AS INTERVAL SECOND) AS DECIMAL(18,6))"
    return f"CAST({seconds} * 1000000 AS BIGINT)"


def as_hours(micros: str) -> str:
    return f"(CAST({micros} AS DOUBLE) / {MICROS_PER_HOUR}D)"


def month_key(iso_date: str) -> str:
    """``YYYY-MM`` of an ISO date, held as text or as a date."""
    return f"substr(CAST({iso_date} AS STRING), 1, 7)"
