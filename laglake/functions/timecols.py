"""Time-zone-free time arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laglake.session import EPOCH_NTZ


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_ntz(c) -> Column:
    """Timestamps are handled as wall-clock NTZ values; TIMESTAMP input is cast in the session zone."""
    return _col(c).cast("timestamp_ntz")


def _epoch() -> Column:
    return F.expr(EPOCH_NTZ)


def micro_index(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 (BIGINT), exact; the ordering key of frames and grids."""
    return F.timestamp_diff("MICROSECOND", _epoch(), as_ntz(ts))


def from_micro_index(m) -> Column:
    return F.timestamp_add("MICROSECOND", _col(m), _epoch())


def minute_index(ts) -> Column:
    """Whole minutes since 1970-01-01 00:00 (BIGINT), the ordering key of RANGE frames."""
    return F.timestamp_diff("MINUTE", _epoch(), as_ntz(ts))


def from_minute_index(m) -> Column:
    return F.timestamp_add("MINUTE", _col(m), _epoch())


def floor_to_step(ts, minutes: int) -> Column:
    """Floor a timestamp onto the epoch-anchored grid of ``minutes``."""
    m = minute_index(ts)
    return from_minute_index(F.floor(m / F.lit(int(minutes))).cast("long") * int(minutes))


# Strftime directives and their Spark datetime-pattern equivalents.
STRFTIME_TO_SPARK = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
    "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%f": "SSSSSS", "%%": "%",
}


def strftime_to_spark(fmt: str) -> str:
    """Translate a strftime format into a Spark pattern; literal text is quoted."""
    out, lit, i = [], [], 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in STRFTIME_TO_SPARK:
            if lit:
                out.append("'" + "".join(lit).replace("'", "''") + "'")
                lit = []
            out.append(STRFTIME_TO_SPARK[tok])
            i += 2
        else:
            ch = fmt[i]
            if ch.isalpha() or ch == "'":
                lit.append(ch)
            else:
                if lit:
                    out.append("'" + "".join(lit).replace("'", "''") + "'")
                    lit = []
                out.append(ch)
            i += 1
    if lit:
        out.append("'" + "".join(lit).replace("'", "''") + "'")
    return "".join(out)
