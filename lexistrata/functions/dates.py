"""Calendar, formatting and parsing of times in seconds since the epoch, UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named zones and their offsets in hours.
ZONES = {"jst": 9, "cct": 8, "kst": 9, "edt": -4, "est": -5, "cdt": -5, "cst": -6, "mdt": -6, "mst": -7, "pdt": -7, "pst": -8, "hdt": -9, "hst": -10, "gmt": 0, "utc": 0}
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _at(seconds: Column, offset: int = 0) -> Column:
    """A wall-clock time without a zone, so results don't depend on the session's."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(seconds + offset).cast("decimal(18,6)"))


def epoch_seconds(wall_clock: Column) -> Column:
    """Seconds since the epoch of a time without a zone, read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), wall_clock.cast("timestamp_ntz"))


def calendar(seconds: Column, offset: int = 0) -> Column:
    """struct(year, month, day, hour, minute, second) at the offset (in seconds) from UTC."""
    t = _at(seconds, offset)
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).cast("int").alias("second"))


def day_of_week(seconds: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(_at(seconds)) - 1


def w3c(seconds: Column, offset: int = 0) -> Column:
    sign, minutes = ("-" if offset < 0 else "+"), abs(offset) // 60
    zone = "Z" if not offset else f"{sign}{minutes // 60:02d}:{minutes % 60:02d}"
    return F.concat(F.date_format(_at(seconds, offset), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))


def rfc1123(seconds: Column) -> Column:
    return F.concat(F.date_format(_at(seconds), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def _epoch(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(mo, 2, "0"), F.lpad(d, 2, "0"))
    part = [F.when(x == "", F.lit(0)).otherwise(x.try_cast("bigint")) for x in (h, mi, s)]
    return F.unix_date(text.try_cast("date")).cast("long") * 86400 + part[0] * 3600 + part[1] * 60 + part[2]


def _offset(zone: Column) -> Column:
    """Seconds east of UTC of `Z`, a named zone, or +hh:mm, +hhmm; 0 if empty."""
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    numeric = sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60)
    named = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v * 3600)])
    return F.when(zone.rlike("^[+-]"), numeric).otherwise(F.coalesce(F.try_element_at(named, F.lower(zone)), F.lit(0)))


def parse(text: Column) -> Column:
    """Seconds of a decimal or 0x number, YYYY-MM-DD[Thh:mm:ss[Z|+hh:mm]], YYYY/MM/DD [hh:mm:ss], or an RFC 1123 date with a
    named or numeric zone; -1 for anything else."""
    t = F.trim(text)
    iso = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(Z|[+-]\d{2}:?\d{2})?)?$"
    rfc = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?: ([A-Za-z]{1,4}|[+-]\d{4}))?$"
    # one pass each: fields year, month, day, hour, minute, second, zone
    fields = F.when(t.rlike(iso), F.split(F.regexp_replace(t, iso, "$1|$2|$3|$4|$5|$6|$7"), "\\|"))
    fields = fields.when(t.rlike(rfc), F.split(F.regexp_replace(t, rfc, "$3|$2|$1|$4|$5|$6|$7"), "\\|"))
    months = F.create_map(*[F.lit(x) for n, m in enumerate(_MONTHS) for x in (m, str(n + 1))])

    def seconds(f: Column) -> Column:
        return _epoch(f[0], F.coalesce(F.try_element_at(months, F.lower(f[1])), f[1]), *[f[n] for n in range(2, 6)]) - _offset(f[6])

    dated = F.transform(F.array(fields), lambda f: F.when(f.isNotNull(), seconds(f)))[0]  # binds the fields once
    value = F.when(t.rlike(r"^-?\d+$"), t.try_cast("bigint")).when(t.rlike("^0[xX][0-9A-Fa-f]+$"), F.conv(F.substr(t, F.lit(3)), 16, 10).try_cast("bigint")).otherwise(dated)
    return F.coalesce(value, F.lit(-1).cast("long"))


def jetlag(seconds: Column, zone: str | Column) -> Column:
    """The zone's offset from UTC in seconds at that time."""
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, _at(seconds))
    return F.timestamp_diff("SECOND", _at(seconds), wall)
