"""Temporal values: exact arithmetic on the driver for literals, column expressions for dates and date-times."""

from __future__ import annotations

import datetime as dt
import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import GraphQueryError, semantic
from . import types as ty

NANOS, DAY = 1_000_000_000, 86_400
MONTH_SECONDS = 2_629_746  # the mean length of a month in the Gregorian calendar
DATE_FORMS = (
    (re.compile(r"^([+-]?\d{4,9})-(\d\d)-(\d\d)$"), ("year", "month", "day")),
    (re.compile(r"^(\d{4})(\d\d)(\d\d)$"), ("year", "month", "day")),
    (re.compile(r"^(\d{4})-?W(\d\d)-?(\d)$"), ("year", "week", "dayOfWeek")),
    (re.compile(r"^(\d{4})-?W(\d\d)$"), ("year", "week")),
    (re.compile(r"^(\d{4})-?Q(\d)-?(\d\d)$"), ("year", "quarter", "dayOfQuarter")),
    (re.compile(r"^(\d{4})-?(\d{3})$"), ("year", "ordinalDay")),
    (re.compile(r"^(\d{4})-(\d\d)$"), ("year", "month")),
    (re.compile(r"^(\d{4})(\d\d)$"), ("year", "month")),
    (re.compile(r"^(\d{4})$"), ("year",)),
)
TIME_FORM = re.compile(r"^(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d{1,9}))?)?)?$")
ZONE_FORM = re.compile(r"^(.*?)(Z|[+-]\d\d(?::?\d\d)?(?::?\d\d)?)?(?:\[([^\]]+)\])?$")
DURATION_FORM = re.compile(r"^([-+]?)P(?:([-+]?[\d.]+)Y)?(?:([-+]?[\d.]+)M)?(?:([-+]?[\d.]+)W)?(?:([-+]?[\d.]+)D)?(?:T(?:([-+]?[\d.]+)H)?(?:([-+]?[\d.]+)M)?(?:([-+]?[\d.]+)S)?)?$")


def failed(message: str) -> GraphQueryError:
    return GraphQueryError(f"RuntimeError: {message}")


def date_of(fields: dict) -> dt.date:
    try:
        base = fields.get("date")
        if isinstance(base, dt.datetime):
            base = base.date()
        if "week" in fields or "dayOfWeek" in fields:
            year, week, day = base.isocalendar() if base else (None, 1, 1)
            return dt.date.fromisocalendar(fields.get("year", year), fields.get("week", week), fields.get("dayOfWeek", day))
        year = fields.get("year", base.year if base else None)
        if year is None:
            raise failed("a date needs a year")
        if "ordinalDay" in fields:
            return dt.date(year, 1, 1) + dt.timedelta(days=checked(fields["ordinalDay"], 366) - 1)
        if "quarter" in fields or "dayOfQuarter" in fields:
            quarter = fields.get("quarter", (base.month + 2) // 3 if base else 1)
            start = dt.date(year, 3 * quarter - 2, 1)
            if "dayOfQuarter" in fields or not base:
                return start + dt.timedelta(days=checked(fields.get("dayOfQuarter", 1), 92) - 1)
            return dt.date(year, 3 * quarter - 2 + (base.month - 1) % 3, base.day)
        return dt.date(year, fields.get("month", base.month if base else 1), fields.get("day", base.day if base else 1))
    except (ValueError, OverflowError) as e:
        raise failed(f"not a date: {e}") from None


def checked(n: int, most: int) -> int:
    if not 1 <= n <= most:
        raise failed(f"{n} is out of range")
    return n


def parsed_date(text: str) -> dt.date:
    for form, names in DATE_FORMS:
        if m := form.match(text):
            return date_of(dict(zip(names, map(int, m.groups()), strict=True)))
    raise failed(f"not a date: {text!r}")


def parsed_nanos(text: str) -> int:
    m = TIME_FORM.match(text)
    if not m:
        raise failed(f"not a time: {text!r}")
    h, mi, s = (int(x or 0) for x in m.groups()[:3])
    if h > 23 or mi > 59 or s > 59:
        raise failed(f"not a time: {text!r}")
    return (h * 3600 + mi * 60 + s) * NANOS + int((m[4] or "0").ljust(9, "0"))


def nanos_of(fields: dict) -> int:
    base = fields.get("time")
    parts = (base // NANOS // 3600, base // NANOS // 60 % 60, base // NANOS % 60) if isinstance(base, int) else (0, 0, 0)
    h, m, s = (fields.get(k, parts[i]) for i, k in enumerate(("hour", "minute", "second")))
    if not (0 <= h < 24 and 0 <= m < 60 and 0 <= s < 60):
        raise failed("not a time")
    fine = [fields.get(k, 0) for k in ("millisecond", "microsecond", "nanosecond")]
    if any(k in fields for k in ("millisecond", "microsecond", "nanosecond")) or not isinstance(base, int):
        sub = fine[0] * 1_000_000 + fine[1] * 1000 + fine[2]
    else:
        sub = base % NANOS
    return (h * 3600 + m * 60 + s) * NANOS + sub


def offset_of(text: str | None) -> int | None:
    if not text:
        return None
    if text == "Z":
        return 0
    digits = text[1:].replace(":", "").ljust(6, "0")
    return (-1 if text[0] == "-" else 1) * (int(digits[:2]) * 3600 + int(digits[2:4]) * 60 + int(digits[4:6]))


def zone_offset(zone: str, local: dt.datetime) -> int:
    from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

    if re.match(r"^(Z|[+-]\d)", zone):
        return offset_of(zone)
    try:
        return int(local.replace(tzinfo=ZoneInfo(zone)).utcoffset().total_seconds())
    except (ZoneInfoNotFoundError, ValueError):
        raise failed(f"unknown time zone {zone!r}") from None


def midnight_plus(day: dt.date, nanos: int) -> dt.datetime:
    return dt.datetime(day.year, day.month, day.day) + dt.timedelta(microseconds=nanos // 1000)


def split_zone(text: str) -> tuple[str, int | None, str | None]:
    """Body, offset and zone name of a text; the offset of a date alone is none."""
    body, _, clock = text.partition("T")
    m = ZONE_FORM.match(clock if clock else body)
    return (f"{body}T{m[1]}" if clock else m[1]), offset_of(m[2]), m[3]


def parsed(kind: str, text: str):
    """A Python value for a text: date; datetime; nanos; (nanos, offset); (datetime, offset, zone, nanos)."""
    if kind == "date":
        return parsed_date(text)
    if kind == "localtime":
        return parsed_nanos(text)
    if kind == "time":
        body, offset, zone = split_zone(text)
        return parsed_nanos(body), offset if offset is not None else zone_offset(zone, dt.datetime(1970, 1, 1)) if zone else 0
    body, offset, zone = split_zone(text) if kind == "datetime" else (text, None, None)
    day, _, clock = body.partition("T")
    nanos = parsed_nanos(clock) if clock else 0
    local = midnight_plus(parsed_date(day), nanos)
    if kind == "localdatetime":
        return local
    if offset is None:
        offset = zone_offset(zone, local) if zone else 0
    return local, offset, zone, nanos % NANOS


def built(kind: str, fields: dict):
    """The same from a map of fields; date, time and datetime fields select from other values."""
    fields = dict(fields)
    source = fields.get("datetime")
    if source is not None:
        source = source[0] if isinstance(source, tuple) else source
        fields.setdefault("date", source.date())
        fields.setdefault("time", (source - dt.datetime(source.year, source.month, source.day)) // dt.timedelta(microseconds=1) * 1000)
    clock = fields.get("time")
    if isinstance(clock, tuple):
        fields["time"], clock = (clock[0], clock) if len(clock) == 2 else ((clock[0] - dt.datetime.combine(clock[0].date(), dt.time())) // dt.timedelta(microseconds=1) * 1000, clock)
    elif isinstance(clock, dt.datetime):
        fields["time"] = (clock - dt.datetime.combine(clock.date(), dt.time())) // dt.timedelta(microseconds=1) * 1000
    if isinstance(fields.get("date"), tuple):
        fields["date"] = fields["date"][0].date()
    zone = fields.get("timezone")
    if kind == "date":
        return date_of(fields)
    nanos = nanos_of(fields)
    if kind == "localtime":
        return nanos
    if kind == "time":
        return nanos, zone_offset(zone, dt.datetime(1970, 1, 1)) if zone else clock[1] if isinstance(clock, tuple) else 0
    local = midnight_plus(date_of(fields), nanos)
    if kind == "localdatetime":
        return local
    return local, zone_offset(zone, local) if zone else 0, zone if zone and not re.match(r"^(Z|[+-]\d)", zone) else None, nanos % NANOS


UNITS = {"years": (12, 0, 0), "quarters": (3, 0, 0), "months": (1, 0, 0), "weeks": (0, 7, 0), "days": (0, 1, 0), "hours": (0, 0, 3600 * NANOS), "minutes": (0, 0, 60 * NANOS), "seconds": (0, 0, NANOS), "milliseconds": (0, 0, 1_000_000), "microseconds": (0, 0, 1000), "nanoseconds": (0, 0, 1)}


def duration_of(parts: dict) -> tuple[int, int, int, int]:
    """(months, days, seconds, nanos): fractions of a unit go on to the next smaller one."""
    months = days = nanos = Fraction(0)
    for unit, value in parts.items():
        if unit not in UNITS:
            raise failed(f"unknown duration field {unit!r}")
        m, d, n = UNITS[unit]
        value = Fraction(str(value))
        months, days, nanos = months + m * value, days + d * value, nanos + n * value
    whole = int(months)
    seconds = (months - whole) * MONTH_SECONDS
    days += int(seconds / DAY)
    nanos += (seconds - int(seconds / DAY) * DAY) * NANOS
    whole_days = int(days)
    nanos += (days - whole_days) * DAY * NANOS
    total = int(nanos)
    s = abs(total) // NANOS * (1 if total >= 0 else -1)
    n = total - s * NANOS
    if n < 0:
        s, n = s - 1, n + NANOS
    return whole, whole_days, s, n


def parsed_duration(text: str) -> tuple[int, int, int, int]:
    m = DURATION_FORM.match(text)
    if not m or len(text) < 3:
        raise failed(f"not a duration: {text!r}")
    names = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")
    sign = -1 if m[1] == "-" else 1
    return duration_of({n: sign * Fraction(v) for n, v in zip(names, m.groups()[1:], strict=True) if v})


def literal(t: ty.T, value) -> Column:
    """A Python value as a column of its type."""
    if value is None:
        return F.lit(None).cast(ty.to_spark(t))
    lit = lambda x: F.lit(x).cast("long")
    if t == ty.DATE:
        return F.lit(value)
    ntz = lambda v: F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    if t == ty.LOCALDATETIME:
        return ntz(value)
    if t == ty.LOCALTIME:
        return F.struct(lit(value).alias("nanos"))
    if t == ty.TIME:
        return F.struct(lit(value[0]).alias("nanos"), lit(value[1]).alias("offset"))
    if t == ty.DATETIME:
        return F.struct(ntz(value[0]).alias("ts"), lit(value[1]).alias("offset"), F.lit(value[2]).cast("string").alias("zone"), lit(value[3]).alias("nanos"))
    return F.struct(*[lit(v).alias(n) for v, n in zip(value, ("months", "days", "seconds", "nanos"), strict=True)])


# arithmetic on constants

YEARS = {"decade": 10, "century": 100, "millennium": 1000}
CLOCK_UNITS = {"day": DAY * NANOS, "hour": 3600 * NANOS, "minute": 60 * NANOS, "second": NANOS, "millisecond": 1_000_000, "microsecond": 1000}


def parts_of(v) -> tuple[dt.date | None, int, int | None, str | None]:
    """Date, nanoseconds of the day, offset and zone of a value, as far as it has them."""
    if isinstance(v, dt.datetime):
        return v.date(), (v - dt.datetime.combine(v.date(), dt.time())) // dt.timedelta(microseconds=1) * 1000, None, None
    if isinstance(v, dt.date):
        return v, 0, None, None
    if isinstance(v, int):
        return None, v, None, None
    if len(v) == 2:
        return None, v[0], v[1], None
    day, nanos, _, _ = parts_of(v[0])
    return day, nanos - nanos % NANOS + v[3], v[1], v[2]


def truncated_constant(kind: str, unit: str, v, fields: dict):
    """The start of the unit that a value lies in, as a value of the kind, with fields set over it."""
    day, nanos, offset, zone = parts_of(v)
    unit = unit.lower()
    if unit in CLOCK_UNITS:
        nanos -= nanos % CLOCK_UNITS[unit]
    elif day is None:
        raise failed(f"a time has no {unit}")
    else:
        nanos = 0
        if unit in YEARS:
            day = dt.date(max(1, day.year - day.year % YEARS[unit]), 1, 1)
        elif unit == "weekyear":
            day = dt.date.fromisocalendar(day.isocalendar()[0], 1, 1)
        elif unit == "year":
            day = day.replace(month=1, day=1)
        elif unit == "quarter":
            day = day.replace(month=3 * ((day.month - 1) // 3) + 1, day=1)
        elif unit == "month":
            day = day.replace(day=1)
        elif unit == "week":
            day -= dt.timedelta(days=day.weekday())
        else:
            raise failed(f"unknown unit {unit!r}")
    own: dict = {"time": nanos} if kind != "date" else {}
    if day is not None and kind not in ("localtime", "time"):
        own["date"] = day
    elif day is None and kind not in ("localtime", "time"):
        raise failed(f"a {kind} needs a date")
    if kind in ("time", "datetime") and "timezone" not in fields and (zone or offset):
        own["timezone"] = zone or ("-" if offset < 0 else "+") + f"{abs(offset) // 3600:02d}:{abs(offset) // 60 % 60:02d}"
    sub = {k: fields[k] for k in ("millisecond", "microsecond", "nanosecond") if k in fields}
    fields = {k: x for k, x in fields.items() if k not in sub}
    out = built(kind, own | fields)
    if not sub:
        return out
    # smaller parts are added to what the truncation has left of larger ones
    extra = sub.get("millisecond", 0) * 1_000_000 + sub.get("microsecond", 0) * 1000 + sub.get("nanosecond", 0)
    if isinstance(out, int):
        return out + extra
    if isinstance(out, tuple):
        return (out[0] + extra, out[1]) if len(out) == 2 else (out[0] + dt.timedelta(microseconds=extra // 1000), *out[1:3], out[3] + extra)
    return out + dt.timedelta(microseconds=extra // 1000)


def months_after(day: dt.date, months: int) -> dt.date:
    """The same day so many months on, or the last of a shorter month."""
    at = day.year * 12 + day.month - 1 + months
    last = (dt.date(at // 12 + at % 12 // 11, (at + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(at // 12, at % 12 + 1, min(day.day, last))


def between_constants(kind: str, a, b) -> tuple[int, int, int, int]:
    """Duration from a to b as (months, days, seconds, nanos); of values without a date their times alone count."""
    (da, na, oa, _), (db, nb, ob, _) = parts_of(a), parts_of(b)
    if oa is not None and ob is not None:
        na, nb = na - oa * NANOS, nb - ob * NANOS
    dated = da is not None and db is not None
    if not dated:
        da = db = dt.date(1970, 1, 1)
    total = (db - da).days * DAY * NANOS + nb - na

    def split(nanos: int) -> tuple[int, int]:
        return nanos // NANOS, nanos % NANOS

    if kind == "inSeconds" or not dated:
        return (0, 0, *split(total)) if kind in ("inSeconds", "between") else (0, 0, 0, 0)
    whole_days = abs(total) // (DAY * NANOS) * (1 if total >= 0 else -1)
    if kind == "inDays":
        return 0, whole_days, 0, 0
    months = (db.year - da.year) * 12 + db.month - da.month
    sign = 1 if total >= 0 else -1
    rest = lambda m: (db - months_after(da, m)).days * DAY * NANOS + nb - na
    while months * sign > 0 and rest(months) * sign < 0:
        months -= sign
    if kind == "inMonths":
        return months, 0, 0, 0
    left = rest(months)
    days = abs(left) // (DAY * NANOS) * (1 if left >= 0 else -1)
    return (months, days, *split(left - days * DAY * NANOS))


# columns

SECOND_PARTS = {"hour": (3600 * NANOS, 24), "minute": (60 * NANOS, 60), "second": (NANOS, 60), "millisecond": (1_000_000, 1000), "microsecond": (1000, 1_000_000), "nanosecond": (1, NANOS)}


def nanos_in_day(c: Column, t: ty.T) -> Column:
    if t in (ty.LOCALTIME, ty.TIME):
        return c["nanos"]
    ts = c["ts"] if t == ty.DATETIME else c
    second = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long") * NANOS
    fine = c["nanos"] if t == ty.DATETIME else F.date_format(ts, "SSSSSS").cast("long") * 1000
    return second + fine


def component(c: Column, t: ty.T, key: str) -> Column | None:
    """A component of a temporal column, or None if the type has none of that name."""
    if t == ty.DURATION:
        return duration_component(c, key)
    day = c["ts"] if t == ty.DATETIME else c
    if t in (ty.DATE, ty.LOCALDATETIME, ty.DATETIME):
        quarter_start = F.make_date(F.year(day), 3 * F.quarter(day) - 2, F.lit(1))
        found = {
            "year": F.year(day), "quarter": F.quarter(day), "month": F.month(day), "week": F.weekofyear(day), "weekYear": F.extract(F.lit("YEAROFWEEK"), day),
            "day": F.day(day), "ordinalDay": F.dayofyear(day), "weekDay": F.weekday(day) + 1, "dayOfWeek": F.weekday(day) + 1, "dayOfQuarter": F.datediff(day.cast("date"), quarter_start) + 1,
        }.get(key)
        if found is not None:
            return found.cast("long")
    if t != ty.DATE and key in SECOND_PARTS:
        unit, size = SECOND_PARTS[key]
        n = nanos_in_day(c, t)
        return (F.floor(n / unit) % size if key in ("hour", "minute", "second") else F.floor(n % NANOS / unit)).cast("long")
    if t in (ty.TIME, ty.DATETIME):
        offset = c["offset"]
        sign, size = F.when(offset < 0, "-").otherwise("+"), F.abs(offset)
        text = F.when(offset == 0, "Z").otherwise(F.format_string("%s%02d:%02d", sign, F.floor(size / 3600), F.floor(size / 60) % 60))
        found = {"offset": text, "offsetMinutes": F.floor(offset / 60), "offsetSeconds": offset, "timezone": F.coalesce(c["zone"], text) if t == ty.DATETIME else text}.get(key)
        if found is not None:
            return found
    if t == ty.DATETIME and key in ("epochSeconds", "epochMillis"):
        seconds = F.datediff(day.cast("date"), F.lit(dt.date(1970, 1, 1))).cast("long") * DAY + F.floor(nanos_in_day(c, t) / NANOS) - c["offset"]
        return seconds if key == "epochSeconds" else seconds * 1000 + F.floor(c["nanos"] / 1_000_000)
    return None


def duration_component(c: Column, key: str) -> Column | None:
    m, d, s, n = (c[k] for k in ("months", "days", "seconds", "nanos"))
    whole = lambda x, y: F.call_function("div", x, F.lit(y).cast("long"))
    return {
        "years": whole(m, 12), "quarters": whole(m, 3), "months": m, "weeks": whole(d, 7), "days": d, "hours": whole(s, 3600), "minutes": whole(s, 60), "seconds": s,
        "milliseconds": s * 1000 + whole(n, 1_000_000), "microseconds": s * 1_000_000 + whole(n, 1000), "nanoseconds": s * NANOS + n,
        "quartersOfYear": whole(m, 3) % 4, "monthsOfQuarter": m % 3, "monthsOfYear": m % 12, "daysOfWeek": d % 7, "minutesOfHour": whole(s, 60) % 60, "secondsOfMinute": s % 60,
        "millisecondsOfSecond": whole(n, 1_000_000), "microsecondsOfSecond": whole(n, 1000), "nanosecondsOfSecond": n,
    }.get(key)


def ranged(c: Column, least: int, most: int, what: str) -> Column:
    return F.when(c.between(least, most), c).otherwise(F.raise_error(F.concat(F.lit(f"not a {what}: "), c.cast("string"))))


def date_columns(fields: dict[str, Column]) -> Column:
    """A date from columns of its fields, over the field date if it is there."""
    base = fields.get("date")
    get = lambda name, of, default: fields.get(name, of(base) if base is not None else F.lit(default)).cast("int")
    if "week" in fields or "dayOfWeek" in fields:
        year = get("year", lambda d: F.extract(F.lit("YEAROFWEEK"), d), None)
        monday = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4)).cast("timestamp_ntz")).cast("date")
        week, day = ranged(get("week", F.weekofyear, 1), 1, 53, "week"), ranged(get("dayOfWeek", lambda d: F.weekday(d) + 1, 1), 1, 7, "weekday")
        found = F.date_add(monday, (week - 1) * 7 + day - 1)
        return F.when(F.extract(F.lit("YEAROFWEEK"), found) == year, found).when(found.isNotNull(), F.raise_error(F.lit("not a date: its year has no such week")).cast("date"))
    if "year" not in fields and base is None:
        raise failed("a date needs a year")
    year = get("year", F.year, None)
    if "ordinalDay" in fields:
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), ranged(fields["ordinalDay"].cast("int"), 1, 366, "day of a year") - 1)
    if "quarter" in fields or "dayOfQuarter" in fields:
        quarter = get("quarter", F.quarter, 1)
        if "dayOfQuarter" in fields or base is None:
            day = ranged(fields["dayOfQuarter"].cast("int"), 1, 92, "day of a quarter") if "dayOfQuarter" in fields else F.lit(1)
            return F.date_add(F.make_date(year, 3 * quarter - 2, F.lit(1)), day - 1)
        return F.make_date(year, 3 * quarter - 2 + (F.month(base) - 1) % 3, F.day(base))
    return F.make_date(year, get("month", F.month, 1), get("day", F.day, 1))


def nanos_columns(fields: dict[str, Column]) -> Column:
    """Nanoseconds of a day from columns of its fields, over the field time (nanoseconds) if it is there."""
    base, long = fields.get("time"), lambda c: c.cast("long")
    parts = {"hour": (3600, 24), "minute": (60, 60), "second": (1, 60)}
    total = F.lit(0).cast("long")
    for name, (size, most) in parts.items():
        own = F.floor(base / (size * NANOS)) % most if base is not None else F.lit(0)
        total = total + long(ranged(long(fields[name]), 0, most - 1, name) if name in fields else own) * size
    fine = {"millisecond": 1_000_000, "microsecond": 1000, "nanosecond": 1}
    if base is not None and not any(k in fields for k in fine):
        return total * NANOS + base % NANOS
    return total * NANOS + sum((long(fields[k]) * n for k, n in fine.items() if k in fields), F.lit(0).cast("long"))


def at(day: Column, nanos: Column) -> Column:
    """Date and nanoseconds of the day as a date-time, to the microsecond."""
    seconds = F.timestamp_add("SECOND", F.floor(nanos / NANOS).cast("int"), day.cast("timestamp_ntz"))
    return F.timestamp_add("MICROSECOND", F.floor(nanos % NANOS / 1000).cast("int"), seconds)


def offset_column(text: Column) -> Column:
    """Seconds of an offset like +02:00; null where the text is none."""
    digits = F.rpad(F.regexp_replace(F.substring(text, 2, 8), ":", ""), 6, "0")
    part = lambda i: F.substring(digits, i, 2).try_cast("long")
    size = part(1) * 3600 + part(3) * 60 + part(5)
    return F.when(text == "Z", F.lit(0).cast("long")).when(F.rlike(text, F.lit(r"^[+-]\d\d(:?\d\d)?(:?\d\d)?$")), F.when(F.startswith(text, F.lit("-")), -size).otherwise(size))


def zone_column(zone: Column, local: Column) -> Column:
    """Seconds that a zone, by name or offset, is ahead at a local time."""
    named = F.timestamp_diff("SECOND", F.convert_timezone(F.when(offset_column(zone).isNull(), zone), F.lit("UTC"), local), local)
    return F.coalesce(offset_column(zone), named)


def assembled(to: ty.T, day: Column | None, nanos: Column, offset: Column | None = None, zone: Column | None = None) -> Column:
    """A value of the type from its parts; an offset that is not given is that of the zone, or 0. Null where a part is."""
    long, zero = lambda c: c.cast("long"), F.lit(0).cast("long")
    if to == ty.DATE:
        return day
    if to == ty.LOCALTIME:
        return F.when(nanos.isNotNull(), F.struct(long(nanos).alias("nanos")))
    if to == ty.TIME:
        own = F.coalesce(*([offset] if offset is not None else []), *([zone_column(zone, F.lit("1970-01-01").cast("timestamp_ntz"))] if zone is not None else []), zero)
        return F.when(nanos.isNotNull(), F.struct(long(nanos).alias("nanos"), long(own).alias("offset")))
    if day is None:
        raise failed(f"a {to} needs a date")
    local = at(day, nanos)
    if to == ty.LOCALDATETIME:
        return local
    own = F.coalesce(*([offset] if offset is not None else []), *([zone_column(zone, local)] if zone is not None else []), zero)
    name = F.when(offset_column(zone).isNull(), zone) if zone is not None else F.lit(None).cast("string")
    return F.when(local.isNotNull(), F.struct(local.alias("ts"), long(own).alias("offset"), name.alias("zone"), long(nanos % NANOS).alias("nanos")))


def parts_columns(c: Column, t: ty.T) -> tuple[Column | None, Column, Column | None, Column | None]:
    """Date, nanoseconds of the day, offset and zone of a column, as far as its type has them."""
    if t == ty.DATE:
        return c, F.lit(0).cast("long"), None, None
    day = None if t in (ty.LOCALTIME, ty.TIME) else (c["ts"] if t == ty.DATETIME else c).cast("date")
    return day, nanos_in_day(c, t), c["offset"] if t in (ty.TIME, ty.DATETIME) else None, c["zone"] if t == ty.DATETIME else None


def text_column(to: ty.T, c: Column) -> Column:
    """A column of texts in any of the forms that a literal may have; another text is an error when it is read."""

    def bad(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"not a {what}: "), c))

    def date(x: Column) -> Column:
        out = F.when(x.isNull(), F.lit(None).cast("date"))
        for form, names in DATE_FORMS:
            own = {n: F.regexp_extract(x, form.pattern, i + 1).try_cast("int") for i, n in enumerate(names)}
            out = out.when(F.rlike(x, F.lit(form.pattern)), date_columns(own))
        return out.otherwise(bad("date").cast("date"))

    def clock(x: Column) -> Column:
        h, m, s, f = (F.coalesce(F.regexp_extract(x, TIME_FORM.pattern, i).try_cast("long"), F.lit(0)) for i in (1, 2, 3, 4))
        fine = F.coalesce(F.rpad(F.regexp_extract(x, TIME_FORM.pattern, 4), 9, "0").try_cast("long"), F.lit(0))
        good = F.rlike(x, F.lit(TIME_FORM.pattern)) & (h < 24) & (m < 60) & (s < 60) & f.isNotNull()
        return F.when(x.isNull(), F.lit(None).cast("long")).when(good, (h * 3600 + m * 60 + s) * NANOS + fine).otherwise(bad("time").cast("long"))

    if to == ty.DATE:
        return date(c)
    if to == ty.LOCALTIME:
        return assembled(to, None, clock(c))
    dated = to in (ty.LOCALDATETIME, ty.DATETIME)
    timed = F.instr(c, "T") > 0
    day = date(F.substring_index(c, "T", 1)) if dated else None
    tail = F.when(timed, F.substring(c, F.instr(c, "T") + 1, F.length(c))).otherwise(F.lit("00")) if dated else c
    if to == ty.LOCALDATETIME:
        return assembled(to, day, clock(tail))
    body, offset, zone = (F.regexp_extract(tail, ZONE_FORM.pattern, i) for i in (1, 2, 3))
    return assembled(to, day, clock(body), offset_column(F.nullif(offset, F.lit(""))), F.nullif(zone, F.lit("")))


def built_column(to: ty.T, fields: dict[str, tuple[Column, ty.T]]) -> Column:
    """A value from columns of its fields; date, time and datetime fields select from other values. Null where a field is."""
    known = {"date", "time", "datetime", "timezone", "year", "month", "day", "week", "dayOfWeek", "quarter", "dayOfQuarter", "ordinalDay", *SECOND_PARTS}
    if unknown := set(fields) - known:
        raise semantic(f"unknown field {min(unknown)!r}")
    own: dict[str, Column] = {k: c for k, (c, _) in fields.items() if k not in ("date", "time", "datetime")}
    zone = own.pop("timezone", None)
    offset = None
    for name in ("date", "time", "datetime"):
        if name in fields:
            day, nanos, at_offset, _ = parts_columns(*fields[name])
            if name != "time" and day is not None:
                own.setdefault("date", day)
            if name != "date":
                own.setdefault("time", nanos)
                offset = at_offset if zone is None and to == ty.TIME else None
    day = date_columns(own) if to in (ty.DATE, ty.LOCALDATETIME, ty.DATETIME) else None
    value = assembled(to, day, nanos_columns(own) if to != ty.DATE else F.lit(0), offset, zone)
    given = F.lit(True)
    for c, _ in fields.values():
        given = given & c.isNotNull()
    return F.when(given, value)


def epoch_column(seconds: Column, nanos: Column) -> Column:
    """Date-times in UTC from seconds since 1970 and nanoseconds."""
    whole = seconds + F.floor(nanos / NANOS)
    day = F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(whole / DAY).cast("int"))
    return F.when(seconds.isNotNull() & nanos.isNotNull(), assembled(ty.DATETIME, day, F.pmod(whole, F.lit(DAY)) * NANOS + F.pmod(nanos, F.lit(NANOS))))


def duration_column(fields: dict[str, Column]) -> Column:
    """A duration from columns of whole or decimal numbers of units: fractions of a unit go on to the next smaller one. Null where a field is."""
    exact = lambda c: c.cast("string").cast("decimal(30,9)")
    months, days, seconds, nanos = (F.lit(0).cast("decimal(30,9)") for _ in range(4))
    for unit, c in fields.items():
        if unit not in UNITS:
            raise failed(f"unknown duration field {unit!r}")
        m, d, n = UNITS[unit]
        months, days = months + exact(c) * m, days + exact(c) * d
        seconds, nanos = (seconds + exact(c) * (n // NANOS), nanos) if n >= NANOS else (seconds, nanos + exact(c) * n)
    long = lambda c: c.cast("long")  # noqa: E731  towards zero
    rest = lambda c: (c - long(c)).cast("decimal(20,9)")
    extra = rest(months) * MONTH_SECONDS
    days = days.cast("decimal(30,9)") + long(extra / DAY)
    seconds = seconds.cast("decimal(30,9)") + (extra - long(extra / DAY) * DAY) + rest(days) * DAY
    fine = long(rest(seconds) * NANOS) + long(nanos)
    made = F.struct(long(months).alias("months"), long(days).alias("days"), (long(seconds) + F.floor(fine / NANOS)).cast("long").alias("seconds"), F.pmod(fine, F.lit(NANOS)).cast("long").alias("nanos"))
    given = F.lit(True)
    for c in fields.values():
        given = given & c.isNotNull()
    return F.when(given, made)


def duration_text_column(c: Column) -> Column:
    """Durations of texts like P1Y2M10DT2H30M; another text is an error when it is read."""
    names = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")
    sign = F.when(F.startswith(c, F.lit("-")), -1).otherwise(1)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, DURATION_FORM.pattern, i), F.lit("")).cast("decimal(28,9)"), F.lit(0).cast("decimal(28,9)")) * sign
    good = F.rlike(c, F.lit(DURATION_FORM.pattern)) & (F.length(c) > 2)
    return F.when(good, duration_column({n: part(i + 2) for i, n in enumerate(names)})).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a duration: "), c)))


def truncated(unit: str, c: Column, t: ty.T, to: ty.T, fields: dict[str, tuple[Column, ty.T]] | None = None) -> Column:
    """The start of the unit that a value lies in, as a value of the type, with fields set over it."""
    day, nanos, offset, zone = parts_columns(c, t)
    unit, fields = unit.lower(), dict(fields or {})
    if unit in CLOCK_UNITS:
        nanos = nanos - nanos % CLOCK_UNITS[unit]
    elif day is None:
        raise semantic(f"a time has no {unit}")
    else:
        nanos = F.lit(0).cast("long")
        if unit in YEARS:
            day = F.make_date(F.greatest(F.floor(F.year(day) / YEARS[unit]) * YEARS[unit], F.lit(1)).cast("int"), F.lit(1), F.lit(1))
        elif unit == "weekyear":
            day = date_columns({"year": F.extract(F.lit("YEAROFWEEK"), day), "week": F.lit(1)})
        elif unit in ("year", "quarter", "month", "week"):
            day = F.trunc(day, unit)
        else:
            raise semantic(f"unknown unit {unit!r}")
    if day is None and to not in (ty.LOCALTIME, ty.TIME):
        raise semantic(f"a {to} needs a date")
    sub = {k: fields.pop(k)[0].cast("long") for k in ("millisecond", "microsecond", "nanosecond") if k in fields}
    own = {"time": nanos} | ({"date": day} if day is not None else {}) | {k: x for k, (x, _) in fields.items() if k != "timezone"}
    day = date_columns(own) if to in (ty.DATE, ty.LOCALDATETIME, ty.DATETIME) else None
    nanos = nanos_columns(own) + sum((x * {"millisecond": 1_000_000, "microsecond": 1000, "nanosecond": 1}[k] for k, x in sub.items()), F.lit(0).cast("long"))
    if "timezone" in fields:
        offset, zone = None, fields["timezone"][0]
    elif zone is not None:  # a named zone may be ahead by another offset at the start of the unit
        offset = F.when(zone.isNull(), offset)
    return F.when(c.isNotNull(), assembled(to, day, nanos, offset, zone))


def between(kind: str, a: Column, ta: ty.T, b: Column, tb: ty.T) -> Column:
    """Duration from a to b: whole calendar months and days and the rest, or all in one unit."""
    zero = F.lit(0).cast("long")
    if {ta, tb} & {ty.LOCALTIME, ty.TIME}:  # times alone count
        (_, na, oa, _), (_, nb, ob, _) = parts_columns(a, ta), parts_columns(b, tb)
        apart = nb - na - ((ob - oa) * NANOS if oa is not None and ob is not None else zero)
        some = kind in ("inSeconds", "between")
        made = F.struct(zero.alias("months"), zero.alias("days"), (F.floor(apart / NANOS) if some else zero).cast("long").alias("seconds"), (F.pmod(apart, F.lit(NANOS)) if some else zero).cast("long").alias("nanos"))
        return F.when(a.isNotNull() & b.isNotNull(), made)
    x, y = ((c["ts"] if t == ty.DATETIME else c).cast("timestamp_ntz") for c, t in ((a, ta), (b, tb)))
    if ta == tb == ty.DATETIME:  # both at an offset: as in UTC
        x, y = (F.timestamp_add("SECOND", -c["offset"].cast("int"), z) for c, z in ((a, x), (b, y)))
    micros = F.timestamp_diff("MICROSECOND", x, y)
    seconds, nanos = F.floor(micros / 1_000_000).cast("long"), F.pmod(micros, F.lit(1_000_000)) * 1000
    if kind == "inSeconds":
        parts = (zero, zero, seconds, nanos)
    elif kind == "inDays":
        parts = (zero, F.timestamp_diff("DAY", x, y), zero, zero)
    else:
        # calendar months, the day held to a shorter month's last, less one where that goes beyond the end
        apart = ((F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)).cast("int")
        there = F.timestamp_add("MONTH", apart, x)
        months = F.when((y >= x) & (there > y), apart - 1).when((y < x) & (there < y), apart + 1).otherwise(apart)
        if kind == "inMonths":
            parts = (months, zero, zero, zero)
        else:
            moved = F.timestamp_add("MONTH", months.cast("int"), x)
            days = F.timestamp_diff("DAY", moved, y)
            rest = F.timestamp_diff("MICROSECOND", F.timestamp_add("DAY", days.cast("int"), moved), y)
            parts = (months, days, F.floor(rest / 1_000_000).cast("long"), F.pmod(rest, F.lit(1_000_000)) * 1000)
    made = F.struct(*[p.cast("long").alias(n) for p, n in zip(parts, ("months", "days", "seconds", "nanos"), strict=True)])
    return F.when(a.isNotNull() & b.isNotNull(), made)
