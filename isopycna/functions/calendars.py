"""Days and dates in the calendars of model output, for single values and for columns alike.

Day 0 of a calendar is its 1 March of the year 0, so that leap days come last in a year.
``standard`` is Julian up to 4 October 1582 and Gregorian from the 15th; the days between
do not exist.  Functions take ints or columns; for columns, whatever does not exist is NULL, for
ints it raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calendars by their names, of which each has several.
NAMES = {
    "standard": "standard",
    "gregorian": "standard",
    "proleptic_gregorian": "proleptic_gregorian",
    "julian": "julian",
    "noleap": "noleap",
    "365_day": "noleap",
    "all_leap": "all_leap",
    "366_day": "all_leap",
    "360_day": "360_day",
}
#: Days from day 0 of the Julian calendar to that of the Gregorian.
GREGORIAN = 2
#: The first Gregorian day, counted from day 0 of the Gregorian calendar, and the dates around the gap, as numbers yyyymmdd.
FIRST_DAY, LAST_JULIAN, FIRST_GREGORIAN = 578041, 15821004, 15821015


def known(name: str) -> str:
    """The one name of a calendar; raises for others."""
    if name.strip().lower() not in NAMES:
        raise ValueError(f"unknown calendar: {name}")
    return NAMES[name.strip().lower()]


def _div(a, b: int):
    return F.floor(a / b) if isinstance(a, Column) else a // b


def _mod(a, b: int):
    return F.pmod(a, F.lit(b)) if isinstance(a, Column) else a % b


def _smaller(a, b):
    if isinstance(a, Column) or isinstance(b, Column):
        return F.least(*(x if isinstance(x, Column) else F.lit(x) for x in (a, b)))
    return min(a, b)


def _pick(condition, a, b):
    if isinstance(condition, Column):
        return F.when(condition, a).otherwise(b)
    return a if condition else b


def month_length(year, month, calendar: str):
    """Days of a month."""
    kind = known(calendar)
    if kind == "360_day":
        return month * 0 + 30
    usual = 30 + _mod(month + _div(month, 8), 2)
    if kind in ("noleap", "all_leap"):
        return _pick(month == 2, 28 if kind == "noleap" else 29, usual)
    julian, gregorian = _mod(year, 4) == 0, ((_mod(year, 4) == 0) & (_mod(year, 100) != 0)) | (_mod(year, 400) == 0)
    leap = julian if kind == "julian" else gregorian if kind == "proleptic_gregorian" else _pick(year > 1582, gregorian, julian)
    return _pick(month == 2, _pick(leap, 29, 28), usual)


def exists(year, month, day, calendar: str):
    """Whether there is such a day."""
    ok = (month >= 1) & (month <= 12) & (day >= 1) & (day <= month_length(year, month, calendar))
    if known(calendar) != "standard":
        return ok
    number = year * 10000 + month * 100 + day
    return ok & ((number <= LAST_JULIAN) | (number >= FIRST_GREGORIAN))


def _number(year, month, day, kind: str):
    if kind == "360_day":
        return year * 360 + (month - 1) * 30 + day - 61
    y, m = _pick(month <= 2, year - 1, year), _mod(month + 9, 12)
    before = _div(153 * m + 2, 5) + day - 1
    if kind in ("noleap", "all_leap"):
        return y * (365 if kind == "noleap" else 366) + before
    days = 365 * y + _div(y, 4) + before
    if kind == "julian":
        return days
    if kind == "proleptic_gregorian":
        return days - _div(y, 100) + _div(y, 400)
    late = year * 10000 + month * 100 + day >= FIRST_GREGORIAN
    return _pick(late, days - _div(y, 100) + _div(y, 400), days - GREGORIAN)


def day_number(year, month, day, calendar: str):
    """Days from day 0 of the calendar to a date."""
    there = exists(year, month, day, calendar)
    if isinstance(there, Column):
        return F.when(there, _number(year, month, day, known(calendar)))
    if not there:
        raise ValueError(f"no such day in {calendar}: {year}-{month}-{day}")
    return _number(year, month, day, known(calendar))


def _date(number, kind: str):
    if kind == "360_day":
        number = number + 60
        return _div(number, 360), _div(_mod(number, 360), 30) + 1, _mod(number, 30) + 1
    if kind in ("noleap", "all_leap"):
        length = 365 if kind == "noleap" else 366
        y, of_year = _div(number, length), _mod(number, length)
    elif kind == "julian":
        y = _div(number, 1461) * 4 + _smaller(_div(_mod(number, 1461), 365), 3)
        of_year = number - 365 * y - _div(y, 4)
    else:
        of_era = _mod(number, 146097)
        y = _div(of_era - _div(of_era, 1460) + _div(of_era, 36524) - _div(of_era, 146096), 365)
        of_year = of_era - (365 * y + _div(y, 4) - _div(y, 100))
        y = y + 400 * _div(number, 146097)
    m = _div(5 * of_year + 2, 153)
    day = of_year - _div(153 * m + 2, 5) + 1
    month = _pick(m < 10, m + 3, m - 9)
    return _pick(month <= 2, y + 1, y), month, day


def date(number, calendar: str):
    """(year, month, day) of so many days after day 0 of the calendar."""
    kind = known(calendar)
    if kind != "standard":
        return _date(number, kind)
    late, early = _date(number, "proleptic_gregorian"), _date(number + GREGORIAN, "julian")
    return tuple(_pick(number >= FIRST_DAY, a, b) for a, b in zip(late, early))


def month_index(number, calendar: str):
    """``ym`` of so many days after day 0 of the calendar."""
    year, month, _ = date(number, calendar)
    return year * 12 + month - 1


def years_before(year, month, day, years: int, calendar: str):
    """(year, month, day) so many years before; the last of the month where that day does not exist, and the first after a gap."""
    back = year - years
    day = _smaller(day, month_length(back, month, calendar))
    if known(calendar) == "standard":
        number = back * 10000 + month * 100 + day
        day = _pick((number > LAST_JULIAN) & (number < FIRST_GREGORIAN), FIRST_GREGORIAN % 100, day)
    return back, month, day
