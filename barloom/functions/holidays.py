"""US federal holidays, with observed days, as one expression over a date column."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# Fixed values: (month, day, first year) and (month, weekday Monday=0, which one, first year); -1 is the last one.
FIXED_DATES = [(1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)]
NTH_WEEKDAYS = [(1, 0, 3, 1986), (2, 0, 3, 0), (5, 0, -1, 0), (9, 0, 1, 0), (10, 0, 2, 0), (11, 3, 4, 0)]


def is_holiday(ts: str) -> Column:
    """True on a holiday, and on the weekday next to one that falls on a weekend."""
    day = F.to_date(ts)

    def on(d: Column, month: int, dom: int, since: int) -> Column:
        return (F.month(d) == month) & (F.dayofmonth(d) == dom) & (F.year(d) >= since)

    rules = []
    for month, dom, since in FIXED_DATES:
        rules.append(on(day, month, dom, since))
        rules.append((F.weekday(day) == 4) & on(F.date_add(day, 1), month, dom, since))
        rules.append((F.weekday(day) == 0) & on(F.date_sub(day, 1), month, dom, since))
    for month, weekday, nth, since in NTH_WEEKDAYS:
        which = F.ceil(F.dayofmonth(day) / 7) == nth if nth > 0 else F.month(F.date_add(day, 7)) != month
        rules.append((F.month(day) == month) & (F.weekday(day) == weekday) & which & (F.year(day) >= since))
    return reduce(or_, rules)
