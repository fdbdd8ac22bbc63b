"""Dates that words name, against an explicit day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def resolve_hint(text: Column, today: Column) -> Column:
    """tomorrow, today, in n days or weeks, next week or month, end of week or month, a weekday; else null."""
    low = F.lower(text)
    count = F.regexp_extract(low, "\\bin ([0-9]{1,3}) (day|week)", 1)
    n = F.when(count != "", count.try_cast("int") * F.when(low.rlike("\\bin [0-9]+ week"), 7).otherwise(1))
    out = (
        F.when(low.rlike("\\btomorrow\\b"), F.date_add(today, 1))
        .when(low.rlike("\\btoday\\b"), today)
        .when(n.isNotNull(), F.date_add(today, n))
        .when(low.rlike("\\bnext week\\b"), F.date_add(today, 7))
        .when(low.rlike("\\bnext month\\b"), F.add_months(today, 1))
        .when(low.rlike("\\bend of (the )?month\\b"), F.last_day(today))
        .when(low.rlike("\\bend of (the )?week\\b"), F.next_day(F.date_sub(today, 1), "Sunday"))
    )
    for day in WEEKDAYS:
        out = out.when(low.rlike(f"\\b{day}\\b"), F.next_day(today, day))
    return out
