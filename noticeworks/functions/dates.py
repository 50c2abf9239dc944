"""Dates: parsing, bounds, weeks, urgency, instants. "Today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Sarajevo"


def parse_date(c: Column) -> Column:
    """``d.M.yyyy`` with or without a last dot, or an ISO prefix; days that no calendar has are null."""
    t = F.trim(c)
    local = F.regexp_extract(t, r"^(\d\d?)[.] ?(\d\d?)[.] ?(\d{4})[.]?\z", 0)
    parts = [F.regexp_extract(t, r"^(\d\d?)[.] ?(\d\d?)[.] ?(\d{4})[.]?\z", k) for k in (3, 2, 1)]
    iso = F.regexp_extract(t, r"^(\d{4}(?:-\d\d){2})", 1)
    text = F.when(local != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))).when(iso != "", iso)
    return F.try_to_date(text, "yyyy-MM-dd")


def plausible(date: Column, published: Column) -> Column:
    """A sale date at most 400 days before its publication and 1,095 behind; any, without a publication."""
    return F.when(published.isNull() | F.datediff(date, published).between(-400, 1095), date)


def sale_date_in(text: Column, as_of: Column) -> Column:
    """The first date in a text from ``as_of`` on, else its latest."""
    found = F.array_sort(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(r"(\d\d?[.] ?\d\d?[.] ?\d{4})"), 1), parse_date)))
    return F.coalesce(F.get(F.filter(found, lambda d: d >= as_of), 0), F.try_element_at(found, F.lit(-1)))


def monday(date: Column) -> Column:
    return F.trunc(date, "week")


def week_label(monday_: Column) -> Column:
    """``dd.MM – dd.MM.`` of a week from its Monday."""
    return F.concat(F.date_format(monday_, "dd.MM."), F.lit(" – "), F.date_format(F.date_add(monday_, 6), "dd.MM."))


def urgency(days: Column) -> Column:
    return F.when(days < 0, "past").when(days <= 3, "due").when(days <= 7, "soon").otherwise("later")


def days_label(days: Column) -> Column:
    tens, ones = days % 100, days % 10
    noun = F.when((ones == 1) & (tens != 11), "dan").otherwise("dana")
    return F.when(days < 0, "prošlo").when(days == 0, "danas").when(days == 1, "sutra").otherwise(F.concat(F.lit("za "), days.cast("string"), F.lit(" "), noun))


def instant(date: Column, time: Column) -> Column:
    """Local wall time as UTC; nine in the morning without a time."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(date.cast("string"), F.lit(" "), F.coalesce(time, F.lit("09:00")), F.lit(":00"))), ZONE)


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
