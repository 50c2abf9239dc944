"""Feeds, calendars, sitemaps and cards as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.functions import dates
from noticeworks.functions.text import fold_octets, ics_escape, xml_escape


def feed_items(df: DataFrame, order: list[Column], limit: int = 100) -> DataFrame:
    """RSS items of the first ``limit`` rows: ``title``, ``guid`` and ``published`` in; the index spreads dates by minutes."""
    top = df.orderBy(*order).limit(limit)
    i = F.row_number().over(W.orderBy(*order)) - 1  # over at most ``limit`` rows
    return lines(top.withColumn("i", i)).orderBy("i")


def lines(top: DataFrame) -> DataFrame:
    """RSS items of rows ``title, guid, published`` with their index ``i``, which spreads the dates by minutes."""
    at = F.date_format(F.to_timestamp("published") + F.make_dt_interval(mins=F.least("i", F.lit(59))), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    line = F.concat(F.lit("<item><title>"), xml_escape(F.col("title")), F.lit("</title><guid>"), xml_escape(F.col("guid")), F.lit("</guid><pubDate>"), at, F.lit("</pubDate></item>"))
    return top.withColumn("line", line)


def feed(items: DataFrame, title: str) -> DataFrame:
    """One RSS document of feed items."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "\n")
    head = f"<?xml version='1.0' encoding='utf-8'?>\n<rss version='2.0'><channel><title>{title}</title>\n"
    return items.agg(F.concat(F.lit(head), body, F.lit("\n</channel></rss>\n")).alias("document"))


def events(df: DataFrame) -> DataFrame:
    """VEVENT blocks of rows ``uid, date, time, summary, description, location``: an hour long, alarms a week and a day ahead, lines folded."""
    start = dates.instant(F.col("date"), F.col("time"))

    def alarm(before: str) -> list[Column]:
        return [F.lit("BEGIN:VALARM"), F.lit("ACTION:DISPLAY"), F.lit(f"TRIGGER:-P{before}"), F.concat(F.lit("DESCRIPTION:"), ics_escape(F.col("summary"))), F.lit("END:VALARM")]

    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("uid")), F.concat(F.lit("DTSTAMP:"), dates.stamp(start)), F.concat(F.lit("DTSTART:"), dates.stamp(start)), F.concat(F.lit("DTEND:"), dates.stamp(start + F.expr("interval 1 hour"))),
        F.concat(F.lit("SUMMARY:"), ics_escape(F.col("summary"))), F.concat(F.lit("DESCRIPTION:"), ics_escape(F.col("description"))), F.concat(F.lit("LOCATION:"), ics_escape(F.col("location"))), *alarm("7D"), *alarm("1D"), F.lit("END:VEVENT"),
    ]
    block = F.concat_ws("\r\n", *map(fold_octets, lines))  # null lines are left out
    return df.withColumn("block", block)


#: Events of one calendar document; a file is one row, so it can't grow without end.
MOST_EVENTS = 10_000


def calendar(df: DataFrame, name: str, order: str = "uid") -> DataFrame:
    """One iCalendar document of the first event blocks, MOST_EVENTS at most."""
    df = df.orderBy(order).limit(MOST_EVENTS)
    head = "\r\n".join(["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//noticeworks//EN", f"X-WR-CALNAME:{name}"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "block"))), lambda r: r["block"]), "\r\n")
    return df.agg(F.concat(F.lit(head + "\r\n"), body, F.lit("\r\nEND:VCALENDAR\r\n")).alias("document"))


def event_blocks(document: Column) -> Column:
    return F.regexp_extract_all(document, F.lit(r"(?s)(BEGIN:VEVENT.*?END:VEVENT)"), 1)


def sitemap(df: DataFrame, base: str, built: str) -> DataFrame:
    """Addresses of rows ``kind, key, lastmod``; what has no date of its own takes the build's."""
    return df.select(F.concat(F.lit(base + "/"), "kind", F.lit("/"), "key").alias("loc"), "kind", F.coalesce("lastmod", F.lit(built)).alias("lastmod"))


def json_ld(df: DataFrame, **fields: Column) -> DataFrame:
    """A JSON-LD text a row; null fields are left out."""
    return df.withColumn("json_ld", F.replace(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))), F.lit("<"), F.lit("\\u003c")))


def card_key(*printed: Column) -> Column:
    """The cache key of a share card: a digest of what is printed on it."""
    return F.substring(F.sha2(F.to_json(F.struct(*printed)), 256), 1, 24)
