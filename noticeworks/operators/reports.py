"""Reports and endpoints as rows: JSON documents, feeds and calendars by key, and whether a build is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.functions.text import clip, slug_of_title
from noticeworks.operators import sinks
from noticeworks.operators.analytics import top_per_group


def write_json(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON in one new version of a folder; null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def quality_report(found: DataFrame, listings: int, comparable: int, worst: int = 20) -> DataFrame:
    """``(field, n, rank, id, ratio)``: how often readings disagree by field, and the worst of each; heads carry the totals."""
    found = found.select("field", "id", "ratio", F.coalesce("ratio", F.lit(0.0)).alias("_r"), F.pmod(F.hash("id"), F.lit(256)).alias("_part"))
    part, whole, order = W.partitionBy("field", "_part"), W.partitionBy("field"), [F.desc("_r"), F.col("id")]
    # the first rows of a part of a field carry how many it has, so the readings are compared once
    first = found.select("*", F.row_number().over(part.orderBy(*order)).alias("_k"), F.count("*").over(part).alias("_n")).where(F.col("_k") <= worst)
    ranked = first.select("*", F.row_number().over(whole.orderBy(*order)).alias("rank"), F.sum(F.when(F.col("_k") == 1, F.col("_n"))).over(whole).alias("n"))
    rows = ranked.where(F.col("rank") <= worst).select("field", "n", "rank", "id", "ratio")
    return rows.withColumns({"listings": F.lit(listings), "comparable": F.lit(comparable)})


def run_report(df: DataFrame, as_of: Column) -> DataFrame:
    """``(what, value)``: the figures that a run ends with, its text sources among them."""
    one = df.agg(
        F.count("*").cast("double").alias("listings"), F.count_if(F.col("sale_date") >= as_of).cast("double").alias("upcoming"), F.count_if(F.col("origin") == "reused").cast("double").alias("reused"), F.count_if(F.col("origin") == "retained").cast("double").alias("retained"),
        F.count_distinct("court_id").cast("double").alias("courts"), F.count("case_number").cast("double").alias("with_case"), F.count(F.coalesce("appraised", "starting")).cast("double").alias("with_price"), F.round(F.avg("confidence"), 2).alias("confidence"),
    )
    figures = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in one.columns))).alias("r")).select("r.*")
    return figures.unionByName(df.groupBy(F.concat(F.lit("source "), "source").alias("what")).agg(F.count("*").cast("double").alias("value")))


def coverage_rows(counts: DataFrame) -> DataFrame:
    """The registry of institutions ``(id, name, central, category)`` that publish by either route, with the route."""
    rows = counts.where((F.col("central") > 0) | (F.col("category") > 0))
    return rows.withColumn("route", F.when(F.col("central") > 0, "central-feed").otherwise("news-category")).orderBy("id")


def envelope(df: DataFrame, generated_at: str, source: str) -> DataFrame:
    """One row that says what a full dump holds; its rows stay a table beside it."""
    return df.agg(F.count("*").alias("count")).select(F.lit(generated_at).alias("generatedAt"), "count", F.lit(source).alias("source"))


def href(df_id: Column, title: Column) -> Column:
    """Where a row's page is: its slug with its id behind it, the bare id without a slug."""
    s = slug_of_title(title)
    return F.concat(F.lit("/oglas/"), F.when(F.coalesce(s, F.lit("")) == "", df_id).otherwise(F.concat(s, F.lit("-"), df_id)), F.lit("/"))


def ics_href(df_id: Column, title: Column) -> Column:
    return F.regexp_replace(href(df_id, title), r"/\z", ".ics")


def card(df: DataFrame) -> DataFrame:
    """``(id, card)``: the short JSON that a saved row is drawn from, one letter a key."""
    fields = {"h": "headline", "m": "meta", "c": "court", "e": "entity", "d": "day", "t": "sale_type", "p": "price", "o": "off"}
    return df.select("id", F.to_json(F.struct(*(F.col(c).alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"}).alias("card"))


def feeds_by_key(df: DataFrame, key: str, order: list[Column], limit: int = 100) -> DataFrame:
    """``(key, i, line)``: feed items of each key's first rows; every key's index starts at 0."""
    top = top_per_group(df, key, order, limit).withColumn("i", F.col("rank") - 1)
    return sinks.lines(top).select(key, "i", "line")


def documents_by_key(lines: DataFrame, key: str, title: Column) -> DataFrame:
    """One feed document for each key; a key has at most the feed's limit of lines."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "\n")
    return lines.groupBy(key).agg(body.alias("body")).select(key, F.concat(F.lit("<rss version='2.0'><channel><title>"), title, F.lit("</title>\n"), F.col("body"), F.lit("\n</channel></rss>\n")).alias("document"))


def event_of(df: DataFrame, base: str) -> DataFrame:
    """Rows as calendar events ``(uid, date, time, summary, description, location)``; texts clipped, what is missing left out or said."""
    price = lambda label, c: F.concat(F.lit(f"{label}: "), F.format_number(c, 2), F.lit(" KM"))
    parts = [
        clip(F.col("item_description"), 600), price("Početna cijena", F.col("starting")), price("Procijenjena vrijednost", F.col("appraised")), F.coalesce(price("Kapara", F.col("deposit")), F.lit("Kapara: nije navedena")), F.concat(F.lit("Predmet: "), "case_number"),
        F.concat(F.lit("Sud: "), "court", F.lit(" ("), "entity", F.lit(")")), F.when(F.col("sale_time").isNull(), F.lit("Vrijeme nije navedeno; upisano je 09:00.")), F.concat(F.lit(base), href(F.col("id"), F.col("headline"))),
    ]
    return df.select(
        F.concat(F.lit("oglas-"), "id").alias("uid"), F.col("sale_date").alias("date"), F.col("sale_time").alias("time"), F.concat("headline", F.lit(" - "), "court").alias("summary"), F.array_join(F.array_compact(F.array(*parts)), "\n").alias("description"),
        F.coalesce("auction_location", "court").alias("location"), *(c for c in ("court_id", "item_tags", "id") if c in df.columns),
    )


def calendars(events: DataFrame, tags: str = "item_tags", limit: int = 500) -> DataFrame:
    """``(calendar, i, block)``: each event in the calendar of all, of its court and of each tag, and alone; the soonest ``limit`` of each."""
    keys = F.concat(F.array(F.lit("kalendar"), F.concat(F.lit("sudovi/"), F.col("court_id").cast("string")), F.concat(F.lit("oglas/"), "id")), F.transform(F.array_distinct(tags), lambda t: F.concat(F.lit("predmeti/"), t)))
    rows = events.select("*", F.explode(keys).alias("calendar"))
    return top_per_group(rows, "calendar", [F.col("date"), F.col("uid")], limit).select("calendar", (F.col("rank") - 1).alias("i"), "block")


def robots(base: str) -> str:
    return f"User-agent: *\nAllow: /\n\nDisallow: /pagefind/\n\nSitemap: {base}/sitemap.xml\n"


def about(df: DataFrame, as_of: Column, day: str) -> DataFrame:
    """One line that tells a reader what the table holds: rows, courts, years, rows to come."""
    one = df.agg(F.count("*").alias("n"), F.count_distinct("court_id").alias("c"), F.min(F.year("sale_date")).alias("a"), F.max(F.year("sale_date")).alias("b"), F.count_if(F.col("sale_date") >= as_of).alias("u"))
    text = F.format_string(f"Dataset as of {day}: %d notices from %d courts, sale dates %d–%d, %d still upcoming.", "n", "c", "a", "b", "u")
    return one.select(text.alias("line"))


def listing_json_ld(df: DataFrame, base: str, start: Column) -> DataFrame:
    """``(id, json_ld)``: the hearing as an event; an offer only where a price is known."""
    url = F.concat(F.lit(base), href(F.col("id"), F.col("headline")))
    stamp = F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    offer = F.when(F.col("starting").isNotNull(), F.struct(F.lit("Offer").alias("@type"), F.col("starting").cast("long").alias("price"), F.lit("BAM").alias("priceCurrency"), stamp.alias("validThrough")))
    place = F.struct(F.lit("Place").alias("@type"), F.coalesce("auction_location", "court").alias("name"))
    node = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("SaleEvent").alias("@type"), F.concat("headline", F.lit(" - "), "court").alias("name"), F.col("item_description").alias("description"), url.alias("url"), stamp.alias("startDate"), place.alias("location"),
        F.array_join("item_tags", ", ").alias("keywords"), offer.alias("offers"),
    )
    return df.select("id", F.replace(F.to_json(node), F.lit("<"), F.lit("\\u003c")).alias("json_ld"))


def site_json_ld(df: DataFrame, base: str, day: str) -> DataFrame:
    """The data set as one JSON-LD row: its size and the years it covers."""
    one = df.agg(F.count("*").alias("n"), F.count_distinct("court_id").alias("c"), F.min(F.year("sale_date")).alias("a"), F.max(F.year("sale_date")).alias("b"))
    node = F.struct(F.lit("Dataset").alias("@type"), F.lit(f"{base}/#dataset").alias("@id"), F.format_string("%d notices from %d courts", "n", "c").alias("description"), F.format_string("%d/%d", "a", "b").alias("temporalCoverage"), F.lit(day).alias("dateModified"))
    return one.select(F.to_json(node).alias("json_ld"))


def search_rows(df: DataFrame, as_of: Column) -> DataFrame:
    """The search index of published rows: its text, five filters, two sorts and six fields to show."""
    held = F.col("sale_date") < as_of
    status, day = F.when(held, "Arhiva").otherwise("Otvoreno"), F.date_format("sale_date", "dd.MM.yyyy.")
    price = F.coalesce("starting", "appraised")
    return df.select(
        "id", F.concat_ws("\n", "headline", "title", "item_description").alias("body"), F.col("court").alias("filter_sud"), F.col("sale_type").alias("filter_vrsta"), F.col("entity").alias("filter_entitet"), F.year("sale_date").cast("string").alias("filter_godina"), status.alias("filter_status"),
        F.col("sale_date").cast("string").alias("sort_datum"), F.lpad(F.coalesce(F.floor(price + 0.5), F.lit(0)).cast("string"), 12, "0").alias("sort_cijena"), status.alias("meta_status"), day.alias("meta_datum"), F.col("court").alias("meta_sud"),
        F.coalesce("auction_round", F.lit("-")).alias("meta_rociste"), F.coalesce(F.floor(price + 0.5).cast("string"), F.lit("-")).alias("meta_cijena"), F.col("sale_type").alias("meta_vrsta"),
    )


#: Rules that every published row keeps, by name.
SCHEMA_RULES: dict[str, str] = {
    "id": "id rlike '^[0-9]+-[0-9]+$'", "court": "court is not null and court <> '' and court_id is not null", "entity": "entity in ('FBiH', 'RS', 'BD')", "sale_type": "sale_type in ('nekretnine', 'vozila', 'tehnika', 'namjestaj', 'ostalo')", "title": "title is not null",
    "sale_date": "sale_date is not null", "published_date": "published_date is not null", "sale_time": "sale_time is null or sale_time rlike '^[0-2][0-9]:[0-5][0-9]$'", "auction_round": "auction_round in ('prvo', 'drugo', 'trece', 'nepoznato')",
    "sale_method": "sale_method in ('usmeno-javno-nadmetanje', 'prikupljanje-ponuda', 'neposredna-pogodba', 'nepoznato')", "money": "coalesce(starting, 1) > 0 and coalesce(appraised, 1) > 0 and coalesce(deposit, 1) > 0", "confidence": "confidence between 0 and 1",
}


def schema_breaches(df: DataFrame) -> DataFrame:
    """``(id, broken)``: rows that break a rule of the published table's schema, with the rules' names."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in SCHEMA_RULES.items())))
    return df.select("id", broken.alias("broken")).where(F.size("broken") > 0)


def completeness(listings: DataFrame, pages: DataFrame, events: DataFrame, urls: DataFrame, feeds: DataFrame) -> DataFrame:
    """``(check, missing)``: what a build lacks, each a count of rows without their counterpart.

    ``pages (id)`` are the pages built, ``events (id, block)`` calendars, ``urls (id)`` the sitemap's, ``feeds (key)`` the feeds by court and tag.
    """
    gone = lambda made, name: listings.select("id").join(made.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("missing")).select(F.lit(name).alias("check"), "missing")
    wanted = listings.select(F.concat(F.lit("sudovi/"), F.col("court_id").cast("string")).alias("key")).unionByName(listings.select(F.explode(F.transform("item_tags", lambda t: F.concat(F.lit("predmeti/"), t))).alias("key"))).distinct()
    feed = wanted.join(feeds.select("key").distinct(), "key", "left_anti").agg(F.count("*").alias("missing")).select(F.lit("feeds").alias("check"), "missing")
    opened, closed = (F.size(F.split("block", f"{w}:VEVENT")) - 1 for w in ("BEGIN", "END"))
    long = F.exists(F.split("block", "\r\n"), lambda x: F.octet_length(x) > 75)
    shape = events.agg(F.count_if(opened != closed).alias("unbalanced"), F.count_if(long).alias("long")).select(F.explode(F.array(F.struct(F.lit("balanced events").alias("check"), F.col("unbalanced").alias("missing")), F.struct(F.lit("lines of 75 octets").alias("check"), F.col("long").alias("missing")))).alias("r")).select("r.*")
    return gone(pages, "pages").unionByName(gone(events, "calendars")).unionByName(gone(urls, "sitemap")).unionByName(feed).unionByName(shape)
