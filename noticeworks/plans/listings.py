"""From candidates to the published table: read, merge, redact, check, and carry the archive on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import dates, extract, merge, numbers, redact
from noticeworks.functions.describe import item_description
from noticeworks.operators.analytics import confidence
from noticeworks.sources.landing import entity_of

VERSION = "1.0.0"


def _money(c: Column) -> Column:
    return F.when((c > 0) & (c <= numbers.MOST_PLAUSIBLE), F.struct(numbers.js_round(c).alias("amount"), F.lit("BAM").alias("currency")))


def build(candidates: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """``(listings, rejected)`` of candidates with ``text``, ``source``, ``documents`` and an ``llm`` reading (null without one).

    A row without any plausible date, court or title is rejected, not lost.
    """
    c, rules = extract.with_reading(candidates, F.col("text"), F.col("title"))
    c = c.withColumn("described", item_description(F.col("text"), F.col("title")))
    c = c.withColumn("tags", extract.item_tags(F.col("title"), F.col("described"), F.substring("text", 1, 8000)))
    c = c.withColumn("m", merge.merged(F.col("llm"), rules, F.col("described"), F.col("tags"), F.col("title"), F.col("text")))
    in_text = dates.plausible(dates.sale_date_in(F.col("text"), as_of), F.col("published_date"))
    sale = F.coalesce(dates.plausible(F.col("sale_date"), F.col("published_date")), in_text, F.col("published_date"))
    kind = F.when(F.col("type_code").isNotNull() | F.col("type_label").isNotNull(), extract.sale_type(F.col("type_code"), F.col("type_label"))).otherwise(
        F.coalesce(F.col("m.sale_type"), extract.infer_sale_type(F.concat_ws("\n", "title", F.substring("text", 1, 4000))))
    )
    score = confidence(
        F.col("m.case_number").isNotNull(), F.col("m.money.appraised").isNotNull(), F.coalesce("m.money.starting", "m.money.appraised").isNotNull(), F.col("m.money.deposit").isNotNull(), F.col("m.sale_time").isNotNull(),
        F.col("m.auction_round") != "nepoznato", F.col("m.sale_method") != "nepoznato", F.col("m.item_description").isNotNull(),
    )
    rows = c.select(
        F.concat_ws("-", F.col("court_id").cast("string"), F.col("article_id").cast("string")).alias("id"), "article_id", "court", "court_id", entity_of(F.col("court")).alias("entity"), F.col("m.case_number").alias("case_number"), kind.alias("sale_type"),
        redact.redact_title(F.col("title")).alias("title"), redact.redact_text(F.col("m.headline")).alias("headline"), redact.redact_text(F.col("m.item_description")).alias("item_description"), F.col("m.item_tags").alias("item_tags"),
        F.col("m.cadastral").alias("cadastral"), F.struct(F.col("m.municipality").alias("municipality"), extract.settlement(F.coalesce(F.col("m.cadastral.ko"), F.array().cast("array<string>"))).alias("settlement")).alias("location"),
        _money(F.col("m.money.appraised")).alias("appraised_value"), _money(F.col("m.money.starting")).alias("starting_price"), _money(F.col("m.money.deposit")).alias("deposit"), F.col("m.auction_round").alias("auction_round"),
        F.col("m.sale_method").alias("sale_method"), sale.alias("sale_date"), F.col("m.sale_time").alias("sale_time"), redact.redact_venue(F.col("m.auction_location")).alias("auction_location"), redact.redact_text(rules["viewing_info"]).alias("viewing_info"),
        "published_date", F.struct(F.lit(VERSION).alias("pipeline_version"), F.col("source"), score.alias("confidence"), F.col("llm").isNotNull().alias("llm")).alias("extraction"),
    )
    sound = F.coalesce(F.col("sale_date").isNotNull() & F.col("court_id").isNotNull() & (F.col("title") != ""), F.lit(False))
    return rows.where(sound), rows.where(~sound)


def carried(prior: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of the archive that the run no longer saw, with today's rules for what stays visible; their version stays."""
    kept = prior.join(now, "id", "left_anti")
    return kept.withColumns({
        "title": redact.redact_title(F.col("title")), "item_description": redact.redact_text(F.col("item_description")), "headline": redact.redact_text(F.col("headline")), "auction_location": redact.redact_venue(F.col("auction_location")),
        "sale_date": F.coalesce(dates.plausible(F.col("sale_date"), F.col("published_date")), F.col("published_date")),
        "location": F.struct(F.col("location.municipality").alias("municipality"), F.coalesce(extract.settlement(F.coalesce(F.col("cadastral.ko"), F.array().cast("array<string>"))), F.col("location.settlement")).alias("settlement")),
    })


def archive(prior: DataFrame, now: DataFrame) -> DataFrame:
    """The new table: the run's rows and those carried on, latest hearing first."""
    return now.unionByName(carried(prior, now)).orderBy(F.desc("sale_date"), "id")
