"""Institutions and articles as landed dimensions: lookups that miss give null, counts come from the feeds."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.functions.text import fold
from noticeworks.sources.landing import entity_of


def env(name: str, fallback: str) -> str:
    """A setting of the environment; a blank one counts as unset."""
    return os.environ.get(name, "").strip() or fallback


def is_court(name: Column) -> Column:
    """Whether an institution's name says it is a court; others are told apart, not dropped."""
    return fold(name).rlike(r"(?<![a-z0-9])sud[au]?(?![a-z0-9])")


def with_article(df: DataFrame, articles: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows with their landed article as a struct ``article``; null where none has landed."""
    rest = [c for c in articles.columns if c != key]
    one = articles.groupBy(key).agg(F.min(F.struct(*rest)).alias("article"))
    return df.join(one, key, "left")


def needs_article(documents: Column, inline: Column) -> Column:
    """Whether a row has neither attachments nor a body of its own, so that its article must be fetched."""
    return (F.coalesce(F.size(documents), F.lit(0)) == 0) & (F.coalesce(F.trim(inline), F.lit("")) == "")


def with_institution(df: DataFrame, institutions: DataFrame, key: str = "court_id") -> DataFrame:
    """Rows with the name of their institution; null where the lookup has none."""
    names = institutions.groupBy(F.col("id").alias(key)).agg(F.min("name").alias("institution"))
    return df.join(names, key, "left")


def route_counts(central: DataFrame, articles: DataFrame, institution: str = "court_id") -> DataFrame:
    """``(id, central, category)``: rows of each institution by route."""
    a = central.groupBy(F.col(institution).alias("id")).agg(F.count("*").alias("central"))
    b = articles.groupBy(F.col(institution).alias("id")).agg(F.count("*").alias("category"))
    return a.join(b, "id", "full").select("id", F.coalesce("central", F.lit(0)).alias("central"), F.coalesce("category", F.lit(0)).alias("category"))


def enumerate_institutions(spark: SparkSession, institutions: DataFrame, counts: DataFrame, most: int = 200) -> DataFrame:
    """Institutions 1 to ``most`` that have a name and publish by either route, by id; with entity and whether each is a court."""
    ids = spark.range(1, most + 1)
    named = ids.join(institutions.select("id", F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name")).where("name <> ''"), "id")
    rows = named.join(counts, "id").where((F.col("central") > 0) | (F.col("category") > 0))
    return rows.select("id", "name", entity_of(F.col("name")).alias("entity"), "central", "category", is_court(F.col("name")).alias("court")).orderBy("id")


def download_url(base: str, document: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/"), document.cast("string"))


def to_download(documents: DataFrame, cached: DataFrame, key: str = "document_id") -> DataFrame:
    """Attachments that no cache folder holds yet, each once."""
    return documents.select(key).where(F.col(key).isNotNull()).distinct().join(cached.select(key), key, "left_anti")


def name_variants(name: Column) -> Column:
    """Spellings to ask a gazetteer for, the most faithful first: whole, without a bracket, without what follows a dash, the first word."""
    bare = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    return F.array_distinct(F.filter(F.array(F.trim(name), bare, F.trim(F.regexp_replace(bare, r"\s+[-–—]\s+.*\z", "")), F.regexp_extract(bare, r"^(\S+)", 1)), lambda v: v != ""))


def geocoded(names: DataFrame, gazetteer: DataFrame, name: str = "name", bounds: tuple[float, float, float, float] = (42.5, 45.4, 15.7, 19.7)) -> DataFrame:
    """``(name, place, lat, lon)``: the first variant that the gazetteer knows within the country's bounds; null without one."""
    inside = gazetteer.where(F.col("lat").between(*bounds[:2]) & F.col("lon").between(*bounds[2:]))
    known = inside.groupBy(fold(F.col("place")).alias("_key")).agg(F.min(F.struct("place", "lat", "lon")).alias("at"))
    asked = names.select(name).distinct().select(name, F.posexplode(name_variants(F.col(name))).alias("rank", "variant"))
    hit = asked.join(known, fold(F.col("variant")) == F.col("_key")).groupBy(name).agg(F.min_by("at", "rank").alias("at"))
    return names.select(name).distinct().join(hit, name, "left").select(name, "at.place", "at.lat", "at.lon")


def usable_languages(wanted: Column, installed: Column) -> Column:
    """Wanted languages that are installed, in the order wanted."""
    return F.array_intersect(wanted, installed)
