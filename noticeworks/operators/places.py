"""Rows put on a map: names looked up in a gazetteer, rollups by place, nearest sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.geo import distance_km
from noticeworks.functions.text import fold_place
from noticeworks.operators.analytics import top_per_group

#: Rows of a gazetteer or of sites that may be broadcast.
BROADCAST_ROWS = 100_000


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def locate(df: DataFrame, gazetteer: DataFrame, names: list[tuple[str, Column]], exact: tuple[str, ...] = ("municipality", "settlement")) -> DataFrame:
    """The first of several names that a gazetteer ``(place, lat, lon)`` knows, in the order given.

    Adds ``place, lat, lon, found_by`` and ``exact``, whether a name of the notice itself was found and not only its court's seat.
    """
    g = _sized(gazetteer.select(fold_place(F.col("place")).alias("_key"), F.struct("place", "lat", "lon").alias("_hit")).groupBy("_key").agg(F.min("_hit").alias("_hit")))
    hits = []
    for i, (label, name) in enumerate(names):
        df = df.withColumn("_key", fold_place(name)).join(g.withColumnRenamed("_hit", f"_hit{i}"), "_key", "left").drop("_key")
        hits.append(F.when(F.col(f"_hit{i}").isNotNull(), F.struct(F.col(f"_hit{i}.place").alias("place"), F.col(f"_hit{i}.lat").alias("lat"), F.col(f"_hit{i}.lon").alias("lon"), F.lit(label).alias("found_by"))))
    out = df.withColumn("_at", F.coalesce(*hits)).drop(*(f"_hit{i}" for i in range(len(names))))
    return out.withColumns({c: F.col(f"_at.{c}") for c in ("place", "lat", "lon", "found_by")} | {"exact": F.coalesce(F.col("_at.found_by").isin(*exact), F.lit(False))}).drop("_at")


def rollup(located: DataFrame, upcoming: Column) -> DataFrame:
    """Rows by place: all, upcoming, and whether any is placed exactly."""
    rows = located.where(F.col("place").isNotNull())
    return rows.groupBy("place").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.count("*").alias("total"), F.count_if(upcoming).alias("upcoming"), F.bool_or("exact").alias("exact")).orderBy(F.desc("total"), "place")


def counters(located: DataFrame) -> DataFrame:
    """How many rows are placed exactly, by their seat, or not at all."""
    placed = F.col("place").isNotNull()
    return located.agg(F.count_if(placed & F.col("exact")).alias("exact"), F.count_if(placed & ~F.col("exact")).alias("by_seat"), F.count_if(~placed).alias("unplaced"))


def nearest(points: DataFrame, sites: DataFrame, point: str, site: str, k: int = 5) -> DataFrame:
    """Of each point ``(id, lat, lon)`` the ``k`` nearest sites; sites are a counted dimension, refused beyond the bound."""
    if sites.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} sites; part them by region first")
    s = F.broadcast(sites.select(F.col(site).alias("site"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")))
    pairs = points.join(s, F.lit(True)).withColumn("km", distance_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    return top_per_group(pairs, point, [F.col("km"), F.col("site")], k).select(point, "site", "km", "rank")


def commonest_spelling(df: DataFrame, name: Column) -> DataFrame:
    """Of each folded name its most frequent spelling, ties in Bosnian order."""
    counts = df.select(name.alias("name")).where("name is not null").groupBy(fold_place(F.col("name")).alias("key"), "name").agg(F.count("*").alias("n"))
    return top_per_group(counts, "key", [F.desc("n"), F.collate("name", "bs"), F.col("name")], 1).select("key", "name", "n")


def commonest_within(df: DataFrame, name: Column, within: Column) -> DataFrame:
    """``(key, within, n)``: of each folded name the region it is most often said to lie in, ties in Bosnian order."""
    counts = df.select(fold_place(name).alias("key"), within.alias("within")).where("key <> '' and within is not null").groupBy("key", "within").agg(F.count("*").alias("n"))
    return top_per_group(counts, "key", [F.desc("n"), F.collate("within", "bs"), F.col("within")], 1).select("key", "within", "n")


def seats_placed(seats: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(court_id, place)`` of courts whose seat the gazetteer knows; others are left out."""
    known = _sized(gazetteer.groupBy(fold_place(F.col("place")).alias("_key")).agg(F.min("place").alias("place")))
    return seats.withColumn("_key", fold_place(F.col("seat"))).join(known, "_key").select("court_id", "place").orderBy("court_id")
