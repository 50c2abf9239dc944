"""Term search with facets over folded tokens."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.text import fold


def tokens(c: Column) -> Column:
    return F.split(fold(c), r"[^a-z0-9]+")


def matching(df: DataFrame, text: Column, term: str, chosen: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows that hold every word of a term (an empty one: all); values of a facet are alternatives, facets go together."""
    words = df.sparkSession.range(1).select(F.array_remove(F.array_distinct(tokens(F.lit(term))), "").alias("w")).first().w
    if words:
        folded = fold(text)
        df = df.where(reduce(and_, (folded.rlike(rf"(?<![a-z0-9]){w}(?![a-z0-9])") for w in words)))
    for facet, values in (chosen or {}).items():
        df = df.where(F.col(facet).isin(values))
    return df


def facets(df: DataFrame, names: list[str]) -> DataFrame:
    """Counts of each facet's values, from one pass; the most frequent first."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names))).alias("r")).select("r.*")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n")).orderBy("facet", F.desc("n"), "value")


def page(df: DataFrame, order: list[Column], number: int, size: int = 12) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def index(df: DataFrame, key: str, text: Column) -> DataFrame:
    """An inverted index: token, row and how often."""
    return df.select(key, F.explode(tokens(text)).alias("token")).where("token <> ''").groupBy("token", key).agg(F.count("*").alias("n"))


def matching_index(index_: DataFrame, key: str, term: str) -> DataFrame:
    """``(key, score)`` of the rows of an inverted index that hold every word of a term: a join by token, the score the words' count."""
    words = index_.sparkSession.range(1).select(F.array_remove(F.array_distinct(tokens(F.lit(term))), "").alias("w")).first().w
    hits = index_.where(F.col("token").isin(words)).groupBy(key).agg(F.count("*").alias("k"), F.sum("n").alias("score"))
    return hits.where(F.col("k") == len(words)).select(key, "score")
