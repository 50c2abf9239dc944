"""Lists and pages of published rows: orders, filters, lines of facts, and the figures that head a page.

Frames have the columns of a published table; "today" is always the parameter ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.functions import dates, numbers
from noticeworks.functions.text import fold
from noticeworks.operators.analytics import week_strip

ROUND_SHORT = {"prvo": "1. ročište", "drugo": "2. ročište", "trece": "3. ročište"}
#: Costs that no notice states, by the kinds of sale that carry them.
UNPRICED = {"iseljenje": ("nekretnine",), "racuni": ("nekretnine",), "legalizacija": ("nekretnine",), "stanje": ("nekretnine", "vozila", "tehnika", "namjestaj", "ostalo")}


def first(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their places ``pos``; only they are numbered, so no window holds the table."""
    return df.orderBy(*order).limit(limit).withColumn("pos", F.row_number().over(W.orderBy(*order)))


def upcoming(df: DataFrame, as_of: Column, date: str = "sale_date") -> DataFrame:
    return df.where(F.col(date) >= as_of)


def past(df: DataFrame, as_of: Column, date: str = "sale_date") -> DataFrame:
    return df.where(F.col(date) < as_of)


def soonest(key: str = "id", date: str = "sale_date") -> list[Column]:
    return [F.col(date).asc(), F.col(key)]


def latest(key: str = "id", date: str = "sale_date") -> list[Column]:
    return [F.col(date).desc(), F.col(key)]


def newest(key: str = "id") -> list[Column]:
    return latest(key, "published_date")


def home_order(by: str, key: str = "id") -> list[Column]:
    """Orders of the first page: by date, price (none counts 0) or discount (none counts -1)."""
    if by == "price":
        return [F.coalesce("starting", "appraised", F.lit(0.0)).desc(), F.col(key)]
    if by == "discount":
        return [F.coalesce(numbers.discount(F.col("starting"), F.col("appraised")), F.lit(-1.0)).desc(), F.col(key)]
    return soonest(key)


def saved_order(as_of: Column, key: str = "id") -> list[Column]:
    """Hearings to come first, the soonest ahead; then those held, the latest ahead."""
    held = F.col("sale_date") < as_of
    return [held.asc(), F.when(~held, F.col("sale_date")).asc(), F.col("sale_date").desc(), F.col(key)]


def archive_order(df: DataFrame, origin: str = "origin", key: str = "id") -> list[Column]:
    """Latest hearing first; of one day rows reused, then built, then retained, each in order of their ids."""
    rank = F.array_position(F.array(*map(F.lit, ("reused", "built", "retained"))), F.col(origin))
    return [F.col("sale_date").desc(), rank, F.col(key)]


def home_filter(df: DataFrame, texts: list[Column], needle: str = "", kind: str | None = None, week: tuple[str, str] | None = None) -> DataFrame:
    """Rows whose texts together hold a folded needle, of one kind, within one week; what isn't asked for filters nothing."""
    if needle.strip():
        wanted = fold(F.lit(needle.strip()))
        df = df.where(F.contains(fold(F.concat_ws(" ", *texts)), wanted))
    if kind:
        df = df.where(F.col("sale_type") == kind)
    if week:
        df = df.where(F.col("sale_date").between(F.lit(week[0]).cast("date"), F.lit(week[1]).cast("date")))
    return df


def court_list(df: DataFrame, as_of: Column, entity: str | None = None, active: bool = False) -> DataFrame:
    """Courts with what they have open and in all, the busiest first."""
    rows = df.groupBy("court_id").agg(F.max_by("court", "id").alias("court"), F.max_by("entity", "id").alias("entity"), F.count_if(F.col("sale_date") >= as_of).alias("open"), F.count("*").alias("total"))
    if entity:
        rows = rows.where(F.col("entity") == entity)
    if active:
        rows = rows.where("open > 0")
    return rows.orderBy(F.desc("open"), F.desc("total"), "court_id")


def firm(drops: DataFrame) -> DataFrame:
    """Falls against a hearing before, not against an appraisal."""
    return drops.where(F.col("from_previous").isNotNull())


def settlement_shown(settlement: Column, municipality: Column) -> Column:
    """A settlement, unless it is the municipality under another spelling."""
    return F.when(municipality.isNull() | (fold(settlement) != fold(municipality)), settlement)


def money_label(amount: Column) -> Column:
    """An amount as people write it: no decimals if it has none, else two."""
    shown = F.when(amount == F.floor(amount), F.format_number(amount, 0)).otherwise(F.format_number(amount, 2))
    return F.when(amount.isNotNull(), F.concat(F.translate(shown, ",.", ".,"), F.lit(" KM")))


def meta_line(kind_label: Column, round_: Column, per_area: Column, deposit: Column, method_label: Column) -> Column:
    """The first four of: kind, hearing, price of a square metre, deposit, method."""
    hearing = F.lit(None).cast("string")
    for k, v in ROUND_SHORT.items():
        hearing = F.when(round_ == k, v).otherwise(hearing)
    area = F.when(per_area > 0, F.concat(F.translate(F.format_number(numbers.js_round(per_area, 0), 0), ",", "."), F.lit(" KM/m²")))
    parts = F.array_compact(F.array(kind_label, hearing, area, F.concat(F.lit("kapara "), money_label(deposit)), F.lower(method_label)))
    return F.array_join(F.slice(parts, 1, 4), " · ")


def unpriced_risks(df: DataFrame, key: str = "id") -> DataFrame:
    """``(key, risk)``: costs that a row's kind carries and its notice doesn't state."""
    risks = F.array(*(F.when(F.col("sale_type").isin(*kinds), F.lit(name)) for name, kinds in UNPRICED.items()))
    return df.select(key, F.explode(F.array_compact(risks)).alias("risk"))


def fact_rows(df: DataFrame, key: str, facts: list[tuple[str, Column, bool]]) -> DataFrame:
    """``(key, fact, value)``: a fact that a row lacks is shown only where asked for, as a dash."""
    made = [F.struct(F.lit(n).alias("fact"), F.coalesce(v.cast("string"), F.lit("-") if always else F.lit(None).cast("string")).alias("value")) for n, v, always in facts]
    return df.select(key, F.explode(F.array(*made)).alias("f")).select(key, "f.*").where("value is not null")


def year_bucket(date: Column, newest_years: list[int]) -> Column:
    """A hearing's year, if it is one of the newest; else "older"."""
    return F.when(F.year(date).isin(*newest_years), F.year(date).cast("string")).otherwise("older")


def newest_years(df: DataFrame, date: str = "sale_date", n: int = 6) -> list[int]:
    """At most ``n`` years, the newest first."""
    return [r.y for r in df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("y")).count().orderBy(F.desc("y")).limit(n).select("y").collect()]


def by_tag(df: DataFrame, tag: str, tags: str = "item_tags") -> DataFrame:
    return df.where(F.array_contains(tags, tag))


def court_bundle(df: DataFrame, as_of: Column) -> DataFrame:
    """What heads a court's page: open and all rows, its share of the archive in per cent, first publication, median lead, kinds of sale."""
    total = df.count()
    lead = F.datediff("sale_date", "published_date")
    kinds = df.groupBy("court_id", "sale_type").agg(F.count("*").alias("n")).groupBy("court_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "sale_type"))).alias("k"))  # five kinds
    one = df.groupBy("court_id").agg(
        F.max_by("entity", "id").alias("entity"), F.count_if(F.col("sale_date") >= as_of).alias("open"), F.count("*").alias("total"), F.min("published_date").alias("oldest"), F.median(F.when(lead >= 0, lead)).alias("lead")
    )
    line = F.array_join(F.transform("k", lambda x: F.concat(x["sale_type"], F.lit(":"), (-x["n"]).cast("string"))), ",")
    return one.join(kinds.select("court_id", line.alias("kinds")), "court_id").withColumn("share", numbers.js_round(100.0 * F.col("total") / total, 0).cast("int"))


def court_weeks(df: DataFrame, court_id: int, as_of: Column) -> DataFrame:
    return week_strip(upcoming(df.where(F.col("court_id") == court_id), as_of), "sale_date")


def price_tiles(df: DataFrame, group: Column, per_area: Column, least: int = 5) -> DataFrame:
    """How many rows state a price for an area, how many of them are in a group of ``least`` or more, and how many groups are."""
    rows = df.select(group.alias("g"), per_area.alias("v")).where("v is not null")
    by = rows.groupBy("g").agg(F.count("*").alias("n"))
    shown = (F.col("n") >= least) & F.col("g").isNotNull()
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("measurable"), F.coalesce(F.sum(F.when(shown, F.col("n"))), F.lit(0)).alias("in_table"), F.count_if(shown).alias("groups"))


def drop_tiles(drops: DataFrame) -> DataFrame:
    """Of falls: all, those against a hearing before, and the steepest."""
    return drops.agg(F.count("*").alias("open"), F.count("from_previous").alias("firm"), F.max("drop").alias("steepest"))


def home_tiles(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows to come, all rows and their first year, courts and active courts."""
    return df.agg(
        F.count_if(F.col("sale_date") >= as_of).alias("upcoming"), F.count("*").alias("total"), F.min(F.year("published_date")).alias("since"), F.count_distinct("court_id").alias("courts"),
        F.count_distinct(F.when(F.col("sale_date") >= as_of, F.col("court_id"))).alias("active"), F.avg(F.col("viewing_info").isNotNull().cast("int")).alias("viewing_share"),
    )


def temporal_coverage(df: DataFrame, date: str = "sale_date") -> DataFrame:
    """The different years of hearings, the first and the last."""
    return df.agg(F.count_distinct(F.year(date)).alias("years"), F.min(F.year(date)).alias("first"), F.max(F.year(date)).alias("last"))


def vat_costs(bid: Column, deposit: Column, rate: Column, fees: Column, vat: Column, vat_rate: float = 0.17, base: Column | None = None, other: Column | None = None) -> Column:
    """The cost breakdown where VAT, if it applies, takes the transfer tax's place and isn't added to it."""
    return numbers.cost_breakdown(bid, deposit, F.when(vat, F.lit(vat_rate)).otherwise(rate), fees, base, other)


def alternative_base(basis: Column, appraised: Column, floor: Column) -> Column:
    """The appraisal, where the tax goes by market value and lies above the floor; else none."""
    return F.when((basis == "trzisna") & (appraised > floor), appraised)


def tag_counts(df: DataFrame, as_of: Column, order: list[str], tags: str = "item_tags") -> DataFrame:
    """Tags with all and upcoming rows in a given order; a row counts in each of its tags, tags without rows are left out."""
    rows = df.select("sale_date", F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("sale_date") >= as_of).alias("upcoming"))
    return rows.withColumn("ord", F.array_position(F.array(*map(F.lit, order)), F.col("tag")).cast("int")).where("ord > 0").orderBy("ord")


def days_line(date: Column, as_of: Column) -> Column:
    return dates.days_label(F.datediff(date, as_of))
