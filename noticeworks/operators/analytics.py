"""Aggregates and windows over hearings, lots and places. Columns come as arguments; results are DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.functions import dates, numbers


def chains(df: DataFrame, case: str, date: str, seq: str, price: str) -> DataFrame:
    """Each hearing with its place in its case's chain, the chain's length and the price before; null cases stand alone."""
    key = F.coalesce(F.col(case).cast("string"), F.concat(F.lit("alone-"), F.col(seq).cast("string")))
    df = df.withColumn("_case", key)
    by = W.partitionBy("_case")
    w = by.orderBy(date, seq)
    return df.select("*", F.row_number().over(w).alias("position"), F.count("*").over(by).alias("chain_length"), F.lag(price).over(w).alias("previous_price")).drop("_case")


def price_drops(chain: DataFrame, price: str, date: str, as_of: Column, appraised: Column | None = None) -> DataFrame:
    """Upcoming hearings whose price fell: against the one before, else against the appraisal; the steepest first."""
    off = F.lit(None).cast("double") if appraised is None else numbers.discount(F.col(price), appraised)
    out = chain.withColumn("from_previous", numbers.fall(F.col("previous_price"), F.col(price))).withColumn("drop", F.coalesce("from_previous", off))
    return out.where((F.col("drop") > 0) & (F.col(date) >= as_of)).orderBy(F.desc("drop"), date)


def slices(df: DataFrame, key: Column, label: str = "label") -> DataFrame:
    """Rows by key, the most frequent first; null keys count nowhere."""
    return df.select(key.alias(label)).where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def labelled_slices(df: DataFrame, key: Column, labels: list[str]) -> DataFrame:
    """Rows by key in the labels' order; labels without rows are left out."""
    order = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    return slices(df, key).withColumn("ord", order).where("ord > 0").orderBy("ord")


#: Values of a group beyond which its median is found by ranks and not in one buffer.
MEDIAN_ROWS = 2_000_000


def medians(df: DataFrame, key: Column, value: Column, least: int, all_rows: bool = False) -> DataFrame:
    """Exact medians by key with their sample sizes, from ``least`` rows on; the greatest first.

    A group of very many values isn't gathered: its middle ranks are found between two approximate ones.
    """
    rows = df.select(key.alias("key"), value.alias("value")).where(F.col("key").isNotNull())
    if not all_rows:
        rows = rows.where(F.col("value").isNotNull())
    largest = rows.groupBy("key").agg(F.count("value").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    found = rows.groupBy("key").agg(F.count("*").alias("n"), F.median("value").alias("median")) if largest <= MEDIAN_ROWS else _medians_by_rank(rows)
    return found.where(F.col("n") >= least).orderBy(F.desc("median"), "key")


def _medians_by_rank(rows: DataFrame, near: float = 0.002) -> DataFrame:
    """``(key, n, median)`` of ``rows (key, value)``: of each group only the values around its middle are sorted."""
    by = rows.groupBy("key").agg(F.count("*").alias("n"), F.count("value").alias("m"), F.percentile_approx("value", [0.5 - near, 0.5 + near], F.lit(10_000)).alias("b"))
    by = by.select("key", "n", "m", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))
    at = rows.where("value is not null").join(by, "key")
    counts = at.where("value <= hi").groupBy("key", "m", F.when(F.col("value") >= F.col("lo"), F.col("value")).alias("v")).agg(F.count("*").alias("c"))  # all below ``lo`` are one row
    so_far = F.sum("c").over(W.partitionBy("key").orderBy(F.col("v").asc_nulls_first()))
    middle = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("c") <= r), F.col("v")))
    low, high = F.floor((F.col("m") - 1) / 2), F.floor(F.col("m") / 2)
    picked = counts.withColumn("upto", so_far).groupBy("key").agg(middle(low).alias("a"), middle(high).alias("b"))
    return by.join(picked, "key", "left").select("key", "n", ((F.col("a") + F.col("b")) / 2).alias("median"))


def median(df: DataFrame, value: Column) -> DataFrame:
    """``(n, median)`` of all values that aren't null; one row."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    n = v.count()
    if n <= MEDIAN_ROWS:
        return v.agg(F.count("*").alias("n"), F.median("v").alias("median"))
    a, b = at_ranks(v, ((n - 1) // 2, n // 2), n)
    return df.sparkSession.createDataFrame([(n, (a + b) / 2)], "n long, median double")


def median_days(df: DataFrame, days: Column) -> DataFrame:
    """``(n, median)`` of whole days that aren't null; one row. Days are few different values, so they are counted in one pass over the rows."""
    counts = df.select(days.cast("long").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    upto = counts.select("v", "c", F.sum("c").over(W.orderBy("v")).alias("upto"), F.sum("c").over(W.partitionBy()).alias("n"))  # a row for each day
    at = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("c") <= r), F.col("v")))
    return upto.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))


def by_year(df: DataFrame, date: str, starting: Column, appraised: Column, least: int = 5) -> DataFrame:
    """Medians by the hearing's year; the count holds unpriced rows too."""
    return (
        df.groupBy(F.year(date).alias("year"))
        .agg(F.count("*").alias("n"), F.median(F.when(starting > 0, starting)).alias("median_starting"), F.median(numbers.discount(starting, appraised)).alias("median_discount"))
        .where(F.col("n") >= least)
        .orderBy("year")
    )


def years_filled(df: DataFrame, date: str) -> DataFrame:
    """Rows by year from the first to the last, years without any too."""
    counts = df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    return span.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n")).orderBy("year")


def week_strip(df: DataFrame, date: str, weeks: int = 9) -> DataFrame:
    """Rows by week from the first Monday on; weeks without any too, and all further ones in the last."""
    d = df.select(F.to_date(date).alias("d")).where("d is not null")
    first = d.agg(F.min(dates.monday(F.col("d"))).alias("first"), F.max(dates.monday(F.col("d"))).alias("last"))
    n = F.least(F.datediff("last", "first") / 7, F.lit(weeks - 1)).cast("int")
    frame = first.where("first is not null").select("first", F.explode(F.sequence(F.lit(0), n)).alias("week"))
    at = F.least(F.floor(F.datediff(F.col("d"), F.col("first")) / 7), F.lit(weeks - 1)).cast("int")
    counts = d.groupBy("d").agg(F.count("*").alias("c")).crossJoin(F.broadcast(first)).groupBy(at.alias("week")).agg(F.sum("c").alias("n"))  # one row
    return frame.join(counts, "week", "left").select("week", F.date_add("first", F.col("week") * 7).alias("monday"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("week")


def histogram(df: DataFrame, value: Column, bins: int = 7, least: int = 8) -> DataFrame:
    """Bins between the values at ranks of five and 95 per cent, rounded to hundreds; what lies outside falls in the end bins.

    The bounds come from ranks, so a distributed sort finds them: no list of all values is gathered.
    """
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    n = v.count()
    if n < least:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    lo, hi = (max(100.0, float(int(b / 100 + 0.5)) * 100) for b in at_ranks(v, (int(n * 0.05), int(n * 0.95)), n))
    if hi <= lo:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    width = (hi - lo) / bins
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / width))).cast("int")
    found = v.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(found, "bin", "left").select("bin", (lo + F.col("bin") * width).alias("lower"), (lo + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


def at_ranks(v: DataFrame, ranks: tuple[int, ...], n: int, near: float = 0.002, few: int = 50_000) -> list[float]:
    """Values at 0-based ranks of the ``n`` values ``v (v)``: brackets from approximate ranks, narrowed until few values lie in each.

    All ranks are narrowed in the same passes.
    """
    found: dict[int, float] = {}
    open_ = dict.fromkeys(ranks, (float("-inf"), float("inf"), 0, n))  # lower and upper end, values below, values within
    while open_:
        inside = lambda b: F.col("v").between(F.lit(b[0]), F.lit(b[1]))
        cuts = []
        for r, b in open_.items():
            f = (r - b[2]) / max(1, b[3])
            cuts.append(F.percentile_approx(F.when(inside(b), F.col("v")), [max(0.0, f - near), min(1.0, f + near)], F.lit(10_000)))
        ends = v.agg(*(c.alias(f"c{i}") for i, c in enumerate(cuts))).first()
        new = {r: (ends[i][0], ends[i][1]) for i, r in enumerate(open_)}
        counts = v.agg(*(c.alias(f"c{2 * i + k}") for i, (lo, hi) in enumerate(new.values()) for k, c in enumerate((F.count_if(F.col("v") < lo), F.count_if(F.col("v").between(lo, hi)))))).first()
        for i, r in enumerate(list(open_)):
            lo, hi = new[r]
            below, within = counts[2 * i], counts[2 * i + 1]
            if not below <= r < below + within:  # an approximate end lies on the wrong side
                lo, hi, below, within = open_[r]
                near *= 4
            if lo == hi:
                found[r] = lo
            elif within <= few:
                seen = below
                for row in v.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("c")).orderBy("v").collect():  # ``few`` rows at most
                    seen += row.c
                    if seen > r:
                        found[r] = row.v
                        break
            else:
                open_[r] = (lo, hi, below, within)
                continue
            del open_[r]
    return [found[r] for r in ranks]


def lead_days(published: Column, sale: Column) -> Column:
    d = F.datediff(sale, published)
    return F.when(d >= 0, d)


def comparables(df: DataFrame, row: str, tag: Column, tags: Column, near: Column, order: list[Column], limit: int = 3) -> DataFrame:
    """``(left_id, right_id, rank)``: of each row the best ``limit`` others that hold its main tag, those alike in ``near`` first.

    Only the best of each tag and class can be partners, and of the other classes the best 2 x ``limit`` of a
    tag, as one class takes ``limit`` of them at most. So each tag offers a short list, whatever its rows.
    """
    right = df.select(F.explode(F.array_distinct(tags)).alias("tag"), near.alias("near"), F.col(row).alias("id"), *(o.alias(f"_o{i}") for i, o in enumerate(order)))
    by = [*(F.col(f"_o{i}") for i in range(len(order))), F.col("id")]
    best = right.withColumn("r", F.row_number().over(W.partitionBy("tag", "near").orderBy(*by))).where(F.col("r") <= limit + 1)
    alike = best.groupBy("tag", "near").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("alike"))  # limit + 1 at most
    first = best.where(F.col("r") <= limit).withColumn("q", F.row_number().over(W.partitionBy("tag").orderBy(*by))).where(F.col("q") <= 2 * limit)
    others = first.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("q", "near", "id"))).alias("others"))  # 2 x limit at most
    left = df.select(F.col(row).alias("left_id"), tag.alias("tag"), near.alias("own"))
    met = left.join(alike, (left["tag"] == alike["tag"]) & left["own"].eqNullSafe(alike["near"]), "left").drop(alike["tag"]).join(others, "tag")
    none = F.array().cast(right.schema["id"].dataType.simpleString().join(("array<", ">")))
    same = F.filter(F.coalesce("alike", none), lambda x: x != F.col("left_id"))
    apart = F.transform(F.filter("others", lambda x: ~x["near"].eqNullSafe(F.col("own"))), lambda x: x["id"])
    return met.select("left_id", F.posexplode(F.slice(F.concat(F.slice(same, 1, limit), apart), 1, limit)).alias("pos", "right_id")).select("left_id", "right_id", (F.col("pos") + 1).alias("rank"))


def top_per_group(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    return df.select("*", F.row_number().over(W.partitionBy(group).orderBy(*order)).alias("rank")).where(F.col("rank") <= limit)


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; keys that a third of rows share still combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    ranked = df.select(key, F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)]).alias("_o"), F.struct(*rest).alias("_r"))
    return ranked.groupBy(key).agg(F.min_by("_r", "_o").alias("_r")).select(key, "_r.*")


def carry_forward(prior: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """The new rows, and those of the archive that the run no longer saw."""
    return now.withColumn("origin", F.lit("built")).unionByName(prior.join(now, key, "left_anti").withColumn("origin", F.lit("retained")))


def reuse_split(now: DataFrame, prior: DataFrame, key: str, full: bool, version: str, least: float = 0.5) -> DataFrame:
    """Rows of a run with whether the archive's reading of them still serves."""
    p = prior.select(key, F.col("version").alias("_v"), F.col("confidence").alias("_c"), F.col("documents").alias("_d"), F.lit(True).alias("_there"))
    ok = F.lit(not full) & F.coalesce("_there", F.lit(False)) & F.coalesce(F.col("_v") == version, F.lit(False)) & F.coalesce(F.col("_c") >= least, F.lit(False)) & F.coalesce(F.col("_d") > 0, F.lit(False))
    return now.join(p, key, "left").withColumn("reused", ok).drop("_v", "_c", "_d", "_there")


def confidence(*filled: Column) -> Column:
    """Share of checks that hold, to two decimals."""
    total = sum((F.coalesce(c, F.lit(False)).cast("int") for c in filled[1:]), F.coalesce(filled[0], F.lit(False)).cast("int"))
    return numbers.js_round(total / float(len(filled)))


def disagreement(name: str, a: Column, b: Column, material: float = 0.02) -> Column:
    """A struct where two readings of an amount differ by more than two per cent, else null."""
    ratio = F.try_divide(F.greatest(a, b), F.least(a, b))
    return F.when((a > 0) & (b > 0) & (ratio - 1 > material), F.struct(F.lit(name).alias("field"), a.alias("llm"), b.alias("rules"), ratio.alias("ratio")))


def concentration(df: DataFrame, key: str, top: int = 3) -> DataFrame:
    """Share of the ``top`` keys among all rows, in rounded per cent."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), key).limit(top).agg(F.sum("n").alias("top"))
    return counts.agg(F.sum("n").alias("all")).crossJoin(first).select("all", "top", numbers.js_round(100.0 * F.col("top") / F.col("all"), 0).cast("int").alias("percent"))  # one row each
