"""Gates that a publication must pass, each a count of offending rows or a rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import dates, numbers, redact


def gates(df: DataFrame, key: str, court: Column, sale: Column, published: Column, case: Column, appraised: Column, starting: Column, texts: list[Column], venue: Column | None = None, least_rows: int = 500, least_courts: int = 15, price_rate: float = 0.6, case_rate: float = 0.7) -> DataFrame:
    """``(gate, value, passed)`` from one aggregation over all rows."""
    priced = F.coalesce((starting > 0) | (appraised > 0), F.lit(False))
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("double")
    rate = lambda c: F.try_divide(F.count_if(F.coalesce(c, F.lit(False))), F.count("*"))
    leak = person = None
    for t in texts:
        named = redact.redact_parties(t) != t
        leak = redact.leaks(t) if leak is None else leak | redact.leaks(t)
        person = named if person is None else person | named
    stray = F.lit(False) if venue is None else venue.isNotNull() & redact.redact_venue(venue).isNull()
    checks = [
        ("rows", F.count("*").cast("double"), lambda v: v >= least_rows),
        ("courts", F.count_distinct(court).cast("double"), lambda v: v >= least_courts),
        ("price_rate", rate(priced), lambda v: v >= price_rate),
        ("case_rate", rate(case.isNotNull()), lambda v: v >= case_rate),
        ("repeated_ids", (F.count("*") - F.count_distinct(F.col(key))).cast("double"), lambda v: v == 0),
        ("undated", bad(sale.isNull()), lambda v: v == 0),
        ("misdated", bad(sale.isNotNull() & dates.plausible(sale, published).isNull()), lambda v: v == 0),
        ("absurd", bad(F.greatest(appraised, starting) > numbers.MOST_PLAUSIBLE), lambda v: v == 0),
        ("inverted", bad(starting > appraised * 1.02), lambda v: v == 0),
        ("leaks", bad(leak) if leak is not None else F.lit(0.0), lambda v: v == 0),
        ("persons", bad(person) if person is not None else F.lit(0.0), lambda v: v == 0),
        ("venues", bad(stray), lambda v: v == 0),
    ]
    one = df.agg(*(c.alias(n) for n, c, _ in checks))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("gate"), F.col(n).alias("value"), F.coalesce(ok(F.col(n)), F.lit(False)).alias("passed")) for n, _, ok in checks))).alias("r")
    return one.select(rows).select("r.*")


def required(df: DataFrame, message: str = "a gate failed") -> DataFrame:
    """The gates again, failing the query where one did not pass."""
    return df.where(F.assert_true(F.col("passed"), F.concat(F.lit(f"{message}: "), F.col("gate"))).isNull())
