"""Numbers: amounts, areas, discounts, falls, and what a purchase costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

MOST_PLAUSIBLE = 150_000_000
DEPOSIT_SHARE, DEPOSIT_CAP = 0.1, 10_000.0
FLOORS = {"prvo": 0.5, "drugo": 1 / 3, "trece": 1 / 3}
#: Canton of a court, by its id, and who pays the transfer tax there.
CANTONS = {
    "USK": (20, 23), "PK": (25,), "TK": (28, 32, 33, 126, 127), "ZDK": (36, 39, 42, 43, 44), "BPK": (45,), "SBK": (46, 51, 128), "HNK": (53, 55, 56, 58), "ZHK": (64,), "KS": (65,), "K10": (68,),
}
BUYER_PAYS = ("KS", "USK", "PK", "HNK", "K10")


def js_round(c: Column, digits: int = 2) -> Column:
    """Half up on the binary value, as a floor: what a plain round would do differently stays undone."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def parse_amount(c: Column) -> Column:
    """An amount whose last separator decides: before three digits it parts thousands, else decimals."""
    return once(F.regexp_replace(c, r"[\s ]", ""), _parsed)


def _parsed(s: Column) -> Column:
    comma, dot = F.locate(",", F.reverse(s)), F.locate(".", F.reverse(s))
    bare = F.regexp_replace(s, r"[.,]", "")
    dotless, last = F.replace(s, F.lit("."), F.lit("")), F.length(s) - dot
    value = (
        F.when((comma > 0) & (dot > 0), F.when(comma < dot, F.regexp_replace(dotless, r",", ".")).otherwise(F.replace(s, F.lit(","), F.lit(""))))
        .when(comma > 0, F.when(s.rlike(r",\d{3}\z"), F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit("."))))
        .when(dot > 0, F.when(dot - 1 == 3, bare).otherwise(F.concat(F.replace(F.substring(s, F.lit(1), last), F.lit("."), F.lit("")), F.lit("."), F.substring(s, last + 2, F.length(s)))))
        .otherwise(s)
    )
    return once(F.regexp_extract(value, r"^(\d+(?:\.\d*)?)", 1).try_cast("double"), lambda n: F.when(n >= 0, n))


def parse_area(c: Column) -> Column:
    """An area: every dot parts thousands, the first comma decimals; null unless positive."""
    n = F.regexp_replace(F.replace(c, F.lit("."), F.lit("")), r"^([^,]*),", "$1.").try_cast("double")
    return F.when(n > 0, n)


def area_of(*texts: Column) -> Column:
    """Square metres, if all texts together name exactly one value."""
    joined = F.concat_ws(" \n ", *texts)
    found = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(joined, F.lit(r"(?i)(\d[.,\d]*)\s?m[2²]"), 1), parse_area)))
    return F.when(F.size(found) == 1, F.get(found, 0))


def price_per_area(starting: Column, appraised: Column, area: Column) -> Column:
    price = F.coalesce(starting, appraised)
    return F.when((price > 0) & (area >= 1), F.try_divide(price, area))


def discount(starting: Column, appraised: Column) -> Column:
    return F.when(starting.isNotNull() & (appraised > 0), 1 - F.try_divide(starting, appraised))


def fall(previous: Column, current: Column) -> Column:
    """Share by which a price fell; null unless within one and 95 per cent, both apart."""
    f = 1 - F.try_divide(current, F.when(previous > 0, previous))
    return F.when((f > 0.01) & (f < 0.95), f)


def format_km(c: Column) -> Column:
    return F.concat(F.translate(F.format_number(c, 0), ",.", ".,"), F.lit(" KM"))


def format_percent(c: Column) -> Column:
    n = js_round(c * 100, 0).cast("long")
    return F.concat(F.when(n < 0, F.lit("−")).otherwise(F.lit("")), F.abs(n).cast("string"), F.lit("%"))


def deposit_for(deposit: Column, appraised: Column) -> Column:
    """The notice's deposit, or a tenth of the appraisal up to the cap."""
    return F.coalesce(deposit, F.when(appraised > 0, F.least(appraised * DEPOSIT_SHARE, F.lit(DEPOSIT_CAP))))


def floor_for(starting: Column, appraised: Column, round_: Column) -> Column:
    share = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, value in FLOORS.items():
        share = share.when(round_ == name, F.lit(value))
    return F.when(starting > 0, starting).when(appraised > 0, appraised * share)


def fees_for(price: Column, sale_type: Column) -> Column:
    registry = F.floor(F.least(F.greatest(price * 0.005, F.lit(100.0)), F.lit(1500.0)) / 10 + 0.5) * 10.0
    return F.when(price <= 0, 0.0).when(sale_type == "nekretnine", registry).when(sale_type == "vozila", 150.0).otherwise(0.0)


def canton_of(court_id: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for canton, courts in CANTONS.items():
        out = out.when(court_id.isin(*courts), canton)
    return out


def tax_rate(sale_type: Column, entity: Column, court_id: Column) -> Column:
    """The transfer tax that falls on the buyer."""
    canton = canton_of(court_id)
    return F.when(sale_type != "nekretnine", 0.0).when(entity == "RS", 0.0).when(entity == "BD", 0.03).when(canton.isNull() | canton.isin(*BUYER_PAYS), 0.05).otherwise(0.0)


def cost_breakdown(bid: Column, deposit: Column, rate: Column, fees: Column, base: Column | None = None, other: Column | None = None) -> Column:
    """What is lodged before the hearing and due after it; the deposit counts toward the price."""
    other = F.lit(0.0) if other is None else other
    lodged = F.least(F.coalesce(deposit, F.lit(0.0)), bid)
    tax = F.greatest(F.lit(0.0), bid if base is None else F.coalesce(base, bid)) * rate
    balance = F.greatest(F.lit(0.0), bid - lodged)
    return F.struct(lodged.alias("deposit"), balance.alias("balance"), tax.alias("tax"), fees.alias("fees"), (bid + tax + fees + other).alias("total"), lodged.alias("before_hearing"), (balance + tax + fees + other).alias("after_hearing"))


def reconcile(appraised: Column, starting: Column, deposit: Column, total: Column, rule_appraised: Column, rule_starting: Column, rule_deposit: Column) -> Column:
    """Money of two readings: no reading above what the text prints in all, no floor above its appraisal, no deposit above the cap."""
    ceiling = F.when(total > 0, total * 1.05)
    sane = lambda c: F.when((c > 0) & (c <= MOST_PLAUSIBLE) & (ceiling.isNull() | (c <= ceiling)), js_round(c))
    value = F.coalesce(sane(appraised), js_round(rule_appraised))
    floor = F.coalesce(sane(starting), js_round(rule_starting))
    floor = F.when(value.isNull() | floor.isNull() | (floor <= value * 1.02), floor).when(rule_starting <= value * 1.02, js_round(rule_starting))
    low = lambda c: F.when((c > 0) & (c <= DEPOSIT_CAP) & (value.isNull() | (c <= value)), js_round(c))
    return F.struct(value.alias("appraised"), floor.alias("starting"), F.coalesce(low(deposit), low(rule_deposit)).alias("deposit"))
