"""Queries of extraction, privacy, views and reports over notices and listings made from orders.

A notice's text is composed from an order's own values, in the wording of such notices; reading it must give
those values back, so the SQL of a query takes them from the order and never reads a text. A listing is an
order with the columns of a published row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.functions import dates, describe, extract, merge, numbers, redact, text
from noticeworks.operators import analytics as A
from noticeworks.operators import places, reports, search, sinks, views
from noticeworks.sources import institutions

from .catalog import AS_OF, _n, _spread, _t, query

_PLACES = ["Omerbegovača", "Batković", "Petrovo", "Grbavica", "Donji Butmir"]
_TOWNS = ["Sarajevu|Sarajevo", "Bijeljini|Bijeljina", "Širokom Brijegu|Široki Brijeg", "Velikoj Kladuši|Velika Kladuša", "Prijedoru|Prijedor", "Mostaru|Mostar", "BANJOJ LUCI|Banja Luka"]
_GOODS = ["Viljuškar marke Linde crvene boje", "Ormar i stolica od hrasta", "Traktor sa prikolicom", "Frižider i zamrzivač bijele boje"]
_GOOD_TAGS = ["viljuskar", "ormari,stolice", "prikolica,traktor", "frizider"]
_KINDS = ["nekretnine", "vozila", "tehnika", "namjestaj", "ostalo"]
_TAGS = ["stan", "kuca", "traktor", "monitor", "klima", "tv"]


def _pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))


def _sql(values: list[str], i: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({i}) % {len(values)} + 1)"


def _km(c: Column) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


def _notices(spark: SparkSession, sf: str) -> DataFrame:
    """``(k, p, day, title, text)``: a notice of each order."""
    k, p = F.col("o_orderkey"), F.floor("o_totalprice")
    towns = [t.split("|")[0] for t in _TOWNS]
    hour, minute = (8 + k % 9).cast("string"), F.lpad((k * 5 % 60).cast("string"), 2, "0")
    when = F.when(k % 5 == 0, F.concat(F.lit("u "), hour, F.lit(" sati"))).otherwise(F.concat(F.lit("u "), hour, F.lit(","), minute, F.lit(" sati")))
    lines = [
        F.concat(F.lit("BOSNA I HERCEGOVINA\nOpćinski sud u "), _pick(towns, k), F.lit("\n")),
        F.concat(F.when(k % 2 == 0, "Broj: 65 0 Ip ").otherwise("Број: 65 0 Ип "), (1_000_000 + k).cast("string"), F.lit(" "), F.lpad((k % 30).cast("string"), 2, "0"), F.when(k % 2 == 0, " Ip\n").otherwise(" Ип\n")),
        F.concat(_pick(["Prvo ročište", "Drugo ročište", "Treće ročište", "Hearing"], k), F.lit(" za prodaju održat će se "), F.date_format("o_orderdate", "d.M.yyyy."), F.lit(" "), when, F.lit(", "), _pick(["usmenim javnim nadmetanjem", "prikupljanjem ponuda", "neposrednom pogodbom", "na drugi način"], F.floor(k / 4)), F.lit(".\n")),
        F.concat(F.lit("Izvršenje se vodi radi naplate duga u iznosu od 500,00 KM i drugih obaveza koje su u predmetu izvršenja nastale do dana donošenja ovoga zaključka o prodaji predmeta.\n")),
        F.concat(F.lit("Nekretnine utvrđene vrijednosti iznose "), _km(p + 0.25), F.lit(" KM, a na ovom ročištu ne mogu se prodati ispod polovine te cijene, odnosno za manje od "), _km(F.floor(p / 2)), F.lit(" KM.\n")),
        F.concat(F.lit("Učesnici su dužni položiti jemstvo od 1/10 u iznosu "), _km(F.least(F.floor(p / 10), F.lit(9999))), F.lit(" KM na račun.\n")),
        F.concat(F.lit("Predmet su k.č. broj "), (k % 5000 + 1).cast("string"), F.lit("/"), (k % 9 + 1).cast("string"), F.lit(", z.k. uložak br. "), (k % 700 + 1).cast("string"), F.lit(" k.o. "), _pick(_PLACES, k), F.lit(".\n")),
        F.concat(F.lit("Razgledanje predmeta moguće je dana "), (k % 28 + 1).cast("string"), F.lit(" u mjesecu. Kraj.\n")),
    ]
    orders = _spread(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderkey")
    return orders.select(k.alias("k"), p.alias("p"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("Prodaja ("), _pick(_GOODS, k), F.lit(")")).alias("title"), F.concat(*lines).alias("text"))


@query("SELECT o_orderkey AS k, '65 0 Ip ' || (1000000 + o_orderkey) || ' ' || lpad((o_orderkey % 30)::VARCHAR, 2, '0') || ' Ip' AS case_number FROM orders")
def notice_case_number(spark, sf):
    return _notices(spark, sf).select("k", extract.case_number(F.col("text")).alias("case_number"))


@query("""SELECT k, ord::INTEGER AS ord, amount, role FROM (SELECT o_orderkey AS k, unnest([1, 2, 3, 4]) AS ord, unnest([500.0, floor(o_totalprice) + 0.25, floor(floor(o_totalprice) / 2), least(floor(floor(o_totalprice) / 10), 9999.0)]) AS amount, unnest(['debt', 'appraised', 'floor', 'deposit']) AS role FROM orders)""")
def notice_amounts(spark, sf):
    a = _notices(spark, sf).select("k", F.posexplode(extract.amounts(F.col("text"))).alias("pos", "a"))
    return a.select("k", (F.col("pos") + 1).alias("ord"), F.col("a.amount").alias("amount"), F.col("a.role").alias("role"))


@query("""SELECT o_orderkey AS k, floor(o_totalprice) + 0.25 AS appraised, floor(floor(o_totalprice) / 2) AS starting, least(floor(floor(o_totalprice) / 10), 9999.0) AS deposit,
500.0 + floor(o_totalprice) + 0.25 + floor(floor(o_totalprice) / 2) + least(floor(floor(o_totalprice) / 10), 9999.0) AS printed FROM orders""")
def notice_money(spark, sf):
    m = _notices(spark, sf).select("k", extract.money(extract.amounts(F.col("text"))).alias("m"))
    return m.select("k", *(F.col(f"m.{c}").cast("double").alias(c) for c in ("appraised", "starting", "deposit", "printed")))


@query("""SELECT o_orderkey AS k, (100 + o_orderkey % 50 + 2 * (o_orderkey % 70 + 1))::DOUBLE AS sum_, 'item' AS role FROM orders""")
def notice_price_list(spark, sf):
    k = _spread(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k")
    rows = F.concat(F.lit("Prodaju se stvari:\n- ormar, po početnoj cijeni od "), _km(100.0 + F.col("k") % 50), F.lit(" KM\n- sto, po početnoj cijeni od "), _km(2.0 * (F.col("k") % 70 + 1)), F.lit(" KM\n"))
    a = k.select("k", extract.amounts(rows).alias("a"))
    return a.select("k", extract.money(F.col("a"))["starting"].cast("double").alias("sum_"), F.array_max(F.transform("a", lambda x: x["role"])).alias("role"))


@query(f"""SELECT o_orderkey AS k, {_sql(['prvo', 'drugo', 'trece', 'nepoznato'], 'o_orderkey')} AS round, {_sql(['usmeno-javno-nadmetanje', 'prikupljanje-ponuda', 'neposredna-pogodba', 'nepoznato'], 'o_orderkey // 4')} AS method,
lpad((8 + o_orderkey % 9)::VARCHAR, 2, '0') || ':' || CASE WHEN o_orderkey % 5 = 0 THEN '00' ELSE lpad((o_orderkey * 5 % 60)::VARCHAR, 2, '0') END AS time FROM orders""")
def notice_hearing(spark, sf):
    t, line = F.col("text"), F.col("line")
    n = _notices(spark, sf).withColumn("line", extract.folded_line(t))
    return n.select("k", extract.round_in(line).alias("round"), extract.method_in(line).alias("method"), extract.sale_time(F.regexp_replace(t, r"\n+", " ")).alias("time"))


@query("""SELECT o_orderkey AS k, 'sudnica broj ' || (o_orderkey % 40 + 1) AS venue, 'Razgledanje predmeta moguće je dana ' || (o_orderkey % 28 + 1) || ' u mjesecu' AS viewing FROM orders""")
def notice_venue_and_viewing(spark, sf):
    n = _notices(spark, sf).withColumn("room", F.concat(F.lit("Ročište je zakazano, sudnica broj "), (F.col("k") % 40 + 1).cast("string"), F.lit(" , kat I.")))
    return n.select("k", extract.venue(F.col("room")).alias("venue"), extract.viewing(F.col("text")).alias("viewing"))


@query(f"SELECT o_orderkey AS k, {_sql([t.split('|')[1] for t in _TOWNS], 'o_orderkey')} AS municipality FROM orders")
def notice_municipality(spark, sf):
    return _notices(spark, sf).select("k", merge.municipality(F.col("text")).alias("municipality"))


@query(f"""SELECT o_orderkey AS k, (o_orderkey % 5000 + 1) || '/' || (o_orderkey % 9 + 1) AS kc, (o_orderkey % 700 + 1)::VARCHAR AS zk, {_sql(_PLACES, 'o_orderkey')} AS ko, {_sql(_PLACES, 'o_orderkey')} AS settlement FROM orders""")
def notice_cadastral(spark, sf):
    c = _notices(spark, sf).select("k", extract.cadastral(F.col("text")).alias("c"))
    return c.select("k", F.array_join("c.kc", ",").alias("kc"), F.array_join("c.zk_ulozak", ",").alias("zk"), F.array_join("c.ko", ",").alias("ko"), extract.settlement(F.col("c.ko")).alias("settlement"))


_NAMES = ["SP_Dolac|Dolac", "Drugovići|Drugovići", "prvoj|", "Dobrinka Milivojević|", "xxx|", "prodaja|", "Republika Srpska|", "NP Trnovo|Trnovo", "ab|", "Gornji   Vakuf|Gornji Vakuf", "Tuzlanski kanton|", "Trn|Trn"]


@query(f"SELECT c_custkey AS k, nullif({_sql([n.split('|')[1] for n in _NAMES], 'c_custkey')}, '') AS place, (c_custkey % 90000)::VARCHAR || '/' || (c_custkey % 7) AS number FROM customer")
def place_names(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    names = F.array(_pick([n.split("|")[0] for n in _NAMES], F.col("k")))
    values = F.array(F.lit("12a"), F.concat(F.lit(" "), (F.col("k") % 90_000).cast("string"), F.lit("/"), (F.col("k") % 7).cast("string"), F.lit(" ")), F.lit("123456789"))
    return c.select("k", F.get(extract.clean_places(names), 0).alias("place"), F.array_join(extract.clean_numbers(values), ",").alias("number"))


@query(f"""SELECT o_orderkey AS k, {_sql([*_KINDS, 'vozila', 'nekretnine', 'ostalo'], 'o_orderkey')} AS declared, {_sql(['nekretnine', 'vozila', 'tehnika', 'namjestaj', 'ostalo'], 'o_orderkey')} AS inferred FROM orders""")
def sale_types(spark, sf):
    k = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    code, label = _pick(["NEK", "VOZ", "TEH", "NAM", "OST", "", "", ""], F.col("k")), _pick(["", "", "", "", "", "Motorna vozila", "Nepokretnosti", "razno"], F.col("k"))
    said = _pick(["prodaja parcele i zemljišta", "putničko vozilo marke Golf", "kompresor i agregat", "orman i krevet", "razne stvari"], F.col("k"))
    return k.select("k", extract.sale_type(F.nullif(code, F.lit("")), label).alias("declared"), extract.infer_sale_type(said).alias("inferred"))


@query(f"SELECT o_orderkey AS k, {_sql(_GOODS, 'o_orderkey')} AS description, {_sql(_GOOD_TAGS, 'o_orderkey')} AS tags FROM orders")
def notice_description(spark, sf):
    n = _notices(spark, sf).withColumn("d", describe.item_description(F.col("text"), F.col("title")))
    return n.select("k", F.col("d").alias("description"), F.array_join(F.array_sort(extract.item_tags(F.col("title"), F.col("d"))), ",").alias("tags"))


_SHAPES = [
    ("Prodaju se popisane stvari i to:\n1) Plug trobrazdni crvene boje\n2) Drljača teška\n\nRočište je zakazano", "Plug trobrazdni crvene boje; Drljača teška"),
    ("- Ugaona garnitura sa foteljom\n- Televizor marke Samsung\nNapomena", "Ugaona garnitura sa foteljom; Televizor marke Samsung"),
    ("Konstatuje se da je vrijednost nekretnine utvrđena", ""),
    ("", ""),
]


@query(f"SELECT c_custkey AS k, nullif({_sql([s[1] for s in _SHAPES], 'c_custkey')}, '') AS description, c_custkey % 4 < 2 AS usable FROM customer")
def description_shapes(spark, sf):
    c = _spread(_t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k").select("k", _pick([s[0] for s in _SHAPES], F.col("k")).alias("t"))
    c = c.withColumn("d", describe.item_description(F.col("t"), F.lit("Zaključak")))
    return c.select("k", F.col("d").alias("description"), F.coalesce(describe.usable(F.col("d")), F.lit(False)).alias("usable"))


@query("""SELECT o_orderkey AS k, strftime(o_orderdate::DATE, '%Y-%m-%d') AS sale, '65 0 Ip ' || (1000000 + o_orderkey) || ' ' || lpad((o_orderkey % 30)::VARCHAR, 2, '0') || ' Ip' AS case_number, floor(o_totalprice) + 0.25 AS appraised FROM orders""")
def notice_reading(spark, sf):
    n, r = extract.with_reading(_notices(spark, sf), F.col("text"), F.col("title"))
    return n.select("k", dates.sale_date_in(F.col("text"), F.lit("1990-01-01").cast("date")).cast("string").alias("sale"), r["case_number"].alias("case_number"), r["money"]["appraised"].cast("double").alias("appraised"))


# --- two readings -----------------------------------------------------------------------------------

_LLM = "struct<headline:string,itemDescription:string,itemTags:array<string>,caseNumber:string,appraisedValue:double,startingPrice:double,deposit:double,saleTime:string,auctionRound:string,saleMethod:string,auctionLocation:string,municipality:string,cadastral:struct<kc:array<string>,zkUlozak:array<string>,ko:array<string>>>"


def _readings(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, Column]]:
    """Notices with a model's reading of every second one: an appraisal off by a twentieth for each third, a time that is none for each fifth."""
    n, rules = extract.with_reading(_notices(spark, sf), F.col("text"), F.col("title"))
    k, p = F.col("k"), F.col("p") + 0.25
    fields = {"headline": F.concat(F.lit("Naslov "), k.cast("string")), "appraisedValue": F.when(k % 3 == 0, p * 1.05).otherwise(p), "saleTime": F.when(k % 5 == 0, "devet").otherwise("11:11"), "auctionRound": F.lit("nepoznato"), "saleMethod": F.lit("neposredna-pogodba"), "caseNumber": F.lit("none")}
    llm = F.from_json(F.to_json(F.struct(*(c.alias(f) for f, c in fields.items()))), _LLM)
    return n.withColumn("llm", F.when(k % 2 == 0, llm)), rules


@query(f"""WITH n AS (SELECT o_orderkey AS k, floor(o_totalprice) + 0.25 AS a, {_sql(['prvo', 'drugo', 'trece', 'nepoznato'], 'o_orderkey')} AS r, {_sql(['usmeno-javno-nadmetanje', 'prikupljanje-ponuda', 'neposredna-pogodba', 'nepoznato'], 'o_orderkey // 4')} AS m FROM orders)
SELECT k, CASE WHEN k % 2 = 0 THEN 'Naslov ' || k END AS headline, floor(CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN a * 1.05 ELSE a END * 100 + 0.5) / 100 AS appraised,
CASE WHEN k % 2 = 0 AND k % 5 > 0 THEN '11:11' ELSE lpad((8 + k % 9)::VARCHAR, 2, '0') || ':' || CASE WHEN k % 5 = 0 THEN '00' ELSE lpad((k * 5 % 60)::VARCHAR, 2, '0') END END AS time, r AS round, CASE WHEN k % 2 = 0 THEN 'neposredna-pogodba' ELSE m END AS method FROM n""")
def merged_readings(spark, sf):
    n, rules = _readings(spark, sf)
    m = merge.merged_fields(F.col("llm"), rules, F.lit(None).cast("string"), F.array().cast("array<string>"), F.col("title"), F.col("text"))
    return n.select("k", m["headline"].alias("headline"), m["money"]["appraised"].cast("double").alias("appraised"), m["sale_time"].alias("time"), m["auction_round"].alias("round"), m["sale_method"].alias("method"))


@query("""WITH n AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0) SELECT k, 'appraisedValue' AS field, 1.05::DOUBLE AS ratio FROM n WHERE k % 3 = 0 UNION ALL SELECT k, 'caseNumber', NULL FROM n UNION ALL SELECT k, 'saleTime', NULL FROM n""")
def reading_disagreements(spark, sf):
    n, rules = _readings(spark, sf)
    d = n.where("llm is not null").select("k", F.explode(merge.disagreements(F.col("llm"), rules)).alias("d"))
    return d.select("k", F.col("d.field").alias("field"), F.col("d.ratio").cast("double").alias("ratio"))


@query("""WITH n AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), d AS (SELECT k, 'appraisedValue' AS field, 1.05::DOUBLE AS ratio FROM n WHERE k % 3 = 0 UNION ALL SELECT k, 'caseNumber', NULL FROM n UNION ALL SELECT k, 'saleTime', NULL FROM n)
SELECT field, n::BIGINT AS n, rank::INTEGER AS rank, k AS id, ratio, (SELECT count(*) FROM orders)::INTEGER AS listings, (SELECT count(*) FROM n)::INTEGER AS comparable
FROM (SELECT *, count(*) OVER (PARTITION BY field) AS n, row_number() OVER (PARTITION BY field ORDER BY coalesce(ratio, 0) DESC, k) AS rank FROM d) WHERE rank <= 20""")
def quality_report(spark, sf):
    found = reading_disagreements(spark, sf).withColumnRenamed("k", "id")
    orders = _t(spark, sf, "orders")
    return reports.quality_report(found, orders.count(), orders.where("o_orderkey % 2 = 0").count())


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Kuća u cvijeću' WHEN 1 THEN 'Stan 62 m² - Batković' WHEN 2 THEN 'Plug, Drljača, Kosilica i još 1' ELSE 'Vozilo - Tuzla' END AS headline FROM orders""")
def headlines(spark, sf):
    k = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    own = F.when(F.col("k") % 4 == 0, F.lit("  Kuća u cvijeću "))
    kind = _pick(["nekretnine", "nekretnine", "tehnika", "vozila"], F.col("k"))
    said = F.get(F.array(F.lit("x"), F.lit("stan površine 62 m2"), F.lit("plug 100,00 KM; drljača; kosilica, vrijednost 5,00 KM; prskalica"), F.lit(None).cast("string")), (F.col("k") % 4).cast("int"))
    ko, town = F.when(F.col("k") % 4 == 1, F.array(F.lit("BATKOVIĆ"))).otherwise(F.array().cast("array<string>")), F.when(F.col("k") % 4 == 3, "Tuzla")
    return k.select("k", merge.headline(own, kind, said, F.lit("x"), ko, town).alias("headline"))


# --- privacy -----------------------------------------------------------------------------------------

_M = redact.MARK


@query(f"""SELECT o_orderkey AS k, 'Prodaja nekretnina izvršenika {_M}, Sarajevo' AS party, 'dužnik Komunalac ' || o_orderkey || ' d.o.o. Tuzla' AS company, 'JMBG {_M} i mail {_M} tel {_M}' AS contacts, 'stan u {_M}, Tuzla' AS street,
CASE WHEN o_orderkey % 2 = 0 THEN 'soba ' || (o_orderkey % 90) || ', ul. Suda br. 1' END AS venue, false AS leaks FROM orders""")
def redacted_notices(spark, sf):
    k = _spread(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k").withColumn("s", F.col("k").cast("string"))
    who = _pick(["Marka Markovića", "Ane Anić", "Đorđa Šušića"], F.col("k"))
    party = F.concat(F.lit("Prodaja nekretnina izvršenika "), who, F.lit(", Sarajevo"))
    contacts = F.concat(F.lit("JMBG "), F.lpad("s", 13, "1"), F.lit(" i mail osoba"), F.col("s"), F.lit("@primjer.ba tel 061 123 456"))
    street = F.concat(F.lit("stan u ul. Kneza Miloša br. "), (F.col("k") % 200 + 1).cast("string"), F.lit(", Tuzla"))
    venue = F.when(F.col("k") % 2 == 0, F.concat(F.lit("soba "), (F.col("k") % 90).cast("string"), F.lit(", ul. Suda br. 1"))).otherwise("ul. Nekoga br. 4")
    rows = k.select("k", redact.redact_text(party).alias("party"), redact.redact_title(F.concat(F.lit("dužnik Komunalac "), "s", F.lit(" d.o.o. Tuzla"))).alias("company"), redact.redact_text(contacts).alias("contacts"), redact.redact_text(street).alias("street"), redact.redact_venue(venue).alias("venue"))
    return rows.withColumn("leaks", redact.leaks(F.concat_ws(" ", "party", "contacts", "street")))


@query("""SELECT gate, value, passed FROM (SELECT 'leaks' AS gate, sum((o_orderkey % 11 = 0)::INT)::DOUBLE AS value, sum((o_orderkey % 11 = 0)::INT) = 0 AS passed FROM orders UNION ALL SELECT 'persons', sum((o_orderkey % 13 = 0)::INT), sum((o_orderkey % 13 = 0)::INT) = 0 FROM orders
UNION ALL SELECT 'venues', sum((o_orderkey % 17 = 0)::INT), sum((o_orderkey % 17 = 0)::INT) = 0 FROM orders UNION ALL SELECT 'absurd', sum((o_orderkey % 19 = 0)::INT), sum((o_orderkey % 19 = 0)::INT) = 0 FROM orders UNION ALL SELECT 'inverted', sum((o_orderkey % 23 = 0 AND o_orderkey % 19 > 0)::INT), sum((o_orderkey % 23 = 0 AND o_orderkey % 19 > 0)::INT) = 0 FROM orders
UNION ALL SELECT 'repeated_ids', count(*) - count(DISTINCT o_orderkey // 2), count(*) = count(DISTINCT o_orderkey // 2) FROM orders UNION ALL SELECT 'undated', sum((o_orderkey % 29 = 0)::INT), sum((o_orderkey % 29 = 0)::INT) = 0 FROM orders
UNION ALL SELECT 'misdated', sum((o_orderkey % 31 = 0 AND o_orderkey % 29 > 0)::INT), sum((o_orderkey % 31 = 0 AND o_orderkey % 29 > 0)::INT) = 0 FROM orders UNION ALL SELECT 'case_rate', avg((o_orderkey % 3 > 0)::INT), avg((o_orderkey % 3 > 0)::INT) >= 0.7 FROM orders
UNION ALL SELECT 'price_rate', avg((o_orderkey % 7 > 0 OR o_orderkey % 19 = 0 OR o_orderkey % 23 = 0)::INT), avg((o_orderkey % 7 > 0 OR o_orderkey % 19 = 0 OR o_orderkey % 23 = 0)::INT) >= 0.6 FROM orders UNION ALL SELECT 'rows', count(*), count(*) >= 500 FROM orders UNION ALL SELECT 'courts', count(DISTINCT o_custkey % 12), count(DISTINCT o_custkey % 12) >= 15 FROM orders)""")
def gates_that_fail(spark, sf):
    from noticeworks.operators import gates as G

    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = _t(spark, sf, "orders").withColumn("half", F.floor(k / 2))
    sale = F.when(k % 29 == 0, None).when(k % 31 == 0, F.date_add(day, 5000)).otherwise(day)
    appraised, starting = F.when(k % 19 == 0, 2e8).otherwise(F.when(k % 7 > 0, 1000.0)), F.when(k % 19 == 0, 1.0).when(k % 23 == 0, 1100.0).otherwise(F.lit(None).cast("double"))
    appraised = F.when(k % 23 == 0, F.coalesce(appraised, F.lit(1000.0))).otherwise(appraised)
    leak, person = F.when(k % 11 == 0, "pišite na a@b.ba").otherwise("uredno"), F.when(k % 13 == 0, "izvršenika Marka Markovića, Tuzla").otherwise("uredno")
    return G.gates(o, "half", F.col("o_custkey") % 12, sale, day, F.when(k % 3 > 0, k), appraised, starting, [leak, person], F.when(k % 17 == 0, "ul. Nekoga br. 4").otherwise("sudnica 4"))


# --- listings ----------------------------------------------------------------------------------------

_L = f"""WITH l AS (SELECT o_orderkey AS k, '65-' || o_orderkey AS id, (o_custkey % 25)::INTEGER AS court_id, 'Sud ' || (o_custkey % 25) AS court, {_sql(['FBiH', 'RS', 'BD'], 'o_custkey % 25')} AS entity, 'C' || o_custkey AS case_number, {_sql(_KINDS, 'o_orderkey')} AS sale_type,
o_orderpriority || ' ' || o_orderstatus AS title, 'Predmet ' || o_orderkey AS headline, CASE WHEN o_orderkey % 7 > 0 THEN floor(o_totalprice) END AS starting, CASE WHEN o_orderkey % 5 > 0 THEN floor(o_totalprice) + 500.0 END AS appraised, CASE WHEN o_orderkey % 3 = 0 THEN 100.5 END AS deposit,
o_orderdate::DATE AS sale_date, o_orderdate::DATE - (o_orderkey % 40)::INTEGER AS published_date, {_sql(['prvo', 'drugo', 'trece', 'nepoznato'], 'o_orderkey')} AS auction_round, CASE WHEN {_sql(_TAGS, 'o_orderkey')} = {_sql(_TAGS, 'o_orderkey // 7')} THEN [{_sql(_TAGS, 'o_orderkey')}] ELSE [{_sql(_TAGS, 'o_orderkey')}, {_sql(_TAGS, 'o_orderkey // 7')}] END AS item_tags,
CASE WHEN o_orderkey % 2 = 0 THEN '10:30' END AS sale_time, CASE WHEN o_orderkey % 4 = 0 THEN 'ponedjeljkom' END AS viewing_info, {_sql(['reused', 'built', 'retained'], 'o_orderkey')} AS origin, (o_orderkey % 101) / 100.0 AS confidence, {_sql(['pdf', 'docx', 'inline'], 'o_orderkey')} AS source FROM orders)
"""


def _listings(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    orders = _t(spark, sf, "orders")
    orders = _spread(orders, "o_orderkey") if spread else orders
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    court = (F.col("o_custkey") % 25).cast("int")
    whole = F.floor("o_totalprice").cast("double")
    return orders.select(
        k.alias("k"), F.concat(F.lit("65-"), k.cast("string")).alias("id"), court.alias("court_id"), F.concat(F.lit("Sud "), court.cast("string")).alias("court"), _pick(["FBiH", "RS", "BD"], court).alias("entity"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("case_number"),
        _pick(_KINDS, k).alias("sale_type"), F.concat("o_orderpriority", F.lit(" "), "o_orderstatus").alias("title"), F.concat(F.lit("Predmet "), k.cast("string")).alias("headline"), F.when(k % 7 > 0, whole).alias("starting"), F.when(k % 5 > 0, whole + 500).alias("appraised"), F.when(k % 3 == 0, 100.5).alias("deposit"),
        day.alias("sale_date"), F.date_sub(day, (k % 40).cast("int")).alias("published_date"), _pick(["prvo", "drugo", "trece", "nepoznato"], k).alias("auction_round"), F.array_distinct(F.array(_pick(_TAGS, k), _pick(_TAGS, F.floor(k / 7)))).alias("item_tags"), F.when(k % 2 == 0, "10:30").alias("sale_time"),
        F.when(k % 4 == 0, "ponedjeljkom").alias("viewing_info"), _pick(["reused", "built", "retained"], k).alias("origin"), ((k % 101) / 100.0).alias("confidence"), _pick(["pdf", "docx", "inline"], k).alias("source"), F.lit(None).cast("string").alias("item_description"), F.lit(None).cast("string").alias("auction_location"),
        F.lit("nepoznato").alias("sale_method"),
    )


def _as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def _ranked(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        rows = df.select(F.lit(name).alias("list"), "pos", "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def _top(name: str, where: str, order: str, n: int) -> str:
    return f"SELECT '{name}' AS list, pos::INTEGER AS pos, id FROM (SELECT id, row_number() OVER (ORDER BY {order}) AS pos FROM l WHERE {where}) WHERE pos <= {n}"


@query(_L + " UNION ALL ".join([
    _top("upcoming", f"sale_date >= '{AS_OF}'", "sale_date, id", 60), _top("past", f"sale_date < '{AS_OF}'", "sale_date DESC, id", 60), _top("newest", "true", "published_date DESC, id", 100), _top("price", f"sale_date >= '{AS_OF}'", "coalesce(starting, appraised, 0) DESC, id", 40),
    _top("discount", f"sale_date >= '{AS_OF}'", "coalesce(CASE WHEN starting IS NOT NULL AND appraised > 0 THEN 1 - starting / appraised END, -1) DESC, id", 40), _top("archive", "true", "sale_date DESC, list_position(['reused', 'built', 'retained'], origin), id", 100),
    _top("saved", "k % 31 = 0", f"(sale_date < '{AS_OF}')::INT, CASE WHEN sale_date >= '{AS_OF}' THEN sale_date END, sale_date DESC, id", 500),
]))
def ordered_lists(spark, sf):
    l, today = _listings(spark, sf), _as_of()
    up = views.upcoming(l, today)
    return _ranked({
        "upcoming": views.first(up, views.soonest(), 60), "past": views.first(views.past(l, today), views.latest(), 60), "newest": views.first(l, views.newest(), 100), "price": views.first(up, views.home_order("price"), 40), "discount": views.first(up, views.home_order("discount"), 40),
        "archive": views.first(l, views.archive_order(l), 100), "saved": views.first(l.where("k % 31 = 0"), views.saved_order(today), 500),
    })


@query(_L + f"""SELECT id FROM l WHERE contains(lower(headline || ' ' || title || ' ' || court), '1-urg') AND sale_type = 'vozila' AND sale_date BETWEEN '1995-01-01' AND '1996-12-31'""")
def home_filter(spark, sf):
    return views.home_filter(_listings(spark, sf), [F.col("headline"), F.col("title"), F.col("court")], " 1-URG ", "vozila", ("1995-01-01", "1996-12-31")).select("id")


@query(_L + f"""SELECT *, row_number() OVER (ORDER BY open DESC, total DESC, court_id)::INTEGER AS pos FROM (SELECT court_id, any_value(court) AS court, any_value(entity) AS entity, sum((sale_date >= '{AS_OF}')::INT)::BIGINT AS open, count(*)::BIGINT AS total FROM l WHERE entity = 'RS' GROUP BY 1 HAVING sum((sale_date >= '{AS_OF}')::INT) > 0)""")
def court_list(spark, sf):
    return views.first(views.court_list(_listings(spark, sf), _as_of(), "RS", True), [F.desc("open"), F.desc("total"), F.col("court_id")], 200)


_DROPS = f""", c AS (SELECT *, lag(starting) OVER (PARTITION BY case_number ORDER BY sale_date, k) AS prev FROM l), f AS (SELECT *, CASE WHEN prev > 0 AND 1 - starting / prev > 0.01 AND 1 - starting / prev < 0.95 THEN 1 - starting / prev END AS from_previous FROM c),
d AS (SELECT *, coalesce(from_previous, CASE WHEN starting IS NOT NULL AND appraised > 0 THEN 1 - starting / appraised END) AS drop FROM f), o AS (SELECT * FROM d WHERE drop > 0 AND sale_date >= '{AS_OF}')
"""


def _drops(spark: SparkSession, sf: str) -> DataFrame:
    return A.price_drops(A.chains(_listings(spark, sf), "case_number", "sale_date", "k", "starting"), "starting", "sale_date", _as_of(), F.col("appraised"))


@query(_L + _DROPS + "SELECT id, round(drop, 6) AS drop FROM o WHERE from_previous IS NOT NULL")
def firm_drops(spark, sf):
    return views.firm(_drops(spark, sf)).select("id", _n(F.col("drop"), 6).alias("drop"))


@query(_L + _DROPS + "SELECT id, round(drop, 6) AS drop, from_previous IS NULL AS off_appraisal FROM o")
def scored_drops(spark, sf):
    return _drops(spark, sf).select("id", _n(F.col("drop"), 6).alias("drop"), F.col("from_previous").isNull().alias("off_appraisal"))


@query(_L + _DROPS + "SELECT count(*)::BIGINT AS open, count(from_previous)::BIGINT AS firm, round(max(drop), 6) AS steepest FROM o")
def drop_tiles(spark, sf):
    return views.drop_tiles(_drops(spark, sf)).select("open", "firm", _n(F.col("steepest"), 6).alias("steepest"))


@query(_L + f"""SELECT sum((sale_date >= '{AS_OF}')::INT)::BIGINT AS upcoming, count(*)::BIGINT AS total, min(year(published_date))::INTEGER AS since, count(DISTINCT court_id)::BIGINT AS courts, count(DISTINCT CASE WHEN sale_date >= '{AS_OF}' THEN court_id END)::BIGINT AS active, round(avg((viewing_info IS NOT NULL)::INT), 6) AS viewing_share FROM l""")
def home_tiles(spark, sf):
    return views.home_tiles(_listings(spark, sf), _as_of()).withColumn("viewing_share", F.round("viewing_share", 6))


@query(_L + """, v AS (SELECT court_id AS g, CASE WHEN coalesce(starting, appraised) > 0 THEN coalesce(starting, appraised) / (k % 90 + 1) END AS v FROM l WHERE k % 13 > 3), b AS (SELECT g, count(v) AS n FROM v WHERE v IS NOT NULL GROUP BY 1)
SELECT sum(n)::BIGINT AS measurable, sum(CASE WHEN n >= 40 THEN n ELSE 0 END)::BIGINT AS in_table, sum((n >= 40)::INT)::BIGINT AS groups FROM b""")
def price_tiles(spark, sf):
    area = F.when(F.col("k") % 13 > 3, (F.col("k") % 90 + 1).cast("double"))
    return views.price_tiles(_listings(spark, sf), F.col("court_id"), numbers.price_per_area(F.col("starting"), F.col("appraised"), area), 40)


@query(_L + f""", t AS (SELECT court_id, sale_type, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT court_id, string_agg(sale_type || ':' || n, ',' ORDER BY n DESC, sale_type) AS kinds FROM t GROUP BY 1)
SELECT court_id, any_value(entity) AS entity, sum((sale_date >= '{AS_OF}')::INT)::BIGINT AS open, count(*)::BIGINT AS total, min(published_date) AS oldest, round(median(date_diff('day', published_date, sale_date)), 4) AS lead, any_value(kinds) AS kinds, floor(100.0 * count(*) / (SELECT count(*) FROM l) + 0.5)::INTEGER AS share
FROM l JOIN s USING (court_id) GROUP BY 1""")
def court_bundle(spark, sf):
    return views.court_bundle(_listings(spark, sf), _as_of()).withColumn("lead", _n(F.col("lead")))


@query(_L + f"SELECT list_position({_TAGS!r}, tag)::INTEGER AS ord, tag, count(*)::BIGINT AS n, sum((sale_date >= '{AS_OF}')::INT)::BIGINT AS upcoming FROM (SELECT unnest(item_tags) AS tag, sale_date FROM l) GROUP BY tag")
def tag_counts(spark, sf):
    return views.tag_counts(_listings(spark, sf), _as_of(), _TAGS)


@query(_L + "SELECT id FROM l WHERE list_contains(item_tags, 'traktor')")
def rows_of_tag(spark, sf):
    return views.by_tag(_listings(spark, sf), "traktor").select("id")


@query(_L + ", y AS (SELECT DISTINCT year(sale_date) AS y FROM l), n AS (SELECT y FROM y ORDER BY y DESC LIMIT 6) SELECT CASE WHEN year(sale_date) IN (SELECT y FROM n) THEN year(sale_date)::VARCHAR ELSE 'older' END AS bucket, count(*)::BIGINT AS n FROM l GROUP BY 1")
def year_buckets(spark, sf):
    l = _listings(spark, sf)
    return l.groupBy(views.year_bucket(F.col("sale_date"), views.newest_years(l)).alias("bucket")).agg(F.count("*").alias("n"))


@query(_L + "SELECT count(DISTINCT year(sale_date))::BIGINT AS years, min(year(sale_date))::INTEGER AS first, max(year(sale_date))::INTEGER AS last FROM l")
def temporal_coverage(spark, sf):
    return views.temporal_coverage(_listings(spark, sf))


@query(_L + "SELECT id, fact, value FROM (SELECT id, unnest(['cijena', 'jemstvo', 'vrijeme']) AS fact, unnest([CASE WHEN starting IS NOT NULL THEN starting::BIGINT::VARCHAR ELSE '-' END, CASE WHEN deposit IS NOT NULL THEN '100.5' END, coalesce(sale_time, '-')]) AS value FROM l) WHERE value IS NOT NULL")
def fact_sheet(spark, sf):
    facts = [("cijena", F.col("starting").cast("long"), True), ("jemstvo", F.col("deposit"), False), ("vrijeme", F.col("sale_time"), True)]
    return views.fact_rows(_listings(spark, sf), "id", facts)


@query(_L + "SELECT id, unnest(CASE WHEN sale_type = 'nekretnine' THEN ['iseljenje', 'racuni', 'legalizacija', 'stanje'] ELSE ['stanje'] END) AS risk FROM l")
def unpriced_risks(spark, sf):
    return views.unpriced_risks(_listings(spark, sf))


@query(_L + """SELECT id, array_to_string(list_filter([sale_type, CASE auction_round WHEN 'prvo' THEN '1. ročište' WHEN 'drugo' THEN '2. ročište' WHEN 'trece' THEN '3. ročište' END, CASE WHEN k % 2 = 0 THEN '1.234 KM/m²' END, CASE WHEN deposit IS NOT NULL THEN 'kapara 100,50 KM' END, 'usmeno'], lambda x: x IS NOT NULL)[1:4], ' · ') AS line FROM l""")
def meta_lines(spark, sf):
    area = F.when(F.col("k") % 2 == 0, 1234.4)
    return _listings(spark, sf).select("id", views.meta_line(F.col("sale_type"), F.col("auction_round"), area, F.col("deposit"), F.lit("Usmeno")).alias("line"))


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Čapljina' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'Trn' END AS shown FROM customer")
def settlements_shown(spark, sf):
    k = F.col("c_custkey")
    return _t(spark, sf, "customer").select(k.alias("k"), views.settlement_shown(_pick(["Čapljina", "CAPLJINA", "Tuzla", "Trn"], k), F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "Čapljina").when(k % 4 == 2, "tuzla").otherwise("Banja Luka")).alias("shown"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice * 0.17 * 100 + 0.5) / 100 ELSE floor(o_totalprice * 0.05 * 100 + 0.5) / 100 END AS tax, CASE WHEN o_orderkey % 2 = 0 AND o_totalprice * 1.1 > o_totalprice THEN floor(o_totalprice * 1.1 * 100 + 0.5) / 100 END AS base FROM orders")
def vat_or_tax(spark, sf):
    k, bid = F.col("o_orderkey"), F.col("o_totalprice")
    c = views.vat_costs(bid, bid * 0.1, F.lit(0.05), F.lit(0.0), k % 3 == 0)
    base = views.alternative_base(F.when(k % 2 == 0, "trzisna").otherwise("cijena"), bid * 1.1, bid)
    return _t(spark, sf, "orders").select(k.alias("k"), numbers.js_round(c["tax"]).alias("tax"), numbers.js_round(base).alias("base"))


# --- reports and endpoints -----------------------------------------------------------------------------


@query(_L + f"""SELECT what, value FROM (SELECT unnest(['listings', 'upcoming', 'reused', 'retained', 'courts', 'with_case', 'with_price', 'confidence']) AS what, unnest([count(*)::DOUBLE, sum((sale_date >= '{AS_OF}')::INT), sum((origin = 'reused')::INT), sum((origin = 'retained')::INT), count(DISTINCT court_id), count(case_number), count(coalesce(appraised, starting)), round(avg(confidence), 2)]) AS value FROM l)
UNION ALL SELECT 'source ' || source, count(*)::DOUBLE FROM l GROUP BY source""")
def run_report(spark, sf):
    return reports.run_report(_listings(spark, sf), _as_of())


@query(_L + f"SELECT '{AS_OF}' AS \"generatedAt\", count(*)::BIGINT AS count, 'orders' AS source FROM l")
def dump_envelope(spark, sf):
    return reports.envelope(_listings(spark, sf), AS_OF, "orders")


@query(_L + """SELECT id, '{"h":"' || headline || '","m":null,"c":"' || court || '","e":"' || entity || '","d":"' || strftime(sale_date, '%Y-%m-%d') || '","t":"' || sale_type || '","p":' || coalesce('"' || coalesce(starting, appraised)::BIGINT || '"', 'null') || ',"o":null}' AS card FROM l""")
def saved_cards(spark, sf):
    l = _listings(spark, sf).withColumns({"meta": F.lit(None).cast("string"), "day": F.col("sale_date").cast("string"), "price": F.coalesce("starting", "appraised").cast("long").cast("string"), "off": F.lit(None).cast("string")})
    return reports.card(l)


@query(_L + """, t AS (SELECT unnest(item_tags) AS tag, * FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY published_date DESC, id) - 1 AS i FROM t)
SELECT tag, i::INTEGER AS i, '<item><title>' || headline || '</title><guid>' || id || '</guid><pubDate>' || strftime(published_date::TIMESTAMP + INTERVAL (least(i, 59)) MINUTE, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>' AS line FROM r WHERE i < 100""")
def feeds_by_tag(spark, sf):
    l = _listings(spark, sf).select(F.explode("item_tags").alias("tag"), F.col("headline").alias("title"), F.col("id").alias("guid"), F.col("published_date").alias("published"))
    return reports.feeds_by_key(l, "tag", [F.desc("published"), F.col("guid")])


@query(_L + """SELECT 'oglas-' || id AS uid, headline || ' - ' || court AS summary, court AS location, concat_ws(chr(10), 'Početna cijena: ' || replace(format('{:,}', starting::BIGINT), ',', ',') || '.00 KM', 'Procijenjena vrijednost: ' || format('{:,}', appraised::BIGINT) || '.00 KM', CASE WHEN deposit IS NULL THEN 'Kapara: nije navedena' ELSE 'Kapara: 100.50 KM' END,
'Predmet: ' || case_number, 'Sud: ' || court || ' (' || entity || ')', CASE WHEN sale_time IS NULL THEN 'Vrijeme nije navedeno; upisano je 09:00.' END, 'https://site/oglas/predmet-' || k || '-' || id || '/') AS description FROM l""")
def calendar_events(spark, sf):
    return reports.event_of(_listings(spark, sf), "https://site").select("uid", "summary", "location", "description")


@query(_L + """, c AS (SELECT id, sale_date, unnest(list_concat(['kalendar', 'sudovi/' || court_id, 'oglas/' || id], list_transform(item_tags, lambda t: 'predmeti/' || t))) AS calendar FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY calendar ORDER BY sale_date, 'oglas-' || id) AS r FROM c)
SELECT calendar, count(*)::BIGINT AS n, min('oglas-' || id) AS first_uid, true AS folded FROM r WHERE r <= 500 GROUP BY 1""")
def calendars(spark, sf):
    events = sinks.events(reports.event_of(_listings(spark, sf, True), "https://site"))
    rows = reports.calendars(events)
    uid = F.regexp_extract("block", r"UID:(\S+)", 1)
    folded = F.forall(F.split("block", "\r\n"), lambda x: F.octet_length(x) <= 75)
    return rows.groupBy("calendar").agg(F.count("*").alias("n"), F.min(uid).alias("first_uid"), F.bool_and(folded).alias("folded"))


@query(_L + f"""SELECT 'Dataset as of {AS_OF}: ' || count(*) || ' notices from ' || count(DISTINCT court_id) || ' courts, sale dates ' || min(year(sale_date)) || '–' || max(year(sale_date)) || ', ' || sum((sale_date >= '{AS_OF}')::INT) || ' still upcoming.' AS line FROM l""")
def about_line(spark, sf):
    return reports.about(_listings(spark, sf), _as_of(), AS_OF)


@query(_L + """SELECT id, '{"@context":"https://schema.org","@type":"SaleEvent","name":"' || headline || ' - ' || court || '","url":"https://site/oglas/predmet-' || k || '-' || id || '/","startDate":"' || strftime(sale_date, '%Y-%m-%d') || 'T08:00:00Z","location":{"@type":"Place","name":"' || court || '"},"keywords":"' || array_to_string(item_tags, ', ') || '"'
|| CASE WHEN starting IS NOT NULL THEN ',"offers":{"@type":"Offer","price":' || starting::BIGINT || ',"priceCurrency":"BAM","validThrough":"' || strftime(sale_date, '%Y-%m-%d') || 'T08:00:00Z"}' ELSE '' END || '}' AS json_ld FROM l""")
def listing_json_ld(spark, sf):
    return reports.listing_json_ld(_listings(spark, sf), "https://site", F.to_timestamp("sale_date") + F.expr("interval 8 hours"))


@query(_L + f"""SELECT '{{"@type":"Dataset","@id":"https://site/#dataset","description":"' || count(*) || ' notices from ' || count(DISTINCT court_id) || ' courts","temporalCoverage":"' || min(year(sale_date)) || '/' || max(year(sale_date)) || '","dateModified":"{AS_OF}"}}' AS json_ld FROM l""")
def site_json_ld(spark, sf):
    return reports.site_json_ld(_listings(spark, sf), "https://site", AS_OF)


@query(_L + f"""SELECT id, headline || chr(10) || title AS body, court AS filter_sud, sale_type AS filter_vrsta, entity AS filter_entitet, year(sale_date)::VARCHAR AS filter_godina, CASE WHEN sale_date < '{AS_OF}' THEN 'Arhiva' ELSE 'Otvoreno' END AS filter_status, strftime(sale_date, '%Y-%m-%d') AS sort_datum, lpad(coalesce(starting, appraised, 0)::BIGINT::VARCHAR, 12, '0') AS sort_cijena,
CASE WHEN sale_date < '{AS_OF}' THEN 'Arhiva' ELSE 'Otvoreno' END AS meta_status, strftime(sale_date, '%d.%m.%Y.') AS meta_datum, court AS meta_sud, auction_round AS meta_rociste, coalesce(coalesce(starting, appraised)::BIGINT::VARCHAR, '-') AS meta_cijena, sale_type AS meta_vrsta FROM l""")
def search_index(spark, sf):
    return reports.search_rows(_listings(spark, sf), _as_of())


@query(_L + """SELECT id, sha256('{"h":"' || headline || '","c":"' || court || '"}')[1:24] AS key FROM l""")
def card_keys(spark, sf):
    return _listings(spark, sf).select("id", sinks.card_key(F.col("headline").alias("h"), F.col("court").alias("c")).alias("key"))


@query(_L + """SELECT id, '/oglas/' || CASE WHEN k % 2 = 0 THEN id ELSE 'predmet-' || k || '-' || id END || '/' AS href, '/oglas/' || CASE WHEN k % 2 = 0 THEN id ELSE 'predmet-' || k || '-' || id END || '.ics' AS ics, id AS back FROM l""")
def listing_links(spark, sf):
    title = F.when(F.col("k") % 2 == 0, "!!").otherwise(F.col("headline"))
    return _listings(spark, sf).select("id", reports.href(F.col("id"), title).alias("href"), reports.ics_href(F.col("id"), title).alias("ics"), text.id_from_slug(F.regexp_replace(reports.href(F.col("id"), title), r"^/oglas/|/\z", "")).alias("back"))


@query(_L + "SELECT id, CASE WHEN k % 50 = 0 THEN 'sale_date,sale_time' ELSE 'money' END AS broken FROM l WHERE k % 50 = 0 OR k % 77 = 0")
def schema_breaches(spark, sf):
    k = F.col("k")
    l = _listings(spark, sf).withColumns({"sale_date": F.when(k % 50 > 0, F.col("sale_date")), "sale_time": F.when(k % 50 == 0, "9 sati").otherwise(F.col("sale_time")), "starting": F.when((k % 77 == 0) & (k % 50 > 0), -1.0).when(k % 50 == 0, 1.0).otherwise(F.when(F.col("starting") > 0, F.col("starting")))})
    return reports.schema_breaches(l).select("id", F.array_join("broken", ",").alias("broken"))


@query(_L + """SELECT "check", missing::BIGINT AS missing FROM (SELECT 'pages' AS "check", sum((k % 10 = 0)::INT) AS missing FROM l UNION ALL SELECT 'calendars', 0 UNION ALL SELECT 'sitemap', sum((k % 33 = 0)::INT) FROM l UNION ALL SELECT 'feeds', 25 UNION ALL SELECT 'balanced events', 0 UNION ALL SELECT 'lines of 75 octets', 0)""")
def build_completeness(spark, sf):
    l = _listings(spark, sf)
    events = sinks.events(reports.event_of(_listings(spark, sf, True), "https://site")).select("id", "block")
    feeds = l.select(F.explode(F.transform("item_tags", lambda t: F.concat(F.lit("predmeti/"), t))).alias("key"))
    return reports.completeness(l, l.where("k % 10 > 0"), events, l.where("k % 33 > 0"), feeds)


# --- sources -------------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT n_nationkey + 1 AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'Općinski sud u ' || n_name WHEN n_nationkey % 3 = 1 THEN 'Tužilaštvo ' || n_name ELSE 'Osnovni sud u ' || n_name END AS name FROM nation), c AS (SELECT c_nationkey + 1 AS id, count(*) AS n FROM customer WHERE c_nationkey < 12 GROUP BY 1), s AS (SELECT s_nationkey + 1 AS id, count(*) AS n FROM supplier WHERE s_nationkey >= 8 AND s_nationkey < 20 GROUP BY 1)
SELECT i.id::BIGINT AS id, name, CASE WHEN name LIKE 'Osnovni%' THEN 'RS' ELSE 'FBiH' END AS entity, coalesce(c.n, 0)::BIGINT AS central, coalesce(s.n, 0)::BIGINT AS category, name NOT LIKE 'Tuž%' AS court FROM i LEFT JOIN c ON c.id = i.id LEFT JOIN s ON s.id = i.id WHERE coalesce(c.n, 0) + coalesce(s.n, 0) > 0""")
def institutions_found(spark, sf):
    n = _t(spark, sf, "nation")
    key = F.col("n_nationkey").cast("long")
    named = n.select((key + 1).alias("id"), F.concat(F.when(key % 3 == 0, "Općinski  sud u ").when(key % 3 == 1, " Tužilaštvo ").otherwise("Osnovni sud u "), "n_name").alias("name"))
    central = _t(spark, sf, "customer").where("c_nationkey < 12").select((F.col("c_nationkey").cast("long") + 1).alias("court_id"))
    articles = _t(spark, sf, "supplier").where("s_nationkey >= 8 and s_nationkey < 20").select((F.col("s_nationkey").cast("long") + 1).alias("court_id"))
    return institutions.enumerate_institutions(spark, named, institutions.route_counts(central, articles))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN c_name END AS name, o_custkey % 2 = 1 AS needs FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def article_lookup(spark, sf):
    articles = _t(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("article_id"), "c_name")
    o = institutions.with_article(_t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("article_id")), articles)
    none = F.when(F.col("article").isNull(), F.array().cast("array<long>")).otherwise(F.array(F.lit(1).cast("long")))
    return o.select("o_orderkey", F.col("article.c_name").alias("name"), institutions.needs_article(none, F.lit(" ")).alias("needs"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN n_name END AS institution FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def institution_lookup(spark, sf):
    known = _t(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return institutions.with_institution(_t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("court_id")), known).select("s_suppkey", "institution")


@query("SELECT DISTINCT l_partkey AS document_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def attachments_to_download(spark, sf):
    cached = _t(spark, sf, "part").where("p_size < 40").select(F.col("p_partkey").alias("document_id"))
    return institutions.to_download(_t(spark, sf, "lineitem").select(F.col("l_partkey").alias("document_id")), cached)


@query("SELECT n_name || ' (općina) – naselje' AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS place FROM nation")
def geocoded_places(spark, sf):
    n = _t(spark, sf, "nation")
    gazetteer = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("place"), F.lit(43.9).alias("lat"), F.lit(18.0).alias("lon")).unionByName(n.where("n_nationkey % 2 = 1").select(F.col("n_name").alias("place"), F.lit(60.0).alias("lat"), F.lit(18.0).alias("lon")))
    return institutions.geocoded(n.select(F.concat("n_name", F.lit(" (općina) – naselje")).alias("name")), gazetteer).select("name", "place")


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'bos,hrv' WHEN 1 THEN 'hrv' ELSE '' END AS languages FROM customer")
def usable_languages(spark, sf):
    k = F.col("c_custkey")
    has = F.when(k % 3 == 0, F.array(F.lit("hrv"), F.lit("eng"), F.lit("bos"))).when(k % 3 == 1, F.array(F.lit("hrv"))).otherwise(F.array(F.lit("eng")))
    return _t(spark, sf, "customer").select(k.alias("k"), F.array_join(institutions.usable_languages(F.array(F.lit("bos"), F.lit("hrv")), has), ",").alias("languages"))


@query("""WITH c AS (SELECT lower(c_mktsegment) AS key, n_name AS within, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT key, within, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, within) AS r FROM c) WHERE r = 1""")
def commonest_region(spark, sf):
    c = _t(spark, sf, "customer").join(places._sized(_t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return places.commonest_within(c, F.col("c_mktsegment"), F.col("n_name"))


@query("SELECT s_suppkey AS court_id, n_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey % 3 > 0")
def seats_placed(spark, sf):
    s = _t(spark, sf, "supplier").join(places._sized(_t(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("court_id"), F.lower("n_name").alias("seat"))
    return places.seats_placed(s, _t(spark, sf, "nation").where("n_nationkey % 3 > 0").select(F.col("n_name").alias("place")))


# --- scalar functions ----------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS k, o_orderkey % 400 - 3 AS days, CASE WHEN o_orderkey % 400 < 3 THEN 'prošlo' WHEN o_orderkey % 400 = 3 THEN 'danas' WHEN o_orderkey % 400 = 4 THEN 'sutra' ELSE 'za ' || (o_orderkey % 400 - 3) || CASE WHEN (o_orderkey % 400 - 3) % 10 = 1 AND (o_orderkey % 400 - 3) % 100 <> 11 THEN ' dan' ELSE ' dana' END END AS label,
strftime(date_trunc('week', o_orderdate), '%d.%m.') || ' – ' || strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%d.%m.') AS week FROM orders""")
def day_labels(spark, sf):
    days = F.col("o_orderkey") % 400 - 3
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), days.alias("days"), dates.days_label(days).alias("label"), dates.week_label(dates.monday(F.to_date("o_orderdate"))).alias("week"))


@query("""SELECT o_orderkey AS k, strftime(o_orderdate::DATE + INTERVAL 10 HOUR + INTERVAL 30 MINUTE - INTERVAL (CASE WHEN month(o_orderdate) BETWEEN 4 AND 8 THEN 2 ELSE 1 END) HOUR, '%Y%m%dT%H%M%SZ') AS stamp FROM orders WHERE month(o_orderdate) NOT IN (3, 9, 10)""")
def hearing_instants(spark, sf):
    o = _t(spark, sf, "orders").where(~F.month("o_orderdate").isin(3, 9, 10))
    return o.select(F.col("o_orderkey").alias("k"), dates.stamp(dates.instant(F.to_date("o_orderdate"), F.lit("10:30"))).alias("stamp"))


@query("""SELECT p_partkey AS k, (p_partkey % 9000 + 1)::DOUBLE AS area, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 9000 + 1)::DOUBLE END AS one, 'Prvi & drugi' AS decoded, '&lt;b&gt; &quot;x&quot; &amp;' AS escaped, chr(128512) || 'Č' AS signs, 'Novi Grad' AS titled FROM part""")
def small_functions(spark, sf):
    k = F.col("p_partkey")
    n = (k % 9000 + 1).cast("string")
    said = F.concat(F.lit("stan od "), n, F.lit(" m2"), F.when(k % 2 == 0, "").otherwise(" i 5,5 m²"))
    return _t(spark, sf, "part").select(
        k.alias("k"), numbers.parse_area(n).alias("area"), numbers.area_of(said, F.lit(None).cast("string")).alias("one"), text.decode_entities(F.lit("Prvi &amp; drugi")).alias("decoded"), text.html_escape(F.lit('<b> "x" &')).alias("escaped"), text.decode_entities(F.lit("&#128512;&#x10C;")).alias("signs"),
        text.title_case(F.lit("NOVI grad")).alias("titled"),
    )


@query("SELECT p_partkey AS k, 'Donji Butmir' AS re_cased, 'Stan u Tuzli' AS sentence, 'abc…' AS clipped, 'stan-povrsine-62-m2' AS slug, 'a\\;b\\,c' AS ics, '500,00 KM i Ročište' AS repaired, 'čevapi đorđe' AS place, '−25%' AS percent FROM part")
def text_functions(spark, sf):
    return _t(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), text.case_of_capitals(F.lit("DONJI BUTMIR")).alias("re_cased"), text.sentence_case(F.lit("stan u Tuzli")).alias("sentence"), text.clip(F.lit("abc defgh"), 5).alias("clipped"), text.slug_of_title(F.lit("Stan, površine 62 m²!")).alias("slug"),
        text.ics_escape(F.lit("a;b,c")).alias("ics"), text.repair_ocr(F.lit("500,00 KIvI i Rociste")).alias("repaired"), F.lower(text.composed(F.lit("čevapi đorđe"))).alias("place_") if False else text.tidy(text.composed(F.lit("c\u030cevapi  đorđe,;"))).alias("place"), numbers.format_percent(F.lit(-0.25)).alias("percent"),
    )


@query("""WITH w AS (SELECT doc_id, unnest(string_split_regex(replace(translate(lower(text), '""" + text.MARKED + """', '""" + text.PLAIN + """'), 'đ', 'd'), '[^a-z0-9]+')) AS token FROM documents) SELECT doc_id, count(*)::BIGINT AS score FROM w WHERE token = 'the' GROUP BY 1""")
def search_by_index(spark, sf):
    return search.matching_index(search.index(_t(spark, sf, "documents"), "doc_id", F.col("text")), "doc_id", "The")
