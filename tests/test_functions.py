"""Cases of single functions: input and what must come out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeworks.functions import dates, extract, geo, numbers, redact, text


@pytest.fixture(scope="module")
def of(spark):
    def run(build, *values):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, v string").orderBy("i")
        return [r.o for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]

    return run


def test_amounts(of):
    assert of(numbers.parse_amount, "1.234.567,89", "47.425,06", "936,46", "1.500", "2.000.00", "100.00", "500", "x") == [1234567.89, 47425.06, 936.46, 1500.0, 2000.0, 100.0, 500.0, None]
    assert of(numbers.parse_area, "62.5", "1.217", "48,5") == [625.0, 1217.0, 48.5]
    assert of(lambda c: numbers.format_km(c.cast("double")), "450000", "999") == ["450.000 KM", "999 KM"]
    assert of(lambda c: numbers.js_round(c.cast("double")), "1.005") == [1.0]


def test_case_numbers(of):
    got = of(extract.case_number, "Broj: 65 0 Ip 1177038 25 Ip, Sarajevo", "80 0 И 123456 23 И", "ništa", "126 0 I 221246 23 Bije")
    assert got == ["65 0 Ip 1177038 25 Ip", "80 0 I 123456 23 I", None, None]


def test_dates(of):
    assert of(dates.parse_date, "05.08.2026", "5.8.2026.", "2026-08-05T10:00:00Z", "45.13.2026", "31.02.2026") == [dt.date(2026, 8, 5)] * 3 + [None, None]
    kept = of(lambda c: dates.plausible(F.to_date(F.split_part(c, F.lit("|"), F.lit(1))), F.try_to_date(F.split_part(c, F.lit("|"), F.lit(2)), "yyyy-MM-dd")), "2924-01-01|2024-06-26", "2029-01-08|2024-06-26", "2011-03-30|2011-05-17", "2030-01-01|")
    assert kept == [None, None, dt.date(2011, 3, 30), dt.date(2030, 1, 1)]
    assert of(lambda c: dates.sale_date_in(c, F.lit(dt.date(2026, 1, 1))), "1.2.2025 i 3.4.2026, pa 5.6.2026", "1.2.2020 i 3.4.2021", "nema") == [dt.date(2026, 4, 3), dt.date(2021, 4, 3), None]
    assert of(lambda c: dates.urgency(c.cast("int")), "-1", "3", "7", "8") == ["past", "due", "soon", "later"]


def test_scripts(of):
    assert of(text.to_latin, "Љубав Њива Џеп Ђурђевдан") == ["Ljubav Njiva Džep Đurđevdan"]
    assert of(text.fold, "Čapljina ĐURĐEVIK", "рочиште") == ["capljina durdevik", "rociste"]
    same = [("SARAJEVO", "Sarajevo"), ("Doboj Istok", "Doboj-Istok"), ("Ćoralići", "Čoralići")]
    a, b = of(text.fold_place, *(x for x, _ in same)), of(text.fold_place, *(y for _, y in same))
    assert a == b and of(text.fold_place, "Novi Grad") != of(text.fold_place, "Stari Grad")
    assert of(text.case_of_capitals, "DONJI BUTMIR", "RIČICE-SVIĆE", "Bijeljina selo") == ["Donji Butmir", "Ričice-Sviće", "Bijeljina selo"]


def test_markup(of):
    assert of(text.html_to_text, "<p>a&amp;b</p><style>p{}</style><!-- x --><div>c&#268;&#x10D;&nbsp;d</div>", None) == ["a&b\ncČč d", ""]
    assert of(text.strip_style_noise, "dobro\nfont-family: Arial\na:b;c:d;e:f;") == ["dobro"]
    assert of(text.slug, "  Općinski sud u Živinicama! ") == ["opcinski-sud-u-zivinicama"]
    long = of(text.slug_of_title, "stan površine 62 m² " + "a" * 30 + " " + "b" * 30)[0]
    assert long == "stan-povrsine-62-m2-" + "a" * 30
    assert of(text.id_from_slug, "stan-65-123", "65-123") == ["65-123", "65-123"]


def test_folding(of):
    folded = of(text.fold_octets, "č" * 80)[0]
    assert all(len(line.encode()) <= 75 for line in folded.split("\r\n")) and folded.replace("\r\n ", "") == "č" * 80
    assert of(text.ics_escape, "a;b,c\\d\ne") == ["a\\;b\\,c\\\\d\\ne"]
    assert of(text.xml_escape, "a<b>&'\"") == ["a&lt;b&gt;&amp;&apos;&quot;"]


def test_rounds_methods_times(of):
    assert of(extract.auction_round, "Prvo ročište za prodaju", "na drugom ročištu", "ТРЕЋЕ РОЧИШТЕ", "ništa") == ["prvo", "drugo", "trece", "nepoznato"]
    assert of(extract.sale_method, "usmenim javnim nadmetanjem", "neposredna pogodba", "x") == ["usmeno-javno-nadmetanje", "neposredna-pogodba", "nepoznato"]
    assert of(extract.sale_time, "u 9,00 sati", "09.00 časova", "13:30 sati", "u 9 sati", "27:00 sati") == ["09:00", "09:00", "13:30", "09:00", None]
    assert of(extract.infer_sale_type, "prodaja stana u Tuzli", "putničko vozilo", "kompresor") == ["nekretnine", "vozila", "tehnika"]


def test_money(of):
    build = lambda c: extract.money(extract.amounts(c))
    a, b, c = of(
        build,
        "radi naplate duga u iznosu od 1.000,00 KM. Nekretnine utvrđene vrijednosti iznose 47.425,06 KM, ne mogu se prodati ispod polovine, tj. 23.712,53 KM. Jemstvo 1/10 u iznosu 4.742,51 KM",
        "- umivaonik, po početnoj cijeni od 100,00 KM\n- ormar, po početnoj cijeni od 100,00 KM",
        "Kosačica 30kg.......500,00 KM",
    )
    assert (a.appraised, a.starting, a.deposit) == (47425.06, 23712.53, 4742.51)
    assert b.starting == 200.0 and c.appraised == 500.0
    assert of(build, "100,00 KM i 300,00 KM")[0].printed == 400.0


def test_cadastral(of):
    r = of(extract.cadastral, "k.č. broj 2933/1, z.k. uložak br. 565 k.o. Omerbegovača", "HERCEGOVAČKO NERETVANSKI KANTON")
    assert r[0].kc == ["2933/1"] and r[0].zk_ulozak == ["565"] and r[0].ko == ["Omerbegovača"] and r[1] is None
    places = of(lambda c: extract.clean_places(F.split(c, ";")), "SP_Dolac;Drugovići;Petrovo;Trn;Batković;prvoj;Dobrinka Milivojević;xxx;SP;prodaja;Republika Srpska")[0]
    assert places == ["Dolac", "Drugovići", "Petrovo", "Trn", "Batković"]
    assert of(lambda c: extract.settlement(F.array(c)), "Sarajevo IV", "Poklečani", "DONJI BUTMIR", "xxx") == ["Sarajevo", "Poklečani", "Donji Butmir", None]


def test_tags(of):
    assert of(lambda c: extract.item_tags(c, F.lit(None).cast("string")), "Računar, monitor i štampač", "ništa") == [["monitor", "racunar", "printer"], []]
    assert of(lambda c: extract.item_tags(F.lit("x"), F.lit(None).cast("string"), c), "prodaje se traktor") == [["traktor"]]


def test_redaction(of):
    got = of(redact.redact_text, "Prodaja nekretnina izvršenika Marka Markovića, Sarajevo", "dužnik Komunalac a.d. Banja Luka", "JMBG 1234567890123", "mail a.b@c.ba tel 061 123 456", "stan u ul. Kneza Miloša br. 43, Tuzla", "ulica Alipašina bb", "", None)
    assert got[0] == "Prodaja nekretnina izvršenika [uklonjeno], Sarajevo"
    assert "Komunalac a.d." in got[1] and got[2] == "JMBG [uklonjeno]" and got[3] == "mail [uklonjeno] tel [uklonjeno]"
    assert got[4] == "stan u [uklonjeno], Tuzla" and got[5] == "[uklonjeno]" and got[6] is None and got[7] is None
    trade = of(redact.redact_text, "izvršenik Stevo Đajić „Dnp“ iz Laktaša")[0]
    assert trade.startswith("izvršenik [uklonjeno] „Dnp") and "Stevo" not in trade
    assert of(redact.redact_venue, "soba 12, ul. Suda br. 1", "ul. Nekoga br. 4") == ["soba 12, ul. Suda br. 1", None]
    assert of(redact.leaks, got[0], "a@b.ba") == [False, True]


def test_costs(spark):
    lots = [("nekretnine", "FBiH", 65, 100000.0), ("nekretnine", "FBiH", 32, 100000.0), ("nekretnine", "RS", 1, 100000.0), ("nekretnine", "BD", 1, 100000.0), ("vozila", "FBiH", 65, 5000.0), ("nekretnine", "FBiH", 65, 1e6)]
    df = spark.createDataFrame(lots, "t string, e string, c int, p double").select(numbers.tax_rate(F.col("t"), F.col("e"), F.col("c")).alias("r"), numbers.fees_for(F.col("p"), F.col("t")).alias("f"))
    rows = df.collect()
    assert [r.r for r in rows] == [0.05, 0.0, 0.0, 0.03, 0.0, 0.05] and [r.f for r in rows] == [500.0, 500.0, 500.0, 500.0, 150.0, 1500.0]
    one = spark.range(1).select(numbers.cost_breakdown(F.lit(50000.0), F.lit(5000.0), F.lit(0.05), F.lit(250.0)).alias("c"), numbers.deposit_for(F.lit(None).cast("double"), F.lit(500000.0)).alias("d"), geo.distance_km(F.lit(43.85), F.lit(18.41), F.lit(43.34), F.lit(17.81)).alias("km")).first()
    assert one.c.balance == 45000 and one.c.before_hearing + one.c.after_hearing == one.c.total and one.d == 10000 and 70 < one.km < 80


def test_ocr_repair(of):
    assert of(text.repair_ocr, "500,00 KIvI i 5 00 XN, Rociste i ROČIŠTE, Nadmetanje ‘x’") == ["500,00 KM i 5,00 KM, Ročište i Ročište, nadmetanje 'x'"]
