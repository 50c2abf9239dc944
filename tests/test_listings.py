"""Descriptions, merging, the build of listings, sources, sinks and the archive."""

import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from noticeworks.functions import describe, merge
from noticeworks.operators import search, sinks
from noticeworks.plans import listings
from noticeworks.sources import documents, landing
from noticeworks.streaming.incremental import Archive

LLM = "struct<headline:string,itemDescription:string,itemTags:array<string>,caseNumber:string,appraisedValue:double,startingPrice:double,deposit:double,saleTime:string,auctionRound:string,saleMethod:string,auctionLocation:string,municipality:string,cadastral:struct<kc:array<string>,zkUlozak:array<string>,ko:array<string>>>"


def test_descriptions():
    text = "ODREĐUJE SE ročište radi prodaje pokretnih stvari izvršenika:\n\nUgaona garnitura vrijednost 1.200,00 KM\nLCD TV 500,00 KM\n\n2. Prodaja će se vršiti putem nadmetanja"
    assert describe.describe(text, "Zaključak") == "; ".join(text.split("\n")[2:4])
    assert describe.describe("x", "Prva prodaja (Kosačica za travu GGP ITALY, T 484 TR)") == "Kosačica za travu GGP ITALY, T 484 TR"
    assert describe.describe("prodaju popisanih stvari:\nOpis; Količina; Procijenjena vrijednost\nViljuškar marke „Linde“ crvene boje, tip H45D", "").startswith("Viljuškar")
    for bad in ("Konstatuje se da je vrijednost nekretnine", "Određuje se prodaja usmenim javnim", "Izvršno odjeljenje.", "05.2026. godine sa početkom u 09,00 sati", "Određuje", "09,00", "", None, "Red. Br. Opis popisanih stvari Kom. Procijenjena Vrijednost"):
        assert not describe.is_usable(bad)
    for good in ("Klima uređaj marke „Samsung\" — 400,00 KM", 'PMV "Peugeot" i Moped "Peugeot"', "objekat u privredi površine 157 m2 i zemljište uz objekat površine 1236m2."):
        assert describe.is_usable(good)


def test_build(spark):
    body = "Broj: 65 0 Ip 1177038 25 Ip. Prvo ročište 05.08.2026. u 9,00 sati, usmeno javno nadmetanje. Stan površine 62 m2, k.o. Omerbegovača, utvrđene vrijednosti iznose 47.425,06 KM. Jemstvo u iznosu od 4.742,51 KM."
    rows = [(1, 65, "Općinski sud u Sarajevu", "Prodaja stana izvršenika Marka Markovića", "NEK", None, dt.date(2026, 6, 1), None, body, "document"), (2, 65, "Općinski sud u Sarajevu", "Bez datuma", None, None, None, None, "ništa", "inline")]
    df = spark.createDataFrame(rows, "article_id long, court_id long, court string, title string, type_code string, type_label string, published_date date, sale_date date, text string, source string")
    df = df.withColumn("llm", F.lit(None).cast(LLM))
    good, bad = listings.build(df, F.lit(dt.date(2026, 1, 1)))
    x = good.collect()
    assert len(x) == 1 and bad.count() == 1
    x = x[0]
    assert x.id == "65-1" and x.case_number == "65 0 Ip 1177038 25 Ip" and x.sale_type == "nekretnine" and x.sale_date == dt.date(2026, 8, 5) and x.sale_time == "09:00" and x.auction_round == "prvo"
    assert x.appraised_value.amount == 47425.06 and x.deposit.amount == 4742.51 and "Markovića" not in x.title and x.cadastral.ko == ["Omerbegovača"] and x.location.settlement == "Omerbegovača" and "stan" in x.item_tags
    prior = good.withColumn("id", F.lit("65-9"))
    kept = {r.id for r in listings.archive(prior, good).collect()}
    assert kept == {"65-1", "65-9"}


def test_disagreements_and_headlines(spark):
    llm = json.dumps({"appraisedValue": 100.0, "deposit": 10.0, "caseNumber": "1 0 I 2", "saleTime": "09:00"})
    rules = json.dumps({"money": {"appraised": 150.0, "deposit": 10.1, "printed": 300.0}, "case_number": "1 0 I 3", "sale_time": "09:00"})
    df = spark.createDataFrame([(llm, rules)], "l string, r string").select(F.from_json("l", LLM).alias("l"), F.from_json("r", "money struct<appraised:double,starting:double,deposit:double,printed:double>, case_number string, sale_time string").alias("r"))
    found = df.select(merge.disagreements(F.col("l"), F.col("r")).alias("d")).first().d
    assert [(d.field, d.ratio) for d in found] == [("appraisedValue", 1.5), ("caseNumber", None)]
    h = spark.createDataFrame([(None, "nekretnine", "oranica površine 1.217 m2", "x", ["HRASNICA"], "Sarajevo"), (None, "tehnika", "računar 100,00 KM; monitor; TV aparat; štampač", "x", [], None), ("Dobar naslov", "ostalo", None, None, [], None), (None, "vozila", None, "x", [], "Tuzla")], "o string, t string, d string, n string, k array<string>, m string")
    got = [r.h for r in h.select(merge.headline(*(F.col(c) for c in "otdnkm")).alias("h")).collect()]
    assert got == ["Oranica 1.217 m² - Hrasnica", "Računar, Monitor, TV aparat i još 1", "Dobar naslov", "Vozilo - Tuzla"]
    towns = spark.createDataFrame([("Sarajevu",), ("Prijedoru",), ("Banjoj Luci",)], "t string").select(merge.nominative(F.col("t"), {"sarajevu": "Sarajevo", "banjoj luci": "Banja Luka"}).alias("n"))
    assert [r.n for r in towns.collect()] == ["Sarajevo", "Prijedor", "Banja Luka"]


def test_sources(spark, tmp_path):
    (tmp_path / "central").mkdir()
    row = {"id": 1, "naslov": "a", "insId": 65, "institucija": "Osnovni sud u Bijeljini", "datumObjave": "01.02.2026", "datumProdaje": "05.08.2026", "RB": 1, "total": 2}
    (tmp_path / "central/0.json").write_text(json.dumps([row, row | {"id": 2}]))
    (tmp_path / "central/1.json").write_text(json.dumps([row | {"id": 2, "naslov": "again"}]))
    central = landing.central_feed(spark, str(tmp_path / "central"))
    assert {(r.id, r.naslov) for r in central.collect()} == {(1, "a"), (2, "a")}
    (tmp_path / "cats/7").mkdir(parents=True)
    (tmp_path / "cats/7/0.json").write_text(json.dumps([{"id": 2, "header": "other", "description": "d", "content": "", "date": "01.02.2026", "insId": 65}, {"id": 3, "header": "new", "description": "d", "content": "c"}]))
    articles = landing.category_feed(spark, str(tmp_path / "cats/*"))
    got = {r.article_id: (r.title, r.inline) for r in landing.candidates(central, articles).collect()}
    assert got == {1: ("a", None), 2: ("a", None), 3: ("new", "d\nc")}
    assert [r.e for r in spark.createDataFrame([("Osnovni sud Brčko distrikta",), ("Osnovni sud u Doboju",), ("Kantonalni sud",)], "n string").select(landing.entity_of(F.col("n")).alias("e")).collect()] == ["BD", "RS", "FBiH"]
    assert landing.coverage(spark, str(tmp_path / "missing.json")).count() == 0 and landing.query_string({"a": 1, "b": None, "c": ""}) == "a=1"
    nav = json.dumps({"props": {"pageProps": {"modules": [{"id": 1, "name": "m", "categories": [{"id": 2, "name": "Prodaja", "subcategories": [{"id": 3, "name": "x"}]}, {"id": 4, "name": "y", "subcategories": [{"id": 5, "name": "Licitacije"}, {"id": 6, "name": "z"}]}]}]}}})
    page = spark.createDataFrame([(f'<script id="__NEXT_DATA__" type="application/json">{nav}</script>',)], "html string")
    assert {r.id for r in landing.sale_categories(page).collect()} == {3, 5}


def test_documents(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>Prodaja &amp; kupovina</w:t></w:p><w:p><w:t>dva</w:t></w:p></w:document>")
    (tmp_path / "a.bin").write_bytes(data.getvalue())
    (tmp_path / "b.bin").write_bytes(b"%PDF-1.4 scan")
    (tmp_path / "c.bin").write_bytes(b"PK\x03\x04broken")
    got = {r.path[-5:]: (r.kind, r.text, r.needs_ocr) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": ("docx", "Prodaja & kupovina\ndva", False), "b.bin": ("pdf", "", True), "c.bin": ("docx", "", False)}
    raw = spark.createDataFrame([('```json\n{"headline": "h"}\n```',), ('{"headline": "g"}',), ("oops",)], "raw string")
    assert [r.llm and r.llm.headline for r in documents.readings(raw).collect()] == ["h", "g", None]
    assert documents.tolerable(documents.readings(raw)).count() == 3
    texts = spark.createDataFrame([("x" * 90,), ("y" * 90,), ("short",)], "text string")
    cache = texts.limit(1).select(F.sha2(F.concat_ws("\0", F.lit("p"), F.lit("m"), "text"), 256).alias("key"))
    assert [r.text[0] for r in documents.pending(texts, cache, "p", "m").collect()] == ["y"]


def test_calendar_and_feed(spark):
    df = spark.createDataFrame([("u1", dt.date(2026, 8, 5), None, "Stan, " + "č" * 60, "opis; dva", "sud"), ("u2", dt.date(2026, 1, 5), "10:30", "b", None, None)], "uid string, date date, time string, summary string, description string, location string")
    doc = sinks.calendar(sinks.events(df), "Prodaje").first().document
    assert doc.count("BEGIN:VEVENT") == doc.count("END:VEVENT") == 2 and doc.count("BEGIN:VALARM") == 4 and all(len(x.encode()) <= 75 for x in doc.split("\r\n"))
    assert "DTSTART:20260805T070000Z" in doc and "DTSTART:20260105T093000Z" in doc and "Stan\\, " in doc
    assert len(spark.createDataFrame([(doc,)], "d string").select(sinks.event_blocks(F.col("d")).alias("b")).first().b) == 2
    items = sinks.feed_items(spark.createDataFrame([("a<b", "1", dt.date(2026, 1, 2), 1), ("c", "2", dt.date(2026, 1, 1), 2)], "title string, guid string, published date, seq int"), [F.col("seq")])
    text = sinks.feed(items, "t").first().document
    assert "a&lt;b" in text and text.index("<guid>1") < text.index("<guid>2") and "Thu, 01 Jan 2026 00:01:00 GMT" in text


def test_archive_replay(spark, tmp_path):
    """Two batches as a stream give what one run over both gives; vanished rows stay."""
    for i, rows in enumerate([[(1, "a", 1), (2, "b", 1), (2, "b", 1)], [(1, "new", 2), (3, "c", 2)]]):
        spark.createDataFrame(rows, "id long, v string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        Archive(spark, str(tmp_path / "table"), "id", "seq").follow(spark.readStream.schema("id long, v string, seq long").parquet(str(tmp_path / "in")), str(tmp_path / "state"))
    a = Archive(spark, str(tmp_path / "table"), "id", "seq")
    assert a.version() == 2 and {(r.id, r.v) for r in a.read().collect()} == {(1, "new"), (2, "b"), (3, "c")}


def test_archive_keeps_changes_apart(spark, tmp_path):
    """Ten merges: most write their own rows only, and each reading is that of all merges so far."""
    a, want = Archive(spark, str(tmp_path / "t"), "id", "seq"), {}
    for v in range(10):
        rows = [(v % 3, f"v{v}", v), (10 + v, "new", v)]
        a.merge(spark.createDataFrame(rows, "id long, v string, seq long"))
        want |= {i: x for i, x, _ in rows}
        assert a.version() == v + 1
    assert {r.id: r.v for r in a.read().collect()} == want
    names = {p.name for p in (tmp_path / "t").iterdir()}
    assert {"v1", "v10"} <= names and "d2" in names and "v2" not in names


def test_search(spark):
    df = spark.createDataFrame([(1, "Stan u Tuzli", "a"), (2, "Kuća, stan", "b"), (3, "Njiva", "a")], "id int, t string, f string")
    assert {r.id for r in search.matching(df, F.col("t"), "STAN").collect()} == {1, 2} and search.matching(df, F.col("t"), "").count() == 3
    assert [r.id for r in search.matching(df, F.col("t"), "stan", {"f": ["b", "c"]}).collect()] == [2]
    assert [r.id for r in search.page(df, [F.col("id")], 1, 2).collect()] == [3]
    assert search.index(df, "id", F.col("t")).where("token = 'stan'").count() == 2


def test_places(spark):
    from noticeworks.operators import places

    g = spark.createDataFrame([("Tuzla", 44.54, 18.67), ("Široki Brijeg", 43.38, 17.59), ("Sarajevo", 43.85, 18.41)], "place string, lat double, lon double")
    rows = spark.createDataFrame([(1, "TUZLA", None, "Sarajevo"), (2, None, "Široki-Brijeg", "Sarajevo"), (3, "Nigdje", None, "Sarajevo"), (4, None, None, None)], "id int, m string, s string, c string")
    at = places.locate(rows, g, [("municipality", F.col("m")), ("settlement", F.col("s")), ("seat", F.col("c"))])
    assert {r.id: (r.place, r.found_by, r.exact) for r in at.collect()} == {1: ("Tuzla", "municipality", True), 2: ("Široki Brijeg", "settlement", True), 3: ("Sarajevo", "seat", False), 4: (None, None, False)}
    assert places.counters(at).first().asDict() == {"exact": 2, "by_seat": 1, "unplaced": 1}
    assert {r.place: (r.total, r.exact) for r in places.rollup(at, F.lit(True)).collect()} == {"Tuzla": (1, True), "Široki Brijeg": (1, True), "Sarajevo": (1, False)}
    near = places.nearest(g.select(F.col("place").alias("p"), "lat", "lon"), g, "p", "place", 2).where("rank = 2").collect()
    assert {r.p: r.site for r in near} == {"Tuzla": "Sarajevo", "Sarajevo": "Tuzla", "Široki Brijeg": "Sarajevo"}
    names = spark.createDataFrame([("Žepče",), ("Zepce",), ("Žepče",), ("ŽEPČE",)], "n string")
    assert [(r.key, r.name, r.n) for r in places.commonest_spelling(names, F.col("n")).collect()] == [("zepce", "Žepče", 2)]
