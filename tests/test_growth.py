"""Steps whose work must not grow faster than their rows: asked of the plans, and of results at odd inputs."""

import statistics

import pytest
from pyspark.sql import functions as F

from noticeworks.functions import describe, extract, redact, text
from noticeworks.operators import analytics, reports
from noticeworks.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_amounts_fold_the_text_ahead_once(spark):  # F2, F4, F9
    df = spark.createDataFrame([("početna cijena 5,00 KM",)], "v string").select(extract.amounts(F.col("v")).alias("o"))
    assert plan(df).count("lower(") == 1


@pytest.mark.parametrize("name", ["notice_reading", "merged_readings", "reading_disagreements", "quality_report"])  # F1, F5, F6, F7
def test_amounts_of_a_reading_are_found_once(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF))
    assert p.count("BAM") == 2 and p.count("Relation") == 1
    assert "ulozak" not in p and "sudnica" not in p  # fields that nothing reads aren't made


@pytest.mark.parametrize("name", ["notice_case_number", "notice_hearing", "notice_venue_and_viewing", "notice_cadastral", "notice_description", "notice_price_list", "description_shapes", "redacted_notices", "calendars"])  # F3, F9, F11-F13, F15, F16, F18
def test_rows_of_one_group_go_to_all_cores(spark, name):
    assert "RepartitionByExpression" in plan(catalog.QUERIES[name](spark, SF))


def test_case_numbers_are_sought_once(spark):  # F11
    df = spark.createDataFrame([("Број: 65 0 Ип 1177038 25 Ип",)], "v string").select(extract.case_number(F.col("v")).alias("c"))
    assert plan(df).count("translate(") == 1 and df.first().c == "65 0 Ip 1177038 25 Ip"


def test_a_text_is_folded_once_for_hearings_and_parcels(spark):  # F12, F15
    assert plan(catalog.QUERIES["notice_hearing"](spark, SF)).count("lower(") == 1
    df = spark.createDataFrame([("k.č. 5",)], "v string").select(extract.cadastral(F.col("v")).alias("o"))
    assert plan(df).split("lower(")[0].count("translate(") == 1


def test_folding_is_by_character_whatever_the_signs(spark):
    rows = ["Љубав Č ĐУР̌ 5, x ў Ъ ß😀", "ŁÓDŹ İ Σ", "plain", ""]
    got = [r.o for r in spark.createDataFrame([(v,) for v in rows], "v string").select(text.fold(F.col("v")).alias("o")).collect()]
    whole = [r.o for r in spark.createDataFrame([(v,) for v in rows], "v string").select(F.translate(F.lower(_all_latin(F.col("v"))), text.MARKED + "đ" + text.MARKS, text.PLAIN + "d").alias("o")).collect()]
    assert got == whole


def _all_latin(c):
    for a, b in text._DIGRAPHS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, text._CYRILLIC, text._LATIN)


def test_tags_fold_the_text_once(spark):  # F3
    df = spark.createDataFrame([("Računar",)], "v string").select(F.array_sort(extract.item_tags(F.col("v"), F.col("v"))).alias("o"))
    assert plan(df).count("lower(") == 1


def test_equal_goods_are_judged_once():  # F3, F13
    describe._clean.cache_clear()
    for _ in range(3):
        assert describe.describe("", "Prodaja (Viljuškar marke Linde)") == "Viljuškar marke Linde"
    assert describe._clean.cache_info().misses == 1


def test_long_calendar_lines_are_folded_without_a_state_for_each_sign(spark):  # F8, F14
    line = "č😀a" * 20_000
    df = spark.createDataFrame([(line,), ("a" * 75,), ("a" * 76,), ("",), (None,)], "v string").select(text.fold_octets(F.col("v")).alias("o"))
    assert "aggregate(" not in plan(df)
    got = [r.o for r in df.collect()]
    assert got[0].replace("\r\n ", "") == line and all(72 <= len(x.encode()) <= 75 for x in got[0].split("\r\n")[:-1])
    assert got[1:] == ["a" * 75, "a" * 75 + "\r\n a", "", None]


def test_parties_are_sought_only_behind_a_role(spark):  # F10, F16
    df = spark.createDataFrame([("duga proza bez ijednog",), ("dužnik Pero Perić, Tuzla",)], "v string").select(redact.redact_parties(F.col("v")).alias("o"))
    assert plan(df).startswith("Project") and "CASE WHEN RLIKE" in plan(df)
    assert [r.o for r in df.collect()] == ["duga proza bez ijednog", "dužnik [uklonjeno], Tuzla"]


def test_days_are_counted_in_one_pass(spark, monkeypatch):  # F17
    monkeypatch.setattr(analytics, "MEDIAN_ROWS", 10)
    monkeypatch.setattr(analytics, "at_ranks", None)
    got = catalog.QUERIES["lead_days_median"](spark, SF).first()
    assert got.n > 10
    for days in ([3], [1, 2], [5, 5, 7, 100], [0, 0, 0, 9, 9], []):
        r = analytics.median_days(spark.createDataFrame([(d,) for d in [*days, None]], "d int"), F.col("d")).first()
        assert (r.n, r.median) == (len(days), statistics.median(days) if days else None)


def test_quality_report_reads_what_was_found_once(spark):  # F6
    rows = [("a", i, float(i % 7)) for i in range(500)] + [("b", i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "field string, id long, ratio double")
    got = reports.quality_report(df, 9, 8, 20)
    assert "Join" not in plan(got)
    a = [(r.rank, r.id, r.n) for r in got.where("field = 'a'").orderBy("rank").collect()]
    assert a == [(i + 1, k, 500) for i, (_, k) in enumerate(sorted((-(i % 7), i) for i in range(500))[:20])]
    assert [(r.rank, r.id, r.n) for r in got.where("field = 'b'").orderBy("rank").collect()] == [(1, 0, 3), (2, 1, 3), (3, 2, 3)]
