"""Every catalogue query against its SQL in DuckDB on the small tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from noticeworks.functions import redact
from noticeworks.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert got
    if name in catalog.ORACLE_SQL:
        r = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(r.columns) == sorted(df.columns)
        at = [list(r.columns).index(c) for c in sorted(r.columns)]
        assert got == sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=str)


def test_slugs_of_whole_texts(spark):
    got = catalog.QUERIES["fold_slug_whole"](spark, SF)
    assert got.where("chars > 200").count() > 0


def test_parties_are_redacted_in_whole_tables(spark, duck):
    rows = [(1, "Prodaja nekretnina izvršenika Marka Markovića, Sarajevo"), (2, "dužnik Komunalac a.d. Banja Luka"), (3, "tuženi Pero Perić protiv banke")]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, text string").select("id", redact.redact_text(F.col("text")).alias("t")).collect()}
    assert got == {1: "Prodaja nekretnina izvršenika [uklonjeno], Sarajevo", 2: rows[1][1], 3: "tuženi [uklonjeno] protiv banke"}
    df = catalog.QUERIES["redact_parties"](spark, SF)
    assert {r.source: r["count"] for r in df.groupBy("source").count().collect()} == dict(duck.sql("SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages").fetchall())
