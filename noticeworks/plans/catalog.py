"""The driver's queries over its own tables, each with the SQL that must give the same rows.

Orders stand for hearings (customer: case, date: hearing, total: starting price), line items for lots
(extended price: appraisal), parts for tagged items, documents and pages for texts, events for arrivals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.functions import dates, extract, geo, numbers, redact, text
from noticeworks.operators import analytics as A
from noticeworks.operators import gates as G
from noticeworks.operators import places, search, sinks
from noticeworks.streaming import incremental

AS_OF = "2000-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key, several parts a core, before long texts are made of them: a file of few row groups is read by few tasks."""
    return df.repartition(3 * max(8, df.sparkSession.sparkContext.defaultParallelism), key)


def _n(c, digits=4):
    return F.round(c.cast("double"), digits)


def _chain(spark, sf):
    return A.chains(_t(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")


_CHAIN_SQL = """SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY o_custkey) AS chain_length, lag(o_totalprice) OVER w AS prev
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


@query(f"""WITH c AS ({_CHAIN_SQL}), f AS (SELECT *, 1 - o_totalprice / prev AS fall FROM c WHERE prev > 0)
SELECT o_orderkey, o_custkey, position::INTEGER AS position, chain_length::BIGINT AS chain_length, round(fall, 4) AS drop FROM f WHERE fall > 0.01 AND fall < 0.95 AND o_orderdate >= '{AS_OF}'""")
def price_drops(spark, sf):
    out = A.price_drops(_chain(spark, sf), "o_totalprice", "o_orderdate", F.lit(AS_OF).cast("timestamp"))
    return out.select("o_orderkey", "o_custkey", "position", "chain_length", _n(F.col("drop")).alias("drop"))


@query(f"SELECT o_orderkey, position::INTEGER AS position, chain_length::BIGINT AS chain_length FROM ({_CHAIN_SQL}) WHERE chain_length > 1")
def chain_positions(spark, sf):
    return _chain(spark, sf).where("chain_length > 1").select("o_orderkey", "position", "chain_length")


@query(f"WITH c AS ({_CHAIN_SQL}), f AS (SELECT 1 - o_totalprice / prev AS fall FROM c WHERE prev > 0) SELECT round(median(fall), 4) AS median_fall, count(*)::BIGINT AS sample FROM f WHERE fall > 0.01 AND fall < 0.95")
def chain_fall_median(spark, sf):
    m = A.median(_chain(spark, sf), numbers.fall(F.col("previous_price"), F.col("o_totalprice")))
    return m.select(_n(F.col("median")).alias("median_fall"), F.col("n").alias("sample"))


@query("SELECT count(*)::BIGINT AS repeated FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def repeat_cases(spark, sf):
    return _t(spark, sf, "orders").groupBy("o_custkey").count().where("count > 1").agg(F.count("*").alias("repeated"))


@query("SELECT o_orderpriority AS key, count(*)::BIGINT AS n, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1 HAVING count(*) >= 8")
def median_by_group_min_n(spark, sf):
    return A.medians(_t(spark, sf, "orders"), F.col("o_orderpriority"), F.col("o_totalprice"), 8).withColumn("median", _n(F.col("median")))


@query("SELECT w AS key, count(*)::BIGINT AS n, round(median(p_retailprice), 4) AS median FROM (SELECT p_partkey, p_retailprice, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) GROUP BY 1 HAVING count(*) >= 8")
def price_by_tag(spark, sf):
    rows = _t(spark, sf, "part").select("p_retailprice", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    return A.medians(rows, F.col("w"), F.col("p_retailprice"), 8).withColumn("median", _n(F.col("median")))


@query("""SELECT n_name AS key, count(*)::BIGINT AS n, round(median(l_extendedprice / l_quantity), 4) AS median
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity >= 1 AND l_extendedprice > 0 GROUP BY 1 HAVING count(*) >= 5""")
def price_per_unit_by_place(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_suppkey", numbers.price_per_area(F.lit(None).cast("double"), F.col("l_extendedprice"), F.col("l_quantity")).alias("unit"))
    rows = li.join(_t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), li.l_suppkey == F.col("s_suppkey")).join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return A.medians(rows, F.col("n_name"), F.col("unit"), 5).withColumn("median", _n(F.col("median")))


@query("""WITH v AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem),
b AS (SELECT greatest(100, floor(max(CASE WHEN r = floor(n * 0.05) THEN v END) / 100 + 0.5) * 100) AS lo, greatest(100, floor(max(CASE WHEN r = floor(n * 0.95) THEN v END) / 100 + 0.5) * 100) AS hi FROM v),
c AS (SELECT greatest(0, least(6, floor((v - lo) / ((hi - lo) / 7))))::INTEGER AS bin, count(*) AS n FROM v, b GROUP BY 1)
SELECT g.bin::INTEGER AS bin, round(lo + g.bin * ((hi - lo) / 7), 4) AS lower, round(lo + (g.bin + 1) * ((hi - lo) / 7), 4) AS upper, coalesce(n, 0)::BIGINT AS n FROM range(7) g(bin), b LEFT JOIN c ON c.bin = g.bin""")
def unit_price_histogram(spark, sf):
    h = A.histogram(_t(spark, sf, "lineitem"), F.col("l_extendedprice"))
    return h.select("bin", _n(F.col("lower")).alias("lower"), _n(F.col("upper")).alias("upper"), F.col("n").cast("long").alias("n"))


@query("""SELECT r.label AS label, count(l_orderkey)::BIGINT AS n, round(median(CASE WHEN l_extendedprice > 0 THEN 1 - l_extendedprice * (1 - l_discount) / l_extendedprice END), 4) AS median
FROM (VALUES ('N'), ('R'), ('A'), ('none')) r(label) LEFT JOIN lineitem ON l_returnflag = r.label GROUP BY 1""")
def discount_by_round(spark, sf):
    labels = spark.createDataFrame([("N", 0), ("R", 1), ("A", 2), ("none", 3)], "label string, ord int")
    li = _t(spark, sf, "lineitem").select("l_returnflag", numbers.discount(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice")).alias("d"))
    by = li.groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"), F.median("d").alias("median"))
    return labels.join(by, "label", "left").orderBy("ord").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), _n(F.col("median")).alias("median"))


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*)::BIGINT AS n, round(median(CASE WHEN o_totalprice > 0 THEN o_totalprice END), 4) AS median_starting FROM orders GROUP BY 1 HAVING count(*) >= 5")
def price_by_year(spark, sf):
    return A.by_year(_t(spark, sf, "orders"), "o_orderdate", F.col("o_totalprice"), F.lit(None).cast("double")).select("year", "n", _n(F.col("median_starting")).alias("median_starting"))


@query("""WITH c AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) % 2 = 1 GROUP BY 1)
SELECT g.y::INTEGER AS year, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(min(y), max(y) + 1)) AS y FROM c) g LEFT JOIN c ON c.y = g.y""")
def published_by_year_gapfill(spark, sf):
    return A.years_filled(_t(spark, sf, "orders").where(F.year("o_orderdate") % 2 == 1), "o_orderdate").select("year", F.col("n").cast("long").alias("n"))


@query("""WITH d AS (SELECT o_orderdate::DATE AS d FROM orders), f AS (SELECT min(date_trunc('week', d))::DATE AS a, max(date_trunc('week', d))::DATE AS b FROM d),
c AS (SELECT least((d - a) // 7, 8)::INTEGER AS week, count(*) AS n FROM d, f GROUP BY 1)
SELECT g.week::INTEGER AS week, (a + (g.week * 7)::INTEGER)::DATE AS monday, coalesce(n, 0)::BIGINT AS n FROM f, range(9) g(week) LEFT JOIN c ON c.week = g.week WHERE g.week <= (b - a) // 7""")
def weekly_strip(spark, sf):
    return A.week_strip(_t(spark, sf, "orders"), "o_orderdate").select("week", "monday", F.col("n").cast("long").alias("n"))


@query("SELECT round(median(d), 4) AS days, count(*)::BIGINT AS n FROM (SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE d >= 0")
def lead_days_median(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))
    rows = _t(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("l_shipdate")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    m = A.median_days(rows, A.lead_days(F.col("o_orderdate"), F.col("l_shipdate")))
    return m.select(_n(F.col("median")).alias("days"), "n")


@query("SELECT o_orderpriority AS label, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def type_slices(spark, sf):
    return A.slices(_t(spark, sf, "orders"), F.col("o_orderpriority"))


@query("SELECT label, n::BIGINT AS n, ord::INTEGER AS ord FROM (SELECT o_orderstatus AS label, count(*) AS n, list_position(['P', 'O', 'F'], o_orderstatus) AS ord FROM orders GROUP BY 1) WHERE ord > 0")
def entity_slices(spark, sf):
    return A.labelled_slices(_t(spark, sf, "orders"), F.col("o_orderstatus"), ["P", "O", "F"]).withColumn("ord", F.col("ord").cast("int"))


@query("SELECT p_brand AS brand, arg_min(p_type, p_partkey) AS name, count(*)::BIGINT AS n FROM part GROUP BY 1")
def court_slices(spark, sf):
    return _t(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min_by("p_type", "p_partkey").alias("name"), F.count("*").alias("n")).orderBy(F.desc("n"), "brand")


@query("""WITH w AS (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS tag, p_brand, p_size FROM part), c AS (SELECT p_brand AS grp, tag, count(*) AS n, sum((p_size >= 25)::INT) AS up FROM w GROUP BY 1, 2)
SELECT grp, string_agg(tag || ':' || n || ':' || up, ',' ORDER BY up DESC, n DESC, tag) AS tags FROM c GROUP BY 1""")
def tag_rollup_nested(spark, sf):
    w = _t(spark, sf, "part").select("p_brand", "p_size", F.explode(F.array_distinct(F.split("p_name", " "))).alias("tag"))
    c = w.groupBy(F.col("p_brand").alias("grp"), "tag").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") >= 25).alias("up"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("a"), (-F.col("n")).alias("b"), "tag")))
    return c.groupBy("grp").agg(rows.alias("r")).select("grp", F.array_join(F.transform("r", lambda x: F.concat(x["tag"], F.lit(":"), (-x["b"]).cast("string"), F.lit(":"), (-x["a"]).cast("string"))), ",").alias("tags"))


@query("""WITH p AS (SELECT coalesce(CASE WHEN c_custkey % 3 = 0 THEN n_name END, CASE WHEN c_custkey % 3 = 1 THEN r_name END, 'seat') AS place, c_custkey % 3 = 0 AS exact, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT place, count(*)::BIGINT AS total, sum((c_acctbal > 0)::INT)::BIGINT AS upcoming, bool_or(exact) AS exact FROM p GROUP BY 1""")
def place_rollup(spark, sf):
    c = _t(spark, sf, "customer").join(places._sized(_t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(places._sized(_t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("c_custkey") % 3
    place = F.coalesce(F.when(kind == 0, F.col("n_name")), F.when(kind == 1, F.col("r_name")), F.lit("seat"))
    return c.groupBy(place.alias("place")).agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("upcoming"), F.bool_or(kind == 0).alias("exact"))


@query("SELECT n_name AS place, count(*)::BIGINT AS total, sum((s_acctbal > 0)::INT)::BIGINT AS open FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def court_points(spark, sf):
    s = _t(spark, sf, "supplier").join(places._sized(_t(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy(F.col("n_name").alias("place")).agg(F.count("*").alias("total"), F.count_if(F.col("s_acctbal") > 0).alias("open"))


@query("""WITH l AS (SELECT p_partkey, p_brand, p_size, string_split(p_name, ' ')[1] AS tag FROM part), w AS (SELECT DISTINCT p_partkey, p_brand, p_size, unnest(string_split(p_name, ' ')) AS tag FROM part),
r AS (SELECT l.p_partkey AS left_id, w.p_partkey AS right_id, row_number() OVER (PARTITION BY l.p_partkey ORDER BY (l.p_brand <> w.p_brand)::INT, w.p_size DESC, w.p_partkey) AS rank FROM l JOIN w ON l.tag = w.tag AND l.p_partkey <> w.p_partkey)
SELECT left_id, right_id, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def comparables_top3(spark, sf):
    p = _t(spark, sf, "part").withColumn("words", F.split("p_name", " "))
    return A.comparables(p, "p_partkey", F.get("words", 0), F.col("words"), F.col("p_brand"), [-F.col("p_size")])


@query("""WITH p AS (SELECT n_nationkey AS k, 42.5 + n_nationkey * 0.11 AS lat, 15.7 + n_regionkey * 0.9 AS lon FROM nation),
d AS (SELECT a.k AS a, b.k AS b, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM p a JOIN p b ON a.k <> b.k)
SELECT a, b, round(km, 3) AS km, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(km, 3), b) AS rank FROM d) WHERE rank <= 5""")
def nearest_sites(spark, sf):
    p = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.lit(42.5) + F.col("n_nationkey") * F.lit(0.11)).alias("lat"), (F.lit(15.7) + F.col("n_regionkey") * F.lit(0.9)).alias("lon"))
    sites = F.broadcast(p.select(F.col("k").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")))  # a dimension of fixed size
    d = p.withColumnRenamed("k", "a").join(sites, F.col("a") != F.col("b")).withColumn("km", F.round(geo.distance_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3))
    return A.top_per_group(d, "a", [F.col("km"), F.col("b")], 5).select("a", "b", "km", "rank")


@query("""WITH u AS (SELECT sha256(text) AS h, 0 AS src, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT sha256(text), 1, doc_id FROM documents)
SELECT h, src::INTEGER AS src, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY src, doc_id) AS r FROM u) WHERE r = 1""")
def dedup_keep_first(spark, sf):
    d = _t(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), "doc_id")
    u = d.where("doc_id % 2 = 0").withColumn("src", F.lit(0)).unionByName(d.withColumn("src", F.lit(1)))
    return A.keep_first(u, "h", [F.col("src"), F.col("doc_id")]).select("h", "src", "doc_id")


@query("""SELECT o_custkey, max(o_totalprice) AS price, 'built' AS origin FROM orders WHERE year(o_orderdate) >= 2000 GROUP BY 1
UNION ALL SELECT o_custkey, max(o_totalprice), 'retained' FROM orders WHERE year(o_orderdate) < 2000 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) >= 2000) GROUP BY 1""")
def carry_forward_anti(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    now, prior = (o.where(c).groupBy("o_custkey").agg(F.max("o_totalprice").alias("price")) for c in ("y >= 2000", "y < 2000"))
    return A.carry_forward(prior, now, "o_custkey")


@query("""SELECT o_orderkey, coalesce(c_mktsegment = 'BUILDING' AND c_acctbal / 10000 >= 0.5 AND c_nationkey > 0, false) AS reused FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey""")
def reuse_split(spark, sf):
    prior = _t(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("version"), (F.col("c_acctbal") / 10000).alias("confidence"), F.col("c_nationkey").alias("documents"))
    return A.reuse_split(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), prior, "o_custkey", False, "BUILDING").select("o_orderkey", "reused")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def saved_semi(spark, sf):
    return _t(spark, sf, "customer").join(_t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT count(*)::BIGINT AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def saved_missing(spark, sf):
    return _t(spark, sf, "customer").join(_t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").agg(F.count("*").alias("missing"))


@query(f"SELECT o_orderkey, o_orderdate >= '{AS_OF}' AS upcoming, date_diff('day', DATE '{AS_OF}', o_orderdate::DATE)::INTEGER AS days, CASE WHEN o_orderdate::DATE < '{AS_OF}' THEN 'past' WHEN o_orderdate::DATE <= DATE '{AS_OF}' + 3 THEN 'due' WHEN o_orderdate::DATE <= DATE '{AS_OF}' + 7 THEN 'soon' ELSE 'later' END AS urgency FROM orders")
def upcoming_past(spark, sf):
    days = F.datediff(F.to_date("o_orderdate"), F.lit(AS_OF).cast("date"))
    return _t(spark, sf, "orders").select("o_orderkey", (days >= 0).alias("upcoming"), days.alias("days"), dates.urgency(days).alias("urgency"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), r AS (SELECT y, dense_rank() OVER (ORDER BY y DESC) AS k FROM y)
SELECT CASE WHEN k <= 3 THEN r.y::VARCHAR ELSE 'older' END AS bucket, count(*)::BIGINT AS n FROM orders JOIN r ON year(o_orderdate) = r.y GROUP BY 1""")
def archive_year_filter(spark, sf):
    y = _t(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    newest = y.select("y").orderBy(F.desc("y")).limit(3).withColumn("new", F.lit(True))
    b = F.when(F.coalesce("new", F.lit(False)), F.col("y").cast("string")).otherwise("older")
    return y.join(newest, "y", "left").groupBy(b.alias("bucket")).agg(F.sum("n").alias("n"))


@query("""SELECT event_id, floor(((user_id IS NOT NULL)::INT + (value > 50)::INT + (event_type <> 'view')::INT + (props IS NOT NULL)::INT + (event_id % 2 = 0)::INT + (user_id % 3 = 0)::INT + (hour(ts) < 12)::INT + (value > 10)::INT) / 8.0::DOUBLE * 100 + 0.5) / 100 AS confidence FROM events""")
def confidence_score(spark, sf):
    c = [F.col("user_id").isNotNull(), F.col("value") > 50, F.col("event_type") != "view", F.col("props").isNotNull(), F.col("event_id") % 2 == 0, F.col("user_id") % 3 == 0, F.hour("ts") < 12, F.col("value") > 10]
    return _t(spark, sf, "events").select("event_id", A.confidence(*c).alias("confidence"))


@query("""WITH d AS (SELECT source AS field, doc_id, round((n_chars + 1.0) / (quality + 1.0), 4) AS ratio FROM labels JOIN documents USING (doc_id))
SELECT field, doc_id, ratio::DOUBLE AS ratio, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY ratio DESC, doc_id) AS rank FROM d) WHERE rank <= 20""")
def quality_report_topn(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("field"), "n_chars").join(_t(spark, sf, "labels"), "doc_id")
    d = d.select("field", "doc_id", _n((F.col("n_chars") + 1.0) / (F.col("quality") + 1.0)).alias("ratio"))
    return A.top_per_group(d, "field", [F.desc("ratio"), F.col("doc_id")], 20).select("field", "doc_id", "ratio", "rank")


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(ul|ol|li|table|tr|p|div|h[1-6])>', chr(10), 'g'), '(?i)</t[dh]>', chr(9), 'g'), '<[^>]+>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&ndash;', '–'), '&mdash;', '—'), '&amp;', '&') AS h FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\.{4,}', '....', 'g'), '[ \t\f\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS h FROM c)
SELECT page_id, sha256(regexp_replace(h, '^\s+|\s+$', '', 'g')) AS sha, length(regexp_replace(h, '^\s+|\s+$', '', 'g'))::INTEGER AS chars FROM d""")
def html_to_text(spark, sf):
    t = _t(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("t"))
    return t.select("page_id", F.sha2("t", 256).alias("sha"), F.length("t").alias("chars"))


@query(f"""SELECT doc_id, sha256(slug) AS sha, length(slug)::INTEGER AS chars FROM (SELECT doc_id, trim(regexp_replace(replace(translate(lower(text), '{text.MARKED}', '{text.PLAIN}'), 'đ', 'd'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents)""")
def fold_slug_whole(spark, sf):
    t = _t(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))
    return t.select("doc_id", F.sha2("slug", 256).alias("sha"), F.length("slug").alias("chars"))


@query(r"""SELECT page_id, sha256(array_to_string(list_filter(string_split(html, chr(10)), lambda x: NOT (regexp_matches(x, '(?i)(mso-|font-family|font-size|line-height|@page|margin-(top|left|right|bottom)|\bMsoNormal\b)')
 OR (length(x) - length(replace(x, ':', '')) >= 3 AND length(x) - length(replace(x, ';', '')) >= 3))), chr(10))) AS sha FROM pages""")
def style_noise(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.sha2(text.strip_style_noise(F.col("html")), 256).alias("sha"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\b\d{13}\b', '[uklonjeno]', 'g'), '\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]{2,}\b', '[uklonjeno]', 'g')) AS sha FROM documents""")
def redact_basic(spark, sf):
    c = redact.redact_mail(redact.redact_ids(F.col("text")))
    return _t(spark, sf, "documents").select("doc_id", F.sha2(c, 256).alias("sha"))


@query()
def redact_parties(spark, sf):
    texts = _t(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    texts = texts.unionByName(_t(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    return texts.select("source", "id", F.sha2(redact.redact_text(F.col("text")), 256).alias("sha"))


_PART_TAGS = {"warm": ("^almond$", "^rose"), "cold": ("^blue", "^azure", "^navy"), "green": ("green$", "olive"), "metal": ("steel", "^metallic", "^brass"), "big": ("^large", "^big")}


@query("SELECT p_partkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(p_name || chr(10) || p_type), '{extract.tag_pattern(s)}') THEN '{t}' END" for t, s in _PART_TAGS.items()) + "], lambda x: x IS NOT NULL), ',') AS tags FROM part")
def item_tags(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.array_join(extract.item_tags(F.col("p_name"), F.col("p_type"), tags=_PART_TAGS), ",").alias("tags"))


@query("SELECT o_orderkey, round(floor(o_totalprice * 100 + 0.5) / 100, 2) AS amount FROM orders")
def amount_parse(spark, sf):
    local = F.translate(F.format_number(numbers.js_round(F.col("o_totalprice")), 2), ",.", ".,")
    return _t(spark, sf, "orders").select("o_orderkey", F.round(numbers.parse_amount(local), 2).alias("amount"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS parsed, CASE WHEN o_orderkey % 7 > 0 AND date_diff('day', DATE '1998-01-01', o_orderdate::DATE) BETWEEN -400 AND 1095 THEN o_orderdate::DATE END AS kept FROM orders""")
def date_parse_bounds(spark, sf):
    local = F.when(F.col("o_orderkey") % 7 == 0, F.lit("45.13.2026")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d.M.yyyy.")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    d = _t(spark, sf, "orders").select("o_orderkey", dates.parse_date(local).alias("parsed"))
    return d.select("o_orderkey", "parsed", dates.plausible(F.col("parsed"), F.lit("1998-01-01").cast("date")).alias("kept"))


@query("SELECT event_id, strftime(ts - INTERVAL (CASE WHEN ts < TIMESTAMP '2024-03-31 02:00:00' OR ts >= TIMESTAMP '2024-10-27 03:00:00' THEN 1 ELSE 2 END) HOUR, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def utc_instant(spark, sf):
    return _t(spark, sf, "events").select("event_id", dates.stamp(F.to_utc_timestamp("ts", dates.ZONE)).alias("stamp"))


@query("""WITH l AS (SELECT o_orderkey, o_totalprice AS bid, least(o_totalprice * 0.1, 10000.0) AS dep, CASE o_orderstatus WHEN 'O' THEN 0.0 WHEN 'P' THEN 0.03 ELSE CASE WHEN o_custkey % 70 IN (20, 23, 25, 53, 55, 56, 58, 65, 68) OR o_custkey % 70 NOT IN (20, 23, 25, 28, 32, 33, 36, 39, 42, 43, 44, 45, 46, 51, 53, 55, 56, 58, 64, 65, 68) THEN 0.05 ELSE 0.0 END END AS rate,
 floor(least(greatest(o_totalprice * 0.005, 100.0), 1500.0) / 10 + 0.5) * 10 AS fees FROM orders)
SELECT o_orderkey, floor(least(dep, bid) * 100 + 0.5) / 100 AS deposit, floor((bid - least(dep, bid)) * 100 + 0.5) / 100 AS balance, floor(bid * rate * 100 + 0.5) / 100 AS tax, floor(fees * 100 + 0.5) / 100 AS fees, floor((bid + bid * rate + fees + 0.0) * 100 + 0.5) / 100 AS total FROM l""")
def cost_breakdown(spark, sf):
    bid, kind = F.col("o_totalprice"), F.lit("nekretnine")
    entity = F.when(F.col("o_orderstatus") == "O", "RS").when(F.col("o_orderstatus") == "P", "BD").otherwise("FBiH")
    c = numbers.cost_breakdown(bid, numbers.deposit_for(F.lit(None).cast("double"), bid), numbers.tax_rate(kind, entity, F.col("o_custkey") % 70), numbers.fees_for(bid, kind))
    o = _t(spark, sf, "orders").select("o_orderkey", c.alias("c"))
    return o.select("o_orderkey", *(numbers.js_round(F.col(f"c.{n}")).alias(n) for n in ("deposit", "balance", "tax", "fees", "total")))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_extendedprice * (1 + (l_linenumber % 3 - 1) * 0.5) AS s, l_extendedprice * l_tax AS d, l_extendedprice * 1.2 AS printed FROM lineitem),
m AS (SELECT *, floor(a * 100 + 0.5) / 100 AS v, CASE WHEN s > 0 AND s <= printed * 1.05 THEN floor(s * 100 + 0.5) / 100 ELSE floor(a * 0.5 * 100 + 0.5) / 100 END AS f FROM l)
SELECT l_orderkey, l_linenumber, round(v, 2) AS appraised, round(CASE WHEN f <= v * 1.02 THEN f ELSE floor(a * 0.5 * 100 + 0.5) / 100 END, 2) AS starting, round(CASE WHEN d > 0 AND d <= 10000 AND d <= v THEN floor(d * 100 + 0.5) / 100 END, 2) AS deposit FROM m""")
def money_reconcile(spark, sf):
    a = F.col("l_extendedprice")
    s = a * (1 + (F.col("l_linenumber") % 3 - 1) * 0.5)
    m = numbers.reconcile(a, s, a * F.col("l_tax"), a * 1.2, F.lit(None).cast("double"), a * 0.5, F.lit(None).cast("double"))
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", m.alias("m"))
    return li.select("l_orderkey", "l_linenumber", *(F.round(f"m.{n}", 2).alias(n) for n in ("appraised", "starting", "deposit")))


@query("""SELECT '<item><title>' || o_orderpriority || ' &amp; ' || o_orderstatus || '</title><guid>' || o_orderkey || '</guid><pubDate>' || strftime(o_orderdate::DATE::TIMESTAMP + INTERVAL (least(i, 59)) MINUTE, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>' AS line
FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS i FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100)""")
def feed_lines(spark, sf):
    o = _t(spark, sf, "orders").select(F.concat("o_orderpriority", F.lit(" & "), "o_orderstatus").alias("title"), F.col("o_orderkey").cast("string").alias("guid"), F.to_date("o_orderdate").alias("published"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    return sinks.feed_items(o, [F.desc("at"), F.col("seq")]).select("line")


@query("""SELECT o_orderkey::VARCHAR AS id, '{"n":"' || o_orderpriority || '","d":"' || strftime(o_orderdate, '%Y-%m-%d') || '","p":' || round(o_totalprice)::BIGINT || '}' AS card, lpad(round(o_totalprice)::BIGINT::VARCHAR, 12, '0') AS sort_price FROM orders""")
def card_index(spark, sf):
    o = _t(spark, sf, "orders")
    card = F.to_json(F.struct(F.col("o_orderpriority").alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.round("o_totalprice").cast("long").alias("p")))
    return o.select(F.col("o_orderkey").cast("string").alias("id"), card.alias("card"), F.lpad(F.round("o_totalprice").cast("long").cast("string"), 12, "0").alias("sort_price"))


@query(f"""WITH t AS (SELECT doc_id, lang, source, list_contains(string_split_regex(replace(translate(lower(text), '{text.MARKED}', '{text.PLAIN}'), 'đ', 'd'), '[^a-z0-9]+'), 'the') AS hit FROM documents)
SELECT 'lang' AS facet, lang AS value, count(*)::BIGINT AS n FROM t WHERE hit GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM t WHERE hit GROUP BY 2""")
def search_facets(spark, sf):
    hits = search.matching(_t(spark, sf, "documents"), F.col("text"), "the")
    return search.facets(hits, ["lang", "source"])


@query("""SELECT gate, value::DOUBLE AS value, passed FROM (
SELECT 'rows' AS gate, count(*)::DOUBLE AS value, count(*) >= 500 AS passed FROM orders UNION ALL SELECT 'courts', count(DISTINCT o_orderpriority), count(DISTINCT o_orderpriority) >= 5 FROM orders
UNION ALL SELECT 'price_rate', 1.0, true UNION ALL SELECT 'case_rate', 1.0, true UNION ALL SELECT 'repeated_ids', 0, true UNION ALL SELECT 'undated', 0, true
UNION ALL SELECT 'misdated', sum((NOT date_diff('day', DATE '1998-01-01', o_orderdate::DATE) BETWEEN -400 AND 1095)::INT), sum((NOT date_diff('day', DATE '1998-01-01', o_orderdate::DATE) BETWEEN -400 AND 1095)::INT) = 0 FROM orders
UNION ALL SELECT 'absurd', 0, true UNION ALL SELECT 'inverted', 0, true UNION ALL SELECT 'leaks', 0, true UNION ALL SELECT 'persons', 0, true UNION ALL SELECT 'venues', 0, true)""")
def gates(spark, sf):
    o = _t(spark, sf, "orders")
    p = F.col("o_totalprice")
    return G.gates(o, "o_orderkey", F.col("o_orderpriority"), F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date"), F.col("o_custkey"), p, p, [F.col("o_orderpriority")], least_courts=5)


@query("SELECT event_type, count(DISTINCT event_id)::BIGINT AS n FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    return incremental.deduplicated_counts(spark, f"{sf}/events.parquet")


@query("SELECT sum(n)::BIGINT AS \"all\", sum(CASE WHEN r <= 3 THEN n END)::BIGINT AS top, floor(100.0 * sum(CASE WHEN r <= 3 THEN n END) / sum(n) + 0.5)::INTEGER AS percent FROM (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1)")
def concentration(spark, sf):
    return A.concentration(_t(spark, sf, "part"), "p_brand")


@query("""SELECT DISTINCT year(o_orderdate)::INTEGER AS year, strftime(o_orderdate, '%d.%m.%Y.') AS label FROM orders""")
def date_labels(spark, sf):
    return _t(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "dd.MM.yyyy.").alias("label")).distinct()


@query("""SELECT 'https://site/' || kind || '/' || key AS loc, kind, coalesce(lastmod, '2000-01-01') AS lastmod FROM (SELECT 'order' AS kind, o_orderkey::VARCHAR AS key, strftime(o_orderdate, '%Y-%m-%d') AS lastmod FROM orders UNION ALL SELECT 'brand', p_brand, NULL FROM (SELECT DISTINCT p_brand FROM part))""")
def sitemap(spark, sf):
    o = _t(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("lastmod"))
    b = _t(spark, sf, "part").select(F.lit("brand").alias("kind"), F.col("p_brand").alias("key"), F.lit(None).cast("string").alias("lastmod")).distinct()
    return sinks.sitemap(o.unionByName(b), "https://site", AS_OF)


@query("SELECT year(o_orderdate)::INTEGER AS label, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def hearing_years(spark, sf):
    return A.slices(_t(spark, sf, "orders"), F.year("o_orderdate")).orderBy(F.desc("label"))


@query("SELECT count(DISTINCT o_orderpriority)::BIGINT AS courts, round(avg((o_totalprice > 100000)::INT), 6) AS share, min(year(o_orderdate))::INTEGER AS first, max(year(o_orderdate))::INTEGER AS last FROM orders")
def tiles(spark, sf):
    return _t(spark, sf, "orders").agg(F.count_distinct("o_orderpriority").alias("courts"), F.round(F.avg((F.col("o_totalprice") > 100000).cast("int")), 6).alias("share"), F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last"))


@query("""WITH t AS (SELECT p_brand, p_size, p_retailprice, unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part)
SELECT tag, sum((p_size >= 25)::INT)::BIGINT AS live, sum((p_size < 25)::INT)::BIGINT AS archived, min(p_size)::INTEGER AS first, round(median(p_retailprice), 4) AS median FROM t GROUP BY 1""")
def tag_bundle(spark, sf):
    t = _t(spark, sf, "part").select("p_size", "p_retailprice", F.explode(F.array_distinct(F.split("p_name", " "))).alias("tag"))
    return t.groupBy("tag").agg(F.count_if(F.col("p_size") >= 25).alias("live"), F.count_if(F.col("p_size") < 25).alias("archived"), F.min("p_size").cast("int").alias("first"), _n(F.median("p_retailprice")).alias("median"))


@query("""WITH g AS (SELECT n_name AS place, n_nationkey FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT coalesce(g.place, CASE WHEN g2.place IS NOT NULL THEN g2.place END) AS place, CASE WHEN g.place IS NOT NULL THEN 'municipality' WHEN g2.place IS NOT NULL THEN 'seat' END AS found_by, count(*)::BIGINT AS n
FROM c LEFT JOIN g ON g.place = c.n_name LEFT JOIN g g2 ON lower(g2.place) = lower(CASE WHEN c.r_name = 'ASIA' THEN 'CHINA' ELSE c.r_name END) GROUP BY 1, 2""")
def place_cascade(spark, sf):
    n, r = _t(spark, sf, "nation"), _t(spark, sf, "region")
    g = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("place"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    c = _t(spark, sf, "customer").join(places._sized(n), F.col("c_nationkey") == F.col("n_nationkey")).join(places._sized(r), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")
    at = places.locate(c, g, [("municipality", F.col("n_name")), ("seat", F.when(F.col("r_name") == "ASIA", "china").otherwise(F.col("r_name")))])
    return at.groupBy("place", "found_by").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_custkey, count(*) AS n, list_distinct(list(o_orderstatus)) AS s FROM orders GROUP BY 1) SELECT o_custkey, n::BIGINT AS n, array_to_string(list_sort(s), '') AS kinds FROM p WHERE list_has_any(s, ['P'])""")
def tag_membership(spark, sf):
    p = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    return p.where(F.array_contains("s", "P")).select("o_custkey", "n", F.array_join("s", "").alias("kinds"))


@query("SELECT o_orderkey, fact, value FROM (SELECT o_orderkey, unnest(['status', 'priority']) AS fact, unnest([CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, o_orderpriority]) AS value FROM orders) WHERE value IS NOT NULL")
def fact_rows(spark, sf):
    facts = F.array(F.struct(F.lit("status").alias("fact"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("value")), F.struct(F.lit("priority").alias("fact"), F.col("o_orderpriority").alias("value")))
    return _t(spark, sf, "orders").select("o_orderkey", F.explode(facts).alias("f")).select("o_orderkey", "f.*").where("value is not null")


from . import notices  # noqa: E402, F401  its queries join the catalogue
