"""Ranks and short lists against plain sorting, and geometry on the driver."""

import random

from pyspark.sql import functions as F

from noticeworks.functions import geo, text
from noticeworks.operators import analytics


def test_medians_by_rank(spark):
    r = random.Random(2)
    rows = [(k % 3, float(r.randrange(50) if k % 3 == 1 else r.random() * 1000)) for k in range(20_001)] + [(5, 1.0), (5, 4.0), (6, None), (7, 2.0)]
    df = spark.createDataFrame(rows, "key int, value double")
    want = {x.key: (x.n, x.m) for x in df.groupBy("key").agg(F.count("*").alias("n"), F.median("value").alias("m")).collect()}
    assert {x.key: (x.n, x.median) for x in analytics._medians_by_rank(df).collect()} == want


def test_values_at_ranks(spark):
    r = random.Random(3)
    values = [float(r.choice((r.randrange(40), r.random() * 1e6))) for _ in range(30_000)]
    v = spark.createDataFrame([(x,) for x in values], "v double")
    ranks = (0, 1500, 14_999, 28_500, 29_999)
    assert analytics.at_ranks(v, ranks, len(values), few=100) == [sorted(values)[k] for k in ranks]


def test_comparables_by_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.choice("abc") for _ in range(r.randint(1, 3))], r.choice(["x", "y", None]), r.randrange(6)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, tags array<string>, near string, size int")
    got = {(x.left_id, x.rank): x.right_id for x in analytics.comparables(df, "id", F.get("tags", 0), F.col("tags"), F.col("near"), [-F.col("size")]).collect()}
    want = {}
    for i, tags, near, _ in rows:
        others = sorted((n != near, -s, j) for j, t, n, s in rows if j != i and tags[0] in t)
        want |= {(i, k + 1): j for k, (_, _, j) in enumerate(others[:3])}
    assert got == want


def test_simplified_line():
    line = [(float(i), 0.0 if i != 5 else 3.0) for i in range(11)]
    assert geo.simplified(line, 0.5) == [(0.0, 0.0), (4.0, 0.0), (5.0, 3.0), (6.0, 0.0), (10.0, 0.0)] and geo.simplified(line, 5.0) == [line[0], line[-1]] and geo.simplified([], 1.0) == []


def test_marks_of_three_scripts(spark):
    given = ["Tiếng Việt", "ΆΈΉ", "cˇ".replace("ˇ", "̌") + "evapi", "&#128512;&#x10FFFF;&#xD800;&#0;"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    folded, decoded = [r.f for r in df.orderBy("i").select(text.fold(F.col("v")).alias("f")).collect()], df.where("i = 3").select(text.decode_entities(F.col("v")).alias("d")).first().d
    assert folded[:3] == ["tieng viet", "αεη", "cevapi"] and decoded == "😀\U0010ffff&#xD800;&#0;"
    assert df.where("i = 2").select(text.composed(F.col("v")).alias("c")).first().c == "čevapi"
