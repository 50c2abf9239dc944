"""Benchmark decontamination with DataFrame functions only.

A text is contaminated by an item if one of its windows of the item's size has a weighted similarity of at
least 0.8 to it: over 5-word shingles with their counts, the sum of the lesser counts by the sum of the
greater. A window needs a certain number of shingles in common with items of its size; all windows that
have them get a SimHash of 64 bits, from running sums of votes along the text. A multi-index over four
blocks of 16 bits finds every item fingerprint within RADIUS bits: one block of any such pair differs in no
more than RADIUS // 4 bits, and index and probes together hold all block values that near. The exact
similarity verifies what it finds; running sums give it for all windows of a text at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, dropped, text_or_empty, written

SIZE = 5
LEAST = 0.8
#: Bits that fingerprints of a window and an item at similarity 0.8 exceed once in some 1,600 cases.
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
#: Rows of two or three numbers (shingles of the items, keys of texts with one) that may be broadcast.
BROADCAST_ROWS = 500_000
_LANES = 32


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, size: int = SIZE) -> Column:
    """Hashes of ``size`` words in a row, in order; none of fewer words. ``w`` must be a column, or each shingle makes it anew."""
    at = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))


def _lanes(h: Column) -> list[Column]:
    """64 bits in 32 columns, two of them in each: as lanes of 32 bits, which no text's shingles fill."""
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(0x0000000100000001)) for k in range(_LANES)]


_V = [f"v{k}" for k in range(_LANES)]


def _fingerprint(n: Column) -> Column:
    """Of each bit the majority of ``n`` votes, from their sums ``v0`` to ``v31``."""
    out = F.lit(0).cast("long")
    for k in range(_LANES):
        for j, votes in enumerate((F.col(_V[k]).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(_V[k]), 32))):
            bit = 1 << (_LANES * j + k)
            out = out.bitwiseOR(F.when(votes * 2 > n, F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0)).cast("long"))
    return out


def _flips(radius: int) -> list[int]:
    return [v for v in range(1 << BLOCK_BITS) if v.bit_count() <= radius]


def _turned(near: Column, value: Column) -> Column:
    return F.transform(near, lambda x: value.bitwiseXOR(x))


def _buckets(fp: Column, flips: list[int]) -> Column:
    """One row for each block and each of its values with the bits of ``flips`` turned; equal lengths meet only."""
    near = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<long>")  # folded to a literal
    value = lambda i: (F.col("len").cast("long") * BLOCKS + i) * (1 << BLOCK_BITS) + F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    blocks = [_turned(near, value(i)) for i in range(BLOCKS)]
    return F.explode(F.concat(*blocks))


def _sizable(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table for broadcast if it is proven small; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def _starts(hit: DataFrame) -> DataFrame:
    """``(key, n, len, start)``: the windows with as many of the items' shingles as similarity LEAST needs.

    Of the sorted places of a text's hits, each run of so many marks the starts of the windows around it;
    a start that the run before marks isn't marked again.
    """
    all_ = F.col("len") - (SIZE - 1)
    need = F.ceil(LEAST / (1 + LEAST) * (F.least("n", all_) + all_) - 1e-9).cast("int")
    places = hit.groupBy("key", "n", "len").agg(F.sort_array(F.collect_set("at")).alias("ps")).withColumn("need", need).where(F.size("ps") >= F.col("need"))  # bounded by one text
    run = lambda i: F.struct(
        F.greatest(F.lit(0), F.get("ps", i + F.col("need") - 1) - all_ + 1, F.when(i > 0, F.get("ps", i - 1) + 1).otherwise(0)).alias("lo"),
        F.least(F.get("ps", i), F.greatest(F.lit(0), F.col("n") - all_)).alias("hi"),
    )
    runs = places.select("key", "n", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size("ps") - F.col("need")), run)).alias("r")).where("r.lo <= r.hi")
    return runs.select("key", "n", "len", F.explode(F.sequence("r.lo", "r.hi")).alias("start"))


def _prints(starts: DataFrame, sets: DataFrame) -> DataFrame:
    """``(key, len, start, fp)``: the windows' fingerprints, as differences of running sums of votes."""
    n = F.least("n", F.col("len") - (SIZE - 1))
    ends = F.explode(F.array(F.struct((F.col("start") + n - 1).alias("pos"), F.lit(1).alias("sign")), F.struct((F.col("start") - 1).alias("pos"), F.lit(-1).alias("sign")))).alias("e")
    marks = starts.select("key", "len", "start", n.alias("n"), ends).select("key", "e.pos", F.lit(1).alias("mark"), F.lit(0).cast("long").alias("h"), "len", "start", "n", "e.sign")
    none = F.lit(None).cast("int")
    tokens = sets.select("key", "lo", F.posexplode("hs").alias("i", "h")).select("key", (F.col("lo") + F.col("i")).alias("pos"), F.lit(0).alias("mark"), "h", none.alias("len"), none.alias("start"), none.alias("n"), none.alias("sign"))
    so_far = W.partitionBy("key").orderBy("pos", "mark").rowsBetween(W.unboundedPreceding, 0)
    sums = tokens.unionByName(marks).select("key", "len", "start", "n", "sign", "mark", *(F.sum(x).over(so_far).alias(v) for v, x in zip(_V, _lanes(F.col("h"))))).where("mark = 1")
    return sums.groupBy("key", "len", "start", "n").agg(*(F.sum(F.col("sign") * F.col(v)).alias(v) for v in _V)).select("key", "len", "start", _fingerprint(F.col("n")).alias("fp"))


def _similarities(pairs: DataFrame, sets: DataFrame, counts: DataFrame) -> DataFrame:
    """``(key, no, len, start, n, both)`` of candidate windows and items: the sum of lesser counts.

    An item's shingle that it has ``c`` times adds one to each window that holds a place of it but not the
    ``c``-th place before, so a place adds to an interval of starts; running sums over the ends of all
    intervals give every window's sum.
    """
    all_ = F.col("len") - (SIZE - 1)
    items = pairs.select("key", "no", "len").distinct()
    places = items.join(sets, "key").select("key", "no", "len", "n", "lo", F.posexplode("hs").alias("i", "h")).join(counts, ["no", "h"])
    by = places.groupBy("key", "no", "len", "n", "h", "c").agg(F.sort_array(F.collect_list(F.col("lo") + F.col("i"))).alias("ps"))  # bounded by one text
    at = by.select("key", "no", "len", "n", "c", "ps", F.posexplode("ps").alias("i", "at"))
    before = F.when(F.col("i") >= F.col("c"), F.get("ps", F.col("i") - F.col("c").cast("int"))).otherwise(-1)
    ends = at.select("key", "no", F.greatest(F.lit(0), before + 1, F.col("at") - all_ + 1).alias("a"), (F.least("at", F.greatest(F.lit(0), F.col("n") - all_)) + 1).alias("b")).where("a < b")
    steps = ends.select("key", "no", F.explode(F.array(F.struct(F.col("a").alias("start"), F.lit(1).alias("step")), F.struct(F.col("b").alias("start"), F.lit(-1).alias("step")))).alias("s")).select("key", "no", "s.start", "s.step", F.lit(False).alias("wanted"))
    marks = pairs.select("key", "no", "start", F.lit(0).alias("step"), F.lit(True).alias("wanted"))
    sums = steps.unionByName(marks).withColumn("both", F.sum("step").over(W.partitionBy("key", "no").orderBy("start"))).where("wanted").select("key", "no", "start", "both")
    return sums.join(items, ["key", "no"])


def _short(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``(key, no, start)`` of items of fewer than SIZE words, each one shingle of them all: where a text first has it."""
    out = None
    for size in sorted(r[0] for r in items.where(F.col("len") < SIZE).select("len").distinct().collect()):  # four lengths at most
        own = items.where(F.col("len") == size).select("no", shingles(F.col("w"), size)[0].alias("h"))
        at = texts.select("key", words(F.col("t")).alias("w")).select("key", shingles(F.col("w"), size).alias("hs")).select("key", F.posexplode_outer("hs").alias("start", "h"))
        found = at.join(_sizable(own), "h").groupBy("key", "no").agg(F.min("start").alias("start"))
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(doc id, item id, similarity, start_word, end_word)``: of each text and item the best window, the first of equals.

    A text shorter than the item is one window. An item of fewer than five words is one shingle of them all
    and is found where a text has these words in a row; items without words are found nowhere, null and
    empty texts have no windows. Rows with equal id and text are one; null ids stay null; other columns are
    not read. Without any item or match there is no row.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words(text_or_empty(item_text)).alias("w")).where(F.size("w") > 0).dropDuplicates()
    items = written(items.withColumn("len", F.size("w")).withColumn("no", F.monotonically_increasing_id()), "items")
    parts = items.select("no", "len", "w").select("no", "len", F.explode(shingles(F.col("w"))).alias("h"))
    sizes = written(parts.select("h", "len").distinct(), "sizes")

    key = F.xxhash64(F.col(id_col), text_or_empty(text)).alias("key")
    texts = docs.select(key, F.col(id_col).alias("doc"), text_or_empty(text).alias("t"))
    at = texts.select("key", words(F.col("t")).alias("w")).select("key", shingles(F.col("w")).alias("hs")).select("key", F.size("hs").alias("n"), F.posexplode_outer("hs").alias("at", "h"))  # not the inner form: Spark would derive a filter from it that makes all shingles once more
    starts = written(_starts(at.join(_sizable(sizes), "h").select("key", "n", "len", "at")), "starts")

    wide = F.least("n", F.col("len") - (SIZE - 1))
    found = _sizable(written(starts.groupBy("key").agg(F.min("start").alias("lo"), F.max(F.col("start") + wide).alias("hi")), "found"))
    own = texts.join(found, "key").select("key", "doc", "lo", "hi", words(F.col("t")).alias("w")).select("key", "doc", "lo", "hi", shingles(F.col("w")).alias("hs")).dropDuplicates(["key"])
    sets = written(own.select("key", "doc", "lo", F.size("hs").alias("n"), F.slice("hs", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("hs")), "sets")

    prints = written(_prints(starts, sets), "prints")
    item_prints = parts.groupBy("no", "len").agg(F.count("*").alias("n"), *(F.sum(x).alias(v) for v, x in zip(_V, _lanes(F.col("h"))))).select("no", "len", _fingerprint(F.col("n")).alias("item_fp"))
    wanted = written(prints.select("len", "fp").distinct(), "wanted")
    # the bits that a block may differ in are turned in part in the index, in part in the probes: whatever makes fewer rows
    many = items.count(), wanted.count()
    most = RADIUS // BLOCKS
    turned = min(range(most + 1), key=lambda r: many[0] * len(_flips(r)) + many[1] * len(_flips(most - r)))
    index = item_prints.select("no", "item_fp", _buckets(F.col("item_fp"), _flips(turned)).alias("bucket"))
    probes = wanted.select("len", "fp", _buckets(F.col("fp"), _flips(most - turned)).alias("bucket"))
    near = probes.join(index.hint("merge"), "bucket").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("len", "fp", "no").distinct()
    near = written(near, "near")
    pairs = written(prints.join(_sizable(near), ["len", "fp"]).select("key", "len", "start", "no"), "pairs")

    counts = parts.groupBy("no", "h").agg(F.count("*").alias("c"))
    alike = _similarities(pairs, sets.select("key", "lo", "n", "hs"), _sizable(written(counts, "counts"))).join(sets.select("key", "doc", "n"), "key").withColumn("width", wide)
    alike = alike.withColumn("similarity", F.col("both") / (F.col("width") + F.col("len") - (SIZE - 1) - F.col("both"))).where(F.col("similarity") >= LEAST)
    best = alike.groupBy("key", "doc", "no").agg(F.max(F.struct(F.col("similarity").alias("s"), (-F.col("start")).alias("back"), F.col("width").alias("n"))).alias("best"))
    names = _sizable(items.select("no", "item"))
    out = best.join(names, "no").select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("best.s").alias("similarity"), (-F.col("best.back")).alias("start_word"), (F.col("best.n") + SIZE - 1 - F.col("best.back")).alias("end_word")
    )
    short = _short(texts, items)
    if short is not None:
        ids = texts.select("key", "doc").distinct()
        short = short.join(ids, "key").join(items.select("no", "item", "len"), "no")
        out = out.unionByName(short.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.lit(1.0).alias("similarity"), F.col("start").alias("start_word"), (F.col("start") + F.col("len")).alias("end_word")))
    out = written(out, "contamination")
    dropped(docs.sparkSession, items, sizes, starts, sets, prints, wanted, near, pairs)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every window of every text by brute force, in DuckDB.
ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
bw AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark)),
ds AS (SELECT doc_id, i - 1 AS pos, len(w) - 4 AS n, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
bs AS (SELECT item_id, len(w) AS size, len(w) - 4 AS total, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw)),
bc AS (SELECT item_id, size, total, s, count(*) AS c FROM bs GROUP BY ALL),
cand AS (SELECT DISTINCT doc_id, item_id, size, total, n, unnest(range(greatest(0, pos - (size - 5)), greatest(0, least(pos, n - total)) + 1)) AS start FROM ds JOIN bc USING (s)),
own AS (SELECT c.doc_id, c.item_id, c.size, c.total, c.start, c.n, d.s, count(*) AS w FROM cand c JOIN ds d ON d.doc_id = c.doc_id AND d.pos >= c.start AND d.pos < c.start + c.total GROUP BY ALL),
sim AS (SELECT o.doc_id, o.item_id, o.start, least(o.n, o.total) AS win, sum(least(o.w, bc.c))::DOUBLE AS both_, o.total FROM own o JOIN bc ON bc.item_id = o.item_id AND bc.s = o.s GROUP BY ALL),
scored AS (SELECT *, both_ / (win + total - both_) AS similarity FROM sim),
short AS (SELECT doc_id, item_id, min(i) - 1 AS start, any_value(len(bw.w)) AS size FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw) d JOIN bw ON len(bw.w) BETWEEN 1 AND 4 AND d.w[i:i + len(bw.w) - 1] = bw.w GROUP BY ALL)
SELECT doc_id, item_id, similarity, start::INTEGER AS start_word, (start + win + 4)::INTEGER AS end_word
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM scored WHERE similarity >= 0.8) WHERE r = 1
UNION ALL SELECT doc_id, item_id, 1.0::DOUBLE, start::INTEGER, (start + size)::INTEGER FROM short
"""
