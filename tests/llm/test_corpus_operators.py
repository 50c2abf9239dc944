"""Near duplicates, contamination, repeated passages, language model, quality, WARC and the pipeline, by brute force on small tables."""

import io
import random
import time
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noticeworks.llm import decontaminate, elias_fano, graphs, ngram_lm, quality, simhash_dedup, substring_dedup, warc

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes_by_brute_force(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    held = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            held[x].add(d)
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in held[x] if e > d).items():
            if n / (len(s) + len(sets[e]) - n) >= 0.8:
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return {d: top(d) for d in sets}


def test_near_duplicates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in simhash_dedup.near_duplicates(docs).collect()}
    assert got == classes_by_brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_oversized_buckets(spark):
    """With a cap of 8 nodes a group of 60 near copies is regrouped again and again and still one class."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(60):
        w = list(words)
        w[r.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(50))) for i in range(40)]
    got = {x.doc_id: x.class_id for x in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cap=8).collect()}
    assert {got[i] for i in range(60)} == {0} and all(got[100 + i] == 100 + i for i in range(40))


def test_near_duplicates_of_odd_rows(odd, none):
    rows = simhash_dedup.near_duplicates(odd).collect()
    got = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    assert len(rows) == odd.count() and got[1] == got[2] == got[3] == 1 and got[9] == 8 and all(got[i] == i for i in (4, 5, 6, 7, 10, 11))
    assert all(r.class_id is None for r in rows if r.doc_id is None)
    assert simhash_dedup.near_duplicates(none).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (50, 60)], "a long, b long")
    got = {r.node: r.label for r in graphs.components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40}


def test_contamination(spark, odd, none):
    r = random.Random(8)
    make = lambda n: [("".join(r.choice("abcdefghij") for _ in range(5))) for _ in range(n)]
    items = [(i, " ".join(make(30))) for i in range(4)] + [(9, "too short"), (10, None)]
    first, second = items[0][1].split(), items[1][1].split()
    docs = [(1, " ".join(make(50) + first + make(50))), (2, " ".join(make(10) + second[:15] + ["other"] + second[16:] + make(10)).upper()), (3, " ".join(make(80))), (4, " ".join(first[:12] + make(60))), (5, " ".join(first[:27])), (6, None), (6, None), (7, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (round(x.similarity, 9), x.start_word, x.end_word) for x in decontaminate.contamination(d, b).collect()}
    c = duckdb.connect()
    for name, rows in (("documents", docs), ("benchmark", items)):
        c.execute(f"CREATE TABLE {name} ({'doc_id' if name == 'documents' else 'item_id'} BIGINT, text VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert got == {(x[0], x[1]): (round(x[2], 9), x[3], x[4]) for x in c.sql(decontaminate.ORACLE).fetchall()}
    assert (1, 0) in got and (5, 0) in got and not any(k[0] in (3, 4) for k in got)
    assert decontaminate.contamination(none, b).collect() == [] and decontaminate.contamination(odd, b.limit(0)).collect() == []


def test_contamination_by_long_and_short_items(spark, odd):
    """An item of 40,000 words, items of fewer than five, odd rows against real items, and rows equal in id."""
    r = random.Random(1)
    big = [f"w{r.randrange(10**9)}" for _ in range(40_000)]
    items = [(1, " ".join(big)), (2, "alpha beta gamma"), (3, None), (4, "Alpha"), (5, "one two three four five"), (6, ""), (4, "Alpha")]
    docs = [(1, " ".join(["x"] * 50 + big + ["y"] * 20)), (2, "the alpha beta, GAMMA alpha"), (3, " ".join(big[:36_000])), (4, "one two three four five"), (5, None), (None, "of alpha"), (4, "none of it")]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("len", F.lit("clash")).withColumn("no", F.lit("clash"))
    rows = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()
    got = {(x.doc_id, x.item_id): (round(x.similarity, 4), x.start_word, x.end_word) for x in rows}
    assert got == {(1, 1): (1.0, 50, 40_050), (3, 1): (0.9, 0, 36_000), (2, 2): (1.0, 1, 4), (2, 4): (1.0, 1, 2), (4, 5): (1.0, 0, 5), (None, 4): (1.0, 1, 2)} and len(rows) == 6
    base = odd.where("doc_id = 1").first().text.split()
    b = spark.createDataFrame([(1, " ".join(base[10:50])), (1, " ".join(base[10:50])), (2, None)], "item_id long, text string")
    assert {(x.doc_id, x.start_word, x.end_word) for x in decontaminate.contamination(odd, b).collect()} == {(1, 10, 50), (2, 10, 50), (3, 10, 50)}


def test_repeated_passages(spark, odd, none):
    r = random.Random(6)
    make = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    p, line = make(60), make(20)
    changed = p[:30] + ["zz"] + p[31:] + make(1)
    docs = [(i, make(r.randint(0, 80)) + p + make(r.randint(0, 80))) for i in range(12)] + [(20, make(40) + line + make(40)), (21, line + make(60)), (22, make(200)), (23, make(30) + changed + make(30))]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    words, cover = dict(docs), defaultdict(set)
    for x in rows:
        cover[x.doc_id] |= set(range(x.start_word, x.end_word))
        cover[x.first_doc_id] |= set(range(x.first_start, x.first_end))
        a, b = shingle_set(" ".join(words[x.doc_id][x.start_word : x.end_word])), shingle_set(" ".join(words[x.first_doc_id][x.first_start : x.first_end]))
        assert len(a & b) / len(a | b) == pytest.approx(x.similarity) and x.similarity >= 0.8 and x.end_word - x.start_word >= 50
    for i in range(12):
        at = next(k for k in range(len(words[i])) if words[i][k : k + 60] == p)
        assert cover[i] >= set(range(at, at + 60))
    assert 23 in cover and not {20, 21, 22} & set(cover)
    assert {x.doc_id for x in substring_dedup.repeated_passages(odd).collect()} | {x.first_doc_id for x in substring_dedup.repeated_passages(odd).collect()} == {1, 2, 3}
    assert substring_dedup.repeated_passages(none).collect() == []


def test_passages_do_not_depend_on_partitions(spark):
    """The same rows at 1, 4 and 16 partitions, and every repeated run of 50 words of the documents is covered."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = [sorted(map(tuple, substring_dedup.repeated_passages(docs.repartition(n, "doc_id")).collect())) for n in (1, 4, 16)]
    assert made[0] == made[1] == made[2] and len(made[0]) > 100
    words = {r.doc_id: re.findall(r"[^\W_]+", r.text.lower()) for r in docs.dropDuplicates().collect() if r.text}
    cover = defaultdict(set)
    for d, i, j, e, k, m, _ in made[0]:
        cover[d] |= set(range(i, j))
        cover[e] |= set(range(k, m))
    held = defaultdict(list)
    for d, w in words.items():
        for i in range(len(w) - 49):
            held[hash(tuple(w[i : i + 50]))].append((d, i))
    again = [x for x in held.values() if len({d for d, _ in x}) > 1]
    missed = [(d, i) for x in again for d, i in x if not cover[d] >= set(range(i, i + 50))]
    assert len(missed) <= 0.01 * sum(map(len, again))


def test_passages_with_a_word_changed(spark):
    """Recall at one changed, added or missing word in 50, each in a text of its own with a near copy elsewhere."""
    r = random.Random(9)
    make = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    docs = []
    for k in range(150):
        n = r.choice((60, 100, 150))
        p = make(n)
        q = list(p)
        for at in range(25, n, 50):
            place = at + r.randrange(-10, 10)
            q[place : place + r.choice((1, 1, 0))] = r.choice(([make(1)[0]], [make(1)[0]], []))
        docs += [(2 * k, make(r.randint(0, 60)) + p + make(r.randint(0, 60))), (2 * k + 1, make(r.randint(0, 60)) + q + make(r.randint(0, 60)))]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    pairs = {tuple(sorted((x.doc_id, x.first_doc_id))) for x in rows}
    assert all(a // 2 == b // 2 for a, b in pairs) and len(pairs) >= 0.9 * 150


def test_compact_windows():
    r = np.random.default_rng(1)
    h = r.integers(0, 50, 80)
    windows = substring_dedup.compact_windows(h, 10)
    for i in range(80):
        for j in range(i + 10, 81):  # every subsequence belongs to exactly one window, by its least hash
            mine = [c for lo, c, hi in windows if lo <= i <= c < j <= hi]
            assert len(mine) == 1 and h[mine[0]] == h[i:j].min()


def test_windows_of_many_texts():
    """The same least tokens as the Cartesian tree's nodes, with the extents as far as a passage reaches."""
    r = np.random.default_rng(5)
    sizes = [0, 3, 10, 200, 45, 77, 10, 0, 64]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    h = r.integers(0, 2**63, offsets[-1]).astype(np.uint64)
    h[20:60] = h[100:140]
    at, left, right = substring_dedup.windows_of(h, offsets, 10)
    got = set(zip(at.tolist(), left.tolist(), right.tolist()))
    want = {(c + a, min(c - lo, 9), min(hi - 1 - c, 9)) for a, b in zip(offsets, offsets[1:]) for lo, c, hi in substring_dedup.compact_windows(h[a:b], 10)}
    assert {x[0] for x in got} == {x[0] for x in want} and got == want


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (1000, 2000), (50_000, 2**40), (3000, 2**64 - 1)):
        v = np.unique(np.concatenate([r.integers(0, top, n, dtype=np.uint64, endpoint=True), (top // 2 + np.arange(min(n, top // 4))).astype(np.uint64)]))
        e = elias_fano.EliasFano(elias_fano.unpack(elias_fano.pack(elias_fano.encode(v))))
        assert len(v) == 0 or ((e.get(np.arange(len(v))) == v).all() and (e.find(v) == np.arange(len(v))).all())
        q = np.setdiff1d(r.integers(0, top, 500, dtype=np.uint64, endpoint=True), v)
        assert (e.find(q) == -1).all()


def test_language_model(spark, none, odd):
    import math

    r = random.Random(3)
    voc = ["a", "b", "C", "dd", "e,", "f"]
    texts = [" ".join(r.choice(voc[:3] if r.random() < 0.7 else voc) for _ in range(r.randint(0, 25))) for _ in range(40)] + [None, "", "zz  new\ta b\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = ngram_lm.train(df, F.col("doc_id") % 5 != 1)
    got = {x.doc_id: x for x in ngram_lm.score(df, model).collect()}
    tok = lambda t: [w.lower() for w in (t or "").split()] + ["</s>"]
    train = [tok(t) for i, t in enumerate(texts) if i % 5 != 1]
    c1 = Counter(w for t in train for w in t)
    c2, c3 = Counter(p for t in train for p in zip(t, t[1:])), Counter(p for t in train for p in zip(t, t[1:], t[2:]))
    k2, k3 = ({p: c for p, c in x.items() if c >= 2} for x in (c2, c3))
    n, v = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 0.5) / (n + 0.5 * (v + 1))
    rest1 = lambda u: 1 - sum((c - 0.75) / c1[u] for (a, _), c in k2.items() if a == u) if u in c1 else 1
    rest2 = lambda p: 1 - sum((c - 0.75) / c2[p] for (a, b, _), c in k3.items() if (a, b) == p)
    p2 = lambda u, w: (k2[u, w] - 0.75 if (u, w) in k2 else 0) / max(1, c1[u]) + rest1(u) * p1(w)

    def p3(t, u, w):
        return p2(u, w) if (t, u) not in k2 else (k3[t, u, w] - 0.75 if (t, u, w) in k3 else 0) / c2[t, u] + rest2((t, u)) * p2(u, w)

    assert (model.total, model.words) == (n, v)
    for i, t in enumerate(texts):
        w = tok(t)
        own = sum(math.log10(p1(x) if j == 0 else p2(w[0], x) if j == 1 else p3(w[j - 2], w[j - 1], x)) for j, x in enumerate(w))
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(x in c1 for x in w)
        assert got[i].base_score == pytest.approx(sum(math.log10(p1(x)) for x in w)) and abs(got[i].score - own) < 0.02 * len(w)
    empty = ngram_lm.train(none, F.lit(True))
    assert empty.total == 0 and len(ngram_lm.score(odd, empty).collect()) == odd.count() and ngram_lm.score(none, model).collect() == []


def test_language_model_beats_its_base(spark):
    rows = ngram_lm_rows(spark)
    assert rows["score"] > rows["base"]


def ngram_lm_rows(spark):
    out = ngram_lm.op5_lm_scoring(spark, SF)
    r = out.where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    return r.asDict()


def test_quality(spark, odd, none):
    out = quality.op10_quality(spark, "/root/testdata/sf0.01")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    good, bad = [x.score for x in rows if x.quality == 1], [x.score for x in rows if x.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([x.predicted == x.quality for x in rows]) > 0.9
    labels = spark.createDataFrame([(1, 1), (8, 0), (11, 1), (9, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels, F.lit(True))
    scored = quality.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= x.score <= 1 for x in scored)
    alone = quality.fit(none, labels.limit(0), F.lit(True))
    assert quality.score(none, alone).collect() == [] and quality.score(odd, alone).first().score == pytest.approx(0.5)


def test_quality_by_brute_force(spark, small):
    """Pooled vectors and the forward pass, word by word in plain Python."""
    import math

    import pyarrow as pa

    p = quality.Params(sample=200, words=60, epochs=2)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(small, labels, F.lit(True), p)
    texts = [r.text or "" for r in small.limit(25).collect()] + ["", "Zz9! unknown-word", "é"]
    got = model.pooled(pa.array(texts))
    known = {int(h): i for i, h in enumerate(model.known)}
    for t, x, s in zip(texts, got, model.scores(pa.array(texts))):
        hashes, shapes, _ = quality.tokens(pa.array([t]), p)
        sums, forms = np.zeros(p.dims), np.zeros(p.dims)
        for h, shape in zip(hashes.tolist(), shapes.tolist()):
            own = quality.index_vectors(np.array([h], np.uint64), p)[0] * quality.OWN / math.sqrt(p.nonzero)
            sums += model.vectors[known[h]] if h in known else own
            forms += model.shape_vectors[shape]
        n = max(1, len(hashes))
        want = np.concatenate([sums / n, forms / n, [math.log1p(len(hashes))]])
        assert len(hashes) == len(t.split()) and np.allclose(x, want, atol=1e-4)
        w1, b1, w2, b2 = model.weights
        hidden = [math.tanh(sum((v - m) / c * w for v, m, c, w in zip(want, model.mean, model.scale, w1[:, k])) + b1[k]) for k in range(p.hidden)]
        assert s == pytest.approx(1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, w2)) + b2) / model.temperature)), abs=1e-3)


def test_warc_round_trip(tmp_path, spark):
    a = warc.record("response", "r1", "http://A.example:80/x?b=2&a=1#top", "2024-01-01T00:00:00Z", "200 OK", [("ETag", '"e"'), ("Content-Type", "text/html"), ("Vary", "x")], b"body\r\n\r\nmore", "sha256:1")
    b = warc.record("revisit", "v1", "http://a.example/x?a=1&b=2", "2024-01-03T00:00:00Z", "304 Not Modified", [("ETag", 'W/"e"'), ("Vary", "y"), ("Content-Length", "0")], b"")
    c = warc.record("revisit", "v2", "http://a.example/x?a=1&b=2", "2023-01-03T00:00:00Z", "304 Not Modified", [], b"")
    d = warc.record("revisit", "v3", None, "2024-01-03T00:00:00Z", "304 Not Modified", [], b"")
    e = warc.record("revisit", "v4", "http://a.example/x?a=1&b=2", "2024-01-01T00:00:01Z", "304 Not Modified", [("ETag", '"z"')], b"")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(a + b + c + d + e + b"\x1f\x8bbroken")
    assert next(warc.parse(io.BytesIO(a)))["body"] == b"body\r\n\r\nmore"
    rows = warc.read_warc(spark, [str(path)])
    assert rows.where("type <> 'damaged'").count() == 5 and rows.where("type = 'damaged'").count() == 1
    got = {x.record_id: x for x in warc.resolve_revisits(rows).collect()}
    assert {k: v.reason for k, v in got.items()} == {"v1": "etag", "v2": "no earlier response", "v3": "no url", "v4": "mismatch"}
    assert got["v1"].response_id == "r1" and got["v1"].headers == {"etag": 'W/"e"', "content-type": "text/html", "vary": "y"} and got["v1"].length == 12 and got["v1"].status == 200
    assert warc.resolve_revisits(rows.limit(0)).collect() == []


def test_warc_damage():
    """Damage costs its own record and is told; reading goes on at the next one."""
    one = [warc.record("response", f"r{i}", "http://a/", "2024-01-01T00:00:00Z", "200 OK", [], b"x" * 5000 + b"%d" % i) for i in range(6)]
    broken = bytearray(one[2])
    broken[40:44] = b"\xff\xff\xff\xff"
    for damaged in (bytes(broken), one[2][: len(one[2]) // 2], b"\x1f\x8b\x08\xff", b"garbage"):
        got = [(x["type"], x["record_id"]) for x in warc.parse(io.BytesIO(b"".join([*one[:2], damaged, *one[3:]])))]
        assert [r for _, r in got if r] == ["r0", "r1", "r3", "r4", "r5"] and ("damaged", None) in got
    import gzip

    plain = [gzip.decompress(x) for x in one]
    assert [x["record_id"] for x in warc.parse(io.BytesIO(b"".join(plain)))] == [f"r{i}" for i in range(6)]
    for damaged in (plain[2].replace(b"Content-Length: ", b"Content-Length: x"), plain[2].replace(b"Content-Length: ", b"Content-Length: 99999")):
        for whole in (b"".join([*plain[:2], damaged, *plain[3:]]), gzip.compress(b"".join([*plain[:2], damaged, *plain[3:]])), b"".join([*one[:2], gzip.compress(damaged), *one[3:]])):
            got = [x["record_id"] for x in warc.parse(io.BytesIO(whole))]
            assert [r for r in got if r] == ["r0", "r1", "r3", "r4", "r5"] and None in got


def test_warc_of_odd_records(spark):
    """Ties, repeats, no date, malformed dates, no URL, identical payloads, nulls anywhere and clashing names."""
    u, e = "http://a/x", {"etag": '"e"'}
    rows = [
        ("r1", "response", None, u, "2024-01-01T00:00:00Z", 200, e, "d1", 1), ("r2", "response", None, u, "2024-01-01T00:00:00Z", 200, e, "d2", 2), ("r9", "response", None, u, "2024-01-05T00:00:00Z", 404, e, "d", 3),
        ("v1", "revisit", None, u, "2024-01-01T00:00:00Z", 304, e, None, 0), ("v2", "revisit", None, u, "2024-01-01T00:00:01Z", 304, e, None, 0), ("v2", "revisit", None, u, "2024-01-01T00:00:01Z", 304, e, None, 0), ("v3", "revisit", None, u, "2024-02-01T00:00:00Z", 304, {}, "d2", 0),
        ("v4", "revisit", None, u, "45.13.2024", 304, e, None, 0), ("v5", "revisit", None, u, None, 304, e, None, 0), ("v6", "revisit", None, None, "2024-02-01T00:00:00Z", 304, e, None, 0), ("v7", "revisit", warc.IDENTICAL, u, "2024-02-01T00:00:00Z", 200, {"etag": '"z"'}, "d2", 0),
        ("v8", "revisit", warc.IDENTICAL, u, "2024-02-01T00:00:00Z", 200, e, "other", 0), (None, "revisit", None, u, "2024-02-01T00:00:00Z", None, None, None, None), (None, None, None, None, None, None, None, None, None), ("x", "response", None, u, None, 200, e, "d", 1),
    ]
    df = spark.createDataFrame(rows, "record_id string, type string, profile string, url string, date string, status int, headers map<string,string>, digest string, length long")
    for c in ("at", "day", "of", "canon", "full", "own", "reason"):
        df = df.withColumn(c, F.lit("clash"))
    got = sorted(((r.record_id or "", r.reason, r.response_id, r.length, r.status) for r in warc.resolve_revisits(df).collect()), key=str)
    assert got == [
        ("", "no validator", None, None, None), ("v1", "no earlier response", None, None, 304), ("v2", "etag", "r2", 2, 200), ("v2", "etag", "r2", 2, 200), ("v3", "digest", "r2", 2, 200), ("v4", "no date", None, None, 304), ("v5", "no date", None, None, 304),
        ("v6", "no url", None, None, 304), ("v7", "identical", "r2", 2, 200), ("v8", "mismatch", None, None, 200),
    ]


def test_warc_against_sql(spark):
    df = warc.op9_warc_revisit(spark, SF)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, c.sql(warc.ORACLE).fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.crc32(F.col("id").cast("string")) % 5 != 0)
    good = {r.doc_id for r in quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    first = {d for d, top in classes_by_brute_force(kept).items() if d == top}
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    leaks = {r[0] for r in c.sql(decontaminate.ORACLE).fetchall()}
    assert {r.doc_id for r in rows} == first - leaks and len(rows) == len({r.doc_id for r in rows})
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_on_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    twice = docs.unionByName(docs.where("doc_id = 3").withColumn("text", F.lit("another text of an id whose first text goes")))
    assert {r.text for r in corpus_pipeline.dedup_stage(spark, twice, SF).where("doc_id = 3").collect()} == {"another text of an id whose first text goes"}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        assert stage(spark, odd, SF).count() <= odd.count(), name
    leaks = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert leaks.columns == docs.columns and leaks.count() == docs.count()
    out = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(i) for i in (1, 4, 5, 6, 7, 8, 10, 11, 12, None, None)) and out.columns == docs.columns
    clean = {r.doc_id: r for r in corpus_pipeline.secrets_stage(spark, docs, SF).collect()}
    assert clean[12].text.count("[SECRET]") == 3 and clean[12].n_chars == len(clean[12].text) and clean[4].text is None


def test_passages_over_added_and_missing_words():
    """Near copies with one edit or two: wherever the whole passage qualifies by brute force, a row covers it, whatever one anchor there is."""
    r = np.random.default_rng(7)
    tried = 0
    for trial in range(300):
        n, edits = ((55, 1), (60, 1), (100, 2), (300, 2))[trial % 4]
        w = r.integers(1, 2**60, n).astype(np.uint64)
        v = list(w)
        for _ in range(edits):
            at = int(r.integers(0, len(v)))
            kind = trial // 4 % 3
            v[at : at + (kind > 0)] = [] if kind == 2 else [np.uint64(r.integers(1, 2**60))]
        around = [r.integers(1, 2**60, int(r.integers(0, 40))).astype(np.uint64) for _ in range(4)]
        texts = [np.concatenate([around[0], w, around[1]]), np.concatenate([around[2], np.array(v, np.uint64), around[3]])]
        a, b = (simhash_dedup.shingles_of(t, np.array([0, len(t)]))[0] for t in texts)
        inner = [(len(around[0]), len(around[0]) + n - 4), (len(around[2]), len(around[2]) + len(v) - 4)]
        x, y = set(a[slice(*inner[0])].tolist()), set(b[slice(*inner[1])].tolist())
        if min(n, len(v)) < 50 or len(x & y) / len(x | y) < 0.8:
            continue
        tried += 1
        where = {t: k for k, t in enumerate(b.tolist())}
        shared = [(k, where[t]) for k, t in enumerate(a.tolist()) if t in where]
        # words changed at a passage's very ends belong to no shared shingle
        ends = [(f(k for k, _ in shared), f(k for _, k in shared)) for f in (min, max)]
        for anchor in (shared[0], shared[-1], shared[int(r.integers(0, len(shared)))]):
            rows = substring_dedup.passages(a, b, [anchor])
            assert any(p <= ends[0][0] and ends[1][0] < q and s <= ends[0][1] and ends[1][1] < e for p, q, s, e, _ in rows), (n, edits, kind)
            for p, q, s, e, sim in rows:
                c, d = set(a[p:q].tolist()), set(b[s:e].tolist())
                assert min(q - p, e - s) >= 46 and len(c & d) / len(c | d) == pytest.approx(sim) and sim >= 0.8
    assert tried > 200


def test_oversized_buckets_without_a_centre_at_the_front(spark):
    """Copies alike to one template and not to one another are one class, though the template isn't a bucket's first node."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    words = [word() for _ in range(400)]
    rows = []
    for i in range(300):
        w = list(words)
        for k in range(6):
            w[r.randrange(66 * k, 66 * k + 60)] = word()
        rows.append((i, " ".join(w)))
    rows.append((1000, " ".join(words)))
    want = classes_by_brute_force(rows)
    assert set(want.values()) == {0}
    got = {x.doc_id: x.class_id for x in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cap=2).collect()}
    assert got == want


def test_pairs_of_oversized_buckets_are_all_compared(spark):
    """Not only those that a regrouping keeps together: each pair within RADIUS that shares a bucket of any table."""
    r = np.random.default_rng(3)
    template = r.integers(0, 2, 256)
    bits = np.array([template ^ (r.random(256) < 0.09) for _ in range(150)]).astype(np.uint8)
    rows = [(i, bytearray(np.packbits(b).tobytes())) for i, b in enumerate(bits)]
    nodes = spark.createDataFrame(rows, "node long, fp binary")
    found, hot = simhash_dedup.candidates(nodes, cap=2)
    found = found.select("a", "b")
    more = simhash_dedup.joining(hot, spark.createDataFrame([], "a long, b long"), False)
    got = {tuple(x) for x in found.collect()} | {tuple(x) for x in more.collect()}
    n, tables = simhash_dedup.plan_tables(150)
    want = set()
    for t in range(tables):
        held = defaultdict(list)
        for i, b in enumerate(bits):
            held[b[simhash_dedup._order(t, 0)[:n]].tobytes()].append(i)
        want |= {(i, j) for g in held.values() for i in g for j in g if i < j and (bits[i] != bits[j]).sum() <= simhash_dedup.RADIUS}
    assert got == want and len(want) > 1000
    assert {tuple(x) for x in found.collect()} < want


def test_long_alignments_take_time_in_proportion():
    """an alignment of thousands of short runs that is nowhere alike enough; looking at every token again for each run took some 10 seconds."""
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 60, 80_000).astype(np.uint64)
    b = a.copy()
    for i in range(0, len(b), 14):
        b[i : i + 5] = r.integers(0, 1 << 60, len(b[i : i + 5])).astype(np.uint64)
    began = time.process_time()
    assert substring_dedup.passages(a, b, [(7, 7)]) == []
    assert time.process_time() - began < 5


def test_near_copies_in_a_bucket_whose_first_is_no_copy(spark):
    """texts that share a line with a text of a lesser key, and a whole passage, but for a word, only with one another."""
    r = np.random.default_rng(5)
    found = lost = 0
    for _ in range(60):
        token = lambda n: r.integers(0, 1 << 16, n).astype(np.uint16)
        line, rest = token(12), token(80)
        p = np.concatenate([rest[:40], line, rest[40:]])
        q = p.copy()
        q[70:75] = token(5)
        rows = [np.concatenate([token(40), line, token(40)]), np.concatenate([token(40), line, token(40)]), p, q]
        at = np.full(4, 40)
        around = np.array([np.concatenate([np.zeros(5, np.uint16), w, np.zeros(91, np.uint16)])[:91] for w in rows])
        pairs = substring_dedup.joined(np.arange(4), at, np.array([False, True, True, True]), np.full(4, 40), np.array([min(45, len(w) - 41) for w in rows]), around)
        found += {tuple(sorted(x)) for x in pairs} == {(2, 3)}
        lost += not pairs
    assert found >= 59 and not lost
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    random.seed(4)
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(60))) for i in range(3)], "id long, t string").withColumn("key", F.col("id"))
    firsts = spark.createDataFrame([(9, i, 20, 1) for i in range(3)], "h long, key long, at int, salts int")
    none = spark.createDataFrame([(0, 1, 0, 60, 0, 60)], "a long, b long, start_word int, end_word int, first_start int, first_end int")
    rows = {x.key: x for x in substring_dedup._around(firsts, none, docs).collect()}
    assert {k: x.open for k, x in rows.items()} == {0: False, 1: False, 2: True} and all((x.left, x.right, len(x.around)) == (20, 35, 182) for x in rows.values())


def test_models_of_many_shards_have_few_parts(spark, monkeypatch):
    """F1: a model of very many shards is looked up in few parts, and scores as one of a single shard does."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    learn = F.col("doc_id") % 5 != 1
    scores = []
    for size in (10**9, 150):
        monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", size)
        model = ngram_lm.train(docs, learn)
        scores.append({r.doc_id: tuple(r)[1:] for r in ngram_lm.score(docs, model).collect()})
    assert 6 <= model.bits <= 7
    assert scores[0].keys() == scores[1].keys()
    for d, x in scores[0].items():
        assert x[:2] == scores[1][d][:2] and x[2:] == pytest.approx(scores[1][d][2:], rel=1e-9)


def test_windows_that_share_one_repeated_token_are_soon_ruled_out(monkeypatch):
    """Windows of runs of one token that others break: every passage has more of those than a pair can lack."""
    r = np.random.default_rng(3)
    n, width, middle = 300, 2 * substring_dedup.AROUND + 1, substring_dedup.AROUND
    around = np.full((n, width), 7, np.uint16)
    for k in range(n):
        for at in (middle + r.integers(10, 13), middle - r.integers(32, 34)):
            around[k, at : at + 5] = r.integers(100, 1 << 16, 5)
    around[200] = around[10]
    around[20:25, middle - 40 : middle + 41] = 7  # whole runs
    around[20:25, :5] = r.integers(100, 1 << 16, (5, 5))
    args = np.arange(n) + 1, np.full(n, 500), np.arange(n) > 0, np.full(n, middle), np.full(n, middle), around
    looked, real = [], substring_dedup._strangers
    monkeypatch.setattr(substring_dedup, "_strangers", lambda member, *rest: looked.append(len(member)) or real(member, *rest))
    found = substring_dedup.joined(*args)
    assert {(10, 200), (200, 10), (20, 21), (21, 20), (24, 20)} <= set(found)
    assert sum(looked) < n * n / 10
    for many, turn in ((3, 4), (1 << 20, 1 << 20)):
        monkeypatch.setattr(substring_dedup, "MANY", many)
        monkeypatch.setattr(substring_dedup, "TURN", turn)
        assert substring_dedup.joined(*args) == found


def test_fewest_tokens_of_passages_by_brute_force():
    r = np.random.default_rng(4)
    passage, middle = substring_dedup.PASSAGE, substring_dedup.AROUND
    around = r.integers(0, 40, (200, 2 * middle + 1)).astype(np.uint16)
    left, right = r.integers(0, middle + 1, 200), r.integers(0, middle + 1, 200)
    place = np.arange(-middle, middle + 1)
    valid = (place >= -left[:, None]) & (place <= right[:, None])
    got = substring_dedup._fewest(valid, substring_dedup._distinct(around, valid)[2])
    for k in range(200):
        ways = [len(set(around[k, i : i + passage].tolist())) for i in range(passage) if valid[k, i] and valid[k, i + passage - 1]]
        assert got[k] == min(ways, default=1 << 15)
