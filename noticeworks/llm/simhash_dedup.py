"""SimHash near-dedup: bit sampling over several tables, and exact verification.

Each text becomes the set of its 5-word shingles (lower-cased words of letters and digits; a text of
fewer words is one shingle) and a SimHash of 256 bits. Texts with equal sets are one node from the start.
Each of several tables groups nodes by randomly sampled bits; the number of tables follows from the bits
and from ``MISS``, the chance that a pair right at similarity 0.8 meets in none. Pairs of a bucket within
``RADIUS`` bits, and of sizes that allow it, are candidates, and those with a Jaccard similarity of at least
0.8 are links. Each node's nearest candidate of a bucket is verified first; of the others only those that the
links so far leave in different classes, so copies of one text do not meet each with each. A document's class
is the least doc_id that links lead to.

A bucket of more than ``CAP`` nodes is first regrouped by additional sampled bits, several times over with
other bits, which links most of its copies; then its nodes are compared block by block: each with the nearest
node of another class in each block, and at last with every node of another class. So all pairs of a bucket
that could join classes are compared, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, dropped, in_arrow, mix64, shingles_of, text_or_empty, words_of, written
from .graphs import components

BITS = 256
LEAST = 0.8
#: Share of bits that differ, as expected of sets of a Jaccard similarity of 0.8 (cosine 8/9).
APART = math.acos(2 * 0.8 / 1.8) / math.pi
#: Candidates differ in no more bits; 3.3 standard deviations above the mean at similarity 0.8.
RADIUS = round(BITS * APART + 3.3 * math.sqrt(BITS * APART * (1 - APART)))
#: Chance that a pair at similarity 0.8 shares no bucket.
MISS = 0.004
#: Nodes of a bucket beyond which it is regrouped by more bits.
CAP = 2048
#: Nodes of a bucket, about, that the number of sampled bits aims at.
AIM = 256
#: Second nodes that a task verifies against one first node.
SALTED = 2048
#: Nodes of an oversized bucket that a task compares with as many others at once.
BLOCK = 4096
#: Regroupings of an oversized bucket, each by other bits.
AGAIN = 4
#: Nodes whose ids may be broadcast (8 bytes each).
BROADCAST_NODES = 2_000_000


def simhash(shingles: np.ndarray) -> np.ndarray:
    """256 bits (as 32 bytes): of each bit, the majority over the shingles' hashes."""
    votes = np.zeros(BITS, np.int64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 8192):
            h = shingles[i : i + 8192]
            wide = np.stack([h, *(mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in (1, 2, 3))], axis=1)
            votes += np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(h), 32), axis=1).sum(0, dtype=np.uint16 if len(h) < 65536 else np.int64)
    return np.packbits(2 * votes > len(shingles))


def prints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, k1, k2, n, fp, sh)`` of each row: key of its shingle set, its size, SimHash and sorted 32-bit shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in by_bytes(batches, "t", 1 << 20):
            sh, at = shingles_of(*words_of(pc.utf8_lower(b.column(1)))[:2])
            k1, k2, n, fp, packed = [], [], [], [], []
            for i, j in zip(at, at[1:]):
                s = np.unique(sh[i:j])
                with np.errstate(over="ignore"):
                    k1.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                    k2.append(int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                n.append(len(s))
                fp.append(simhash(s).tobytes())
                packed.append((s >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), pa.array(packed, pa.binary())], ["id", "k1", "k2", "n", "fp", "sh"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("t")).transform(in_arrow, run, f"id {kind}, k1 long, k2 long, n int, fp binary, sh binary")


def plan_tables(nodes: int) -> tuple[int, int]:
    """Bits that a table samples, and how many tables there are, for so many nodes."""
    bits = min(40, max(10, math.ceil(math.log2(max(1, nodes) / AIM))))
    return bits, math.ceil(math.log(MISS) / math.log(1 - (1 - APART) ** bits))


def _order(table: int, turn: int) -> np.ndarray:
    return np.random.default_rng([table, turn]).permutation(BITS)


def _keyed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``(tab, key, node, m, fp)``: each node in each table; ``m`` is its number of shingles."""
    orders = [_order(t, 0)[:bits] for t in range(tables)]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                fp = part.column(2)
                raw = np.unpackbits(np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(len(fp), BITS // 8), axis=1)
                for t, cols in enumerate(orders):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(_pack(raw[:, cols])), part.column(0), part.column(1), fp], ["tab", "key", "node", "m", "fp"])

    sized = nodes if "m" in nodes.columns else nodes.withColumn("m", F.lit(1))
    return sized.select("node", "m", "fp").transform(in_arrow, run, "tab int, key long, node long, m int, fp binary")


def _pack(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bits), np.int64)
    for k in range(bits.shape[1]):
        out = out << 1 | bits[:, k]
    return out


def _deeper(rows: DataFrame, bits: int, turn: int) -> DataFrame:
    """Rows ``(tab, key, n, node, m, fp)`` of oversized buckets, ``AGAIN`` times, with so many more bits that about CAP / 4 stay together."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                tab, key, n = (part.column(k).to_numpy() for k in range(3))
                fp = part.column(5)
                raw = np.unpackbits(np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(len(fp), BITS // 8), axis=1)
                extra = np.ceil(np.log2(4 * n / CAP)).astype(np.int64)
                for again in range(AGAIN):
                    new = np.zeros(len(tab), np.int64)
                    for t in np.unique(tab):
                        who = np.flatnonzero(tab == t)
                        cols = _order(int(t), turn * AGAIN + again)[:32]
                        new[who] = _pack(raw[who][:, cols]) >> (32 - np.minimum(extra[who], 32))
                    with np.errstate(over="ignore"):
                        mixed = mix64(mix64(key.astype(np.uint64)) + mix64(new.astype(np.uint64) * np.uint64(64) + extra.astype(np.uint64)) + np.uint64(again)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mixed), part.column(3), part.column(4), fp], ["tab", "key", "node", "m", "fp"])

    return rows.select("tab", "key", "n", "node", "m", "fp").transform(in_arrow, run, "tab int, key long, node long, m int, fp binary")


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in batches that end with a group, and where the groups start; the first ``keys`` columns tell groups apart."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        change = np.zeros(b.num_rows - 1, bool)
        for k in range(keys):
            v = b.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        if len(starts) > 1:
            yield b.slice(0, int(starts[-1])), starts
        held = b.slice(int(starts[-1]))
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _sizes_allow(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may have a similarity of LEAST."""
    return np.minimum(x, y) >= LEAST * np.maximum(x, y) - 1e-9


def _pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs ``(a, b, near)`` of a bucket; ``near`` where one is the other's nearest. Buckets hold a bounded number of rows."""

    def run(batches):
        for b, starts in in_groups(batches, 2):
            node, m = b.column(2).to_numpy(), b.column(3).to_numpy().astype(np.float64)
            fp = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(-1, BITS // 64)
            found = []
            for i, j in zip(starts.tolist(), starts[1:].tolist()):
                if j - i < 2:
                    continue
                part = fp[i:j]
                apart = np.zeros((j - i, j - i), np.uint16)
                for k in range(BITS // 64):
                    apart += np.bitwise_count(part[:, k, None] ^ part[None, :, k])
                apart[~_sizes_allow(m[i:j, None], m[None, i:j])] = BITS + 1
                np.fill_diagonal(apart, BITS + 1)
                nearest = apart.argmin(1)
                x, y = np.nonzero(np.triu(apart <= RADIUS, 1))
                if len(x):
                    found.append((node[i + x], node[i + y], (nearest[x] == y) | (nearest[y] == x)))
            if found:
                x, y, near = (np.concatenate(c) for c in zip(*found))
                for k in range(0, len(x), 100_000):
                    u, v = x[k : k + 100_000], y[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(near[k : k + 100_000])], ["a", "b", "near"])

    return rows.repartition("tab", "key").sortWithinPartitions("tab", "key").transform(in_arrow, run, "a long, b long, near boolean").where("a <> b")


def _blocks(rows: DataFrame, nearest: bool) -> DataFrame:
    """Pairs ``(a, b)`` of oversized buckets with different labels, no more than RADIUS bits apart, of ``rows (tab, key, n, node, m, fp, label)``.

    Each block of a bucket is compared with each. With ``nearest`` a node has only the nearest of a block.
    """

    def compared(fp, m, label, x, y):
        for i in range(0, len(x), 256):
            u = x[i : i + 256]
            apart = np.zeros((len(u), len(y)), np.uint16)
            for k in range(BITS // 64):
                apart += np.bitwise_count(fp[u, k, None] ^ fp[None, y, k])
            apart[(label[u, None] == label[None, y]) | ~_sizes_allow(m[u, None], m[None, y])] = BITS + 1
            if nearest:
                at = apart.argmin(1)
                good = apart[np.arange(len(u)), at] <= RADIUS
                yield u[good], y[at[good]]
            else:
                p, q = np.nonzero(apart <= RADIUS)
                yield u[p], y[q]

    def run(batches):
        for b, starts in in_groups(batches, 4):
            lo, hi, own, node, label, m = (b.column(k).to_numpy() for k in range(2, 8))
            m = m.astype(np.float64)
            fp = np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint64).reshape(-1, BITS // 64)
            for i, j in zip(starts.tolist(), starts[1:].tolist()):
                values, counts = np.unique(label[i:j], return_counts=True)
                if len(values) < 2:
                    continue
                at = np.arange(i, j)
                rest = label[at] != values[counts.argmax()]  # nodes of the largest class aren't compared with one another
                if lo[i] == hi[i]:
                    ways = [(at[rest], at)]
                else:
                    left = own[at] == lo[i]
                    ways = [(at[left & rest], at[~left]), (at[~left & rest], at[left] if nearest else at[left & ~rest])]
                for x, y in ways:
                    if len(x) and len(y):
                        for p, q in compared(fp, m, label, x, y):
                            for k in range(0, len(p), 100_000):
                                u, v = node[p[k : k + 100_000]], node[q[k : k + 100_000]]
                                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("tab", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "label", "m", "fp")
    order = ("tab", "key", "lo", "hi")
    return rows.repartition(*order).sortWithinPartitions(*order).transform(in_arrow, run, "a long, b long").distinct()


def candidates(nodes: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs ``(a, b, near)`` of ``nodes (node, m, fp)``, and the rows ``(tab, key, n, node, m, fp)`` of oversized buckets.

    Of oversized buckets the pairs are those that regroupings keep together.
    """
    bits, tables = plan_tables(nodes.count())
    rows, out, hot, turn = _keyed(nodes, bits, tables), [], None, 1
    while True:
        large = written(rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > cap), "large")
        out.append(_pairs(rows.join(large.select("tab", "key"), ["tab", "key"], "left_anti")))
        if not large.limit(1).count():
            break
        over = rows.join(large, ["tab", "key"])
        hot = over if turn == 1 else hot
        if turn > 3:
            break
        rows, turn = written(_deeper(over, bits, turn), "deeper"), turn + 1
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union.groupBy("a", "b").agg(F.bool_or("near").alias("near")), hot


def joining(hot: DataFrame, links: DataFrame, nearest: bool) -> DataFrame:
    """Candidate pairs of oversized buckets whose nodes ``links`` don't lead from one to the other."""
    rows = hot.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("tab", "key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("tab", "key")
    return written(_blocks(rows.join(mixed, ["tab", "key"]), nearest), "joining")


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs whose shingle sets (``sets (node, sh)``) have a Jaccard similarity of at least ``least``.

    All rows of a pair's first node come in order behind its own set, so a task holds two sets at a time; a
    node that is first in very many pairs has its set in as many tasks as they take.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    from_b = salted.join(sets.select(F.col("node").alias("b"), "sh"), "b").select("a", "salt", "b", "sh")
    from_a = sets.join(many.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "sh")

    def run(batches):
        own, mine = None, np.empty(0, np.uint32)
        for batch in batches:
            (a, salt, b), sh = (batch.column(k).to_pylist() for k in range(3)), batch.column(3)
            found = []
            for i in range(len(a)):
                s = np.frombuffer(sh[i].as_buffer(), "<u4")
                if b[i] is None:
                    own, mine = (a[i], salt[i]), s.copy()
                elif own == (a[i], salt[i]):
                    n, m = len(mine), len(s)
                    if min(n, m) >= least * max(n, m):
                        both = np.sort(np.concatenate([mine, s]), kind="stable")
                        common = int((both[1:] == both[:-1]).sum())
                        if common >= least * (n + m - common) - 1e-9:
                            found.append((a[i], b[i]))
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    rows = from_a.unionByName(from_b)
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).transform(in_arrow, run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", cap: int = CAP) -> DataFrame:
    """``(id, class_id, n_shingles)``: one row per row, with the least id of its class.

    Texts without words (null, empty, only symbols) and rows with a null id are each a class of their own.
    Equal texts and repeated rows share a class; equal ids stay as they are. Other columns are not read.
    """
    spark = docs.sparkSession
    table = written(prints(docs, text, id_col).withColumn("row", F.monotonically_increasing_id()), "prints")
    real = table.where("n > 0 and id is not null")
    nodes = written(real.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.first("n").alias("m"), F.first("fp").alias("fp")), "nodes")

    def linked_by(pairs: DataFrame) -> DataFrame:
        wanted = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
        few = wanted.count() <= BROADCAST_NODES
        sets = written(real.select(F.col("row").alias("node"), "sh").join(F.broadcast(wanted) if few else wanted, "node", "left_semi"), "sets")
        out = written(verified(pairs, sets), "links")
        dropped(spark, sets, pairs, wanted)
        return out

    found, hot = candidates(nodes, cap)
    found = written(found, "pairs")
    links = linked_by(written(found.where("near").select("a", "b"), "near"))
    rest = found.where("not near").select("a", "b")
    labels = components(links)
    for end in "ab":
        rest = rest.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
    rest = written(rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "rest")
    links = links.unionByName(linked_by(rest))
    dropped(spark, found)
    for nearest in (True, False) if hot is not None else ():
        more = joining(hot, links, nearest)
        if not more.limit(1).count():
            break
        links = links.unionByName(linked_by(more))
    labels = components(links)
    least = nodes.select("node", "least").join(labels, "node")
    of_label = least.groupBy("label").agg(F.min("least").alias("class_id"))
    of_node = least.join(of_label, "label").select("node", "class_id")
    of_key = nodes.select("k1", "k2", "node", "least").join(of_node, "node", "left").select("k1", "k2", F.coalesce("class_id", "least").alias("class_id"))
    linked = real.select("id", "k1", "k2", "n").join(of_key, ["k1", "k2"]).select("id", "class_id", F.col("n").alias("n_shingles"))
    alone = table.where("n = 0 or id is null").select("id", F.col("id").alias("class_id"), F.col("n").alias("n_shingles"))
    return linked.unionByName(alone).withColumnRenamed("id", id_col)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
