"""Language-model scoring by an n-gram trie in Elias-Fano levels.

Level 1 holds the hashes of all training words, level 2 word pairs and level 3 triples seen at least
``Params.least`` times. A level is a monotone sequence: the bounds of a context's successors are monotone
pointers, and a successor is stored relative to its context (a triple's last word by its place among the
successors of the word before), so a lookup is a successor search. Probabilities are smoothed by absolute
discounting and interpolation and quantised to 8 bits. Shards by the hash of the first word are counted one
at a time; parts of one shard or more are built by separate tasks, written to the shared folder and mapped into memory by the tasks that score.

    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w|v) = (c(vw) - D)+ / c(v) + rest(v) p(w)        p(w|uv) = (c(uvw) - D)+ / c(uv) + rest(uv) p(w|v)

All counts cover all training texts; ``rest`` is what the discounts and rare n-grams left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano as ef
from .common import LOWER, NON_SPACE, by_bytes, documents, fresh_path, in_arrow, text_or_empty, words_of

#: The end of a text, a word of its own.
END = np.uint64(0xE0D0F7E8D5A1C3B7)
#: Training words of a shard, about.
SHARD_TOKENS = 2_000_000
#: Parts that a model is looked up in, unless they would hold more than so many shards each.
PARTS, MOST_SHARDS = 64, 16
#: Bits of a shard's number, at most: a million shards, two trillion words.
MOST_BITS = 20
#: Words that a counting task holds before it passes counts on.
FLUSH = 3_000_000


@dataclass(frozen=True)
class Params:
    least: int = 2  # pairs and triples seen less often are left to the lower order
    discount: float = 0.75


def _fs(path: str):
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def _write(path: str, data: bytes) -> None:
    """A whole file or none, also if two attempts of a task write it: both write the same."""
    import uuid

    system, at = _fs(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, at)


def _map(path: str):
    system, at = _fs(path)
    if system.type_name == "local":
        return pa.memory_map(at).read_buffer()
    with system.open_input_file(at) as f:
        return f.read_buffer()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and where each text's begin."""
    hashes, offsets, _, _ = words_of(texts, NON_SPACE, LOWER)
    n = len(texts)
    at = offsets + np.arange(n + 1)
    out = np.full(int(at[-1]), END)
    ends = at[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = hashes
    return out, at


def quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as 8 bits: steps of 0.03 in log10; 255 is 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log10(np.maximum(p, 1e-30)) * 32), 0, 254), 255).astype(np.uint8)


_VALUES = np.append(10.0 ** (-np.arange(255) / 32), 0.0)


@dataclass
class Shard:
    """A mapped shard: words, and the pairs and triples that begin with them."""

    words: ef.EliasFano
    counts: np.ndarray
    pairs: ef.EliasFano | None = None
    pointers: ef.EliasFano | None = None
    pair_p: np.ndarray | None = None
    word_rest: np.ndarray | None = None
    pair_counts: np.ndarray | None = None
    triples: ef.EliasFano | None = None
    triple_p: np.ndarray | None = None
    pair_rest: np.ndarray | None = None


def _sub(arrays: dict, prefix: str) -> ef.EliasFano:
    return ef.EliasFano({k[len(prefix) :]: v for k, v in arrays.items() if k.startswith(prefix)})


@dataclass
class Model:
    path: str
    bits: int  # shards: the hash's first bits
    order: int = 1
    total: int = 0  # N
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each shard, the words before it
    pair_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    params: Params = Params()

    def __post_init__(self):
        self.shards: dict[int, Shard] = {}

    def __getstate__(self):
        return self.__dict__ | {"shards": {}}

    @property
    def words(self) -> int:
        return int(self.starts[-1])

    def shard(self, s: int) -> Shard:
        if s not in self.shards:
            a = ef.unpack(_map(f"{self.path}/1-{s}"))
            out = Shard(_sub(a, "w."), a["c"])
            if self.order > 1:
                a = ef.unpack(_map(f"{self.path}/2-{s}"))
                out.pairs, out.pointers, out.pair_p, out.word_rest, out.pair_counts = _sub(a, "k."), _sub(a, "p."), a["q"], a["rest"], a["c"]
            if self.order > 2:
                a = ef.unpack(_map(f"{self.path}/3-{s}"))
                out.triples, out.triple_p, out.pair_rest = _sub(a, "k."), a["q"], a["rest"]
            self.shards[s] = out
        return self.shards[s]

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Shards with words, and their stretches in an array in order of shards."""
        bounds = np.searchsorted(shard, np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(bounds)):
            if self.starts[s + 1] > self.starts[s]:
                yield int(s), slice(int(bounds[s]), int(bounds[s + 1]))

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of hashes in order: word ids (-1: unknown), counts, and what their contexts leave to the lower order."""
        ids, counts, rest = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.ones(len(hashes))
        for s, at in self._by_shard((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            shard = self.shard(s)
            i = shard.words.find(hashes[at])
            known = i >= 0
            ids[at] = np.where(known, i + self.starts[s], -1)
            counts[at][known] = shard.counts[i[known]]
            if self.order > 1:
                rest[at][known] = _VALUES[shard.word_rest[i[known]]]
        return ids, counts, rest

    def find_pairs(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of word ids in order of the first: pair ids (-1: none), probabilities, rests, and the pair's place among its context's."""
        n = len(u)
        ids, p, rest, place = np.full(n, -1, np.int64), np.zeros(n), np.ones(n), np.zeros(n, np.int64)
        for s, at in self._by_shard(np.searchsorted(self.starts, u, "right") - 1):
            shard = self.shard(s)
            own = u[at] - self.starts[s]
            i = shard.pairs.find(own.astype(np.uint64) * np.uint64(self.words) + v[at].astype(np.uint64))
            hit = np.flatnonzero(i >= 0)
            if len(hit):
                j = i[hit]
                ids[at][hit] = j + self.pair_starts[s]
                p[at][hit] = _VALUES[shard.pair_p[j]]
                place[at][hit] = j - shard.pointers.get(own[hit]).astype(np.int64)
                if self.order > 2:
                    rest[at][hit] = _VALUES[shard.pair_rest[j]]
        return ids, p, rest, place

    def find_triples(self, pair: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Probabilities of triples, by the id of their first pair (in order) and the place of the second; 0 for none."""
        p = np.zeros(len(pair))
        for s, at in self._by_shard(np.searchsorted(self.pair_starts, pair, "right") - 1):
            shard = self.shard(s)
            i = shard.triples.find((pair[at] - self.pair_starts[s]).astype(np.uint64) * np.uint64(self.words) + place[at].astype(np.uint64))
            p[at][i >= 0] = _VALUES[shard.triple_p[i[i >= 0]]]
        return p

    def read(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Ids of a batch's words, and its pairs (the second word's position), looked up once each."""
        hashes, at = tokens(texts)
        uniq, inverse = np.unique(hashes, return_inverse=True)
        ids, counts, rest = self.lookup(uniq)
        out = {"at": at, "id": ids[inverse], "count": counts[inverse], "rest": rest[inverse]}
        if self.order > 1:
            second = np.ones(len(hashes), bool)
            second[at[:-1]] = False
            second[1:] &= (out["id"][1:] >= 0) & (out["id"][:-1] >= 0)
            pos = np.flatnonzero(second)
            u, v = out["id"][pos - 1], out["id"][pos]
            order = np.argsort(u.astype(np.uint64) * np.uint64(self.words) + v.astype(np.uint64))
            pos, u, v = pos[order], u[order], v[order]
            new = np.ones(len(pos), bool)
            new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            pick = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            found = self.find_pairs(u[pick], v[pick])
            for name, empty, value in zip(("pair", "pair_p", "pair_rest", "place"), (-1, 0.0, 1.0, 0), found):
                column = np.full(len(hashes), empty, value.dtype)
                column[pos] = value[which]
                out[name] = column
        return out

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Of each text: words with the end, known ones, log10 of the base and of this model."""
        r = self.read(texts)
        at, n = r["at"], len(texts)
        doc = np.repeat(np.arange(n), np.diff(at))
        one = (r["count"] + 0.5) / (self.total + 0.5 * (self.words + 1))
        p = one
        if self.order > 1:
            before = np.ones(len(p))
            before[1:] = r["rest"][:-1]
            before[at[:-1]] = 1.0
            p = r["pair_p"] + before * one
        if self.order > 2:
            third = np.zeros(len(p), bool)
            third[1:] = r["pair"][:-1] >= 0  # the two words before are a pair
            third[at[:-1]] = False
            who = np.flatnonzero(third)
            full = np.zeros(len(p))
            go = who[r["pair"][who] >= 0]
            go = go[np.argsort(r["pair"][go - 1])]
            full[go] = self.find_triples(r["pair"][go - 1], r["place"][go])
            p = p.copy()
            p[who] = full[who] + r["pair_rest"][who - 1] * p[who]
        total = lambda x: np.bincount(doc, weights=x, minlength=n)
        return np.diff(at), total(r["count"] > 0).astype(np.int64), total(np.log10(one)), total(np.log10(np.minimum(p, 1.0)))


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: what the shuffle's codec compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _blobs(shard: np.ndarray, key: np.ndarray, shards: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Counted keys in order, by shard: differences and counts."""
    top = np.uint64(64 - (shards - 1).bit_length())
    if not len(key):
        return
    if not (key >> top).any():  # shard and key fit one word: sorted as such
        both = np.sort(shard.astype(np.uint64) << top | key)
        shard, key = (both >> top).astype(np.int64), both & np.uint64((1 << int(top)) - 1)
    elif (key >> top == shard.astype(np.uint64)).all():  # the key begins with its shard
        key = np.sort(key)
        shard = (key >> top).astype(np.int64)
    else:
        order = np.lexsort((key, shard))
        shard, key = shard[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
    pick = np.flatnonzero(new)
    n = np.diff(np.append(pick, len(key))).astype(np.uint32)
    shard, key = shard[pick], key[pick]
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        k = key[bounds[s] : bounds[s + 1]]
        yield int(s), int(n[bounds[s] : bounds[s + 1]].sum()), _planes(np.diff(k, prepend=np.uint64(0))), _planes(n[bounds[s] : bounds[s + 1]])


def _merged(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.concatenate([np.cumsum(_unplanes(k, np.uint64), dtype=np.uint64) for k, _ in parts])
    n = np.concatenate([_unplanes(c, np.uint32) for _, c in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order].astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    pick = np.flatnonzero(new)
    return key[pick], np.add.reduceat(n, pick)


def _counted(texts: DataFrame, keys, shards: int, each: int, least: int, build) -> list:
    """Counts ``keys(batch's texts) -> (shard, key)`` over all texts; ``build(part, keys, counts)`` writes each part of ``each`` shards, with the keys seen ``least`` times, and its numbers come back.

    A task merges one shard after the other, and holds of a part only what it writes.
    """

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            if held:
                rows = list(_blobs(np.concatenate([s for s, _ in held]), np.concatenate([k for _, k in held]), shards))
                held.clear()
                if rows:
                    s, _, k, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.binary()), pa.array(n, pa.binary())], ["s", "k", "n"])

        for b in by_bytes(batches, "t", 2 << 20, 8192):
            held.append(keys(b.column(0)))
            if sum(len(k) for _, k in held) >= FLUSH:
                yield from flush()
        yield from flush()

    def reduce(batches):
        at, blobs, kept = None, [], []

        def merged():
            key, n = _merged(blobs)
            blobs.clear()
            kept.append((key[n >= least], n[n >= least]))

        for b in batches:
            for s, k, n in zip(*(c.to_pylist() for c in b.columns)):
                if s != at:
                    if at is not None:
                        merged()
                        if s // each != at // each:
                            yield done(at // each, kept)
                    at = s
                if k:
                    blobs.append((k, n))
        if at is not None:
            merged()
            yield done(at // each, kept)

    def done(part, kept):
        key, n = (np.concatenate(x) for x in zip(*kept))
        kept.clear()
        a, b = build(part, key, n)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([a], pa.int64()), pa.array([b], pa.int64())], ["s", "a", "b"])

    spark = texts.sparkSession
    all_ = spark.range(shards).select(F.col("id").cast("int").alias("s"), F.lit(b"").alias("k"), F.lit(b"").alias("n"))  # every part gets a file
    rows = texts.transform(in_arrow, count, "s int, k binary, n binary").unionByName(all_)
    width = min(shards // each, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # numbers of a part, one row each
    return rows.repartition(width, F.floor(F.col("s") / each)).sortWithinPartitions("s").transform(in_arrow, reduce, "s int, a long, b long").collect()


def _starts(rows: list, shards: int) -> np.ndarray:
    out = np.zeros(shards + 1, np.int64)
    for r in rows:
        out[r.s + 1] = r.a
    return np.cumsum(out)


def train(docs: DataFrame, learn: Column, text: str = "text", order: int = 3, params: Params = Params()) -> Model:
    """A model of the texts of rows where ``learn`` holds, written to the shared folder.

    Null texts are empty: their end counts. Without rows the model knows no word.
    """
    spark = docs.sparkSession
    texts = docs.where(learn).select(text_or_empty(text).alias("t"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("t") / 6 + 1), F.lit(0.0)).alias("n")).first().n
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2.0, size / SHARD_TOKENS)))))
    shards = 1 << bits
    each = min(MOST_SHARDS, max(1, shards // PARTS))  # a lookup takes time for each part of a model that it goes to
    parts = shards // each
    model = Model(fresh_path(spark, "ngrams"), parts.bit_length() - 1, 1, params=params)
    path = model.path

    def words(t):
        hashes, _ = tokens(t)
        return (hashes >> np.uint64(64 - bits)).astype(np.int64), hashes

    def sharded(starts, ids):  # the shard of each id, its place in the part
        part = np.searchsorted(starts, ids, "right") - 1
        own = ids - starts[part]
        return part * each + own * each // np.maximum(np.diff(starts)[part], 1), own.astype(np.uint64)

    def build_words(s, keys, counts):
        _write(f"{path}/1-{s}", ef.pack({f"w.{k}": v for k, v in ef.encode(keys).items()} | {"c": _narrow(counts)}))
        return len(keys), int(counts.sum())

    rows = _counted(texts, words, shards, each, 1, build_words)
    model.starts, model.total = _starts(rows, parts), sum(r.b for r in rows)
    if order < 2 or not model.total:
        return model
    vocabulary = np.uint64(model.words)
    one = Model(path, model.bits, 1, model.total, model.starts, params=params)

    def pairs(t):
        r = one.read(t)
        ids = r["id"]
        second = np.ones(len(ids), bool)
        second[r["at"][:-1]] = False
        pos = np.flatnonzero(second)
        u, v = ids[pos - 1], ids[pos]
        s, own = sharded(one.starts, u)
        return s, own * vocabulary + v.astype(np.uint64)

    def build_pairs(s, keys, counts):
        n = int(one.starts[s + 1] - one.starts[s])
        context = (keys // vocabulary).astype(np.int64)
        of = one.shard(s).counts[:n].astype(np.float64)
        own = (counts - params.discount) / of[context] if len(keys) else np.zeros(0)
        rest = 1 - np.bincount(context, weights=own, minlength=n)
        pointers = np.searchsorted(context, np.arange(n + 1)).astype(np.uint64)
        _write(f"{path}/2-{s}", ef.pack({f"k.{k}": x for k, x in ef.encode(keys).items()} | {f"p.{k}": x for k, x in ef.encode(pointers).items()} | {"q": quantised(own), "rest": quantised(rest), "c": _narrow(counts)}))
        return len(keys), 0

    rows = _counted(texts, pairs, shards, each, params.least, build_pairs)
    model.pair_starts, model.order = _starts(rows, parts), 2
    if order < 3:
        return model
    two = Model(path, model.bits, 2, model.total, model.starts, model.pair_starts, params)

    def triples(t):
        r = two.read(t)
        third = r["pair"] >= 0
        third[1:] &= r["pair"][:-1] >= 0
        third[r["at"][:-1]] = False
        pos = np.flatnonzero(third)
        pair = r["pair"][pos - 1]
        s, own = sharded(two.pair_starts, pair)
        return s, own * vocabulary + r["place"][pos].astype(np.uint64)

    def build_triples(s, keys, counts):
        n = int(two.pair_starts[s + 1] - two.pair_starts[s])
        context = (keys // vocabulary).astype(np.int64)
        of = two.shard(s).pair_counts[:n].astype(np.float64)
        own = (counts - params.discount) / of[context] if len(keys) else np.zeros(0)
        rest = 1 - np.bincount(context, weights=own, minlength=n)
        _write(f"{path}/3-{s}", ef.pack({f"k.{k}": x for k, x in ef.encode(keys).items()} | {"q": quantised(own), "rest": quantised(rest)}))
        return len(keys), 0

    _counted(texts, triples, shards, each, params.least, build_triples)
    model.order = 3
    return model


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, n_tokens, n_known, base_score, score)`` of each row, over its whole text and end.

    Null and empty texts are scored by their end alone; unknown words by the share that the base leaves
    them. Repeated rows give equal scores, null ids stay null, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t", 2 << 20, 8192):
            n, known, base, own = model.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(known), pa.array(base), pa.array(own)], ["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("t")).transform(in_arrow, run, f"id {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(docs, fold != 1)
    out = score(docs, model)
    return out.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
