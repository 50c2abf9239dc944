"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The normaliser compiles to a map of character sequences, the longest first, and a rule for spaces, and is composed
with the input first. The pieces and the byte fallback compile to one transducer: a trie over characters whose
final states write a piece's id and return to the root. A
unigram model weighs an arc with its piece's score. A BPE model composes with an acceptor of adjacent
pieces: a pair is allowed if merging by rank never joins across their bound, which holds for each two
neighbours of a segmentation exactly if it is the BPE result. An input composes with it to a lattice of
positions; the tropical shortest path through that is the encoding.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import Kept, by_bytes, documents, in_arrow, text_or_empty
from .token_counts import SEGMENTS_KEPT, WORDS_KEPT, tokenizer_path, words_of_normalised, words_with_spaces

_END = ""
#: Pairs of pieces whose bound a worker remembers; beyond them it begins anew.
PAIRS_KEPT = 1 << 19


class Transducer:
    def __init__(self, model: pieces.Model):
        self.model = model
        self.trie: dict = {}
        for piece, i in model.normal.items():
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[_END] = i
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, list] = {}
        self.rank = {p: -model.scores[i] for p, i in model.normal.items()}
        self.surface = [b""] * len(model.pieces)
        for p, i in model.normal.items():
            self.surface[i] = p.replace(pieces.SPACE, " ").encode()
        for b, i in model.byte.items():
            self.surface[i] = bytes([b])
        self.surface[model.unknown] = " ⁇ ".encode()

    def fallback(self, ch: str) -> list[int]:
        m = self.model
        return [m.byte[b] for b in ch.encode()] if len(m.byte) == 256 else [m.unknown]

    def merged(self, symbols: list[str]) -> list[str]:
        """Merging by rank, leftmost of equals first: the definition that the acceptor is compiled from.

        A heap holds the pairs that may merge and a list of neighbours what is left, so any length takes
        about as many steps as it has symbols.
        """
        symbols, rank = list(symbols), self.rank
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue  # one of them is gone
            symbols[i], symbols[j] = left + right, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] + symbols[i])) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return [s for s in symbols if s]

    def spine(self, piece: int, right: bool) -> list[tuple[str, float, float]]:
        """The symbols at an edge of a piece while it is merged: each with the ranks that make and consume it."""
        key = piece << 1 | right
        found = self.spines.get(key)
        if found is None:
            symbols, made, found = list(self.model.pieces[piece]), -np.inf, []
            edge = -1 if right else 0
            while True:
                best, at = None, -1
                for i in range(len(symbols) - 1):
                    r = self.rank.get(symbols[i] + symbols[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                if at == (len(symbols) - 2 if right else 0):
                    found.append((symbols[edge], made, best))
                    made = best
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            found.append((symbols[edge], made, np.inf))
            found = self.spines[key] = found if len(symbols) == 1 else []
        return found

    def allowed(self, a: int, b: int) -> bool:
        """Whether merging leaves the bound between two pieces alone: no symbols that ever meet there merge before they are consumed."""
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS_KEPT // 4:  # a dictionary takes several times the bytes of the lattices' table
                self.pairs.clear()
            found = self.pairs[key] = self.apart(a, b)
        return found

    def apart(self, a: int, b: int) -> bool:
        """``allowed``, without remembering it."""
        left, right, rank = self.spine(a, True), self.spine(b, False), self.rank.get
        found = bool(left and right)
        for u, u_made, u_end in left:
            for v, v_made, v_end in right:
                if u_made < v_end and v_made < u_end:
                    r = rank(u + v)
                    if r is not None and r < u_end and r <= v_end:
                        found = False
        return found

    def encode(self, s: str) -> list[int]:
        """Ids of a normalised string."""
        return self._bpe(s) if self.model.is_bpe else self._unigram(s)

    def _bpe(self, s: str) -> list[int]:
        if s[:2] == pieces.SPACE * 2:  # pieces of spaces alone share one rank; their order needs the merges themselves
            return [i for p in self.merged(list(s)) for i in ((self.model.normal[p],) if p in self.model.normal else self.fallback(p))]
        n, root, allowed = len(s), self.trie, self.allowed
        last: list = [None] * (n + 1)  # of each position, the piece that ends the one path there
        back = [0] * (n + 1)
        last[0] = -1
        for i in range(n):
            left = last[i]
            if left is None:
                continue
            node = root.get(s[i])
            if node is None or _END not in node:
                # a character without a piece takes part in no merge: a bound that any pair may cross
                last[i + 1], back[i + 1] = -1, i
            j = i
            while node is not None:
                j += 1
                p = node.get(_END)
                if p is not None and last[j] is None and (left < 0 or allowed(left, p)):
                    last[j], back[j] = p, i
                node = node.get(s[j]) if j < n else None
        out: list[int] = []
        j = n
        while j:
            i = back[j]
            out += (last[j],) if last[j] >= 0 else self.fallback(s[i])[::-1]
            j = i
        return out[::-1]

    def _unigram(self, s: str) -> list[int]:
        n, root, scores = len(s), self.trie, self.model.scores
        least = min((scores[i] for i in self.model.normal.values()), default=0.0)
        best: list[float] = [0.0] + [np.inf] * n
        back: list[tuple[int, list[int]]] = [(0, [])] * (n + 1)
        for i in range(n):
            node, j, single = root.get(s[i]), i, False
            while node is not None:
                j += 1
                p = node.get(_END)
                if p is not None:
                    single |= j == i + 1
                    if best[i] - scores[p] < best[j]:
                        best[j], back[j] = best[i] - scores[p], (i, [p])
                node = node.get(s[j]) if j < n else None
            if not single and best[i] + 10.0 - least < best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + 10.0 - least, (i, self.fallback(s[i]))
        out: list[int] = []
        j = n
        while j:
            i, ids = back[j]
            out += ids[::-1]
            j = i
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces for U+2581, the first one dropped, bytes joined to characters."""
        out = b"".join(map(self.surface.__getitem__, ids))
        n = self.model.normalise
        drop = 0  # of each first piece one space, as long as nothing else has come
        for i in ids if n.front or n.one_space else ():
            if self.surface[i][:1] != b" ":
                break
            drop += 1
            if not n.one_space or self.surface[i] != b" ":
                break
        return out[drop:].decode("utf-8", "replace")


class Lattices:
    """Shortest paths of many short strings at once, for a BPE transducer: the same arcs and the same acceptor in arrays.

    Position by position, all strings step backwards through a trie of reversed pieces; of the pieces
    that end at a position, the acceptor leaves one.
    """

    LONGEST = 64
    #: Strings whose paths are sought at once.
    STRINGS = 8192

    def __init__(self, fst: Transducer):
        self.fst = fst
        chars = sorted({c for p in fst.model.normal for c in p})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        edges: dict[tuple[int, int], int] = {}
        ends: list[int] = [-1]
        for p, i in fst.model.normal.items():
            node = 0
            for c in reversed(p):
                key = (node, int(self.code[ord(c)]))
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = i
        self.ends = np.array(ends, np.int64)
        self.single = self.ends[[edges.get((0, c), 0) for c in range(len(chars) + 1)]] >= 0
        self.width = len(chars) + 1
        self.edges = _Table()
        self.edges.put(np.array([a * self.width + b for a, b in edges], np.int64), np.array(list(edges.values()), np.int32))
        self.pairs = _Table()

    def allowed(self, keys: np.ndarray) -> np.ndarray:
        found = self.pairs.get(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            if self.pairs.held + len(new) > PAIRS_KEPT:  # all of this call's for the moment
                self.pairs, new = _Table(), np.unique(keys)
            self.pairs.put(new, np.array([self.fst.apart(k >> 20, k & 0xFFFFF) for k in new.tolist()], np.int32))
            found = self.pairs.get(keys)
        return found > 0

    def encode(self, strings: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(strings)
        if not strings:
            return out
        lengths = np.array([len(s) for s in strings])
        double = pieces.SPACE * 2
        plain = np.array([bool(s) and not s.startswith(double) for s in strings]) & (lengths <= self.LONGEST)
        order = np.flatnonzero(plain)
        order = order[np.argsort(-lengths[order], kind="stable")]
        for k in range(0, len(order), self.STRINGS):
            part = order[k : k + self.STRINGS]
            lens = lengths[part]
            n, width = len(part), int(lens[0])
            codes = self.code[np.array([strings[i] for i in part], f"<U{width}").view(np.uint32).reshape(n, width)]
            good = self.single[codes].sum(1) == lens  # a character without a piece of its own falls back to bytes, one by one
            self._paths(part[good], lens[good], np.ascontiguousarray(codes[good].T), out)
        for i, s in enumerate(strings):
            if s and not out[i]:
                out[i] = np.array(self.fst.encode(s), "<i4").tobytes()
        return out

    def _paths(self, order: np.ndarray, lens: np.ndarray, codes: np.ndarray, out: list[bytes]) -> None:
        n, width = len(order), int(lens[0]) if len(order) else 0
        last = np.full((width + 1, n), -1, np.int32)
        size = np.zeros((width + 1, n), np.int8)
        active = np.searchsorted(-lens, -np.arange(width + 1), "right")  # strings of at least that length
        for j in range(1, width + 1):
            at = np.arange(active[j])
            node = np.zeros(len(at), np.int64)
            for k in range(1, j + 1):
                node = self.edges.get(node * self.width + codes[j - k, at])
                alive = node >= 0
                at, node = at[alive], node[alive]
                if not len(at):
                    break
                piece = self.ends[node]
                fits = (piece >= 0) & (size[j, at] == 0)
                if k < j:
                    fits &= last[j - k, at] >= 0
                    who = np.flatnonzero(fits)
                    fits[who] = self.allowed(last[j - k, at[who]].astype(np.int64) << 20 | piece[who])
                else:
                    fits &= self.whole(piece)
                last[j, at[fits]], size[j, at[fits]] = piece[fits], k
        pos, cols = lens.copy(), np.arange(n)
        ids = np.zeros((width, n), np.int32)
        count = np.zeros(n, np.int64)
        while len(cols):
            ids[count[cols], cols] = last[pos[cols], cols]
            count[cols] += 1
            pos[cols] -= size[pos[cols], cols]
            cols = cols[pos[cols] > 0]
        total = np.concatenate([[0], np.cumsum(count)])
        who = np.repeat(np.arange(n), count)
        flat = ids[count[who] - 1 - (np.arange(total[-1]) - total[who]), who].astype("<i4").tobytes()
        for i, a, b in zip(order.tolist(), (total[:-1] * 4).tolist(), (total[1:] * 4).tolist()):
            out[i] = flat[a:b]

    def whole(self, piece: np.ndarray) -> np.ndarray:
        """Whether merging makes the piece itself from its characters."""
        if not hasattr(self, "_whole"):
            self._whole = np.array([p in self.fst.model.normal and self.fst.merged(list(p)) == [p] for p in self.fst.model.pieces])
        return self._whole[np.maximum(piece, 0)] & (piece >= 0)


class _Table:
    """A hash table of 64-bit keys and small values, looked up by arrays; -1 for what it lacks."""

    def __init__(self):
        self.held = self.bits = 0
        self.keys, self.values = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.put(self.keys, self.values)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that it lacks."""
        self.held += len(keys)
        grown = max(12, (3 * self.held).bit_length())
        if grown > self.bits:
            there = self.keys != -1
            keys, values = np.concatenate([self.keys[there], keys]), np.concatenate([self.values[there], values])
            self.bits = grown
            self.keys = np.full(1 << grown, -1, np.int64)
            self.values = np.full(1 << grown, -1, np.int32)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1)).astype(np.int64)
        rest = np.flatnonzero((there != keys) & (there != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (there != -1)]
        return out


@lru_cache(2)
def lattices(path: str) -> Lattices:
    return Lattices(transducer(path))


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(pieces.model(path))


class Coder:
    """Encodes whole texts to packed ids; segments that return come from caches of bounded size."""

    def __init__(self, path: str):
        self.fst = transducer(path)
        self.cut = pieces.cutter(path) if self.fst.model.is_bpe else None
        self.many = lattices(path) if self.fst.model.is_bpe else None
        self.words, self.segments = Kept(WORDS_KEPT // 2), Kept(SEGMENTS_KEPT // 2)  # an entry holds ids, where op2 holds a count

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't kept; what fits is kept."""
        kept, found = self.segments, {}
        for i in range(0, len(new), 20_000):
            cuts = [c if len(c := self.cut(w)) > 1 else [w] for w in new[i : i + 20_000]]  # one string for both caches
            known = {s: kept[s] for c in cuts for s in c if s in kept}
            fresh = list({s for c in cuts for s in c if s not in known})
            made = dict(zip(fresh, self.many.encode(fresh)))
            known |= made
            found.update((w, known[c[0]] if len(c) == 1 else b"".join([known[s] for s in c])) for w, c in zip(new[i:], cuts))
            kept.keep(made, known)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        normalise = self.fst.model.normalise
        if self.cut is None:
            return [np.array(self.fst.encode(normalise(t)), "<i4").tobytes() for t in texts]
        split = [words_with_spaces(t) if self.fst.model.identity else words_of_normalised(normalise(t)) for t in texts]
        words = self.words
        new = {w for ws in split for w in ws if w not in words}
        found = self.learn(list(new)) if new else {}
        words.update(found)  # all of the batch's for the moment
        out = [b"".join([words[w] for w in ws]) for ws in split]
        words.keep(found, chain.from_iterable(split))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.fst.decode(ids.tolist())


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id", batch_bytes: int = 1 << 20) -> DataFrame:
    """``(id, ids, ids_sha256, decoded_sha256, round_trip)``: ids of each whole text, and whether they decode to it.

    ``ids_sha256`` digests the ids as little-endian 32-bit integers, ``decoded_sha256`` the UTF-8 bytes
    decoded from them. Null and empty texts have no ids and decode to the empty text; U+2581 in a text
    decodes to a space, as the format has it, so there ``round_trip`` is false. Repeated rows give
    repeated results, null ids stay null, other columns are not read.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in by_bytes(batches, "t", batch_bytes):
            texts = b.column(1).to_pylist()
            coded = coder.encode(texts)
            flat = np.frombuffer(b"".join(coded), "<i4")
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
            back = [coder.decode(flat[i:j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(at, pa.array(flat, pa.int32())), pa.array(map(sha, coded)), pa.array(sha(x.encode()) for x in back), pa.array([x == y for x, y in zip(back, texts)], pa.bool_())],
                ["id", "ids", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("t")).transform(in_arrow, run, f"id {kind}, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir)).withColumn("n_tokens", F.size("ids").cast("long"))
