"""Secret scans: three patterns, and a character network over every other candidate in its context.

Candidates are all runs of LEAST or more key characters. A convolutional network in numpy reads a candidate
with the characters around it; it is trained on labelled findings written by a seeded generator (keys of many
formats against words, names, numbers, addresses and paths), calibrated with a temperature on findings held
out, and cut at the highest threshold that keeps the wanted recall on further ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, in_arrow, text_or_empty

KINDS = ("assign", "access", "hex", "network")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the same matches as runs of any length, shorter ones dropped
_NAMES = ("password", "passwd", "secret", "token", "api")
LEAST, BODY, LEFT, RIGHT = 16, 48, 20, 4
WIDTH = LEFT + BODY + RIGHT
_RUN = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
#: Share of the held-out labelled findings that the threshold keeps.
RECALL = 0.97


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' matches, in order."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of LEAST or more key characters, without dots and dashes behind them."""
    for m in _RUN.finditer(text):
        i, j = m.span()
        while j > i and text[j - 1] in ".-":
            j -= 1
        if j - i >= LEAST:
            yield i, j


def windows(text: str, i: int, j: int) -> list[tuple[int, int]]:
    """Parts of a candidate that the network reads one by one; half of each longer candidate's part lies in the next, and the last ends with it."""
    starts = list(range(i, j - BODY, BODY // 2))
    return [(k, k + BODY) for k in starts] + [(max(i, j - BODY), j)]


def parts(i: int, j: int, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What of a candidate lies outside the patterns' matches ``spans``, which are in order of their starts; parts of LEAST or more."""
    for s, _, e in spans:
        if s - i >= LEAST:
            yield i, min(s, j)
        i = max(i, e)
        if j - i < LEAST:
            return
    if j - i >= LEAST:
        yield i, j


def codes(text: str, i: int, j: int) -> np.ndarray:
    """Characters around, left-aligned before the body; in two planes, by whether they belong to it."""
    left = text[max(0, i - LEFT) : i].rjust(LEFT, "\0")
    body = text[i:j].ljust(BODY, "\0")
    right = text[j : j + RIGHT].ljust(RIGHT, "\0")
    x = np.minimum(np.frombuffer((left + body + right).encode("utf-32-le"), "<u4"), 127).astype(np.int64)
    x[LEFT : LEFT + BODY] += 128
    x[LEFT + j - i : LEFT + BODY] = 0
    return x


class Network:
    """Embedding, one convolution, the greatest and mean activation of each filter, one output."""

    EMBED, TAPS, FILTERS = 12, 5, 32

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        e, t, f = self.EMBED, self.TAPS, self.FILTERS
        self.w = [rng.normal(0, 0.3, (256, e)), rng.normal(0, (e * t) ** -0.5, (e * t, f)), np.zeros(f), rng.normal(0, (2 * f) ** -0.5, 2 * f), np.zeros(1)]
        self.w[0][0] = 0
        self.temperature, self.threshold = 1.0, 0.5

    def forward(self, x: np.ndarray):
        e, t = self.EMBED, self.TAPS
        emb = self.w[0][x]
        n, width = x.shape
        cols = np.lib.stride_tricks.sliding_window_view(emb, t, axis=1).transpose(0, 1, 3, 2).reshape(n, width - t + 1, t * e)
        z = np.maximum(cols @ self.w[1] + self.w[2], 0)
        top = z.argmax(1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None], 1)[:, 0], z.mean(1)], 1)
        return cols, z, top, pooled, pooled @ self.w[3] + self.w[4][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(self.forward(x[i : i + 256])[4] / self.temperature, -50, 50))) for i in range(0, len(x), 256)]
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        cols, z, top, pooled, logit = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(y)
        f, n = self.FILTERS, len(y)
        dp = d[:, None] * self.w[3]
        dz = np.repeat(dp[:, None, f:] / z.shape[1], z.shape[1], 1)
        np.add.at(dz, (np.arange(n)[:, None], top, np.arange(f)[None]), dp[:, :f])
        dz *= z > 0
        flat = dz.reshape(-1, f)
        dcols = (flat @ self.w[1].T).reshape(n, z.shape[1], self.TAPS, self.EMBED)
        de = np.zeros_like(self.w[0])
        for k in range(self.TAPS):
            np.add.at(de, x[:, k : k + z.shape[1]], dcols[:, :, k])
        de[0] = 0
        return [de, cols.reshape(len(flat), -1).T @ flat, flat.sum(0), pooled.T @ d, np.array([d.sum()])]


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """``(text, start, end, secret)``: findings in context, half of them secrets."""
    import random

    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    low, hexa, b64 = _ALNUM[26:52], "0123456789abcdef", _ALNUM + "+/"
    syllable = lambda: r.choice(["", *"bcdfghjklmnprstvwz", "ch", "st", "tr", "sch", "pr"]) + r.choice([*"aeiou", "ei", "ou", "au", "ie"]) + r.choice(["", "", *"nrstlm", "ch", "ng"])
    word = lambda: pick(low, r.randint(2, 9)) if r.random() < 0.4 else "".join(syllable() for _ in range(r.randint(1, 3))) or "a"

    def long_word() -> str:
        out = ""
        while len(out) < LEAST + r.randint(0, 12):
            out += syllable()
        return out

    secrets = [
        lambda: "ghp_" + pick(_ALNUM, 36), lambda: "sk_live_" + pick(_ALNUM, r.randint(20, 40)), lambda: "sk-" + pick(_ALNUM, r.randint(32, 48)), lambda: "xoxb-" + pick("0123456789", 11) + "-" + pick(_ALNUM, 24),
        lambda: "AIza" + pick(_ALNUM + "_-", 35), lambda: "eyJ" + pick(_ALNUM, 20) + "." + "eyJ" + pick(_ALNUM, 40) + "." + pick(_ALNUM + "_-", 43), lambda: pick(b64, 40), lambda: pick(b64, r.randint(22, 86)) + "==", lambda: pick(_ALNUM, r.randint(20, 64)),
        lambda: pick(hexa.upper(), r.choice([32, 40, 64])), lambda: "glpat-" + pick(_ALNUM, 20), lambda: "npm_" + pick(_ALNUM, 36), lambda: pick(_ALNUM + "+/_.-", r.randint(18, 40)),
        lambda: ("/".join(word() for _ in range(r.randint(1, 6))) + "/")[-26:] + r.choice(["", "ghp_", "key_"]) + pick(_ALNUM, r.randint(18, 22)), lambda: "/" + "/".join(word() for _ in range(r.randint(1, 2))) + "/" + pick(_ALNUM, 24), lambda: pick(_ALNUM[:52], r.randint(20, 48)), lambda: pick(low + "0123456789", r.randint(24, 48)), lambda: "-".join(pick(hexa.upper(), k) for k in (8, 4, 4, 4, 12)), lambda: pick(_ALNUM[:26] + "234567", r.choice([16, 26, 32])),
    ]
    others = [
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(0, 99)), lambda: "_".join(word() for _ in range(r.randint(3, 5))) + "_" + str(r.randint(0, 9999)), lambda: ".".join(word() for _ in range(r.randint(3, 6))) + "." + str(r.randint(1, 20)), lambda: pick("0123456789", r.randint(16, 24)),
        lambda: "-".join(pick("0123456789", 4) for _ in range(4)), lambda: f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T0{r.randint(0, 9)}.30.00.000", lambda: word() + word() + word() + pick("0123456789", r.randint(1, 4)), lambda: "=" * r.randint(14, 30) + str(r.randint(0, 9)), lambda: "-" * r.randint(14, 30) + str(r.randint(0, 9)) + "-" * 4,
        lambda: word() + "=" + word() + "+" + word() + "=" + str(r.randint(0, 99)) + word(), lambda: (word() + word()).upper() + "-" + str(r.randint(100, 999)) + "-" + word(), lambda: "version-" + ".".join(str(r.randint(0, 30)) for _ in range(4)) + "-" + word(), lambda: "/".join(pick("0123456789", r.randint(1, 4)) for _ in range(6)), lambda: (word() + str(r.randint(0, 9))) * 4, lambda: "".join(word().capitalize() for _ in range(4)) + str(r.randint(0, 20)), lambda: pick(low, r.randint(12, 24)) + ".com/" + word() + str(r.randint(1, 99)),
        lambda: long_word(), lambda: "-".join(word() for _ in range(r.randint(4, 7))), lambda: "/".join(word() for _ in range(r.randint(4, 7))), lambda: "".join(word().capitalize() for _ in range(4)), lambda: "_".join(word().upper() for _ in range(4)), lambda: ".".join(word() for _ in range(5)),
        lambda: r.choice("=-._/+") * r.randint(16, 60), lambda: pick("-=._", r.randint(16, 30)), lambda: long_word().capitalize(), lambda: (syllable() * 12)[: r.randint(16, 40)], lambda: r.choice(low) * r.randint(16, 50), lambda: long_word() + "-" + long_word(),
    ]
    before_secret = ["key: ", "auth=", "Bearer ", "credential ", "export KEY=", "pass ", "", "private_key ", "client_secret: ", "--key ", "signature=", '"access": "']
    before_any = ["", "see ", "id ", "at ", "file ", "www.", "no. ", "https://", "ref ", "in "]
    out = []
    for k in range(n):
        y = k % 2
        s = r.choice(secrets if y else others)()
        while len(s) < LEAST:
            s += pick("0123456789", 4) if not y and r.random() < 0.5 else word() if not y else pick(_ALNUM, 4)
        lead = r.choice(before_secret if y and r.random() < 0.6 else before_any)
        text = " ".join(word() for _ in range(r.randint(0, 5))) + r.choice([" ", "\n"]) + lead
        out.append((text + s + r.choice([" ", ".", ",", '"', "\n", ""]) + word(), len(text), len(text) + len(s), y))
    return out


def threshold_for(scores: np.ndarray, recall: float = RECALL) -> float:
    """The highest threshold that keeps the share of the secrets' scores."""
    return float(np.sort(scores)[len(scores) - math.ceil(recall * len(scores) - 1e-9)])


#: Labelled findings to learn from, to calibrate on, and to set the threshold on.
LEARN, CALIBRATE, CUT = 6000, 1500, 1500


@lru_cache(1)
def trained() -> Network:
    """The network: fitted, calibrated and cut, each on findings of its own; the same on every machine up to rounding."""
    rows = labelled_findings(LEARN + CALIBRATE + CUT, 11)
    x = np.array([codes(t, *windows(t, i, j)[0]) for t, i, j, _ in rows])
    y = np.array([v for *_, v in rows], np.float64)
    learn, calibrate, cut = slice(0, LEARN), slice(LEARN, LEARN + CALIBRATE), slice(LEARN + CALIBRATE, None)
    net = Network()
    rng = np.random.default_rng(3)
    m, v, step = [np.zeros_like(q) for q in net.w], [np.zeros_like(q) for q in net.w], 0
    for _ in range(6):
        order = rng.permutation(LEARN)
        for k in range(0, LEARN, 100):
            step += 1
            part = order[k : k + 100]
            for q, g, a, b in zip(net.w, net.gradients(x[learn][part], y[learn][part]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 5e-3 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w = [q.astype(np.float32) for q in net.w]
    logit = net.forward(x[calibrate])[4]
    sign = np.where(y[calibrate] > 0, -1, 1)
    grid = np.geomspace(0.25, 8, 41)
    net.temperature = float(grid[np.argmin([np.logaddexp(0, sign * logit / t).mean() for t in grid])])
    found = net.scores(x[cut])[y[cut] > 0]
    net.threshold = threshold_for(found)
    assert (found >= net.threshold).mean() >= RECALL
    return net


def network_spans(texts: list[str], base: list[list[tuple[int, int, int]]], net: Network) -> list[list[tuple[int, int, int]]]:
    """Spans that the network adds to each text: candidates apart from the patterns' matches."""
    where, rows = [], []
    for d, (text, spans) in enumerate(zip(texts, base)):
        k = 0
        for i, j in candidates(text):
            while k < len(spans) and spans[k][2] <= i:
                k += 1
            touching, m = [], k
            while m < len(spans) and spans[m][0] < j:
                touching.append(spans[m])
                m += 1
            for p, q in parts(i, j, touching):
                for a, b in windows(text, p, q):
                    where.append((d, p, q))
                    rows.append(codes(text, a, b))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i in range(0, len(rows), 4096):
        for (d, s, e), p in zip(where[i : i + 4096], net.scores(np.array(rows[i : i + 4096]))):
            if p >= net.threshold and (not out[d] or out[d][-1] != (s, 3, e)):
                out[d].append((s, 3, e))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_network, base_sha256, spans)`` of each whole text; bounds in code points, end exclusive.

    Null and empty texts have no span and the digest of the empty string. A match lying over another of
    another kind is kept beside it. Repeated rows give equal results, null ids stay null, other columns
    are not read.
    """
    net = trained()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t", 2 << 20):
            texts = b.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            more = network_spans(texts, base, net)
            n = [[sum(s[1] == k for s in spans) for spans in base] for k in range(3)]
            cols = [pa.array(c, pa.int64()) for c in (*n, [len(m) for m in more])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]), pa.array([_joined(s + m) for s, m in zip(base, more)])], ["id", "n_assign", "n_access", "n_hex", "n_network", "base_sha256", "spans"])

    schema = f"id {kind}, n_assign long, n_access long, n_hex long, n_network long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("t")).transform(in_arrow, run, schema).withColumnRenamed("id", id_col)


MARK = "[SECRET]"


def without_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with each secret in ``text`` replaced by MARK; null texts stay null, all columns and rows are kept."""
    net = trained()
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text, 2 << 20):
            texts = b.column(at).to_pylist()
            filled = [t or "" for t in texts]
            base = [base_spans(t) for t in filled]
            out = []
            for t, spans in zip(texts, (s + m for s, m in zip(base, network_spans(filled, base, net)))):
                if spans:
                    parts, end = [], 0
                    for s, _, e in sorted(spans):
                        if s >= end:
                            parts += (t[end:s], MARK)
                        end = max(end, e)
                    t = "".join(parts) + t[end:]
                out.append(t)
            yield b.set_column(at, text, pa.array(out, b.schema.field(at).type))

    return docs.transform(in_arrow, run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
