"""Helpers that the operators share: columnar tokenising in numpy, batching by bytes, written tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a step of a numpy kernel takes at once; bounds the memory of a worker.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch between Spark and Python; one longer row is a batch of its own.
BATCH_BYTES = 8 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))

#: Word bytes: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Everything but space and the bytes 9 to 13.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, *range(9, 14)]] = False
#: Maps A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        made = []
        for base in (_P, _PINV):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        if n > 4 * CHUNK_BYTES:  # one giant word; not worth keeping
            return made[0], made[1]
        _tables[:] = made
    return _tables[0], _tables[1]


def words_of(texts: pa.Array, word: np.ndarray = WORD, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a string array, with first word of each row, and byte bounds.

    Returns ``(hashes, offsets, starts, ends)``: row ``i`` has the words ``offsets[i]`` to
    ``offsets[i + 1]``; bounds count from the first byte of the array's data. Null rows have none.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or at[-1] == at[0]:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), none, none
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    is_word = word[data]
    first, last = is_word.copy(), is_word.copy()
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    first[1:] &= ~is_word[:-1] | cut[1:-1]
    last[:-1] &= ~is_word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            p, q = _powers(hi - lo + 1)
            part = data[lo:hi]
            if lower is not None:
                part = lower[part]
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=sums[1:])
            hashes[i:j] = mix64((sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * q[starts[i:j] - lo])
            i = j
    return hashes, np.searchsorted(starts, at).astype(np.int64), starts, ends


def shingles_of(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, in order; a row of fewer words has one shingle of them all."""
    n, counts = len(hashes), np.diff(offsets)
    with np.errstate(over="ignore"):
        if n >= size:
            x = np.zeros(n - size + 1, np.uint64)
            for k in range(size):
                x = x * _P + hashes[k : n - size + 1 + k]
            x = mix64(x)
        else:
            x = np.empty(0, np.uint64)
        per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        out = np.empty(int(per.sum()), np.uint64)
        to = np.concatenate([[0], np.cumsum(per)])
        whole = np.flatnonzero(counts >= size)
        take = np.repeat(offsets[whole] - to[whole], per[whole])
        put = np.repeat(counts >= size, per)
        out[put] = x[np.flatnonzero(put) + take]
        for i in np.flatnonzero((counts > 0) & (counts < size)):
            y = np.uint64(int(counts[i]))
            for h in hashes[offsets[i] : offsets[i + 1]]:
                y = y * _P + h
            out[to[i]] = mix64(np.array([y], np.uint64))[0]
    return out, to


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``text`` and at most ``rows`` rows; one longer row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        wide = pa.types.is_large_string(col.type)
        at = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        i = 0
        while i < len(col):
            j = min(i + rows, max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j


class Kept(dict):
    """A cache from strings, of bounded bytes: what would lead beyond them makes it begin anew, with those just used if there is room; long strings aren't kept."""

    LONGEST, EACH = 4096, 120

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, found: dict, used: Iterable[str] = ()) -> None:
        """Keeps ``found``, which may be in it already, or what of it fits; ``used`` may stay."""
        for k in [k for k in found if len(k) > self.LONGEST]:
            self.pop(k, None)
            del found[k]
        size = self._size(found)
        if self.held + size > self.most:
            recent = {k: self[k] for k in used if k in self and k not in found}
            self.clear()
            self.held = 0
            if size > self.most:
                return
            if (more := self._size(recent)) + size <= self.most // 2:
                self.update(recent)
                self.held = more
        self.update(found)
        self.held += size

    def _size(self, some: dict) -> int:
        return sum(map(len, some)) * 2 + self.EACH * len(some)


class _Libc:
    """The C library, opened where it is first used; a worker opens its own."""

    def __getattr__(self, name: str):
        return getattr(ctypes.CDLL(None), name)


_libc = _Libc()


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes, whatever the rows' lengths; a worker gives its memory back when a task ends."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = re.fullmatch(r"(\d+)b?", str(conf.get(name)))
    if not bound or int(bound[1]) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(_libc, "malloc_trim"):
            _libc.malloc_trim(0)

    return df.mapInArrow(returned, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="noticeworks-")
        atexit.register(shutil.rmtree, made, True)
        at = "file://" + made
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage is cut, a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = shared_dir(spark)
    for df in frames:
        for d in {os.path.dirname(f) for f in df.inputFiles()}:
            if d.startswith(base) or d.replace("file:///", "file:/").startswith(base.replace("file:///", "file:/")):
                path = jvm.org.apache.hadoop.fs.Path(d)
                path.getFileSystem(conf).delete(path, True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
