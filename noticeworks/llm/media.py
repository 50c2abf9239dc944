"""Media columns: bytes kept as lossless WebP images, written, read back and described.

A payload is stored as images of up to 4,096 bytes one behind the other, four samples a pixel; all images of a
batch are coded and decoded side by side (``webp_batch``).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp_batch
from .common import by_bytes, documents, in_arrow, text_or_empty

#: Bytes of an image; more bytes take several images.
IMAGE_BYTES = 4 * webp_batch.PIXELS


def padded(data: bytes) -> bytes:
    """The bytes, filled up with 0 to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 if data else 64)


def _swapped(px: np.ndarray) -> np.ndarray:
    """Red and blue change places: samples in order of their bytes, as pixels and back."""
    return (px & np.uint32(0xFF00FF00)) | (px & np.uint32(255)) << np.uint32(16) | px >> np.uint32(16) & np.uint32(255)


def images_of(payload: bytes) -> list[np.ndarray]:
    """A payload (a multiple of 64 bytes) as ARGB pixels of images, samples in the order red, green, blue, alpha."""
    return [_swapped(np.frombuffer(payload[i : i + IMAGE_BYTES], "<u4")).reshape(-1, webp_batch.WIDTH) for i in range(0, len(payload), IMAGE_BYTES)]


def files_of(stored: bytes) -> list[bytes]:
    """The image files of a stored form."""
    out, at = [], 0
    while at < len(stored):
        size = 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        out.append(stored[at : at + size])
        at += size
    return out


def pixels(argb: np.ndarray) -> np.ndarray:
    """``(height, width, 4)`` array of the red, green, blue and alpha samples of an image."""
    return np.ascontiguousarray(_swapped(argb), "<u4").view(np.uint8).reshape(*argb.shape, 4)


def store_many(payloads: list[bytes]) -> list[bytes]:
    images = [images_of(p) for p in payloads]
    files = iter(webp_batch.encode_many([x for i in images for x in i]))
    return [b"".join(next(files) for _ in i) for i in images]


def load_many(stored: list[bytes]) -> list[bytes]:
    files = [files_of(s) for s in stored]
    images = iter(webp_batch.decode_many([f for x in files for f in x]))
    return [b"".join(pixels(next(images)).tobytes() for _ in x) for x in files]


def store(payload: bytes) -> bytes:
    return store_many([payload])[0]


def load(stored: bytes, payload_bytes: int) -> bytes:
    return load_many([stored])[0][:payload_bytes]


def feature(payload: bytes) -> str:
    """Mean and spread of the samples, their entropy in bits, and a 64-bit difference hash over 65 equal spans."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    spread = (float(counts @ (values * values)) / len(x) - mean * mean) ** 0.5
    share = counts[counts > 0] / len(x)
    sums = np.add.reduceat(x, np.arange(65) * len(x) // 65, dtype=np.int64) if len(x) >= 65 else np.resize(x.astype(np.int64), 65)
    bits = np.packbits(sums[1:] > sums[:-1]).tobytes().hex()
    return f"{mean:.4f}:{max(spread, 0):.4f}:{float(-(share * np.log2(share)).sum()) + 0.0:.4f}:{bits}"


def media_columns(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """Each text as a stored image with what reading it back gives; ``keep_media`` adds the image itself.

    Null and empty texts are 64 bytes of 0. Texts of any length are stored whole, equal texts give equal
    values, null ids stay null, other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"][: 8 + keep_media]
    types = [kind, "long", "long", "string", "long", "long", "string", "string", "binary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t", 3 << 20):
            raws = [v.as_buffer().to_pybytes() for v in b.column(1)]
            media = store_many([padded(r) for r in raws])
            rows = []
            for raw, stored, back in zip(raws, media, load_many(media)):
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back), stored)[: 7 + keep_media])
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("t")).transform(in_arrow, run, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    return out.withColumnRenamed("id", id_col)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
