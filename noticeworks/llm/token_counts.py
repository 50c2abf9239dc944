"""Token counts: lengths of encoded texts, never the ids.

Batches hold about the same bytes whatever the texts' lengths, and a text of any length is encoded in
segments that end where no piece of the vocabulary reaches across, so the counts are those of the
whole text. Segments that return are looked up in a cache of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import Kept, by_bytes, documents, in_arrow, text_or_empty

#: Bytes of a worker's caches, about; beyond it they begin anew.
WORDS_KEPT, SEGMENTS_KEPT = 64 << 20, 40 << 20


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class SentencePieceCounter:
    """Counts as the library does on the whole text, from counts of segments by the same library."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = not pieces.model(path).identity  # a normaliser may reach across any cut
        self.cut = pieces.cutter(path)
        self.words, self.segments = Kept(WORDS_KEPT), Kept(SEGMENTS_KEPT)
        # Many segments are encoded at once with a mark between them that no piece joins with anything.
        self.mark = "\n"
        if any(self.mark in p for p in pieces.model(path).normal):
            raise ValueError("the vocabulary has pieces with a newline")
        self.mark_ids = np.array(self.lib.encode(self.mark)[1:])

    def encoded(self, segments: list[str]) -> list[int]:
        """Counts of segments, encoded in one call; the last id of the mark parts them."""
        if len(self.mark_ids) != 1:
            return [len(self.lib.encode(self.mark + s)) - 1 - len(self.mark_ids) for s in segments]
        ids = np.array(self.lib.encode(self.mark + self.mark.join(segments) + self.mark))
        return (np.diff(np.flatnonzero(ids == self.mark_ids[0])) - 1).tolist()

    def learn(self, new: list[str]) -> dict[str, int]:
        """Counts of words that aren't kept; what fits is kept."""
        cuts = [self.cut(w) for w in new]
        kept = self.segments
        known = {s: kept[s] for c in cuts for s in c if s in kept}
        known[self.mark] = len(self.mark_ids)
        fresh = list({s for c in cuts for s in c if s not in known})
        for i in range(0, len(fresh), 1000):
            part = fresh[i : i + 1000]
            known.update(zip(part, self.encoded(part)))
        found = {w: sum(map(known.__getitem__, c)) for w, c in zip(new, cuts)}
        kept.keep({s: known[s] for s in fresh})
        return found

    def counts(self, texts: list[str]) -> list[int]:
        if self.whole:
            return [len(x) for x in self.lib.encode(texts)]
        split = [words_with_spaces(t) for t in texts]
        words = self.words
        new = {w for ws in split for w in ws if w not in words}
        found = self.learn(list(new)) if new else {}
        words.update(found)  # all of the batch's for the moment
        out = [sum(map(words.__getitem__, ws)) for ws in split]
        words.keep(found)
        return out


def words_with_spaces(text: str) -> list[str]:
    """A text with a space in front, cut before each run of spaces; a piece never holds a space behind another character."""
    return spaced(text.replace(pieces.SPACE, " ").split(" ")) if text else []


def words_of_normalised(text: str) -> list[str]:
    """A normalised text, cut before each run of its spaces."""
    parts = text.split(pieces.SPACE)
    first, rest = parts[0], spaced(parts[1:]) if len(parts) > 1 else []
    return [first, *rest] if first else rest


def spaced(parts: list[str]) -> list[str]:
    """Words parted by single spaces, each with the spaces ahead of it."""
    if "" not in parts:
        return [pieces.SPACE + p for p in parts]
    out, run = [], ""
    for p in parts:
        run += pieces.SPACE
        if p:
            out.append(run + p)
            run = ""
    if run:
        out.append(run)
    return out


class TokenizersCounter:
    """Counts of a tokenizers file; whole texts, without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.lib.encode_batch(texts, add_special_tokens=False)]


def counter(path: str):
    return TokenizersCounter(path) if path.endswith(".json") else SentencePieceCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id", batch_bytes: int = 1 << 20) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of each row.

    Null and empty texts count 0 bytes and 0 tokens; null ids stay null; repeated rows are counted each;
    other columns, whatever their names, are not read. A text of any length is counted whole.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in by_bytes(batches, "t", batch_bytes):
            t = b.column(1)
            n = count.counts(t.to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(t), pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("t")).transform(in_arrow, run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(documents(spark, sf_dir))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)
