"""Attachments: kind by first bytes, text of DOCX, digests; other kinds keep what a landed reading gives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.functions.text import clean_whitespace


def kind_of(content: Column) -> Column:
    """pdf, docx, doc or unknown, whatever the name says."""
    h = F.hex(F.substring(content, 1, 8))
    return F.when(h.startswith("255044462D"), "pdf").when(h.startswith("504B0304"), "docx").when(h.startswith("D0CF11E0A1B11AE1"), "doc").otherwise("unknown")


def docx_text(content: bytes) -> str:
    """Text of a DOCX: paragraphs by line, tabs kept; of a broken one nothing."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, NotImplementedError, RuntimeError):
        return ""
    xml = re.sub(r"<w:tab\b[^>]*/>", "\t", re.sub(r"<w:br\b[^>]*/>|</w:p>", "\n", xml))
    return unescape(re.sub(r"<[^>]+>", "", xml))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, kind, sha256, text, needs_ocr)`` of files in a folder; PDF and DOC texts come from landed readings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [docx_text(c) if k == "docx" else "" for c, k in zip(b.column(3).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], ["path", "kind", "sha256", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", kind_of(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"), "content").mapInArrow(run, "path string, kind string, sha256 string, text string")
    rows = rows.withColumn("text", clean_whitespace(F.col("text")))
    return rows.withColumn("needs_ocr", (F.col("kind") == "pdf") & (F.length(F.regexp_replace("text", r"\s", "")) < 120))


def pending(texts: DataFrame, cache: DataFrame, prompt: str, model: str, text: str = "text") -> DataFrame:
    """Texts that a model has still to read: long enough, and not in the cache by the digest of prompt, model and text."""
    key = F.sha2(F.concat_ws("\0", F.lit(prompt), F.lit(model), F.col(text)), 256)
    long_enough = F.length(F.regexp_replace(text, r"\s", "")) >= 80
    return texts.where(long_enough).withColumn("key", key).join(cache.select("key"), "key", "left_anti")


def readings(landed: DataFrame, column: str = "raw") -> DataFrame:
    """A model's landed answers as structs; a fenced block is read as what it holds, an unreadable answer as null."""
    schema = (
        "headline string, itemDescription string, itemTags array<string>, caseNumber string, appraisedValue double, startingPrice double, deposit double, saleTime string, auctionRound string, "
        "saleMethod string, auctionLocation string, municipality string, cadastral struct<kc:array<string>,zkUlozak:array<string>,ko:array<string>>"
    )
    fenced = F.regexp_extract(column, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return landed.withColumn("llm", F.from_json(F.when(fenced != "", fenced).otherwise(F.col(column)), schema))


def tolerable(readings_: DataFrame, most: float = 0.25, least: int = 3) -> DataFrame:
    """The readings, failing the query where too many of them failed."""
    failed = readings_.agg(F.count_if(F.col("llm").isNull()).alias("bad"), F.count("*").alias("all"))
    ok = failed.select(F.assert_true((F.col("bad") < least) | (F.col("bad") <= most * F.col("all")), F.lit("too many readings failed")).alias("x")).where("x is null")
    return readings_.crossJoin(F.broadcast(ok.select(F.lit(1).alias("_ok")))).drop("_ok")  # one row
