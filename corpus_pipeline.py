"""A corpus pipeline: five stages, each one of the operators, each written as Parquet and read again.

A stage takes ``(spark, docs, sf_dir)``, works on every row the stage before kept and gives the columns of
``documents``; the last gives the encoded texts. Id and text tell rows apart, so a row goes for what its own text
is. Any column may be null: a null text counts as empty, a row without an id is never taken for a duplicate or for
contaminated. Empty tables give empty tables, and further columns of any name are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import decontaminate, quality, secret_scan, simhash_dedup, transducer
from noticeworks.llm.common import documents, fresh_path

#: Keys of rows to go (two numbers each) that may be broadcast; beyond it they are shuffled.
BROADCAST_IDS = 500_000

#: The stages learn, vote and search; SQL can't express them.
ORACLE_SQL = None


def _key(docs: DataFrame) -> Column:
    """A struct of id and text's hash that tells rows apart; null where the id is."""
    return F.when(docs["doc_id"].isNotNull(), F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("h")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key(docs).alias("row_key"), "text")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't among ``keys (row_key)``; another text of the same id stays, and rows without an id."""
    keys = keys.where("row_key is not null").distinct()
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, _key(docs) == keys["row_key"], "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that the quality classifier rejects; it learns from the same labels as its query. Null texts are judged as empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, F.crc32(F.col("id").cast("string")) % 5 != 0)
    return quality.accepted(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least id stays, of equal ids one; of rows equal in id and text, one.

    Rows without an id, and texts without words that differ, are in no class and stay.
    """
    classes = simhash_dedup.near_duplicates(_keyed(docs), id_col="row_key")
    out = _without(docs, classes.where("row_key <> class_id").select("row_key"))
    repeated = _keyed(docs).where("row_key is not null").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:
        out = out.where("doc_id is null").unionByName(out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that hold a passage of the benchmark; rows without an id, empty and null texts stay."""
    found = decontaminate.contamination(_keyed(docs).where("row_key is not null"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row_key")
    return _without(docs, found.select("row_key"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; each secret in a text becomes a mark, and ``n_chars`` counts anew."""
    out = secret_scan.without_secrets(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as ids, with whether they decode to it; null and empty texts have none."""
    return transducer.encode_documents(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("sentencepiece encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
