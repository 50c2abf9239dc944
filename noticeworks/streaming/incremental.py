"""Arrivals as streams: repeats dropped, batches merged into an archive that loses no row."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="noticeworks-")
        atexit.register(shutil.rmtree, made, True)
        at = f"file://{made}"
    return f"{at.rstrip('/')}/{uuid.uuid4().hex[:12]}"


def deduplicated_counts(spark: SparkSession, path: str, key: str = "event_id", time: str = "ts", kind: str = "event_type", late: str = "60 days") -> DataFrame:
    """Different events by kind, from a stream over files that drops repeats while they may still come."""
    schema = spark.read.parquet(path).schema
    out = _folder(spark)
    events = spark.readStream.schema(schema).parquet(path.rpartition("/")[0], pathGlobFilter=path.rpartition("/")[2]).withColumn(time, F.col(time).cast("timestamp"))
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    q = once.select(kind).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(once.select(kind).schema).parquet(f"{out}/rows").groupBy(kind).agg(F.count("*").alias("n"))


class Archive:
    """Versions of a table in a folder: whole ones (``v1``) and what later batches changed (``d2``, ``d3``).

    A batch writes its own rows only; from time to time one writes the whole table anew. Readers see versions
    that were written to their end.
    """

    #: Batches kept as changes before the table is written whole.
    CHANGES = 8

    def __init__(self, spark: SparkSession, path: str, key: str, order: str):
        self.spark, self.path, self.key, self.order = spark, path, key, order
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self) -> tuple[int, list[int]]:
        """The last whole version (0 without one), and the changes behind it."""
        top = self._path("")
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        done = [n for n in names if n[:1] in "vd" and n[1:].isdigit() and self._fs.exists(self._path(f"{n}/_SUCCESS"))]
        whole = max((int(n[1:]) for n in done if n[0] == "v"), default=0)
        return whole, sorted(int(n[1:]) for n in done if n[0] == "d" and int(n[1:]) > whole)

    def version(self) -> int:
        whole, changes = self._versions()
        return changes[-1] if changes else whole

    def read(self) -> DataFrame | None:
        """The table: whole rows that no change replaced, and of the changes the last of each key."""
        whole, changes = self._versions()
        if not whole:
            return None
        base = self.spark.read.parquet(f"{self.path}/v{whole}")
        if not changes:
            return base
        later = None
        for v in changes:
            part = self.spark.read.parquet(f"{self.path}/d{v}").withColumn("_v", F.lit(v))
            later = part if later is None else later.unionByName(part)
        rest = [c for c in base.columns if c != self.key]
        newest = later.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_v").alias("r")).select(self.key, "r.*")
        return base.join(newest.select(self.key), self.key, "left_anti").unionByName(newest)

    def merge(self, batch: DataFrame) -> None:
        """Rows of a batch replace those of the same key; rows it lacks are carried on. An unreadable archive is an error, never an empty one."""
        rest = [c for c in batch.columns if c != self.key]
        newest = batch.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.col(self.order)).alias("r")).select(self.key, "r.*")
        whole, changes = self._versions()
        new = (changes[-1] if changes else whole) + 1
        if whole and len(changes) < self.CHANGES:
            newest.write.mode("overwrite").parquet(f"{self.path}/d{new}")
            return
        prior = self.read()
        out = newest if prior is None else newest.unionByName(prior.join(newest, self.key, "left_anti"))
        out.write.mode("overwrite").parquet(f"{self.path}/v{new}")

    def follow(self, stream: DataFrame, state: str) -> None:
        """Merges all that has arrived, batch by batch, and ends."""
        q = stream.writeStream.foreachBatch(lambda df, _: self.merge(df)).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
