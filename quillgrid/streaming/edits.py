"""Edit logs as a stream: each micro-batch is reduced to the latest edit of a cell and merged by its number."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edits import latest


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``.

    Only on a single machine may that setting be absent; then a local folder is made.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def latest_by_cell(stream: DataFrame, key: list[str]) -> DataFrame:
    """Running state of an edit stream: the value with the greatest ``seq`` of each cell (update or complete mode)."""
    return stream.groupBy(*key).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def merge_batches(stream: DataFrame, key: list[str], path: str, checkpoint: str):
    """Append each micro-batch's latest edits to a log at ``path``; replayed batches change nothing for readers.

    Readers take ``latest`` of the log, so the order of batches and repeated edits do not matter.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch, key).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_edit_counts(stream: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Edits per window and type, with late rows up to ``late``. An extension."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"))
