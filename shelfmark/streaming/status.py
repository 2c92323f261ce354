"""Upload status: the latest state per key, in batch and as a stream, and micro-batch enrichment."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PENDING, SENT, PROCESSED = "PENDING", "SENT", "PROCESSED"


def latest(events: DataFrame, key: str, state: str, order: Column) -> DataFrame:
    """The last state of each key: one partial aggregate, the same in a batch and in a stream's complete or update mode."""
    return events.groupBy(key).agg(F.max_by(state, order).alias(state), F.max(order).alias("at"))


def advanced(events: DataFrame, key: str, event: str) -> DataFrame:
    """State of each book: PROCESSED once a success was seen, else SENT once a send or an error was seen, else PENDING; with counts."""
    rank = F.when(F.col(event) == "success", 2).when(F.col(event).isin("send", "error"), 1).otherwise(0)
    top = F.max(rank)
    state = F.when(top == 2, PROCESSED).when(top == 1, SENT).otherwise(PENDING)
    return events.groupBy(key).agg(state.alias("state"), F.count("*").alias("n_events"), F.count_if(F.col(event) == "error").alias("n_errors"))


def stream_of(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 8) -> DataFrame:
    """Files landing in a folder, a bounded number each micro-batch: backpressure instead of a rejecting queue."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a folder of this machine, and that only if the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="shelfmark-")


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process all that is there into the in-memory table ``name`` and give it: for tests and small states."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def enrich_to(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Enrich every micro-batch and write it under its batch id, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
