"""Incremental load: new papers as a stream, de-duplicated against what is loaded."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.structure import deduplicated


def loaded_papers(spark: SparkSession, target: str) -> DataFrame | None:
    """What ``target`` holds, on any file system; None if it isn't there or holds nothing yet."""
    try:
        return spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_increment(new: DataFrame, target: str, order: list[str], batch: int | None = None) -> DataFrame:
    """The rows of ``new`` whose source ``target`` (a Parquet folder, may be missing) doesn't hold, one a source.

    ``batch``: number of the batch that the rows are; what an earlier try of it left doesn't count as loaded.
    """
    loaded = loaded_papers(new.sparkSession, target)
    if loaded is not None and batch is not None and "batch_id" in loaded.columns:
        loaded = loaded.where(F.col("batch_id") != batch)
    return deduplicated(new, order, loaded)


def stream_papers(spark: SparkSession, folder: str, target: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Add every new file of papers under ``folder`` to ``target``, first of each source wins; runs over what is there and ends.

    A batch is the partition ``batch_id`` of the target and replaces what it wrote before, so a replay adds nothing twice.
    """
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).parquet(folder)

    def write(rows: DataFrame, batch: int) -> None:
        load_increment(rows, target, order, batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
