"""The pairs within groups, large groups dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 4_000


def pairs_within(rows: DataFrame, key: str, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, x, y): the pairs x < y of the values of a key. rows: key and value, each once.

    A key of more than ``hot_rows`` values is dealt to tasks on one side and copied to them on the other.
    """
    large = rows.groupBy(key).count().where(F.col("count") > hot_rows).select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("salts"))
    salted = rows.join(large, key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = salted.select(key, F.col(value).alias("x"), F.pmod(F.xxhash64(value), F.col("salts")).cast("int").alias("salt"))
    right = salted.select(key, F.col(value).alias("y"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, [key, "salt"]).where("x < y").select(key, "x", "y")
