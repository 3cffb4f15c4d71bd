"""User functions over rows, with errors as values, and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_with_errors(rows: DataFrame, key: str, column: str, function: Callable[[object], str]) -> DataFrame:
    """(key, value, error): ``function`` of every value; what it raises becomes the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf[column]):
                try:
                    out.append((k, str(function(x)), None))
                except Exception as e:  # noqa: BLE001 - errors are values
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "value", "error"])

    return rows.select(key, column).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, value string, error string")


def batches(rows: DataFrame, index: str, size: int) -> DataFrame:
    """The rows with the number of their batch of ``size`` consecutive positions."""
    return rows.withColumn("batch", F.floor(F.col(index) / size).cast("long"))
