"""Retrieval measures over confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measures(tp: Column, fp: Column, fn: Column, tn: Column, beta: float = 1.0) -> dict[str, Column]:
    precision, recall = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    f = F.try_divide((1 + beta * beta) * precision * recall, beta * beta * precision + recall)
    return {"precision": precision, "recall": recall, "f": f, "accuracy": F.try_divide((tp + tn).cast("double"), tp + fp + fn + tn)}


def confusion(found: DataFrame, true: DataFrame, keys: list[str], universe: Column | None = None) -> DataFrame:
    """One row: tp, fp, fn and, if the number of all possible pairs is given, tn."""
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(true.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full")
    counts = both.agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return counts.withColumn("tn", (universe - F.col("tp") - F.col("fp") - F.col("fn")) if universe is not None else F.lit(0))
