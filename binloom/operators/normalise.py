"""Normalisation and encoding of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.operators.order import ranked


def over_mean(rows: DataFrame, key: str, value: str, eps: float = 0.0) -> DataFrame:
    """Each value over the mean of its row (``key``)."""
    return rows.withColumn(value, F.col(value) / (F.avg(value).over(Window.partitionBy(key)) + eps))


def z_scores(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Values of a column (``column``) less their mean, over their population deviation; null without any spread."""
    w = Window.partitionBy(column)
    return rows.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def dense_labels(rows: DataFrame, label: str, order: str) -> DataFrame:
    """(label, code): labels numbered from 0 as they come first by ``order``; one row a label."""
    first = rows.groupBy(label).agg(F.min(order).alias("first"))
    return ranked(first, "first", label, name="code").select(label, "code")
