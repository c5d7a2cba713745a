"""Filters, unions and projections of edges and of ``src, trg`` relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def partition_by_label(edges: DataFrame, labels: list[str]) -> list[DataFrame]:
    """The edges of each label, without the label.  Labels may repeat; each stream is filtered for itself."""
    return [edges.where(F.col("label") == name).drop("label") for name in labels]


def not_loops(rows: DataFrame) -> DataFrame:
    """Rows whose endpoints differ."""
    return rows.where("src <> trg")


def swapped(rows: DataFrame) -> DataFrame:
    """Rows with source and target exchanged."""
    other = {"src": "trg", "trg": "src"}
    return rows.select(*[F.col(other.get(c, c)).alias(c) for c in rows.columns])


def labelled(rows: DataFrame, label: str) -> DataFrame:
    return rows.withColumn("label", F.lit(label))


def union(streams: list[DataFrame]) -> DataFrame:
    """All rows of all streams, as a bag."""
    return reduce(DataFrame.unionByName, streams)
