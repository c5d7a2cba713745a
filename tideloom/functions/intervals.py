"""Half-open intervals ``[vs, ve)`` as two columns, and sets of them per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def overlaps(a_vs: Column, a_ve: Column, b_vs: Column, b_ve: Column) -> Column:
    """Whether two intervals share an instant; an empty one shares none."""
    return F.greatest(a_vs, b_vs) < F.least(a_ve, b_ve)


def intersect(a_vs: Column, a_ve: Column, b_vs: Column, b_ve: Column) -> tuple[Column, Column]:
    return F.greatest(a_vs, b_vs), F.least(a_ve, b_ve)


def hull(a_vs: Column, a_ve: Column, b_vs: Column, b_ve: Column) -> tuple[Column, Column]:
    return F.least(a_vs, b_vs), F.greatest(a_ve, b_ve)


def coalesce(rows: DataFrame, keys: list[str], stretch: int | None = None) -> DataFrame:
    """The canonical form per key: the fewest intervals that cover the same instants.  Touching intervals merge, empty
    ones vanish.  Columns other than the keys, ``vs`` and ``ve`` are dropped.

    A key's intervals are worked through by one task.  Where a key may have very many, ``stretch`` splits them by when they
    begin, into times of that length, which are coalesced apart from each other; what is left of them is few.
    """
    rows = rows.where("vs < ve").select(*keys, "vs", "ve")
    if stretch:
        return coalesce(coalesce(rows.withColumn("_stretch", F.floor(F.col("vs") / stretch)), [*keys, "_stretch"]), keys)
    by = Window.partitionBy(*keys).orderBy("vs", "ve")  # one exchange serves the windows and the grouping
    rows = rows.withColumn("_reach", F.max("ve").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("_reach").isNull() | (F.col("vs") > F.col("_reach")), 1).otherwise(0)
    rows = rows.withColumn("_island", F.sum(opens).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("vs").alias("vs"), F.max("ve").alias("ve")).drop("_island")


def timeslice(rows: DataFrame, instant: int) -> DataFrame:
    """The rows valid at an instant, without their intervals."""
    return rows.where((F.col("vs") <= instant) & (F.col("ve") > instant)).drop("vs", "ve").distinct()


def expire(rows: DataFrame, instant: int) -> DataFrame:
    """Without the rows that have ended by the instant."""
    return rows.where(F.col("ve") > instant)


def expiry_bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The least and the largest expiry per key."""
    return rows.groupBy(*keys).agg(F.min("ve").alias("min_expiry"), F.max("ve").alias("max_expiry"))
