"""Time-based sliding windows over edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


#: So many boundaries, a long each, are broadcast.
FEW_BOUNDARIES = 100_000


def wscan(edges: DataFrame, window: int) -> DataFrame:
    """Each edge with the interval in which it is valid: ``src, label, trg, vs, ve``, ``[ts, ts + window)``."""
    return edges.select("src", "label", "trg", F.col("ts").alias("vs"), (F.col("ts") + window).alias("ve"))


def slide_boundaries(edges: DataFrame, slide: int, start: int | None = None, flush: bool = True) -> DataFrame:
    """Where the window slides, ``idx, b``: at the first edge ``slide`` or more after the start, then at the first that
    far after that boundary, and so on; with ``flush`` a last one right after the last edge.

    The times are made distinct in parallel; one task then streams through them in order, holding a batch at a time.
    """
    times = edges.select("ts").where("ts is not null").distinct()
    times = times.repartition(1).sortWithinPartitions("ts")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, idx, last = start, 0, None
        for batch in batches:
            ts = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ts):
                continue
            last = int(ts[-1])
            base = int(ts[0]) if base is None else base
            out, at = [], 0
            while (at := at + int(np.searchsorted(ts[at:], base + slide))) < len(ts):
                base = int(ts[at])
                out.append(base)
            yield pa.RecordBatch.from_arrays([pa.array(range(idx, idx + len(out)), pa.int64()), pa.array(out, pa.int64())], names=["idx", "b"])
            idx += len(out)
        if flush and last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([idx], pa.int64()), pa.array([last + 1], pa.int64())], names=["idx", "b"])

    return times.mapInArrow(walk, "idx long, b long")


def valid_at(edges: DataFrame, instant: int, window: int) -> DataFrame:
    """``src, label, trg`` of the edges valid at an instant: ``ts <= instant < ts + window``."""
    rows = edges.where((F.col("ts") <= instant) & (F.col("ts") > instant - window))
    return rows.select("src", "label", "trg").distinct()


def at_boundary(edges: DataFrame, boundary: int, window: int) -> DataFrame:
    """``src, label, trg`` of the edges in the window when it slides: ``ts < boundary < ts + window``.  The edge that
    makes the window slide isn't in it yet."""
    rows = edges.where((F.col("ts") < boundary) & (F.col("ts") > boundary - window))
    return rows.select("src", "label", "trg").distinct()


def at_boundaries(edges: DataFrame, boundaries: DataFrame, window: int, slide: int) -> DataFrame:
    """``b, src, label, trg`` for all boundaries at once.

    Boundaries are a slide apart at least, but for the last one, so a time bucket of a slide's length has two of them at
    most.  An edge is repeated for the buckets that its interval touches, which is as often as it is in a window, and
    meets boundaries by equal buckets; so this is an equi-join, and not one of ranges.  ``FEW_BOUNDARIES`` are broadcast
    after a count, so that edges aren't dealt out by a few keys; beyond that keys are many.
    """
    slide = max(int(slide), 1)
    touched = F.sequence(F.floor((F.col("ts") + 1) / slide), F.floor((F.col("ts") + window - 1) / slide))
    edges = edges.select("src", "label", "trg", "ts").withColumn("_bucket", F.explode(touched))
    marks = boundaries.select("b", F.floor(F.col("b") / slide).alias("_bucket"))
    if boundaries.count() <= FEW_BOUNDARIES:
        marks = F.broadcast(marks)
    rows = edges.join(marks, "_bucket").where((F.col("ts") < F.col("b")) & (F.col("ts") + window > F.col("b")))
    return rows.select("b", "src", "label", "trg").distinct()


def latest_per_epoch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of a key the interval that ends last: ``keys, vs, ve``."""
    return rows.groupBy(*keys).agg(F.max(F.struct("ve", "vs")).alias("_i")).select(*keys, "_i.vs", "_i.ve")
