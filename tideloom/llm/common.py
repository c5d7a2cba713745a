"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import new_path, remove

#: ``broadcast()`` is used only for narrow rows and only up to this many of them.
BROADCAST_ROWS = 200_000

#: Words of 64 bits of the filters that stand before joins with more keys than that.
FILTER_SLOTS = 1 << 20

#: Arrow batches that Python workers get have about so many bytes at most.
BATCH_BYTES = 8 << 20

_scope: ContextVar[list[str] | None] = ContextVar("stashed", default=None)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later plans neither repeat its work nor
    depend on the executors that did it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if (held := _scope.get()) is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Remove the files of a stashed table that no later plan reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


@contextmanager
def stashing() -> Iterator[list[str]]:
    """Within it, the paths that ``stash`` writes are gathered in the list it gives."""
    held: list[str] = []
    token = _scope.set(held)
    try:
        yield held
    finally:
        _scope.reset(token)


def row_key(key: Column, text: Column) -> Column:
    """128 bits that tell rows apart by id and text; nulls are values of their own."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\n", part(key), part(text))))


def few(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a count shows that ``df`` has at most ``rows`` rows (``BROADCAST_ROWS`` by default)."""
    return df.count() <= (BROADCAST_ROWS if rows is None else rows)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has few rows, else ``df`` itself, for a shuffled join that adaptive execution
    may split where a key is hot."""
    return F.broadcast(df) if few(df, rows) else df


def _bits(key: Column) -> tuple[Column, Column]:
    """The slot of a key in a filter of ``FILTER_SLOTS`` words of 64 bits, and its three bits there."""
    h = F.xxhash64(F.lit("filter"), key)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int"))
    return F.pmod(h, F.lit(FILTER_SLOTS)).cast("int"), bit(46).bitwiseOR(bit(52)).bitwiseOR(bit(58))


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``__in``: false only if their ``key`` is not among ``keys``.

    A Bloom filter of ``FILTER_SLOTS`` words, as a broadcast table with a row for each word that isn't empty; so its size
    is bounded, and rows that are not wanted need no exchange.  It is wrong the more often, the more keys there are;
    a join has to follow.
    """
    slot, bits = _bits(F.col(key))
    words = keys.select(slot.alias("__slot"), bits.alias("__bits")).groupBy("__slot").agg(F.bit_or("__bits").alias("__word"))
    out = rows.withColumns({"__slot": slot, "__bits": bits}).join(F.broadcast(words), "__slot", "left")
    hit = F.coalesce(F.col("__word").bitwiseAND(F.col("__bits")) == F.col("__bits"), F.lit(False))
    return out.withColumn("__in", hit).drop("__slot", "__bits", "__word")


def semi(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``keys(key)``, a stashed table.  Few keys are broadcast; of more, a filter first
    sorts out most other rows, so that those which are wanted are shuffled, and not all."""
    if few(keys):
        return rows.join(F.broadcast(keys), key, "left_semi")
    return marked(rows, keys, key).where("__in").drop("__in").join(keys, key, "left_semi")


def meet(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to a narrow, stashed ``table`` with distinct keys; see ``semi``."""
    if few(table):
        return rows.join(F.broadcast(table), key)
    return marked(rows, table, key).where("__in").drop("__in").join(table, key)


def anti(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` isn't in ``keys(key)``, a stashed table; see ``semi``."""
    if few(keys):
        return rows.join(F.broadcast(keys), key, "left_anti")
    told = marked(rows, keys, key)
    away = told.where("__in").drop("__in").join(keys, key, "left_anti").select(rows.columns)
    return told.where("not __in").drop("__in").unionByName(away)


def lookup(rows: DataFrame, table: DataFrame, key: str, narrow: bool = True) -> DataFrame:
    """``rows`` with the other columns of ``table``, a stashed one with distinct keys; nulls where it has no such key.
    Only a ``narrow`` table is ever broadcast; else rows that can't have a partner are not shuffled."""
    if narrow and few(table):
        return rows.join(F.broadcast(table), key, "left")
    told = marked(rows, table, key)
    more = [c for c in table.columns if c != key]
    columns = [*rows.columns, *more]
    met = told.where("__in").drop("__in").join(table, key, "left").select(columns)
    return told.where("not __in").drop("__in").withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in more}).select(columns).unionByName(met)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, for Python workers: rows with long texts would fill a worker's memory, so the session's bound on the bytes
    of Arrow batches is lowered to ``BATCH_BYTES`` if it is higher.  Plans read that setting when they run, so it stays
    lowered; no other setting of the session is ever changed."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(key))) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for ``count[0]`` values, then the same for the next."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
