"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import small, stash

#: 13 hexadecimal digits of an MD5 hash make a uniform number.
DIGITS = 13
#: A row's copies are made in one task up to so many.
CHUNK = 1000


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    text = F.concat_ws(":", F.lit(seed), *cols)
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_inverse(rate: Column, at: Column) -> Column:
    """The least k at which the cumulative distribution of Poisson(``rate``) reaches ``at``.

    A running sum over k up to far into the tail, in steps whose number is that of the copies a row can get; nothing is
    held but the sum.  Terms are built in logarithms, so that a large rate does not underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), (F.exp(-rate) < at).cast("long").alias("copies"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate / k)
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), (acc["copies"] + (total < at).cast("long")).alias("copies"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["copies"]


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    rows: float | None = None,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    copy_col: str | None = "copy",
) -> DataFrame:
    """``docs`` with each row repeated as often as its source needs, in a globally shuffled order.

    ``weights(source, weight)`` holds the shares of the result that sources should have, in any scale; without it all
    sources weigh the same.  A source that it does not name, or names with a null or no positive weight, gets no rows.
    ``rows`` is the expected size of the result (default: that of the input).  A source's mean repetition rate is its
    share times ``rows`` over its row count, and a row is repeated as often as the inverse of that Poisson distribution
    says at a uniform number hashed from seed and id; so a run gives the same counts again, whatever the partitioning.
    Copies are numbered from 0 in ``copy_col`` (none if it is None; a column of that name is replaced).

    A null source is a source of its own.  Repeated rows draw the same number and are repeated alike; rows with a null
    id draw by their text.  A null text stays.  An empty table gives an empty result.

    Rates are one row per source and are broadcast only after a count.  Rows are dealt by a hash of seed, id and copy,
    so a hot source spreads evenly.  Where a source is so rare that its rows are repeated more than ``CHUNK`` times, its
    rows are first split into chunks of copies, which are dealt out before the copies are made.
    """
    counts = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        shares = counts.withColumn("_weight", F.lit(1.0))
    else:
        given = weights.select(F.col("source").alias("_given"), F.greatest(F.col("weight"), F.lit(0)).cast("double").alias("_weight"))
        shares = counts.join(given, F.col("_source").eqNullSafe(F.col("_given"))).drop("_given")
    totals = shares.agg(F.sum("_weight").alias("_all"), F.sum("_n").alias("_rows"))
    wanted = F.col("_rows") if rows is None else F.lit(float(rows))
    rates = shares.crossJoin(F.broadcast(totals)).where("_weight > 0")  # totals is one row
    rates = stash(rates.select(F.col("_source").alias("__mix_of"), (F.col("_weight") / F.col("_all") * wanted / F.col("_n")).alias("__mix_rate")), "rates")

    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    out = docs.withColumn("__mix_name", name).join(small(rates, 10_000), F.col(source_col).eqNullSafe(F.col("__mix_of")))
    out = out.withColumn("__mix_copies", poisson_inverse(F.col("__mix_rate"), uniform(seed, F.col("__mix_name")))).where("__mix_copies > 0")
    often = F.col("__mix_rate") > CHUNK / 2
    last = F.col("__mix_copies") - 1
    plain = out.where(~often).withColumn("__mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if not rates.where(often).isEmpty():
        chunked = out.where(often).withColumn("__mix_first", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(CHUNK).cast("long"))))
        chunked = chunked.repartition("__mix_name", "__mix_first")
        plain = plain.unionByName(chunked.withColumn("__mix_copy", F.explode(F.sequence(F.col("__mix_first"), F.least(F.col("__mix_first") + CHUNK - 1, last)))).drop("__mix_first"))
    out = plain.withColumn("__mix_order", F.md5(F.concat_ws(":", F.lit(seed), "__mix_name", F.col("__mix_copy"))))
    out = out.repartition("__mix_order").sortWithinPartitions("__mix_order").drop("__mix_order", "__mix_of", "__mix_rate", "__mix_copies", "__mix_name")
    return out.drop("__mix_copy") if copy_col is None else out.withColumn(copy_col, F.col("__mix_copy").cast("int")).drop("__mix_copy")
