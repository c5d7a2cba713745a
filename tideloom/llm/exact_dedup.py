"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import anti, lookup, semi, stash

#: Fixed: what counts as white space, and is one space after normalisation.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=F.md5) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if identical after white space runs become one space; a null text counts as empty.  ``keep_id`` is
    the smallest id of the equal texts; null ids come last (a group of null ids alone has a null ``keep_id``, and is
    kept).  Repeated rows that share the smallest id and the text are all kept: they are the same document.  Other
    columns are not read, and an empty table gives an empty result.

    Texts are shuffled only for groups of several rows, after copies within a task have been folded into one; with more
    groups than may be broadcast, a filter of bounded size picks those texts out, and lets a part of the others pass as
    it fills up (``common.marked``).  What is joined to the documents is one narrow row per group.  ``content_hash`` is
    a parameter so that tests can make it collide.
    """
    texts = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    hashed = texts.select("_id", F.unhex(content_hash("_text")).alias("_hash"), F.sha2("_text", 256).alias("text_sha256"))
    hashed = stash(hashed, "hashes")
    groups = hashed.groupBy("_hash").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    groups = stash(groups.where("_size > 1"), "groups")

    members = semi(texts.withColumn("_hash", F.unhex(content_hash("_text"))), groups.select("_hash"), "_hash")
    classes = members.groupBy("_hash", "_text").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    clashes = stash(classes.groupBy("_hash").count().where("count > 1").select("_hash"), "clashes")

    told = lookup(hashed, groups, "_hash")
    if not clashes.isEmpty():
        told = anti(told, clashes, "_hash")
        exact = semi(classes, clashes, "_hash")
        rows = semi(texts.withColumn("_hash", F.unhex(content_hash("_text"))), clashes, "_hash")
        rows = rows.withColumn("text_sha256", F.sha2("_text", 256)).join(exact, ["_hash", "_text"], "left")
        told = told.unionByName(rows.select(told.columns))
    keep = F.when(F.coalesce("_size", F.lit(1)) > 1, F.col("_keep")).otherwise(F.col("_id"))
    return told.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
