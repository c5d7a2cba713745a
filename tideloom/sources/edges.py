"""Sources of labelled edges: text files, streams of them, and graph views of tables.

Every source gives ``src, label, trg, ts``; ids are longs, or strings where they are read as such.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Kind:
    """A text format: whether ids are integers, and whether a fourth field holds the time."""

    integer_ids: bool
    timed: bool


#: Fixed names of the four text formats.
KINDS = {"s": Kind(False, False), "st": Kind(False, True), "i": Kind(True, False), "it": Kind(True, True)}


def _fields(lines: DataFrame, kind: Kind) -> DataFrame:
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.withColumn("_f", f).where(F.size("_f") >= (4 if kind.timed else 3))
    identity = (lambda c: c.cast("long")) if kind.integer_ids else (lambda c: c)
    columns = [identity(F.col("_f")[0]).alias("src"), F.col("_f")[1].alias("label"), identity(F.col("_f")[2]).alias("trg")]
    return rows.select(*columns, *[F.col("_f")[3].cast("long").alias("ts")] * kind.timed, *[c for c in lines.columns if c != "value"])


def read_edges(spark: SparkSession, path: str, kind: str = "it") -> DataFrame:
    """Edges of a text file: ``src label trg [ts]`` by white space; further fields are ignored, shorter lines skipped.

    Without timestamps lines count as 1, 2, 3, ... in the order of the file; that order is Spark's order of the input
    splits, so numbering takes one pass that counts the lines of each split, and no shuffle.
    """
    spec = KINDS[kind]
    rows = _fields(spark.read.text(path), spec)
    if spec.timed:
        return rows
    sizes = dict(rows.groupBy(F.spark_partition_id().alias("split")).count().collect())  # a row for each split
    first, offsets = 1, []
    for split in sorted(sizes):
        offsets.append((split, first))
        first += sizes[split]
    offsets = spark.createDataFrame(offsets, "_split int, _first long")
    place = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)
    rows = rows.withColumns({"_split": F.spark_partition_id(), "_place": place}).join(F.broadcast(offsets), "_split")
    return rows.withColumn("ts", F.col("_first") + F.col("_place")).drop("_split", "_place", "_first")


def read_edge_stream(spark: SparkSession, path: str, kind: str = "it", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the timestamped text files that appear in a folder."""
    spec = KINDS[kind]
    if not spec.timed:
        raise ValueError("a stream of files needs timestamps in its lines")
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _fields(reader.load(path), spec)


def start_timestamp(edges: DataFrame, kind: str = "it") -> int:
    """The time of the first edge; 0 for a format without times, and for no edges."""
    if not KINDS[kind].timed:
        return 0
    return edges.agg(F.min("ts")).first()[0] or 0


def hashed_ids(edges: DataFrame) -> DataFrame:
    """String ids as 64-bit hashes.  Ids that collide become one vertex; keep strings where that matters."""
    return edges.withColumns({c: F.xxhash64(c) for c in ("src", "trg")})


def label_filter(edges: DataFrame, labels: list[str]) -> DataFrame:
    """Edges with one of the labels.  Slide boundaries are to be taken from the edges before this."""
    return edges.where(F.col("label").isin(labels))


def _seconds(name: str) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, rounded down."""
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
    return F.floor(micros / 1_000_000).cast("long")


def events_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: users act on things by number; edges from a vertex to itself are left out."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("src"), F.col("event_type").alias("label"), F.get_json_object("props", "$.k").cast("long").alias("trg"), _seconds("ts").alias("ts")
    )
    return rows.where("src <> trg")


def orders_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` and ``lineitem``: customer -placed-> order -contains-> part -suppliedBy-> supplier, with string ids."""
    vertex = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    placed = orders.select(vertex("c:", "o_custkey").alias("src"), F.lit("placed").alias("label"), vertex("o:", "o_orderkey").alias("trg"), _seconds("o_orderdate").alias("ts"))
    contains = items.select(vertex("o:", "l_orderkey").alias("src"), F.lit("contains").alias("label"), vertex("p:", "l_partkey").alias("trg"), _seconds("l_shipdate").alias("ts"))
    supplied = items.select(vertex("p:", "l_partkey").alias("src"), F.lit("suppliedBy").alias("label"), vertex("s:", "l_suppkey").alias("trg"), _seconds("l_shipdate").alias("ts"))
    return placed.unionByName(contains).unionByName(supplied)
