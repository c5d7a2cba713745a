"""A training-corpus pipeline of the operators in ``tideloom.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideloom.llm import decontam, line_dedup, mixing, ngram_join, toxicity
from tideloom.llm.common import new_path, remove, stashing

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_earlier: list[str] = []


def stage(f: Stage) -> Stage:
    """A stage that first removes the tables that the stage before it left in the shared folder: its result has been
    written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _earlier:
            remove(spark, _earlier.pop())
        with stashing() as held:
            out = f(spark, docs, sf_dir)
        _earlier.extend(held)
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger rejects go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut out; documents of which they leave no word go, those without words before stay."""
    out = line_dedup.dedup_lines(docs, size_col="n_chars", counts=True)
    return out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("n_lines", "n_dropped")


@stage
def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays (five-word shingles, a similarity of 0.8)."""
    return ngram_join.keep_one(docs, width=5, percent=80)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to equal weights, and rows shuffled; ``copy`` numbers a document's copies."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
#: SQL can express neither the tagger nor the index search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
