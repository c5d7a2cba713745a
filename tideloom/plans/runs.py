"""Experiments: a query run slide by slide, its metrics as CSV files, and summaries of many runs."""

from __future__ import annotations

import contextlib
import json
import os
import threading
import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.window import slide_boundaries
from ..sources.edges import label_filter, read_edges
from ..storage import stash
from . import evaluate, library

#: Fixed names of the quantiles in metric files.
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p999": 0.999}
METRICS = ("batch-latency", "batch-size", "total-latency", "total-size")
SLIDES = "idx long, b long, batch_size long, total_size long, results long, batch_latency double, total_latency double"
#: Seconds that a run without a total time is taken to have lasted.
TIMEOUT = 600


@dataclass
class Run:
    """A query of an experiment."""

    name: str
    labels: list[str]
    window: int
    slide: int
    index: int = 0


def read_config(path: str) -> tuple[dict[str, Any], list[Run]]:
    """An experiment's settings and runs from JSON: ``name, dataset, input-type, report-folder, timeout, runs[query-name,
    index, window-size, slide-size, predicates, ...]``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    runs = [Run(r["query-name"], list(r["predicates"]), int(r["window-size"]), int(r["slide-size"]), int(r.get("index", k))) for k, r in enumerate(spec.pop("runs"))]
    return spec, runs


class TimedOut(RuntimeError):
    """A run took longer than it may."""


class Memory(threading.Thread):
    """Samples the resident memory of the driver's JVM while it is entered; ``peak`` in MB (None where it can't be read).
    Executors of other machines aren't seen."""

    def __init__(self, spark: SparkSession, seconds: float = 5.0):
        super().__init__(daemon=True)
        self.path = f"/proc/{spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()}/statm"
        self.seconds, self.peak, self.over = seconds, None, threading.Event()

    def sample(self) -> None:
        with contextlib.suppress(OSError, ValueError, IndexError), open(self.path, encoding="ascii") as f:
            self.peak = max(self.peak or 0.0, int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20)

    def run(self) -> None:
        while not self.over.wait(self.seconds):
            self.sample()

    def __enter__(self) -> Memory:
        self.sample()
        self.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.sample()


def run_slides(edges: DataFrame, run: Run, timeout: float | None = None) -> DataFrame:
    """Evaluate a run at each of its boundaries in turn, and measure: milliseconds of the slide and since the one before
    it, matching and all edges that came in since, and results.  The first slide warms up, and isn't among the rows.  A
    run that goes on for more than ``timeout`` seconds is ended after its slide, with ``TimedOut``."""
    end = None if timeout is None else time.perf_counter() + timeout
    spark, plan = edges.sparkSession, library.named(run.name, run.labels)
    edges = stash(edges, "edges")
    matching = stash(label_filter(edges, run.labels), "matching")
    marks = slide_boundaries(edges, run.slide).collect()  # as many rows as slides, which are run one by one
    rows, before, last = [], None, time.perf_counter()
    for m in marks:
        came = (F.col("ts") < m.b) & (F.col("ts") >= before) if before is not None else F.col("ts") < m.b
        sizes = [rel.where(came).count() for rel in (matching, edges)]
        began = time.perf_counter()
        results = evaluate.at_boundary(matching, plan, m.b, run.window).count()
        now = time.perf_counter()
        rows.append((m.idx, m.b, *sizes, results, 1e3 * (now - began), 1e3 * (now - last)))
        before, last = m.b, now
        if end is not None and now > end and m is not marks[-1]:
            raise TimedOut(f"{run.name} took more than {timeout} s, up to slide {len(rows)} of {len(marks)}")
    return spark.createDataFrame(rows[1:], SLIDES)


def histograms(slides: DataFrame) -> DataFrame:
    """One row per metric: count, mean and quantiles over all slides."""
    columns = {m: m.replace("-", "_") for m in METRICS}
    long = slides.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in columns.items()])).alias("x")).select("x.*")
    marks = F.percentile("value", F.array(*map(F.lit, QUANTILES.values())))
    rows = long.groupBy("metric").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), marks.alias("q"))
    return rows.select("metric", "count", "mean", *[F.col("q")[i].alias(q) for i, q in enumerate(QUANTILES)])


def write_metrics(slides: DataFrame, folder: str, seconds: float, timestamp: int | None = None) -> None:
    """A CSV file per metric, of ``timestamp, count, mean, p25, ...``, and ``total-time`` in whole seconds."""
    stamp = int(time.time()) if timestamp is None else timestamp
    rows = stash(histograms(slides), "histograms")
    for metric in METRICS:
        one = rows.where(F.col("metric") == metric).select(F.lit(stamp).alias("timestamp"), "count", "mean", *QUANTILES)
        one.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{metric}.csv")
    total = slides.sparkSession.createDataFrame([(stamp, int(seconds))], "timestamp long, value long")
    total.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/total-time.csv")


def summarize(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One row per run from its metric files: latencies, slides, mean slide sizes, total time and throughput (slides
    times mean matching edges, by total time)."""

    def last(folder: str, metric: str) -> Any:
        rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{metric}.csv")
        return rows.orderBy(F.desc("timestamp")).first()

    out = []
    for folder in folders:
        size, latency, total = last(folder, "batch-size"), last(folder, "batch-latency"), last(folder, "total-size")
        try:
            seconds = last(folder, "total-time")["value"]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            seconds = TIMEOUT
        rate = size["count"] * size["mean"] / seconds if seconds else None
        out.append((folder.rstrip("/").rpartition("/")[2], size["count"], float(size["mean"]), float(total["mean"]), float(latency["mean"]), float(latency["p99"]), int(seconds), rate))
    return spark.createDataFrame(out, "run string, slides long, batch_size double, total_size double, batch_latency double, batch_latency_p99 double, total_time long, throughput double")


def run_experiment(spark: SparkSession, config: str, report: str | None = None) -> DataFrame:
    """All runs of a configuration, one after the other, with their metrics in the report folder; their summary.  Runs
    that exceed the configuration's ``timeout`` have no metrics; ``memory.csv`` tells which, and the peak memory of each."""
    spec, runs = read_config(config)
    folder = report or spec["report-folder"]
    edges = read_edges(spark, spec["dataset"], spec["input-type"])
    folders, peaks = [], []
    for run in runs:
        name = f"{run.name}-{run.window}-{run.slide}-{run.index}"
        began, slides = time.perf_counter(), None
        with Memory(spark) as memory, contextlib.suppress(TimedOut):
            slides = run_slides(edges, run, spec.get("timeout"))
        peaks.append((name, slides is not None, memory.peak))
        if slides is not None:
            folders.append(f"{folder}/{name}")
            write_metrics(slides, folders[-1], time.perf_counter() - began)
    spark.createDataFrame(peaks, "run string, finished boolean, peak_mb double").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/memory.csv")
    return summarize(spark, folders)
