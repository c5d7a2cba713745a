import json
import os

import pytest

from tideloom.plans import evaluate, library, runs
from tideloom.plans.algebra import Join, NotLoop, Path, Scan, Union
from tideloom.sources.edges import read_edges, read_edge_stream
from tideloom.streaming.stream import GraphStream, Increment, stream_join

from .test_graph import EDGES, KNOWS, knows, random_edges, rows


def feed(stream, spark, raw, size):
    return [stream.process(spark.createDataFrame(raw[i : i + size], EDGES), k) for k, i in enumerate(range(0, len(raw), size))]


def test_epochs_add_up_to_the_batch_result(spark, tmp_path):
    raw = random_edges(11, edges=40)
    mixed = Join(Union(Scan("a"), Path("b*|c+")), NotLoop(Path("a/b|c")), "TT", "SS")
    for name, plan in (("query2", library.query2("a", "b")), ("mixed", mixed)):
        stream = GraphStream(spark, plan, 15, str(tmp_path / name / "state"), str(tmp_path / name / "out"))
        epochs = feed(stream, spark, raw, 14)
        assert sum(e.edges for e in epochs) == len(raw) and not any(e.late for e in epochs)
        expected = rows(evaluate.valid_time(spark.createDataFrame(raw, EDGES), plan, 15))
        assert rows(stream.results()) == expected
        assert stream.process(spark.createDataFrame(raw[:3], EDGES), len(epochs) - 1) == epochs[-1]  # a batch again does nothing
        assert rows(stream.results()) == expected


def test_components_over_a_stream(spark, tmp_path, monkeypatch):
    """query8 over a stream adds up to the batch result, without a search of walks; other parts take in what it adds."""
    monkeypatch.setattr(Increment, "extended", None)
    monkeypatch.setattr("tideloom.operators.component.CHANGES", 5)
    raw = random_edges(12, edges=45)
    for name, plan in (("query8", library.query8("a")), ("joined", Join(library.query8("a"), Scan("b"), "TT", "SS"))):
        stream = GraphStream(spark, plan, 15, str(tmp_path / name / "state"), str(tmp_path / name / "out"))
        epochs = feed(stream, spark, raw, 15)
        assert [e.batch for e in epochs] == [0, 1, 2]
        expected = rows(evaluate.valid_time(spark.createDataFrame(raw, EDGES), plan, 15))
        assert rows(stream.results()) == expected and expected


def test_twins_over_a_stream(spark, tmp_path):
    """What is emitted of a closure of what is alike is between classes, which later batches may divide."""
    once = [(100, 90, 1), (101, 90, 3), (100, 90, 8), (102, 91, 9), (101, 91, 13), (102, 90, 30)]
    raw = sorted(((x + 1000 * c, "a", y, ts) for x, y, ts in once for c in range(4)), key=lambda r: r[3])
    raw = [r for r in raw if r != (2101, "a", 91, 13)]  # no longer as the others of its class
    plan = library.query8("a")
    stream = GraphStream(spark, plan, 6, str(tmp_path / "state"), str(tmp_path / "out"))
    epochs = feed(stream, spark, raw, 12)
    expected = rows(evaluate.valid_time(spark.createDataFrame(raw, EDGES), Path("(__r|__none)+", plan.inputs), 6))  # searched
    assert rows(stream.results()) == expected
    assert 10 * sum(e.emitted for e in epochs) < 3 * len(expected)


def test_late_edges_are_counted(spark, tmp_path):
    stream = GraphStream(spark, library.query1("a"), 10, str(tmp_path / "state"), str(tmp_path / "out"))
    feed(stream, spark, [(1, "a", 2, 100)], 1)
    epoch = stream.process(spark.createDataFrame([(2, "a", 3, 50), (2, "a", 3, 105)], EDGES), 1)
    assert (epoch.late, epoch.edges) == (1, 1)
    assert rows(stream.results()) == [(1, 2, 100, 110), (1, 3, 105, 110), (2, 3, 105, 115)]


def test_a_lost_state_is_an_error(spark, tmp_path):
    stream = GraphStream(spark, library.query1("a"), 10, str(tmp_path / "state"), str(tmp_path / "out"))
    with pytest.raises(LookupError):
        stream.process(spark.createDataFrame([(2, "a", 3, 50)], EDGES), 3)


def write_files(folder):
    os.mkdir(folder)
    for k, part in enumerate((slice(0, 3), slice(3, 6), slice(6, 9))):
        path = folder / f"{k}.txt"
        path.write_text("".join(f"{s} knows {t} {ts}\n" for s, t, ts in KNOWS[part]))
        os.utime(path, (1e9 + k, 1e9 + k))


def test_streams_of_files(spark, tmp_path):
    write_files(tmp_path / "in")
    plan = library.query1("knows")
    stream = GraphStream(spark, plan, 10, str(tmp_path / "state"), str(tmp_path / "out"))
    stream.start(read_edge_stream(spark, str(tmp_path / "in"), "it", 1), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert rows(stream.results()) == rows(evaluate.valid_time(knows(spark), plan, 10))

    edges = read_edge_stream(spark, str(tmp_path / "in"), "it", 1).drop("label")
    stream_join(edges, edges, "TS", "ST", 10).writeStream.format("memory").queryName("joined").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("joined")) == rows(evaluate.valid_time(knows(spark), library.join("knows", "knows"), 10))


def test_experiments(spark, tmp_path):
    write_files(tmp_path / "in")
    run = {"query-name": "query1", "index": 0, "exec-name": "x", "window-size": 10, "slide-size": 3, "predicates": ["knows"]}
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"name": "n", "dataset": str(tmp_path / "in"), "input-type": "it", "report-folder": str(tmp_path / "report"), "timeout": 600, "runs": [run]}))
    spec, (only,) = runs.read_config(str(config))
    assert spec["dataset"].endswith("in") and only == runs.Run("query1", ["knows"], 10, 3, 0)
    slides = runs.run_slides(read_edges(spark, spec["dataset"]), only)
    assert [(r.b, r.batch_size, r.total_size) for r in slides.orderBy("idx").collect()] == [(11, 1, 1), (14, 3, 3), (17, 2, 2), (18, 1, 1)]
    row = runs.run_experiment(spark, str(config)).first()
    assert (row.slides, row.batch_size) == (4, 1.75)
    (peak,) = spark.read.option("header", True).csv(str(tmp_path / "report" / "memory.csv")).collect()
    assert peak.finished == "true" and float(peak.peak_mb) > 50
    with pytest.raises(runs.TimedOut):
        runs.run_slides(read_edges(spark, spec["dataset"]), only, timeout=0)
    header = next((tmp_path / "report").glob("*/batch-size.csv/*.csv")).read_text().splitlines()[0]
    assert header == "timestamp,count,mean,p25,p50,p75,p90,p99,p999"
