"""Queries over the tables of a folder, one for each operator and named query, with SQL for another engine."""

from __future__ import annotations

import itertools
import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import intervals
from ..functions.automata import determinize, minimize, nfa_of
from ..functions.regex import PathSyntaxError, parse
from ..operators import relational, window as w
from ..operators.join import SELECTORS, endpoint_join, pair_join
from ..sources import edges as source
from ..storage import new_path, stash
from ..streaming.stream import GraphStream, stream_join as join_streams
from . import evaluate, library, runs
from .algebra import Join, NotLoop, PairJoin, Path, Plan, Scan, Union
from .evaluate import BOUNDARIES, SNAPSHOT, VALID_TIME
from .sql import SqlText

DAY, HOUR = 86_400, 3_600
#: 2024-01-15 00:00 UTC; the events are of that January.
INSTANT = 1_705_276_800
LABELS = ("click", "view", "purchase")

EDGES = "SELECT user_id AS src, event_type AS label, CAST(json_extract_string(props, '$.k') AS BIGINT) AS trg, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE user_id <> CAST(json_extract_string(props, '$.k') AS BIGINT)"
ORDERS = (
    "SELECT 'c:' || o_custkey AS src, 'placed' AS label, 'o:' || o_orderkey AS trg, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts FROM orders "
    "UNION ALL SELECT 'o:' || l_orderkey, 'contains', 'p:' || l_partkey, CAST(floor(epoch(l_shipdate)) AS BIGINT) FROM lineitem "
    "UNION ALL SELECT 'p:' || l_partkey, 'suppliedBy', 's:' || l_suppkey, CAST(floor(epoch(l_shipdate)) AS BIGINT) FROM lineitem"
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.events_graph(spark, sf_dir)


def at_instant_sql(window: int, edges: str = EDGES, instant: int = INSTANT) -> str:
    return f"SELECT src, label, trg FROM ({edges}) WHERE ts <= {instant} AND ts > {instant} - {window}"


def valid_time_sql(window: int, edges: str = EDGES) -> str:
    return f"SELECT src, label, trg, ts AS vs, ts + {window} AS ve FROM ({edges})"


BOUNDARY_SQL = (
    "WITH RECURSIVE g AS MATERIALIZED ({edges}), bs(idx, b) AS (SELECT CAST(0 AS BIGINT), (SELECT min(ts) FROM g WHERE ts >= (SELECT min(ts) FROM g) + {slide}) "
    "UNION ALL SELECT idx + 1, (SELECT min(ts) FROM g WHERE ts >= bs.b + {slide}) FROM bs WHERE bs.b IS NOT NULL), "
    "marks AS (SELECT idx, b FROM bs WHERE b IS NOT NULL UNION ALL SELECT (SELECT count(*) FROM bs WHERE b IS NOT NULL), max(ts) + 1 FROM g)"
)


def boundary_edges_sql(window: int, slide: int) -> str:
    return f"SELECT b, src, label, trg FROM ({BOUNDARY_SQL.format(edges=EDGES, slide=slide)} SELECT m.b, g.src, g.label, g.trg FROM g JOIN marks m ON g.ts < m.b AND g.ts + {window} > m.b)"


def planned(name: str, plan: Plan, mode: evaluate.Mode, window: int, slide: int = DAY, orders: bool = False) -> None:
    """Register a plan in one of the modes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = source.orders_graph(spark, sf_dir) if orders else graph(spark, sf_dir)
        if mode is SNAPSHOT:
            return evaluate.at_instant(edges, plan, INSTANT, window)
        if mode is BOUNDARIES:
            return evaluate.at_boundaries(edges, plan, window, slide)
        return evaluate.valid_time(edges, plan, window)

    run.__name__ = name
    raw = ORDERS if orders else EDGES
    edges = at_instant_sql(window, raw) if mode is SNAPSHOT else boundary_edges_sql(window, slide) if mode is BOUNDARIES else valid_time_sql(window, raw)
    query(SqlText(edges, mode).statement(plan))(run)


@query(f"SELECT src, label, trg, ts FROM ({EDGES})")
def events_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)


@query(ORDERS)
def orders_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.orders_graph(spark, sf_dir)


@query(f"SELECT min(ts) AS start_timestamp FROM ({EDGES})")
def start_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(source.start_timestamp(graph(spark, sf_dir)),)], "start_timestamp long")


@query(f"SELECT edges, count(*) AS vertices FROM (SELECT count(*) AS edges FROM (SELECT a.src FROM ({EDGES}) a JOIN (SELECT DISTINCT trg FROM ({EDGES}) x) b ON a.src = b.trg) GROUP BY src) GROUP BY edges")
def hashed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with edges in and out, by their number of edges out; hashes of sources meet those of targets."""
    edges = source.hashed_ids(graph(spark, sf_dir))
    both = edges.join(edges.select(F.col("trg").alias("src")).distinct(), "src", "left_semi")
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("edges")).groupBy("edges").agg(F.count(F.lit(1)).alias("vertices"))


@query(f"SELECT src, label, trg, ts AS vs, ts + {6 * HOUR} AS ve FROM ({EDGES})")
def wscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.wscan(graph(spark, sf_dir), 6 * HOUR)


@query(f"SELECT src, label, trg, ts FROM ({EDGES}) WHERE label IN ('click', 'view')")
def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.label_filter(graph(spark, sf_dir), ["click", "view"])


@query(" UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS part, src, trg, ts FROM ({EDGES}) WHERE label = '{n}'" for i, n in enumerate(("click", "view", "view"))))
def label_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = relational.partition_by_label(graph(spark, sf_dir), ["click", "view", "view"])
    return relational.union([s.select(F.lit(i).alias("part"), "src", "trg", "ts") for i, s in enumerate(streams)])


@query(f"SELECT trg AS src, src AS trg, 'clickedBy' AS label FROM ({EDGES}) WHERE label = 'click'")
def swap_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = relational.partition_by_label(graph(spark, sf_dir), ["click"])
    return relational.labelled(relational.swapped(rows.select("src", "trg")), "clickedBy")


@query(f"SELECT b, idx FROM ({BOUNDARY_SQL.format(edges=EDGES, slide=DAY)} SELECT * FROM marks)")
def slide_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.slide_boundaries(graph(spark, sf_dir), DAY)


@query(f"SELECT DISTINCT src, label, trg FROM ({at_instant_sql(DAY)})")
def snapshot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.valid_at(graph(spark, sf_dir), INSTANT, DAY)


@query(f"SELECT DISTINCT src, label, trg FROM ({EDGES}) WHERE ts < {INSTANT} AND ts + {DAY} > {INSTANT}")
def boundary_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.at_boundary(graph(spark, sf_dir), INSTANT, DAY)


@query(f"SELECT DISTINCT * FROM ({boundary_edges_sql(DAY, DAY)})")
def boundary_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph(spark, sf_dir)
    return w.at_boundaries(edges, w.slide_boundaries(edges, DAY), DAY, DAY)


@query(f"SELECT src, label, trg, max(ts) AS vs, max(ts) + {DAY} AS ve FROM ({EDGES}) GROUP BY ALL")
def latest_per_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.latest_per_epoch(w.wscan(graph(spark, sf_dir), DAY), ["src", "label", "trg"])


def _coalesced_sql(window: int) -> str:
    text = SqlText("", VALID_TIME)
    name = text.canonical(valid_time_sql(window), "src, label, trg")
    return f"WITH {', '.join(text.parts)} SELECT src, label, trg, vs, ve FROM {name}"


@query(_coalesced_sql(DAY))
def coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coalesce(w.wscan(graph(spark, sf_dir), DAY), ["src", "label", "trg"])


@query(f"SELECT DISTINCT src, label, trg FROM ({_coalesced_sql(DAY)}) WHERE vs <= {INSTANT} AND ve > {INSTANT}")
def timeslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.timeslice(coalesce(spark, sf_dir), INSTANT)


@query(f"SELECT * FROM ({_coalesced_sql(DAY)}) WHERE ve > {INSTANT}")
def expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.expire(coalesce(spark, sf_dir), INSTANT)


@query(f"SELECT src, min(ts) + {DAY} AS min_expiry, max(ts) + {DAY} AS max_expiry FROM ({EDGES}) GROUP BY src")
def expiry_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.expiry_bounds(w.wscan(graph(spark, sf_dir), DAY), ["src"])


A, B, C = map(Scan, LABELS)
for _key in SELECTORS:
    planned(f"join_{_key.lower()}", Join(A, B, _key, "ST"), SNAPSHOT, DAY)
    planned(f"vt_join_{_key.lower()}", Join(A, B, _key, "ST"), VALID_TIME, 6 * HOUR)
planned("join_output_ts", Join(A, B, "SS", "TS"), SNAPSHOT, DAY)
planned("union_streams", Union(A, B), SNAPSHOT, DAY)
planned("vt_union_streams", Union(A, B), VALID_TIME, DAY)
planned("not_loops", NotLoop(Join(A, A, "TT", "SS")), SNAPSHOT, DAY)
# pairs are rare in short windows
planned("pair_join", PairJoin(Path("click+"), B), SNAPSHOT, 3 * DAY)
planned("pair_join_reverse", PairJoin(Path("click+"), Path("view+"), reverse=True), SNAPSHOT, 3 * DAY)
planned("pair_join_swap", PairJoin(Path("click+"), Path("view+"), swap=True), SNAPSHOT, 3 * DAY)
planned("vt_pair_join", PairJoin(Join(A, C, "TT", "SS"), Join(B, C, "TT", "SS")), VALID_TIME, DAY)
planned("rpq_chain", Path("click/view/purchase*"), SNAPSHOT, DAY)
planned("vt_rpq_chain", Path("click/view/purchase*"), VALID_TIME, 6 * HOUR)
for _name, _text in {"plus": "click+", "star": "click*", "concat": "click/view", "alt": "click|view", "group": "(click/view)+|purchase", "alt_star": "(click|view)*/purchase"}.items():
    planned(f"rpq_{_name}", Path(_text), SNAPSHOT, DAY)
    planned(f"vt_rpq_{_name}", Path(_text), VALID_TIME, 6 * HOUR)
for _name, (_n, _) in library.NAMED.items():
    _plan = library.named(_name, list(LABELS[:_n]))
    _id = _name.replace("-", "_")
    # patterns of several edges are rare in short windows
    _at, _vt, _bs = (10 * DAY, 2 * DAY, 5 * DAY) if _name[:6] in ("query5", "query6", "query7") else (DAY, 6 * HOUR, 12 * HOUR)
    planned(_id, _plan, SNAPSHOT, _at)
    planned(f"vt_{_id}", _plan, VALID_TIME, _vt)
    planned(f"bs_{_id}", _plan, BOUNDARIES, _bs, 2 * DAY if _at > DAY else DAY)
planned("query2_joined", library.query2_joined(*LABELS[:2]), SNAPSHOT, DAY)
planned("vt_query3_joined", library.query3_joined(*LABELS), VALID_TIME, 6 * HOUR)
planned("orders_path", Path("placed/contains/suppliedBy"), VALID_TIME, 30 * DAY, orders=True)


def _delta_sql(plan: Plan, window: int, slide: int) -> str:
    results = SqlText(boundary_edges_sql(window, slide), BOUNDARIES).statement(plan)
    marks = f"{BOUNDARY_SQL.format(edges=EDGES, slide=slide)} SELECT idx, b FROM marks"
    return (
        f"WITH m AS ({marks}), r AS (SELECT m.idx, q.src, q.trg FROM ({results}) q JOIN m ON m.b = q.b), "
        "d AS (SELECT idx, src, trg, 1 AS diff FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.idx = r.idx - 1 AND o.src = r.src AND o.trg = r.trg) "
        "UNION ALL SELECT idx + 1, src, trg, -1 FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.idx = r.idx + 1 AND o.src = r.src AND o.trg = r.trg)) "
        "SELECT m.b, d.src, d.trg, CAST(d.diff AS INTEGER) AS diff FROM d JOIN m ON m.idx = d.idx"
    )


@query(_delta_sql(library.query1("click"), 12 * HOUR, DAY))
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.deltas(graph(spark, sf_dir), library.query1("click"), 12 * HOUR, DAY)


@query(_delta_sql(library.query6(*LABELS), 5 * DAY, 2 * DAY))
def deltas_query6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.deltas(graph(spark, sf_dir), library.query6(*LABELS), 5 * DAY, 2 * DAY)


@query(None)
def temporal_join_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = w.wscan(graph(spark, sf_dir), 6 * HOUR)
    one = lambda label: intervals.coalesce(edges.where(F.col("label") == label), ["src", "trg"])
    rows = endpoint_join(one("click"), one("view"), "TS", "ST", timed=True, span=6 * HOUR)
    return intervals.coalesce(rows, ["src", "trg"])


@query(None)
def pair_join_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = w.wscan(graph(spark, sf_dir), DAY)
    one = lambda label: intervals.coalesce(edges.where(F.col("label") == label), ["src", "trg"])
    return intervals.coalesce(pair_join(one("click"), one("view"), timed=True, span=DAY), ["src", "trg"])


def streamed(name: str, plan: Plan, window: int, epochs: int) -> None:
    """Register a plan that is fed with the events of a few stretches of time in turn, as micro-batches are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = stash(graph(spark, sf_dir), "edges")
        first, last = edges.agg(F.min("ts"), F.max("ts")).first()
        stream = GraphStream(spark, plan, window, new_path(spark, "state"), new_path(spark, "results"))
        span = (last - first) // epochs + 1
        for k in range(epochs):
            stream.process(edges.where((F.col("ts") >= first + k * span) & (F.col("ts") < first + (k + 1) * span)), k)
        return stream.results()

    run.__name__ = name
    query(SqlText(valid_time_sql(window), VALID_TIME).statement(plan))(run)


streamed("stream_query1", library.query1("click"), 6 * HOUR, 3)
streamed("stream_query2_a", library.query2a(*LABELS[:2]), 6 * HOUR, 3)
streamed("stream_query8", library.query8("purchase"), 6 * HOUR, 3)
streamed("stream_query6_cq", library.query6_cq(*LABELS), 2 * DAY, 3)

SQL["temporal_join_spans"] = SqlText(valid_time_sql(6 * HOUR), VALID_TIME).statement(Join(A, B))
SQL["pair_join_spans"] = SqlText(valid_time_sql(DAY), VALID_TIME).statement(PairJoin(A, B))


def read_back(kind: str) -> Query:
    """A query that writes the events as lines of a text format, and reads them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, path = graph(spark, sf_dir), new_path(spark, "lines")
        spec = source.KINDS[kind]
        vertex = lambda c: F.col(c).cast("string") if spec.integer_ids else F.concat(F.lit("v"), F.col(c))
        line = F.concat_ws(" ", vertex("src"), "label", vertex("trg"), *["ts"] * spec.timed)
        if not spec.timed:  # lines are numbered, so their order has to be known here
            edges = edges.coalesce(1).sortWithinPartitions("ts", "src", "label", "trg")
        edges.select(line.alias("value")).write.text(path)
        return source.read_edges(spark, path, kind)

    run.__name__ = f"read_edges_{kind}"
    return run


for _kind, _spec in source.KINDS.items():
    _x, _y = ("src", "trg") if _spec.integer_ids else ("'v' || src AS src", "'v' || trg AS trg")
    _ts = "ts" if _spec.timed else "row_number() OVER (ORDER BY ts, g.src, label, g.trg) AS ts"
    query(f"SELECT {_x}, label, {_y}, {_ts} FROM ({EDGES}) g")(read_back(_kind))


@query(SqlText(valid_time_sql(6 * HOUR), VALID_TIME).statement(Join(A, B)))
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of files, joined as they come; results are appended to a folder, and coalesced from there."""
    path, out, checkpoint = (new_path(spark, name) for name in ("stream", "joined", "checkpoint"))
    graph(spark, sf_dir).select(F.concat_ws(" ", "src", "label", "trg", "ts")).write.text(path)
    edges = source.read_edge_stream(spark, path)
    one = lambda label: edges.where(F.col("label") == label).drop("label")
    rows = join_streams(one("click"), one("view"), "TS", "ST", 6 * HOUR)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return intervals.coalesce(spark.read.schema(rows.schema).parquet(out), ["src", "trg"])


#: Edges that came in at each slide but the first, which warms up and isn't measured: all, and those that match.
MEASURED = (
    f"WITH e AS MATERIALIZED ({EDGES}), ms AS MATERIALIZED ({BOUNDARY_SQL.format(edges=EDGES, slide=5 * DAY)} SELECT idx, b FROM marks), "
    "s AS (SELECT m.idx, count(e.ts) AS total, count(e.ts) FILTER (WHERE e.label = 'click') AS batch FROM ms m JOIN ms p ON p.idx = m.idx - 1 LEFT JOIN e ON e.ts < m.b AND e.ts >= p.b GROUP BY m.idx)"
)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_slides(graph(spark, sf_dir), runs.Run("query1", ["click"], 12 * HOUR, 5 * DAY))


@query(f"{MEASURED} SELECT 'batch-size' AS metric, count(*) AS count, avg(batch)::DOUBLE AS mean, quantile_cont(batch, 0.5) AS p50, quantile_cont(batch, 0.99) AS p99 FROM s UNION ALL SELECT 'total-size', count(*), avg(total)::DOUBLE, quantile_cont(total, 0.5), quantile_cont(total, 0.99) FROM s")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.histograms(_measured(spark, sf_dir))
    return rows.where(F.col("metric").isin("batch-size", "total-size")).select("metric", "count", "mean", "p50", "p99")


@query(f"{MEASURED} SELECT 'run' AS run, count(*) AS slides, avg(batch)::DOUBLE AS batch_size, avg(total)::DOUBLE AS total_size, CAST(100 AS BIGINT) AS total_time, count(*) * avg(batch) / 100.0 AS throughput FROM s")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric files as written and summed up, of a run that is taken to have lasted 100 seconds."""
    folder = new_path(spark, "report") + "/run"
    runs.write_metrics(_measured(spark, sf_dir), folder, 100.0)
    return runs.summarize(spark, [folder]).select("run", "slides", "batch_size", "total_size", "total_time", "throughput")


@query(f"{MEASURED} SELECT 'query1-{12 * HOUR}-{5 * DAY}-7' AS run, true AS finished, count(*) AS slides, avg(batch)::DOUBLE AS batch_size, avg(total)::DOUBLE AS total_size FROM s")
def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration's run over a text file: its summary, and what the memory file says of it."""
    lines, report = new_path(spark, "dataset"), new_path(spark, "report")
    graph(spark, sf_dir).select(F.concat_ws(" ", "src", "label", "trg", "ts").alias("value")).write.text(lines)
    run = {"query-name": "query1", "index": 7, "window-size": 12 * HOUR, "slide-size": 5 * DAY, "predicates": ["click"]}
    spec = {"name": "rows", "dataset": lines, "input-type": "it", "report-folder": report, "timeout": 600, "runs": [run]}
    with tempfile.NamedTemporaryFile("w", suffix=".json", encoding="utf-8") as config:  # the driver alone reads it
        json.dump(spec, config)
        config.flush()
        summary = runs.run_experiment(spark, config.name)
    memory = spark.read.schema("run string, finished boolean, peak_mb double").option("header", True).csv(f"{report}/memory.csv")
    return summary.join(memory, "run").select("run", "finished", "slides", "batch_size", "total_size")


#: An expression, and the same for SQL's regular expressions.
WORDS = ("(a/b)+|c/b*|(a|c)*/b", "(ab)+|cb*|[ac]*b")


@query(
    "WITH RECURSIVE w(word) AS (SELECT '' UNION ALL SELECT word || l FROM w, (VALUES ('a'), ('b'), ('c')) t(l) WHERE length(word) < 5), "
    f"r AS (SELECT word, regexp_full_match(word, '({WORDS[1]})') AS ok FROM w) SELECT word, ok AS nfa, ok AS dfa, ok AS minimal FROM r"
)
def automaton_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of up to five labels the three automata of an expression accept."""
    nfa = nfa_of(parse(WORDS[0]))
    machines = [nfa, determinize(nfa), minimize(determinize(nfa))]
    words = ["".join(w) for n in range(6) for w in itertools.product("abc", repeat=n)]
    return spark.createDataFrame([(w, *[m.accepts(w) for m in machines]) for w in words], "word string, nfa boolean, dfa boolean, minimal boolean")


#: Expressions that are errors, with the kinds of error.
REJECTED = {"a?": "UnsupportedPath", "a{2}": "UnsupportedPath", "a{1,}": "UnsupportedPath", "a{1,3}": "UnsupportedPath", "^a": "UnsupportedPath", "a^b": "UnsupportedPath", "a//b": "PathSyntaxError", "(a": "PathSyntaxError"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in REJECTED.items()) + ") t(path, error)")
def rejected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions that are not supported, or none at all, with the error that they raise."""

    def error(path: str) -> str | None:
        try:
            parse(path)
        except PathSyntaxError as e:
            return type(e).__name__
        return None

    return spark.createDataFrame([(p, error(p)) for p in REJECTED], "path string, error string")
