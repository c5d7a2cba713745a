"""Persistent queries over streams of edges; a micro-batch is an epoch.

Edges must come in order of time up to ``lateness``; later ones are dropped and counted.  Results are appended, as
intervals; coalesced, all of them together are what the batch evaluation for all time gives.  Those of a closure of what
is alike are between the first ones of classes of twins, whose members are appended beside them.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.automata import compile_path
from ..functions.intervals import coalesce
from ..functions.regex import labels, parse
from ..operators.component import alike_classes, alike_intervals, expanded, refined
from ..operators.join import SELECTORS, endpoint_join, pair_join
from ..operators.path import product_edges
from ..operators.window import wscan
from ..plans.algebra import Join, NotLoop, PairJoin, Path, Plan, Scan, Union, alike, children
from ..storage import exists, new_path, remove, stash, table, written


def stream_join(left: DataFrame, right: DataFrame, key: str, output: str, window: int, lateness: str = "0 seconds") -> DataFrame:
    """The endpoint join of two streams of edges ``src, trg, ts``, as ``src, trg, vs, ve``.

    Both sides get a watermark; the condition on time lets Spark drop state that can't meet any more.
    """
    a, b = SELECTORS[key]
    x, y = SELECTORS[output]

    def side(rows: DataFrame, p: str) -> DataFrame:
        rows = rows.select(*[F.col(c).alias(f"{p}_{c}") for c in ("src", "trg", "ts")])
        return rows.withColumn(f"{p}_time", F.timestamp_seconds(f"{p}_ts")).withWatermark(f"{p}_time", lateness)

    span = F.expr(f"INTERVAL {window} SECONDS")
    on = (F.col(f"l_{a}") == F.col(f"r_{b}")) & (F.col("l_time") > F.col("r_time") - span) & (F.col("l_time") < F.col("r_time") + span)
    rows = side(left, "l").join(side(right, "r"), on)
    return rows.select(F.col(f"l_{x}").alias("src"), F.col(f"r_{y}").alias("trg"), F.greatest("l_ts", "r_ts").alias("vs"), (F.least("l_ts", "r_ts") + window).alias("ve"))


def uncovered(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` in canonical form, without those whose interval lies in one of ``known`` of their keys."""
    n, s = coalesce(rows, keys).alias("n"), known.alias("s")
    on = (F.col("s.vs") <= F.col("n.vs")) & (F.col("s.ve") >= F.col("n.ve"))
    for c in keys:
        on = on & (F.col(f"n.{c}") == F.col(f"s.{c}"))
    return n.join(s, on, "left_anti")


class Increment:
    """What a batch of edges adds to each part of a plan.

    A join adds what new rows of its left give with all rows of its right, and what new rows of its right give with the
    rows that its left held before.  A path expression is extended by its new edges, from the walks that reach them; they
    are edges of the batch, or what the plans of its names add.  What has been found stays, with its own interval, so
    nothing is derived again when edges expire.  What is covered by earlier rows is left out at each part.

    A closure of what is alike isn't searched: its components are followed anew from the last watermark on, before which
    new rows change nothing, over the rows of its body that are valid then.  If it is the whole plan, it stays in classes
    of twins: rows are between the first ones of ``classes``, which are parts of those of the state and of the batch.

    The state of a part is what it has found, as far as that is valid after the watermark: rows of the sides of joins,
    of derived parts and of closures of what is alike, walks and edges of other path expressions.  It is read from the folder ``last`` and written to
    ``here``, under the part's number in the plan.
    """

    def __init__(self, edges: DataFrame, plan: Plan, here: str, last: str | None, old: int | None, mark: int):
        self.edges, self.plan, self.here, self.last, self.old, self.mark = edges, plan, here, last, old, mark
        self.spark = edges.sparkSession
        self.number: dict[Plan, int] = {}
        self.keeps: set[Plan] = {plan}
        self.new: dict[Plan, DataFrame] = {}
        self.classes: DataFrame | None = None
        self.enter(plan)
        one = F.lit(0).cast("int")
        # what rows, walks and edges of path expressions look like
        self.pairs = edges.select("src", "trg", "vs", "ve")
        self.walks = edges.select(F.col("src").alias("root"), F.col("trg").alias("v"), one.alias("st"), "vs", "ve")
        self.steps = edges.select("src", one.alias("st"), F.col("trg").alias("v2"), one.alias("st2"), "vs", "ve")

    def enter(self, p: Plan) -> None:
        if p in self.number:
            return
        found = alike(p)
        for c in children(p) if found is None else found[:1]:
            self.enter(c)
        if isinstance(p, Join | PairJoin):
            self.keeps |= {p, p.left, p.right}
        elif found is not None:
            self.keeps |= {p, found[0]}
        elif isinstance(p, Union):
            self.keeps.add(p)
        self.number[p] = len(self.number)

    def has_rows(self, p: Plan) -> bool:
        """Whether a part's state is rows, and not walks."""
        return not isinstance(p, Path) or alike(p) is not None

    def run(self) -> DataFrame:
        """The rows that the plan adds; the state of its parts is written."""
        kept = [p for p in self.number if p in self.keeps and self.has_rows(p)]
        if alike(self.plan) is not None:
            out = self.closed()
            kept.remove(self.plan)
        else:
            out = self.added(self.plan)
        with ThreadPoolExecutor(max(len(kept), 1)) as pool:  # each waits for jobs of its own
            list(pool.map(lambda p: self.keep(self.before(p).unionByName(self.added(p)), p, "rows", ["src", "trg"]), kept))
        return out

    def closed(self) -> DataFrame:
        """The rows that the batch adds to a closure of what is alike, between classes; its state is written."""
        p = self.plan
        name = f"{self.number[p]}-classes"
        body, loops = self.common(p)
        new, classes = alike_classes(body, loops)
        if classes is None:
            new = stash(new, "pairs")
            classes = new.select(F.col("src").alias("one"), "src").distinct()
        old = self.held(p, "rows", self.pairs)
        if self.last is not None:
            number = lambda rows, n: rows.withColumn("_batch", F.lit(n))
            before = table(self.spark, classes, f"{self.last}/{name}")
            rows, classes = refined(number(old, 0).unionByName(number(new, 1)), number(before, 0).unionByName(number(classes, 1)), "_batch")
            rows = stash(rows, "pairs")
            old, new = (rows.where(F.col("_batch") == n).drop("_batch") for n in (0, 1))
        out = stash(uncovered(new, old, ["src", "trg"]), "added")
        self.keep(old.unionByName(out), p, "rows", ["src", "trg"])
        kept = table(self.spark, self.pairs, f"{self.here}/{self.number[p]}-rows").select(F.col("src").alias("one")).distinct()
        written(classes.join(kept, "one", "left_semi").select("one", "src"), f"{self.here}/{name}")
        self.classes = classes.join(out.select(F.col("src").alias("one")).distinct(), "one", "left_semi").select("one", "src")
        return out

    def common(self, p: Plan) -> tuple[DataFrame, bool]:
        """What vertices have in common in a closure of what is alike, from the last watermark on: ``src, trg, vs, ve``, and
        whether pairs of the same are in."""
        body, end, common, loops = alike(p)
        rows = self.added(body)
        if self.last is not None:
            held = self.before(body).withColumn("vs", F.greatest("vs", F.lit(self.old)))
            rows = coalesce(rows.unionByName(held), ["src", "trg"])
        return rows.select(F.col(end).alias("src"), F.col(common).alias("trg"), "vs", "ve"), loops

    def held(self, p: Plan, name: str, like: DataFrame) -> DataFrame:
        """A part's state before the batch, less what has expired."""
        if self.last is None:
            return like.limit(0)
        return table(self.spark, like, f"{self.last}/{self.number[p]}-{name}").where(F.col("ve") > self.old)

    def keep(self, rows: DataFrame, p: Plan, name: str, keys: list[str]) -> None:
        written(coalesce(rows.where(F.col("ve") > self.mark), keys), f"{self.here}/{self.number[p]}-{name}")

    def before(self, p: Plan) -> DataFrame:
        """The rows that a part held before the batch."""
        if self.has_rows(p):
            return self.held(p, "rows", self.pairs)
        return self.ended(p, self.held(p, "walks", self.walks))

    def ended(self, p: Path, walks: DataFrame) -> DataFrame:
        """The rows of walks that spell a word."""
        final = compile_path(p.expression).final
        rows = walks.where(F.col("st").isin(sorted(final))).select(F.col("root").alias("src"), F.col("v").alias("trg"), "vs", "ve")
        return coalesce(rows, ["src", "trg"])

    def added(self, p: Plan) -> DataFrame:
        """The rows that the batch adds to a part."""
        if p not in self.new:
            rows = self.derive(p)
            if p in self.keeps and self.has_rows(p):
                rows = stash(uncovered(rows, self.before(p), ["src", "trg"]), "added")
            self.new[p] = rows
        return self.new[p]

    def derive(self, p: Plan) -> DataFrame:
        if isinstance(p, Scan):
            return self.edges.where(F.col("label") == p.label).select("src", "trg", "vs", "ve")
        if isinstance(p, NotLoop):
            return self.added(p.body).where("src <> trg")
        if isinstance(p, Union):
            return self.added(p.left).unionByName(self.added(p.right))
        if alike(p) is not None:
            return alike_intervals(*self.common(p))
        if isinstance(p, Path):
            return stash(self.ended(p, self.extended(p)), "added")
        if isinstance(p, Join):
            join = lambda left, right: endpoint_join(left, right, p.key, p.output, timed=True)
        else:
            join = lambda left, right: pair_join(left, right, p.reverse, p.swap, timed=True)
        right = self.before(p.right).unionByName(self.added(p.right))
        return join(self.added(p.left), right).unionByName(join(self.before(p.left), self.added(p.right)))

    def extended(self, p: Path) -> DataFrame:
        """The walks that the batch adds to a path expression."""
        dfa, given, keys, ends = compile_path(p.expression), dict(p.inputs), ["root", "v", "st"], ["src", "st", "v2", "st2"]
        edges = self.edges.where(F.col("label").isin(sorted(dfa.alphabet() - set(given))))
        for name, q in p.inputs:
            edges = edges.unionByName(self.added(q).withColumn("label", F.lit(name)))
        fresh = stash(coalesce(product_edges(edges, dfa).withColumnsRenamed({"trg": "v2"}), ends), "steps")
        steps = stash(self.held(p, "steps", self.steps).unionByName(fresh), "steps")
        seed = fresh.where("st = 0").select(F.col("src").alias("root"), F.col("v2").alias("v"), F.col("st2").alias("st"), "vs", "ve")
        seen = self.held(p, "walks", self.walks)

        def follow(rows: DataFrame, along: DataFrame) -> DataFrame:
            e = along.withColumnsRenamed({c: f"_{c}" for c in along.columns})
            vs, ve = F.greatest("vs", "_vs"), F.least("ve", "_ve")
            met = rows.join(e, (F.col("v") == F.col("_src")) & (F.col("st") == F.col("_st")) & (vs < ve))
            return met.select("root", F.col("_v2").alias("v"), F.col("_st2").alias("st"), vs.alias("vs"), ve.alias("ve"))

        paths: list[str] = []
        rows = uncovered(seed.unionByName(follow(seen, fresh)), seen, keys)
        while written(rows, path := new_path(self.spark, "walks")):
            paths.append(path)
            known = seen.unionByName(table(self.spark, seed, *paths))
            rows = uncovered(follow(table(self.spark, seed, path), steps), known, keys)
        found = table(self.spark, seed, *paths) if paths else seed.limit(0)
        self.keep(steps, p, "steps", ends)
        self.keep(seen.unionByName(found), p, "walks", keys)
        return found


@dataclass
class Epoch:
    """What a micro-batch did."""

    batch: int
    watermark: int
    edges: int
    late: int
    emitted: int


class GraphStream:
    """A persistent query, fed with micro-batches of edges ``src, label, trg, ts``.

    State is written anew for each batch, in a folder of its number, and the note of what the batch did comes last; so
    a batch that is run again after a failure starts from the state before it, and one that was finished does nothing.
    Both state and results are bounded by the window's content.

    Nothing is evaluated anew: each part of the plan takes in what its inputs added (see ``Increment``).
    """

    def __init__(self, spark: SparkSession, plan: Plan, window: int, state: str, output: str, lateness: int = 0):
        self.spark, self.plan, self.window, self.state, self.output, self.lateness = spark, plan, window, state.rstrip("/"), output.rstrip("/"), lateness

    def note(self, batch: int) -> Epoch | None:
        path = f"{self.state}/{batch}/note"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            return None
        return Epoch(**self.spark.read.parquet(path).first().asDict())

    def used(self) -> list[str]:
        def of(p: Plan) -> set[str]:
            if isinstance(p, Scan):
                return {p.label}
            own = labels(parse(p.expression)) - {n for n, _ in p.inputs} if isinstance(p, Path) else set()
            return own.union(*map(of, children(p)))

        return sorted(of(self.plan))

    def process(self, edges: DataFrame, batch: int) -> Epoch:
        """Take in a micro-batch."""
        if (done := self.note(batch)) is not None:
            return done
        before = self.note(batch - 1) if batch else None
        if batch and before is None:
            raise LookupError(f"{self.state}: batch {batch} came, but what batch {batch - 1} left isn't there")
        old = before.watermark if before else None
        edges = stash(edges.select("src", "label", "trg", "ts"), "batch")
        late = edges.where(F.col("ts") < old).count() if before else 0
        fresh = edges.where(F.col("ts") >= old) if before else edges
        top = fresh.agg(F.max("ts"), F.count(F.lit(1))).first()
        mark = max(x for x in (old, None if top[0] is None else top[0] - self.lateness, -(2**62)) if x is not None)
        fresh = coalesce(wscan(fresh.where(F.col("label").isin(self.used())), self.window), ["src", "label", "trg"])
        here, last = f"{self.state}/{batch}", f"{self.state}/{batch - 1}" if before else None
        increment = Increment(stash(fresh, "edges"), self.plan, here, last, old, mark)
        emitted = increment.run()
        if increment.classes is not None:
            written(increment.classes, f"{self.output}-classes/batch={batch}")
        epoch = Epoch(batch, mark, top[1], late, written(emitted, f"{self.output}/batch={batch}"))
        written(self.spark.createDataFrame([Row(**epoch.__dict__)], "batch long, watermark long, edges long, late long, emitted long"), f"{here}/note")
        if batch > 1:
            remove(self.spark, f"{self.state}/{batch - 2}")
        return epoch

    def start(self, edges: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A stream writer that feeds the micro-batches of ``edges``; start it with a trigger of choice."""
        return edges.writeStream.foreachBatch(lambda rows, batch: self.process(rows, batch) and None).option("checkpointLocation", checkpoint)

    def results(self) -> DataFrame:
        """Everything emitted so far, coalesced."""
        rows = self.spark.read.parquet(self.output)
        if alike(self.plan) is None:
            return coalesce(rows.select("src", "trg", "vs", "ve"), ["src", "trg"])
        rows, classes = refined(rows, self.spark.read.parquet(f"{self.output}-classes"), "batch")
        return expanded(coalesce(rows, ["src", "trg"]), classes)
