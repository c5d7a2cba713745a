"""Regular path queries: pairs of vertices with a walk between them whose labels spell a word of an expression.

The product of graph and automaton is searched breadth first from all roots at once, by a semi-naive fixpoint of joins.
A round joins the rows that the last one found to the edges, and keeps what no earlier row covers.  Each round's rows
are written to the shared folder, so plans stay short and lost executors cost a round at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.automata import Dfa, compile_path
from ..functions.intervals import coalesce
from ..storage import new_path, remove, stash, table, written
from .join import neighbour_classes

#: From so many rows on, what was found is kept in buckets.
LARGE_ROWS = 20_000_000
#: So many times the edges of inner vertices must be those of others, for walks to be searched from inner ones only.
OUTER_TIMES = 2
#: From so many edges of outer vertices on, and so many times as many of these as classes with the same targets, what they
#: reach is found for classes.
MANY_OUTER, MANY_TWINS = 1_000_000, 2
#: So many tables of buckets are joined one after the other before they are written as one.
MANY_TABLES = 8


class TooManyRounds(RuntimeError):
    """The fixpoint was not reached within the given number of rounds."""


class Found:
    """The rows of all rounds, as written tables.

    While they are few, they are read together.  From ``LARGE_ROWS`` on they are bucketed by their keys, into as many
    buckets as exchanges have partitions: new rows, which are dealt out by the same keys, then meet them without
    another exchange, and only new rows are shuffled in a round.
    """

    def __init__(self, like: DataFrame, keys: list[str], timed: bool):
        self.spark, self.like, self.keys, self.timed = like.sparkSession, like, keys, timed
        self.paths: list[str] = []
        self.buckets: list[tuple[str, str]] = []
        self.rows = 0

    def bucketed(self, rows: DataFrame) -> tuple[str, str, int]:
        name, path, seen = f"tideloom_{uuid.uuid4().hex}", new_path(self.spark, "reach"), Observation()
        number = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        out = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        out.write.format("parquet").bucketBy(number, *self.keys).option("path", path).saveAsTable(name)
        return name, path, seen.get["rows"]

    def add(self, rows: DataFrame) -> DataFrame | None:
        """Write the rows of a round, and return them as read back; None if there are none."""
        if self.rows < LARGE_ROWS:
            path = new_path(self.spark, "reach")
            count = written(rows, path)
            self.paths.append(path)
        else:
            name, path, count = self.bucketed(rows)
            old, paths = self.buckets, self.paths
            if paths or len(old) >= MANY_TABLES:  # no plan reads them any more
                merged, at, _ = self.bucketed(self.all())
                self.buckets, self.paths = [(merged, at)], []
                self.drop(old)
                for p in paths:
                    remove(self.spark, p)
            self.buckets.append((name, path))
        self.rows += count
        return table(self.spark, self.like, path) if count else None

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows that no earlier one covers: an equal one, or one with an interval around theirs."""
        known = [table(self.spark, self.like, *self.paths)] if self.paths else []
        known += [self.spark.table(name) for name, _ in self.buckets]
        for held in known:
            n, s = rows.alias("n"), held.alias("s")
            on = F.lit(True)
            for c in self.keys:
                on = on & (F.col(f"n.{c}") == F.col(f"s.{c}"))
            if self.timed:
                on = on & (F.col("s.vs") <= F.col("n.vs")) & (F.col("s.ve") >= F.col("n.ve"))
            rows = n.join(s, on, "left_anti")
        return rows

    def all(self) -> DataFrame:
        return table(self.spark, self.like, *self.paths, *[p for _, p in self.buckets])

    def drop(self, buckets: list[tuple[str, str]], files: bool = True) -> None:
        for name, path in buckets:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files are the table's own only in name
            if files:
                remove(self.spark, path)

    def close(self) -> DataFrame:
        """All rows; the tables' names go, their files stay."""
        self.drop(self.buckets, files=False)
        return self.all()


def product_edges(edges: DataFrame, dfa: Dfa) -> DataFrame:
    """Edges of the product graph: ``edges`` with ``st`` and ``st2``, for each move that the label allows.  The moves
    are few and are broadcast; only labels of the automaton are read."""
    moves = edges.sparkSession.createDataFrame(dfa.rows(), "st int, label string, st2 int")
    wanted = edges.where(F.col("label").isin(sorted(dfa.alphabet())))
    return wanted.join(F.broadcast(moves), "label").drop("label")


def is_plus(dfa: Dfa) -> bool:
    """Whether the words are those of one label or more, of any of the automaton's."""
    moves = {(s, label) for s, label, _ in dfa.rows()}
    return set(dfa.final) == {1} and {t for _, _, t in dfa.rows()} == {1} and moves == {(s, label) for s in (0, 1) for label in dfa.alphabet()}


def plus_query(edges: DataFrame, dfa: Dfa, by: tuple[str, ...], max_rounds: int) -> DataFrame | None:
    """``path_query`` for one edge or more, untimed: only from vertices with edges both in and out are walks searched;
    others reach what their edges lead to, and what those vertices reach.  None if most edges are from such vertices."""
    steps = stash(edges.where(F.col("label").isin(sorted(dfa.alphabet()))).select(*by, "src", "trg").distinct(), "steps")
    met = steps.select(*by, F.col("trg").alias("src")).distinct()
    inner, outer = (stash(steps.join(met, [*by, "src"], how), "steps") for how in ("left_semi", "left_anti"))
    number = outer.count()
    if number < OUTER_TIMES * inner.count():
        return None
    members = None
    if number >= MANY_OUTER:
        twins, classes = neighbour_classes(outer.select(*by, F.col("src").alias("x"), F.col("trg").alias("k")), by, "x")
        if twins.count() >= MANY_TWINS * twins.where("x = _x").count():
            members, outer = twins, classes.select(*by, F.col("_x").alias("src"), F.col("k").alias("trg"))
    label = min(dfa.alphabet())
    found = searched(inner.withColumn("label", F.lit(label)), f"{label}+", compile_path(f"{label}+"), by, False, max_rounds, True)
    onward = outer.withColumnsRenamed({"trg": "via"}).join(found.withColumnsRenamed({"src": "via"}), [*by, "via"]).select(*by, "src", "trg")
    reach = outer.unionByName(onward).distinct()
    if members is not None:
        parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few rows of classes become very many
        members = members.select(*by, F.col("_x").alias("src"), F.col("x").alias("_src")).repartition(parts, *by, "src")
        reach = members.join(stash(reach, "reach").hint("merge"), [*by, "src"]).select(*by, F.col("_src").alias("src"), "trg")
    return found.unionByName(stash(reach, "reach"))


def path_query(edges: DataFrame, expression: str | Dfa, by: tuple[str, ...] = (), timed: bool = False, max_rounds: int = 10_000, canonical: bool = False) -> DataFrame:
    """``by, src, trg`` (and ``vs, ve`` if ``timed``) such that a walk from ``src`` to ``trg`` spells a word of the
    expression.

    ``edges`` has ``by``, ``src``, ``label``, ``trg``, and with ``timed`` ``vs`` and ``ve``: then a walk is valid while
    all its edges are, and results are coalesced.  Walks have an edge at least: the empty word gives no pair, but a
    cycle gives (x, x).  ``max_rounds`` guards against endless runs, and raises.  ``canonical`` says that the edges are
    distinct, or coalesced, already.
    """
    dfa = compile_path(expression) if isinstance(expression, str) else expression
    if not timed and is_plus(dfa) and (out := plus_query(edges, dfa, by, max_rounds)) is not None:
        return out
    return searched(edges, expression, dfa, by, timed, max_rounds, canonical)


def searched(edges: DataFrame, expression: str | Dfa, dfa: Dfa, by: tuple[str, ...], timed: bool, max_rounds: int, canonical: bool) -> DataFrame:
    """``path_query`` by a search from all roots."""
    spark, keys, interval = edges.sparkSession, [*by, "root", "v", "st"], ["vs", "ve"] * timed
    steps = product_edges(edges, dfa).select(*by, "src", "st", F.col("trg").alias("v2"), "st2", *interval)
    moves = [(s, t) for s, _, t in dfa.rows()]
    if not canonical or len(set(moves)) < len(moves):
        steps = coalesce(steps, [*by, "src", "st", "v2", "st2"]) if timed else steps.distinct()
    base = new_path(spark, "steps")
    written(steps, base)
    steps = table(spark, steps, base)
    near = steps.withColumnsRenamed({c: f"_{c}" for c in steps.columns})

    def settled(rows: DataFrame) -> DataFrame:
        rows = rows.select(*by, "root", "v", "st", *interval)
        return coalesce(rows, keys) if timed else rows.distinct()

    first = settled(steps.where("st = 0").withColumnsRenamed({"src": "root"}).drop("st").withColumnsRenamed({"v2": "v", "st2": "st"}))
    found = Found(first, keys, timed)
    # walks that end in a state without moves can't be extended
    onward = sorted({s for s, _, _ in dfa.rows()})
    on = (F.col("v") == F.col("_src")) & (F.col("st") == F.col("_st"))
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    ends = [*by, "root", F.col("_v2").alias("v"), F.col("_st2").alias("st")]
    last, rounds = found.add(first), 1
    while last is not None:
        if (rounds := rounds + 1) > max_rounds:
            raise TooManyRounds(f"{expression!r}: no fixpoint in {max_rounds} rounds")
        last = last.where(F.col("st").isin(onward))
        if timed:
            vs, ve = F.greatest("vs", "_vs"), F.least("ve", "_ve")
            more = last.join(near, on & (vs < ve)).select(*ends, vs.alias("vs"), ve.alias("ve"))
        else:
            more = last.join(near, on).select(*ends)
        last = found.add(found.unseen(settled(more)))
    out = found.close().where(F.col("st").isin(sorted(dfa.final))).withColumnsRenamed({"root": "src", "v": "trg"}).drop("st")
    if timed:
        return coalesce(out, [*by, "src", "trg"])
    return out.distinct() if len(dfa.final) > 1 else out
