"""Evaluation of logical plans: at an instant, at slide boundaries, or for all time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.intervals import coalesce
from ..functions.regex import labels, parse
from ..operators import window as w
from ..operators.component import alike_closure, alike_intervals
from ..operators.join import SELECTORS, class_join, endpoint_join, legs, pair_join, square_join, triangle_join
from ..operators.path import path_query
from ..operators.relational import swapped
from ..storage import stash
from .algebra import Join, NotLoop, PairJoin, Path, Plan, Scan, Union, alike, shared


@dataclass(frozen=True)
class Mode:
    """Columns that rows must share to meet, and whether they have intervals."""

    by: tuple[str, ...] = ()
    timed: bool = False

    @property
    def columns(self) -> list[str]:
        return [*self.by, "src", "trg", *["vs", "ve"] * self.timed]


SNAPSHOT, BOUNDARIES, VALID_TIME = Mode(), Mode(by=("b",)), Mode(timed=True)


class Evaluation:
    """Evaluates plans over ``edges``, which have the mode's columns and ``label``, in canonical form: distinct, or with
    coalesced intervals."""

    def __init__(self, edges: DataFrame, mode: Mode):
        self.edges, self.mode = edges, mode
        self.kept: dict[Plan, DataFrame] = {}
        self.held: set[Plan] = set()

    def canonical(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*self.mode.columns)
        return coalesce(rows, [*self.mode.by, "src", "trg"]) if self.mode.timed else rows.distinct()

    def run(self, plan: Plan) -> DataFrame:
        """The result, with the mode's columns."""
        self.twice = twice = shared(plan)

        def of(p: Plan) -> DataFrame:
            if p not in self.kept:
                out = self.one(p, of)
                self.kept[p] = stash(out, "shared") if p in twice else out
            return self.kept[p]

        return of(plan)

    def one(self, p: Plan, of) -> DataFrame:
        by, timed = self.mode.by, self.mode.timed
        if isinstance(p, Scan):
            return self.edges.where(F.col("label") == p.label).select(*self.mode.columns)
        if isinstance(p, Union):
            return self.canonical(of(p.left).unionByName(of(p.right)))
        if isinstance(p, NotLoop):
            return of(p.body).where("src <> trg")
        if isinstance(p, Join):
            (a, b), (x, y) = SELECTORS[p.key], SELECTORS[p.output]
            if not timed and a != x and b != y and isinstance(p.left, Path) and p.left.inputs:  # a closure's sources reach much the same
                rows = class_join(*legs(self.stashed(p.left, of), self.stashed(p.right, of), p.key, p.output, "k", by), by)
                if rows is not None:
                    return rows
            return self.canonical(endpoint_join(of(p.left), of(p.right), p.key, p.output, by, timed))
        if isinstance(p, PairJoin):
            rows = self.cyclic(p, of)
            if rows is None:
                rows = pair_join(of(p.left), of(p.right), p.reverse, False, by, timed)
            return self.canonical(swapped(rows) if p.swap else rows)
        if (found := alike(p)) is not None:
            body, end, common, loops = found
            ends = [F.col(end).alias("src"), F.col(common).alias("trg")]
            return alike_intervals(of(body).select(*ends, "vs", "ve"), loops) if timed else alike_closure(of(body).select(*by, *ends), by, loops)
        given = dict(p.inputs)
        plain = sorted(labels(parse(p.expression)) - set(given))
        streams = [self.edges.where(F.col("label").isin(plain)).select(*self.mode.columns, "label")] if plain else []
        streams += [of(q).withColumn("label", F.lit(name)) for name, q in p.inputs]
        rows = streams[0]
        for s in streams[1:]:
            rows = rows.unionByName(s)
        return path_query(rows, p.expression, by, timed, canonical=True)

    def stashed(self, q: Plan, of) -> DataFrame:
        """The rows of a part that are counted before they are joined."""
        rows = of(q)
        if isinstance(q, Scan) or q in self.twice or q in self.held:
            return rows
        self.held.add(q)
        self.kept[q] = stash(rows, "side")
        return self.kept[q]

    def cyclic(self, p: PairJoin, of) -> DataFrame | None:
        """A pair join whose left is a join, without all rows of that join, of which few may be wanted; None if it has
        no such left, or if that is the shorter way.

        At every instant the rows are those of the plain way, and so is their canonical form.
        """
        by, timed = self.mode.by, self.mode.timed
        if not isinstance(p.left, Join) or p.left in self.twice:
            return None

        sides = lambda j, via: legs(self.stashed(j.left, of), self.stashed(j.right, of), j.key, j.output, via, by, timed)
        a, c = sides(p.left, "k")
        if isinstance(p.right, Join) and p.right not in self.twice:
            b, d = sides(p.right, "n")
            if p.reverse:
                b, d = d.withColumnsRenamed({"y": "x"}), b.withColumnsRenamed({"x": "y"})
            return square_join(a, c, b, d, by, timed)
        x, y = ("trg", "src") if p.reverse else ("src", "trg")
        pairs = self.stashed(p.right, of).withColumnsRenamed({x: "x", y: "y"})
        return triangle_join(a, c, pairs, by, timed)


def at_instant(edges: DataFrame, plan: Plan, instant: int, window: int) -> DataFrame:
    """``src, trg`` that hold at an instant."""
    return Evaluation(w.valid_at(edges, instant, window), SNAPSHOT).run(plan)


def at_boundary(edges: DataFrame, plan: Plan, boundary: int, window: int) -> DataFrame:
    """``src, trg`` that hold in the window when it slides."""
    return Evaluation(w.at_boundary(edges, boundary, window), SNAPSHOT).run(plan)


def at_boundaries(edges: DataFrame, plan: Plan, window: int, slide: int, start: int | None = None) -> DataFrame:
    """``b, src, trg`` at all slide boundaries, in one go; boundaries are of all edges, whatever their label."""
    boundaries = stash(w.slide_boundaries(edges, slide, start), "boundaries")
    return Evaluation(stash(w.at_boundaries(edges, boundaries, window, slide), "windows"), BOUNDARIES).run(plan)


def deltas(edges: DataFrame, plan: Plan, window: int, slide: int, start: int | None = None) -> DataFrame:
    """``b, src, trg, diff``: what each boundary adds (+1) to and takes (-1) from the result of the one before."""
    boundaries = stash(w.slide_boundaries(edges, slide, start), "boundaries")
    windows = stash(w.at_boundaries(edges, boundaries, window, slide), "windows")
    return changes(Evaluation(windows, BOUNDARIES).run(plan), boundaries)


def changes(results: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``b, src, trg, diff`` of results at boundaries ``idx, b``."""
    rows = results.join(boundaries, "b").select("idx", "src", "trg")
    # a pair's stay begins where the boundary before lacks it, and ends at the first boundary that lacks it: each row
    # counts +1 at its own boundary and -1 at the next, which cancel within a stay
    both = rows.select("idx", "src", "trg", F.lit(1).alias("diff")).unionByName(rows.select((F.col("idx") + 1).alias("idx"), "src", "trg", F.lit(-1).alias("diff")))
    net = both.groupBy("idx", "src", "trg").agg(F.sum("diff").cast("int").alias("diff")).where("diff <> 0")
    return net.join(boundaries, "idx").select("b", "src", "trg", "diff")


def valid_time(edges: DataFrame, plan: Plan, window: int) -> DataFrame:
    """``src, trg, vs, ve``: for every instant what holds then, coalesced."""
    # raw edges of a pair may be very many: in stretches of time first
    scanned = coalesce(w.wscan(edges, window), ["src", "label", "trg"], stretch=16 * window)
    return Evaluation(scanned, VALID_TIME).run(plan)
