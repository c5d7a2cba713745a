"""Closures of what vertices have in common: those of a component reach each other, so pairs are listed, not searched.

Components are found by alternating stars (large stars, then small ones), whose rows never become more and whose rounds
are few even for long chains.  Pairs are made from the members alone; nothing of their number is shuffled or written.

For all time, components are followed through stretches of time.  In a stretch, what is linked throughout is made one
vertex first; a task then works through the links that begin or end there, of which there are few by choice of stretches.
Vertices with the very same rows are twins: two of them are followed, and the rest are put in where the pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.intervals import coalesce
from ..storage import new_path, remove, stash, table, written

#: So many members of a component are paired with all its members by one task.
CHUNK = 512
#: So many changes, or those of one bin, are worked through by one task; so many bins are in the longest stretch.
CHANGES, BINS = 20_000, 1024
#: So many times the classes of twins must be the vertices, for classes to be followed.
MANY_TWINS = 2
#: Members of classes that are broadcast, at most.
FEW_MEMBERS = 200_000


def _lowest(rows: DataFrame, by: tuple[str, ...], key: str, value: str) -> DataFrame:
    return rows.groupBy(*by, key).agg(F.min(value).alias("_low"))


def roots(links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, u, v``: for each vertex of the links ``by, u, v``, but the least one of a component, that least one."""
    spark, on = links.sparkSession, [*by, "u"]
    rows = links.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    written(rows, path := new_path(spark, "stars"))
    rows = table(spark, rows, path)
    while True:
        both = rows.unionByName(rows.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, by, "u", "v").withColumn("_low", F.least("u", "_low"))
        large = both.where("v > u").join(low, on).select(*by, F.col("v").alias("u"), F.col("_low").alias("v")).distinct()
        met = large.join(_lowest(large, by, "u", "v"), on)
        small = met.select(*by, "u", F.col("_low").alias("v")).unionByName(met.where("v <> _low").select(*by, F.col("v").alias("u"), F.col("_low").alias("v"))).distinct()
        number = written(small, at := new_path(spark, "stars"))
        remove(spark, path)
        rows, path = table(spark, rows, at), at
        # stars: a vertex has one centre, which has none
        inner = rows.join(rows.select(*by, F.col("u").alias("v")).distinct(), [*by, "v"], "left_semi")
        if inner.isEmpty() and rows.select(*on).distinct().count() == number:
            return rows


def alike_closure(rows: DataFrame, by: tuple[str, ...] = (), loops: bool = False) -> DataFrame:
    """``by, src, trg``: the closure of: the two have a ``trg`` of ``rows`` in common, and with ``loops`` false are not
    the same."""
    rows = stash(rows.select(*by, "src", "trg"), "alike")
    first = _lowest(rows, by, "trg", "src")
    links = rows.join(first, [*by, "trg"]).select(*by, F.col("src").alias("u"), F.col("_low").alias("v"))
    stars = roots(links, by)
    members = stars.select(*by, F.col("u").alias("src"), F.col("v").alias("root")).unionByName(stars.select(*by, F.col("v").alias("src"), F.col("v").alias("root")).distinct())
    if loops:  # who has nothing in common with others has it with itself
        alone = rows.select(*by, "src").distinct().join(members.select(*by, "src"), [*by, "src"], "left_anti")
        members = members.unionByName(alone.withColumn("root", F.col("src")))
    members = stash(members, "members")
    return _pairs(members, by)


def _pairs(members: DataFrame, by: tuple[str, ...], timed: bool = False) -> DataFrame:
    """``by, src, trg`` of members ``by, root, src`` with the same root; with ``timed`` while both are members."""
    interval = ["vs", "ve"] * timed
    chunks = members.groupBy(*by, "root").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks"))
    members = members.join(chunks, [*by, "root"])
    left = members.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    right = members.select(*by, "root", F.col("src").alias("trg"), F.pmod(F.xxhash64("src"), "_chunks").cast("int").alias("_chunk"), *[F.col(c).alias(f"_{c}") for c in interval])
    rows = left.join(right.hint("merge"), [*by, "root", "_chunk"])
    if not timed:
        return rows.select(*by, "src", "trg")
    vs, ve = F.greatest("vs", "_vs"), F.least("ve", "_ve")
    return rows.where(vs < ve).select(*by, "src", "trg", vs.alias("vs"), ve.alias("ve"))


def _stretches(edges: DataFrame) -> DataFrame:
    """The edges ``src, trg, vs, ve``, cut at the bounds of stretches of time, ``_from, _to``.

    A stretch is at most as long as an edge on average, so members of a component that don't meet are few, and has at
    most ``CHANGES`` of the edges' begins and ends, if they don't fall into one bin.
    """
    length = max(int(edges.agg(F.ceil(F.avg(F.col("ve") - F.col("vs")))).first()[0] or 1), 1)
    width = -(-length // BINS)
    low = F.explode(F.sequence(F.col("vs") - F.pmod("vs", F.lit(length)), F.col("ve") - 1, F.lit(length).cast("long")))
    cells = edges.select("src", "trg", "vs", "ve", low.alias("_low"))
    bin_of = lambda t: F.floor((t - F.col("_low")) / width)
    inner = lambda c: F.when((F.col(c) > F.col("_low")) & (F.col(c) < F.col("_low") + length), bin_of(F.col(c)))
    marks = cells.select("_low", F.explode(F.array(F.lit(-1).cast("long"), inner("vs"), inner("ve"))).alias("_bin")).where("_bin is not null")
    bins = marks.groupBy("_low", F.greatest("_bin", F.lit(0)).alias("_bin")).agg(F.sum(F.when(F.col("_bin") >= 0, 1).otherwise(0)).alias("_n"))
    in_order = Window.partitionBy("_low").orderBy("_bin")
    parts = bins.withColumn("_part", F.floor((F.sum("_n").over(in_order) - F.col("_n")) / CHANGES))
    begins = parts.groupBy("_low", "_part").agg((F.col("_low") + F.min("_bin") * width).alias("_from"))
    until = F.lead("_from").over(Window.partitionBy("_low").orderBy("_part"))
    stretches = begins.select("_low", "_from", F.coalesce(until, F.col("_low") + length).alias("_to"))
    met = cells.join(stretches, "_low").where("vs < _to AND ve > _from")
    return met.select("_from", "_to", "src", "trg", F.greatest("vs", "_from").alias("vs"), F.least("ve", "_to").alias("ve"))


class Forest:
    """Components of vertices while links between them come and go, each link's end being known when it begins.

    The trees have those links that end last, so the end of a tree's link always divides the tree.  The smaller part of a
    tree that is divided or joined changes its component's number, the larger one keeps it.  ``stays`` has when a vertex
    with a weight was in a component of weight 2 or more: ``vertex, component, vs, ve``.
    """

    def __init__(self, weights: list[int], start: int):
        number = len(weights)
        self.weights = weights
        self.near: list[set[int]] = [set() for _ in range(number)]
        self.up, self.ends = [-1] * number, [0] * number
        self.component = list(range(number))
        self.since = [start] * number
        self.size, self.weight = dict.fromkeys(range(number), 1), dict(enumerate(weights))
        self.counted = {v: {v} if w else set() for v, w in enumerate(weights)}
        self.next = number
        self.stays: list[tuple[int, int, int, int]] = []

    def leave(self, v: int, at: int) -> None:
        if self.since[v] < at:
            self.stays.append((v, self.component[v], self.since[v], at))

    def reroot(self, v: int) -> None:
        up, ends, below, end = self.up, self.ends, -1, 0
        while v >= 0:
            above, its = up[v], ends[v]
            up[v], ends[v] = below, end
            below, end, v = v, its, above

    def above(self, v: int) -> list[int]:
        path = [v]
        while (v := self.up[v]) >= 0:
            path.append(v)
        return path

    def tie(self, child: int, parent: int, end: int) -> None:
        self.up[child], self.ends[child] = parent, end
        self.near[child].add(parent)
        self.near[parent].add(child)

    def untie(self, child: int) -> None:
        parent = self.up[child]
        self.up[child] = -1
        self.near[child].discard(parent)
        self.near[parent].discard(child)

    def renumber(self, vertices: Iterable[int], new: int, at: int, seen: bool) -> None:
        for x in vertices:
            if self.weights[x]:
                if seen:
                    self.leave(x, at)
                self.since[x] = at
            self.component[x] = new

    def begin(self, u: int, v: int, end: int, at: int) -> None:
        a, b = self.component[u], self.component[v]
        if a == b:
            one, two = self.above(u), self.above(v)
            while one and two and one[-1] == two[-1]:
                one.pop(), two.pop()
            # the link of the circle that ends first goes
            low = min(one + two, key=self.ends.__getitem__, default=-1)
            if low >= 0 and self.ends[low] < end:
                self.untie(low)
                child, parent = (u, v) if low in one else (v, u)
                self.reroot(child)
                self.tie(child, parent, end)
            return
        if self.size[a] < self.size[b]:
            a, b, u, v = b, a, v, u
        self.renumber(self.spread(v), a, at, self.weight[b] >= 2)
        if self.weight[a] < 2:
            for x in self.counted[a]:
                self.since[x] = at
        self.size[a] += self.size.pop(b)
        self.weight[a] += self.weight.pop(b)
        self.counted[a] |= self.counted.pop(b)
        self.reroot(v)
        self.tie(v, u, end)

    def spread(self, v: int) -> Iterator[int]:
        """The vertices of a tree, one after the other."""
        todo = [(v, -1)]
        while todo:
            x, came = todo.pop()
            yield x
            todo += [(y, x) for y in self.near[x] if y != came]

    def smaller(self, u: int, v: int) -> list[int]:
        """The vertices of the tree of either that has fewer; no more of the other are visited."""
        found: tuple[list[int], list[int]] = ([], [])
        both = self.spread(u), self.spread(v)
        while True:
            for seen, rest in zip(found, both):
                if (x := next(rest, None)) is None:
                    return seen
                seen.append(x)

    def finish(self, u: int, v: int, at: int) -> None:
        child = u if self.up[u] == v and self.ends[u] == at else v if self.up[v] == u and self.ends[v] == at else -1
        if child < 0:
            return  # left the tree before
        other, old = self.up[child], self.component[child]
        self.untie(child)
        part = self.smaller(child, other)
        new, self.next = self.next, self.next + 1
        seen = self.weight[old] >= 2
        self.renumber(part, new, at, seen)
        self.counted[new] = {x for x in part if self.weights[x]}
        self.counted[old] -= self.counted[new]
        self.size[new] = len(part)
        self.size[old] -= len(part)
        self.weight[new] = sum(self.weights[x] for x in self.counted[new])
        self.weight[old] -= self.weight[new]
        if seen and self.weight[old] < 2:
            for x in self.counted[old]:
                self.leave(x, at)

    def close(self, at: int) -> None:
        for number, weight in self.weight.items():
            if weight >= 2:
                for x in self.counted[number]:
                    self.leave(x, at)


STAYS = "_from long, node string, root string, vs long, ve long"


def _follow(links: pa.Table) -> pa.Table:
    """The ``STAYS`` of vertices in components, by the links ``_from, _to, u, v, uw, vw, vs, ve`` of a stretch."""
    column = lambda name: links.column(name).to_numpy()
    begin, to = column("_from")[0], column("_to")[0]
    ends = np.concatenate([column("u"), column("v")])
    names, at = np.unique(ends, return_index=True)
    weights = np.concatenate([column("uw"), column("vw")])[at]
    known = {x: i for i, x in enumerate(names)}
    u, v = (np.array([known[x] for x in column(c)]) for c in "uv")
    vs, ve = column("vs"), column("ve")
    forest = Forest(weights.tolist(), int(begin))
    # at an instant links begin before others end, so what stays linked keeps its component
    when, kind = np.concatenate([vs, ve[ve < to]]), np.concatenate([np.zeros(len(vs), int), np.ones((ve < to).sum(), int)])
    which = np.concatenate([np.arange(len(vs)), np.flatnonzero(ve < to)])
    order = np.lexsort((which, kind, when))
    u, v, end = u.tolist(), v.tolist(), ve.tolist()
    for t, ending, i in zip(when[order].tolist(), kind[order].tolist(), which[order].tolist()):
        if ending:
            forest.finish(u[i], v[i], t)
        else:
            forest.begin(u[i], v[i], end[i], t)
    forest.close(int(to))
    stays = np.array(forest.stays, dtype=np.int64).reshape(-1, 4)
    root = pa.array(stays[:, 1]).cast(pa.string())
    return pa.table({"_from": pa.array(np.full(len(stays), begin)), "node": pa.array(names[stays[:, 0]], pa.string()), "root": root, "vs": stays[:, 2], "ve": stays[:, 3]})


def twins(rows: DataFrame, what: list[str], least: float = 0) -> DataFrame | None:
    """Members ``one, src`` of the classes of vertices ``src`` with the very same ``what`` in their rows, which are
    distinct; ``one`` is the least of a class.  None if there are fewer than ``least`` vertices for a class.

    Rows of a vertex are gathered only if a hash of all of them is another vertex's too.
    """
    marks = rows.groupBy("src").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64(*what)).alias("_mark"))
    marks = stash(marks, "marks")
    groups = marks.groupBy("_n", "_mark").agg(F.count(F.lit(1)).alias("_vertices"))
    number, vertices = groups.agg(F.count(F.lit(1)), F.sum("_vertices")).first()
    if (vertices or 0) < least * number:
        return None
    marks = marks.join(groups, ["_n", "_mark"])
    sets = rows.join(marks.where("_vertices > 1").select("src"), "src", "left_semi").groupBy("src").agg(F.sort_array(F.collect_list(F.struct(*what))).alias("_set"))
    sets = stash(sets, "sets")
    shared = sets.join(sets.groupBy("_set").agg(F.min("src").alias("one")), "_set").select("one", "src")
    return stash(shared.unionByName(marks.where("_vertices = 1").select(F.col("src").alias("one"), "src")), "twins")


def refined(pairs: DataFrame, members: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Pairs ``by, src, trg, vs, ve`` between classes with ``members`` ``by, one, src``, between classes that are parts of
    such of every ``by``, and the members ``one, src`` of those."""
    finer = twins(members.select("src", by, "one"), [by, "one"])
    parts = stash(members.join(finer.withColumnRenamed("one", "_part"), "src").select(by, "one", "_part").distinct(), "parts")
    rows = pairs
    for end in ("src", "trg"):
        rows = rows.join(parts.select(by, F.col("one").alias(end), F.col("_part").alias(f"_{end}")), [by, end])
    return rows.select(by, F.col("_src").alias("src"), F.col("_trg").alias("trg"), "vs", "ve"), finer


def expanded(pairs: DataFrame, members: DataFrame | None) -> DataFrame:
    """Pairs ``src, trg, vs, ve`` between classes, for each two of their members ``one, src``.

    The pairs of classes are dealt out, by parts of a class if it is large; what they become isn't shuffled if members
    are few enough to be broadcast.
    """
    if members is None:
        return pairs
    few = F.broadcast if members.count() <= FEW_MEMBERS else lambda rows: rows
    chunks = members.groupBy("one").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks"))
    left = members.join(chunks, "one").select(F.col("one").alias("src"), F.col("src").alias("_src"), F.pmod(F.xxhash64("src"), "_chunks").cast("int").alias("_chunk"))
    right = members.select(F.col("one").alias("trg"), F.col("src").alias("_trg"))
    number = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few pairs of classes become very many rows
    rows = pairs.join(few(chunks.withColumnRenamed("one", "src")), "src")
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).repartition(number, "src", "trg", "vs", "_chunk")
    rows = rows.join(few(left), ["src", "_chunk"]).join(few(right), "trg")
    return rows.select(F.col("_src").alias("src"), F.col("_trg").alias("trg"), "vs", "ve")


def alike_intervals(rows: DataFrame, loops: bool = False) -> DataFrame:
    """``src, trg, vs, ve``, coalesced: ``alike_closure`` of rows ``src, trg, vs, ve`` for all time.  The rows are
    coalesced."""
    return expanded(*alike_classes(rows, loops))


def alike_classes(rows: DataFrame, loops: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``alike_intervals`` between the first ones of classes of twins, and the members ``one, src`` of the classes; None if
    few vertices are twins, and the pairs are between vertices then."""
    rows = stash(rows.where("src IS NOT NULL AND trg IS NOT NULL").select("src", "trg", "vs", "ve"), "alike")
    if (members := twins(rows, ["trg", "vs", "ve"], MANY_TWINS)) is None:
        return _followed(rows, loops), None
    # with a second one a class is linked to itself as long as it has anything
    first = members.groupBy("one").agg(F.min(F.when(F.col("src") != F.col("one"), F.col("src"))).alias("_two"))
    first = stash(first, "first")
    second = first.where("_two IS NOT NULL").select(F.col("_two").alias("src"))
    ones = stash(rows.join(first.select(F.col("one").alias("src")).unionByName(second), "src", "left_semi"), "alike")
    return stash(_followed(ones, loops, second), "classes"), members


def _followed(rows: DataFrame, loops: bool, without: DataFrame | None = None) -> DataFrame:
    """``alike_intervals`` by components that are followed; vertices ``without`` link others, but aren't paired."""
    kind = rows.schema["src"].dataType
    # those who have something and what they have are vertices with names of their own
    links = stash(_stretches(rows), "links")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    links = links.select("_from", "_to", name("s", "src").alias("u"), name("t", "trg").alias("v"), "vs", "ve")
    whole = "vs = _from AND ve = _to"
    always, changing = links.where(whole), links.where(f"NOT ({whole})").withColumns({"uw": F.lit(1).cast("long"), "vw": F.lit(0).cast("long")})
    own = lambda node: F.expr(f"substring({node}, 2)").cast(kind)
    follow = lambda changing: changing.groupBy("_from").applyInArrow(_follow, STAYS)
    if always.isEmpty():
        members = follow(changing).select("_from", "root", own("node").alias("src"), "vs", "ve")
    else:
        stars = stash(roots(always.select("_from", "u", "v"), ("_from",)), "stars")
        same = stars.select("_from", F.col("u").alias("node"), F.col("v").alias("one"))
        same = stash(same.unionByName(stars.select("_from", F.col("v").alias("node"), F.col("v").alias("one")).distinct()), "same")
        classes = same.groupBy("_from", "one").agg(F.sum(F.col("node").startswith("s").cast("long")).alias("weight"))
        same = stash(same.join(classes, ["_from", "one"]), "same")
        for end, weight in (("u", "uw"), ("v", "vw")):
            part = same.select("_from", F.col("node").alias(end), F.col("one").alias("_one"), F.col("weight").alias("_weight"))
            found = changing.join(part, ["_from", end], "left")
            changing = found.withColumns({end: F.coalesce("_one", end), weight: F.coalesce("_weight", weight)}).drop("_one", "_weight")
        changing = stash(changing.where("u <> v"), "changing")
        stays = follow(changing)
        # what is linked throughout and has no other links
        touched = changing.select("_from", F.col("u").alias("one")).unionByName(changing.select("_from", F.col("v").alias("one"))).distinct()
        spans = links.select("_from", "_to").distinct()
        rest = classes.where(F.col("weight") >= 2).join(touched, ["_from", "one"], "left_anti").join(spans, "_from")
        stays = stays.unionByName(rest.select("_from", F.col("one").alias("node"), F.col("one").alias("root"), F.col("_from").alias("vs"), F.col("_to").alias("ve")))
        who = links.select("_from", F.col("u").alias("who")).distinct().join(same.select("_from", F.col("node").alias("who"), "one"), ["_from", "who"], "left")
        who = who.select("_from", "who", F.coalesce("one", "who").alias("node"))
        members = who.join(stays, ["_from", "node"]).select("_from", "root", own("who").alias("src"), "vs", "ve")
    if without is not None:
        members, rows = (r.join(without, "src", "left_anti") for r in (members, rows))
    members = stash(members, "members")
    pairs = _pairs(members, ("_from",), timed=True).select("src", "trg", "vs", "ve")
    if loops:  # who has something has it with itself
        pairs = pairs.unionByName(rows.select("src", F.col("src").alias("trg"), "vs", "ve"))
    return coalesce(pairs, ["src", "trg"])
