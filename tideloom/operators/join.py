"""Joins of ``src, trg`` relations on endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import stash

#: Which endpoint of the left and of the right side: source or target.
SELECTORS = {"SS": ("src", "src"), "ST": ("src", "trg"), "TS": ("trg", "src"), "TT": ("trg", "trg")}


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in rows.columns])


def _common(left: DataFrame, by: list[str]) -> tuple[Column, list[Column]]:
    condition = F.lit(True)
    for c in by:
        condition = condition & (F.col(f"l_{c}") == F.col(f"r_{c}"))
    return condition, [F.col(f"l_{c}").alias(c) for c in by]


def _joined(left: DataFrame, right: DataFrame, on: Column, keep: list[Column], timed: bool, span: int | None) -> DataFrame:
    l, r = _prefixed(left, "l_"), _prefixed(right, "r_")
    vs, ve = F.greatest("l_vs", "r_vs"), F.least("l_ve", "r_ve")
    if not timed:
        return l.join(r, on).select(*keep)
    if span is None:
        return l.join(r, on & (vs < ve)).select(*keep, vs.alias("vs"), ve.alias("ve"))
    # long histories of a vertex: only rows of the same stretch of time meet, and a pair where its intersection begins
    bucket = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}_vs") / span), F.floor((F.col(f"{p}_ve") - 1) / span))).alias(f"{p}_bucket")
    l, r = l.where("l_vs < l_ve").select("*", bucket("l")), r.where("r_vs < r_ve").select("*", bucket("r"))
    rows = l.join(r, on & (F.col("l_bucket") == F.col("r_bucket")) & (vs < ve))
    return rows.where(F.floor(vs / span) == F.col("l_bucket")).select(*keep, vs.alias("vs"), ve.alias("ve"))


def endpoint_join(left: DataFrame, right: DataFrame, key: str = "TS", output: str = "ST", by: tuple[str, ...] = (), timed: bool = False, span: int | None = None) -> DataFrame:
    """Rows whose endpoints ``key`` are equal, as (the left's, the right's) endpoint ``output``.

    ``by`` names columns that are equal too, such as the boundary.  With ``timed`` rows have intervals and the result
    their intersection; empty ones are left out.  ``span`` splits the intervals into stretches of that length, for
    vertices with so long a history that most of their pairs of rows don't meet.
    """
    a, b = SELECTORS[key]
    x, y = SELECTORS[output]
    same, kept = _common(left, list(by))
    return _joined(left, right, (F.col(f"l_{a}") == F.col(f"r_{b}")) & same, [*kept, F.col(f"l_{x}").alias("src"), F.col(f"r_{y}").alias("trg")], timed, span)


def pair_join(left: DataFrame, right: DataFrame, reverse: bool = False, swap: bool = False, by: tuple[str, ...] = (), timed: bool = False, span: int | None = None) -> DataFrame:
    """Rows of ``left`` whose pair of endpoints is a row of ``right``, or with ``reverse`` the exchanged pair; with
    ``swap`` the result is the exchanged pair of the left."""
    a, b = ("trg", "src") if reverse else ("src", "trg")
    x, y = ("l_trg", "l_src") if swap else ("l_src", "l_trg")
    same, kept = _common(left, list(by))
    on = (F.col("l_src") == F.col(f"r_{a}")) & (F.col("l_trg") == F.col(f"r_{b}")) & same
    return _joined(left, right, on, [*kept, F.col(x).alias("src"), F.col(y).alias("trg")], timed, span)


def common(left: DataFrame, right: DataFrame, on: list[str], timed: bool) -> DataFrame:
    """The join of rows that are equal in the columns ``on``; with ``timed`` while both are valid."""
    if not timed:
        return left.join(right, on)
    vs, ve = F.greatest("vs", "_vs"), F.least("ve", "_ve")
    rows = left.join(right.withColumnsRenamed({"vs": "_vs", "ve": "_ve"}), on).where(vs < ve)
    return rows.withColumns({"vs": vs, "ve": ve}).drop("_vs", "_ve")


def legs(left: DataFrame, right: DataFrame, key: str, output: str, via: str, by: tuple[str, ...] = (), timed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sides of an endpoint join that isn't made: ``by, x, via`` and ``by, y, via``, where ``x, y`` is its output."""
    (a, b), (x, y), rest = SELECTORS[key], SELECTORS[output], ["vs", "ve"] * timed
    side = lambda rows, name, end, k: rows.select(*by, F.col(end).alias(name), F.col(k).alias(via), *rest)
    return side(left, "x", x, a), side(right, "y", y, b)


def sizes(joins: dict[str, list[tuple[DataFrame, DataFrame, list[str]]]]) -> dict[str, float]:
    """How many rows the joins of each name make in all, from the numbers of rows of their keys, whatever the times."""

    def of(name: str, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        number = lambda rows, n: rows.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(n))
        return number(left, "_l").join(number(right, "_r"), on).agg(F.sum(F.col("_l") * F.col("_r")).alias("rows")).select(F.lit(name).alias("name"), "rows")

    parts = [of(name, *join) for name, all_joins in joins.items() for join in all_joins]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return {r.name: r.rows or 0.0 for r in rows.groupBy("name").agg(F.sum("rows").alias("rows")).collect()}


def triangle_join(a: DataFrame, c: DataFrame, pairs: DataFrame, by: tuple[str, ...] = (), timed: bool = False) -> DataFrame | None:
    """Pairs ``x, y`` for which there are a row ``x, k`` of ``a`` and a row ``y, k`` of ``c``, as ``src, trg``: the pairs
    are joined to one of the sides first.  None if joining the sides first makes fewer rows."""
    one, two = [*by, "x"], [*by, "y"]
    found = sizes({"sides": [(a, c, [*by, "k"])], "a": [(pairs, a, one)], "c": [(pairs, c, two)]})
    if found["sides"] <= min(found["a"], found["c"]):
        return None
    if found["a"] <= found["c"]:
        rows = common(common(pairs, a, one, timed), c, [*two, "k"], timed)
    else:
        rows = common(common(pairs, c, two, timed), a, [*one, "k"], timed)
    return rows.select(*by, F.col("x").alias("src"), F.col("y").alias("trg"), *["vs", "ve"] * timed)


def square_join(a: DataFrame, c: DataFrame, b: DataFrame, d: DataFrame, by: tuple[str, ...] = (), timed: bool = False) -> DataFrame | None:
    """Pairs ``x, y`` with rows ``x, k`` of ``a``, ``y, k`` of ``c``, ``x, n`` of ``b`` and ``y, n`` of ``d``, as ``src,
    trg``: what has ``x`` in common and what has ``y`` in common is joined first.  None if the joins on ``k`` and on ``n``
    make fewer rows."""
    one, two, both = [*by, "x"], [*by, "y"], [*by, "k", "n"]
    found = sizes({"pairs": [(a, c, [*by, "k"]), (b, d, [*by, "n"])], "corners": [(a, b, one), (c, d, two)]})
    if found["pairs"] <= found["corners"]:
        return None
    rows = common(common(a, b, one, timed), common(c, d, two, timed), both, timed)
    return rows.select(*by, F.col("x").alias("src"), F.col("y").alias("trg"), *["vs", "ve"] * timed)


#: From so many rows on, and so many times the rows of its sides, a join is made by classes.
MANY_PAIRS, MANY_TIMES = 2_000_000, 4
#: Members of classes that are broadcast, at most.
FEW_MEMBERS = 200_000


def neighbour_classes(rows: DataFrame, by: tuple[str, ...], end: str) -> tuple[DataFrame, DataFrame]:
    """Vertices ``end`` with the very same set of ``k``: members ``by, end, c``, where ``c`` is the least one of the
    class, and classes ``by, c, k``."""
    sets = stash(rows.groupBy(*by, end).agg(F.sort_array(F.collect_set("k")).alias("_set")), "sets")
    classes = stash(sets.groupBy(*by, "_set").agg(F.min(end).alias(f"_{end}")), "classes")
    members = stash(sets.join(classes, [*by, "_set"]).select(*by, end, f"_{end}"), "members")
    return members, classes.select(*by, f"_{end}", F.explode("_set").alias("k"))


def class_join(a: DataFrame, c: DataFrame, by: tuple[str, ...] = ()) -> DataFrame | None:
    """Distinct ``by, src, trg`` such that ``a`` has a row ``x, k`` and ``c`` a row ``y, k``.

    Vertices with the same ``k`` have the same results; so classes of them are joined and made distinct, and only then
    replaced by their members, which needs no exchange of the results.  None if the plain join makes few rows.
    """
    made = sizes({"join": [(a, c, [*by, "k"])]}).get("join", 0.0)
    if made < MANY_PAIRS or made < MANY_TIMES * (a.count() + c.count()):
        return None
    (left, one), (right, two) = neighbour_classes(a, by, "x"), neighbour_classes(c, by, "y")
    pairs = stash(one.join(two, [*by, "k"]).select(*by, "_x", "_y").distinct(), "pairs")
    few = lambda members: F.broadcast(members) if members.count() <= FEW_MEMBERS else members
    number = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few pairs of classes become very many rows
    rows = pairs.repartition(number, *by, "_x", "_y").join(few(left), [*by, "_x"]).join(few(right), [*by, "_y"])
    return rows.select(*by, F.col("x").alias("src"), F.col("y").alias("trg"))
