import itertools
import random
import re

import pytest

from tideloom.functions import intervals
from tideloom.functions.automata import Dfa, compile_path, determinize, minimize, nfa_of
from tideloom.functions.regex import PathSyntaxError, UnsupportedPath, labels, parse

LETTERS = "abc"


def drawn(rnd, depth):
    """A random path expression, and the same as a regular expression of the standard library."""
    if depth == 0 or rnd.random() < 0.2:
        c = rnd.choice(LETTERS)
        return c, c
    (p, x), (q, y) = drawn(rnd, depth - 1), drawn(rnd, depth - 1)
    return rnd.choice([(f"({p})/({q})", f"(?:{x})(?:{y})"), (f"({p})|({q})", f"(?:{x})|(?:{y})"), (f"({p})*", f"(?:{x})*"), (f"({p})+", f"(?:{x})+")])


@pytest.mark.parametrize("seed", range(60))
def test_automata_accept_what_regular_expressions_do(seed):
    rnd = random.Random(seed)
    path, pattern = drawn(rnd, 4)
    nfa = nfa_of(parse(path))
    known, match = nfa.alphabet(), re.compile(pattern).fullmatch
    words = ["".join(w) for n in range(4) for w in itertools.product(sorted(known), repeat=n)]
    words += ["".join(rnd.choice(sorted(known)) for _ in range(rnd.randrange(4, 9))) for _ in range(60)]
    wide, small = determinize(nfa), minimize(determinize(nfa))
    for word in words:
        assert [m.accepts(word) for m in (nfa, wide, small)] == [bool(match(word))] * 3
    assert len(small.states()) <= len(wide.states())


def test_machines_built_by_hand():
    """Random tables of moves, against following them one by one."""
    rnd = random.Random(4)
    for _ in range(30):
        moves = {(s, c): rnd.randrange(4) for s in range(4) for c in "xy" if rnd.random() < 0.7}
        final = {s for s in range(4) if rnd.random() < 0.4}
        dfa = Dfa(final)
        for (s, c), t in moves.items():
            dfa.add(s, c, t)
        for n in range(7):
            for word in map("".join, itertools.product(sorted(dfa.alphabet()), repeat=n)):
                at = 0
                for c in word:
                    at = None if at is None else moves.get((at, c))
                assert dfa.accepts(word) == (at in final)


@pytest.mark.parametrize(("left", "right"), [("x*/x", "x+"), ("(x|y)*/(x|y)*", "(x|y)*"), ("(x/y)*/x", "x/(y/x)*"), ("x/z|y/z", "(x|y)/z")])
def test_equal_languages_have_machines_of_one_size(left, right):
    one, two = compile_path(left), compile_path(right)
    assert len(one.states()) == len(two.states()) and len(one.final) == len(two.final)


def test_foreign_symbol_is_an_error():
    for machine in (nfa_of(parse("a/b")), compile_path("a/b")):
        with pytest.raises(ValueError):
            machine.accepts(["a", "z"])


@pytest.mark.parametrize("text", ["a?", "a{2}", "a{1,}", "a{1,3}", "^a", "a^b"])
def test_unsupported(text):
    with pytest.raises(UnsupportedPath):
        parse(text)


@pytest.mark.parametrize("text", ["", "a//b", "a / b", "(a", "a)", "|a", "*"])
def test_syntax_errors(text):
    with pytest.raises(PathSyntaxError):
        parse(text)


def test_labels():
    assert labels(parse(":a/(b_1|c)*")) == {":a", "b_1", "c"}


def sets(spark, rows):
    return spark.createDataFrame([("k", *r) for r in rows], "k string, vs long, ve long")


def test_coalesce_steps(spark):
    rows = [(3, 6), (10, 13), (15, 21), (8, 9)]
    steps = [
        ([], [(3, 6), (8, 9), (10, 13), (15, 21)]),
        ([(8, 11)], [(3, 6), (8, 13), (15, 21)]),
        ([(11, 14)], [(3, 6), (8, 14), (15, 21)]),
        ([(11, 12), (8, 14)], [(3, 6), (8, 14), (15, 21)]),
        ([(5, 14)], [(3, 14), (15, 21)]),
        ([(14, 15)], [(3, 21)]),
        ([(1, 2)], [(1, 2), (3, 21)]),
        ([(22, 25)], [(1, 2), (3, 21), (22, 25)]),
        ([(30, 30), (9, 7)], [(1, 2), (3, 21), (22, 25)]),
    ]
    for more, expected in steps:
        rows = rows + more
        got = intervals.coalesce(sets(spark, rows), ["k"]).collect()
        assert sorted((r.vs, r.ve) for r in got) == expected


def test_coalesce_in_stretches(spark):
    rnd = random.Random(1)
    rows = [(k, v, v + rnd.randrange(0, 40)) for k in "ab" for v in (rnd.randrange(-500, 500) for _ in range(300))]
    df = spark.createDataFrame(rows, "k string, vs long, ve long")
    whole = sorted(intervals.coalesce(df, ["k"]).collect())
    for stretch in (1, 7, 100, 5000):
        assert sorted(intervals.coalesce(df, ["k"], stretch).collect()) == whole


def test_expiry(spark):
    rows = sets(spark, [(3, 6), (8, 9), (10, 13), (15, 21)])
    count = lambda t: intervals.expire(rows, t).count()
    assert [count(2), count(6), count(11)] == [4, 3, 2]
    assert intervals.expiry_bounds(rows, ["k"]).first()[1:] == (6, 21)
    assert intervals.timeslice(rows, 12).count() == 1 and intervals.timeslice(rows, 13).count() == 0


def test_interval_columns(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        intervals.overlaps(F.lit(1), F.lit(3), F.lit(3), F.lit(5)).alias("touch"),
        intervals.overlaps(F.lit(1), F.lit(4), F.lit(3), F.lit(5)).alias("meet"),
        *[c.alias(f"i{k}") for k, c in enumerate(intervals.intersect(F.lit(1), F.lit(4), F.lit(3), F.lit(5)))],
        *[c.alias(f"h{k}") for k, c in enumerate(intervals.hull(F.lit(1), F.lit(4), F.lit(3), F.lit(5)))],
    ).first()
    assert tuple(row) == (False, True, 3, 4, 1, 5)
