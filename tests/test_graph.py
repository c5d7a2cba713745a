"""Sources, windows, joins, paths and named queries, against goldens and brute force."""

import random

import pytest

from tideloom.operators.component import alike_closure
from tideloom.operators.join import SELECTORS, endpoint_join, pair_join
from tideloom.operators.path import TooManyRounds, path_query
from tideloom.operators import component, join, path, relational, window as w
from tideloom.plans import evaluate, library
from tideloom.plans.algebra import Join, PairJoin, Path, Scan
from tideloom.sources.edges import hashed_ids, label_filter, read_edges, start_timestamp

EDGES = "src long, label string, trg long, ts long"
#: Two small graphs.
KNOWS = [(2, 3, 3), (1, 2, 4), (3, 4, 8), (4, 1, 11), (1, 6, 12), (5, 3, 13), (6, 5, 14), (1, 5, 16), (4, 7, 17)]
FORUM = [(2, "hasCreator", 3, 7), (1, "knows", 2, 8), (3, "hasCreator", 5, 10), (5, "replyOf", 6, 15), (6, "replyOf", 7, 16)]
REACH = """
(1,1,11,13) (1,1,14,18) (1,2,4,14) (1,3,4,13) (1,3,14,23) (1,4,8,13) (1,4,14,18) (1,5,14,26) (1,6,12,22)
(1,7,17,18) (2,1,11,13) (2,2,11,13) (2,3,3,13) (2,4,8,13) (2,6,12,13) (3,1,11,18) (3,2,11,14) (3,3,11,13)
(3,3,14,18) (3,4,8,18) (3,5,14,18) (3,6,12,18) (3,7,17,18) (4,1,11,21) (4,2,11,14) (4,3,11,13) (4,3,14,21)
(4,4,11,13) (4,4,14,18) (4,5,14,21) (4,6,12,21) (4,7,17,27) (5,1,13,18) (5,2,13,14) (5,3,13,23) (5,4,13,18)
(5,5,14,18) (5,6,13,18) (5,7,17,18) (6,1,14,18) (6,3,14,23) (6,4,14,18) (6,5,14,24) (6,6,14,18) (6,7,17,18)
"""


def knows(spark):
    return spark.createDataFrame([(s, "knows", t, ts) for s, t, ts in KNOWS], EDGES)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_valid_time_golden(spark):
    expected = sorted(eval(x) for x in REACH.split())
    assert rows(evaluate.valid_time(knows(spark), library.query1("knows"), 10)) == expected


@pytest.mark.parametrize(
    ("name", "labels", "expected"),
    [
        ("query2", ["hasCreator", "replyOf"], [(3, 6, 15, 20), (3, 7, 16, 20)]),
        ("query2-a", ["hasCreator", "replyOf"], [(2, 3, 7, 17), (3, 5, 10, 20), (3, 6, 15, 20), (3, 7, 16, 20)]),
        ("query3", ["knows", "hasCreator", "replyOf"], [(1, 6, 15, 17), (1, 7, 16, 17)]),
        ("query3-a", ["knows", "hasCreator", "replyOf"], [(1, 2, 8, 18), (1, 3, 8, 17), (1, 5, 10, 17), (1, 6, 15, 17), (1, 7, 16, 17)]),
    ],
)
def test_forum_goldens(spark, name, labels, expected):
    assert rows(evaluate.valid_time(spark.createDataFrame(FORUM, EDGES), library.named(name, labels), 10)) == expected


def test_boundaries(spark):
    edges = knows(spark)
    assert rows(w.slide_boundaries(edges, 5)) == [(0, 8), (1, 13), (2, 18)]
    assert rows(w.slide_boundaries(edges, 5, flush=False)) == [(0, 8), (1, 13)]
    assert rows(w.slide_boundaries(edges.limit(0), 5)) == []
    got = rows(evaluate.at_boundaries(edges, library.query1("knows"), 10, 5))
    assert [x[1:] for x in got if x[0] == 8] == [(1, 2), (1, 3), (2, 3)]
    assert [x[1:] for x in got if x[0] == 13] == [(1, 2), (1, 6), (3, 1), (3, 2), (3, 4), (3, 6), (4, 1), (4, 2), (4, 6)]
    assert [x[1:] for x in got if x[0] == 18] == [(1, 3), (1, 5), (1, 6), (4, 1), (4, 3), (4, 5), (4, 6), (4, 7), (5, 3), (6, 3), (6, 5)]
    for b in (8, 13, 18):
        assert [(b, *x) for x in rows(evaluate.at_boundary(edges, library.query1("knows"), b, 10))] == [x for x in got if x[0] == b]
    held: set = set()
    by_b: dict = {}
    for b, src, trg, diff in rows(evaluate.deltas(edges, library.query1("knows"), 10, 5)):
        by_b.setdefault(b, []).append((src, trg, diff))
    for b in (8, 13, 18):  # the changes add up to the results
        for src, trg, diff in by_b[b]:
            (held.add if diff > 0 else held.remove)((src, trg))
        assert sorted(held) == [x[1:] for x in got if x[0] == b]


def test_reader(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 a 2 5 extra\n\n3\ta   4 6\n1 a\n  7 b 8 9\n")
    (tmp_path / "u.txt").write_text("x a y\nshort line\nz b x more\n")
    assert rows(read_edges(spark, str(tmp_path / "e.txt"), "it")) == [(1, "a", 2, 5), (3, "a", 4, 6), (7, "b", 8, 9)]
    assert rows(read_edges(spark, str(tmp_path / "e.txt"), "st"))[0] == ("1", "a", "2", 5)
    plain = read_edges(spark, str(tmp_path / "u.txt"), "s")
    assert rows(plain) == [("x", "a", "y", 1), ("z", "b", "x", 2)]
    assert rows(read_edges(spark, str(tmp_path / "e.txt"), "i")) == [(1, "a", 2, 1), (3, "a", 4, 2), (7, "b", 8, 3)]
    assert start_timestamp(plain, "s") == 0 and start_timestamp(read_edges(spark, str(tmp_path / "e.txt"))) == 5
    assert hashed_ids(plain).dtypes[0] == ("src", "bigint")
    assert label_filter(plain, ["b"]).count() == 1


def test_relational(spark):
    edges = spark.createDataFrame(FORUM, EDGES)
    a, b, c = relational.partition_by_label(edges, ["replyOf", "replyOf", "none"])
    assert (a.count(), b.count(), c.count()) == (2, 2, 0)
    assert rows(relational.swapped(a.select("src", "trg"))) == [(6, 5), (7, 6)]
    assert relational.union([a, b]).count() == 4
    assert relational.not_loops(spark.createDataFrame([(1, 1), (1, 2)], "src long, trg long")).count() == 1
    assert relational.labelled(a, "x").first()["label"] == "x"


def random_edges(seed, labels=3, vertices=7, edges=45, span=60):
    rnd = random.Random(seed)
    out = sorted((rnd.randrange(span), rnd.randrange(vertices), rnd.randrange(vertices), "abc"[rnd.randrange(labels)]) for _ in range(edges))
    return [(s, label, t, ts) for ts, s, t, label in out if s != t]


def test_joins_against_brute_force(spark):
    rnd = random.Random(1)
    make = lambda: [(rnd.randrange(4), rnd.randrange(4), s := rnd.randrange(20), s + rnd.randrange(0, 9)) for _ in range(30)]
    left, right = make(), make()
    schema = "src long, trg long, vs long, ve long"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    at = {"src": 0, "trg": 1}
    meet = lambda x, y: (max(x[2], y[2]), min(x[3], y[3]))
    for key, (a, b) in SELECTORS.items():
        for output, (x, y) in SELECTORS.items():
            expected = sorted((p[at[x]], q[at[y]], *meet(p, q)) for p in left for q in right if p[at[a]] == q[at[b]] and meet(p, q)[0] < meet(p, q)[1])
            assert rows(endpoint_join(l, r, key, output, timed=True)) == expected
        assert rows(endpoint_join(l, r, key, output, timed=True, span=4)) == expected
    for reverse in (False, True):
        for swap in (False, True):
            expected = sorted(((p[1], p[0]) if swap else p[:2]) + meet(p, q) for p in left for q in right if p[:2] == (q[:2][::-1] if reverse else q[:2]) and meet(p, q)[0] < meet(p, q)[1])
            assert rows(pair_join(l, r, reverse, swap, timed=True)) == expected
            assert rows(pair_join(l, r, reverse, swap, timed=True, span=5)) == expected


def closure(pairs):
    out = set(pairs)
    while True:
        more = {(a, d) for a, b in out for c, d in pairs if b == c} - out
        if not more:
            return out
        out |= more


def compose(a, b):
    return {(x, z) for x, y in a for y2, z in b if y == y2}


def one_shot(name, p):
    """The named queries on sets of pairs."""
    a, b, c = (p.get(x, set()) for x in "abc")
    recent = compose(b, c)
    if name == "join":
        return compose(a, b)
    if name == "query1":
        return closure(a)
    if name == "query2":
        return compose(a, closure(b))
    if name == "query2-a":
        return a | compose(a, closure(b))
    if name == "query3":
        return compose(compose(a, closure(b)), closure(c))
    if name == "query3-a":
        ab = a | compose(a, closure(b))
        return ab | compose(ab, closure(c))
    if name.startswith("query4"):
        return closure(compose(compose(a, b), c))
    if name == "query5":
        return {(m1, m2) for m1, u1 in b for u, u2 in a if u == u1 for m2, v in b if v == u2 and (m2, m1) in c}
    if name == "query6":
        return recent & closure(a)
    if name == "query6-cq":
        return recent & a
    if name.startswith("query7"):
        return {(x, m) for x, y in closure(recent & (closure(a) if name == "query7" else a)) for m, z in c if z == y}
    return closure({(x, y) for x, m in a for y, n in a if m == n and x != y})


@pytest.mark.parametrize("name", list(library.NAMED))
def test_named_queries_at_all_instants(spark, name):
    """Snapshot reducibility: what holds at an instant is what the query gives on the edges valid then."""
    window = 12
    raw = random_edges(len(name))
    edges = spark.createDataFrame(raw, EDGES)
    number, _ = library.NAMED[name]
    got = rows(evaluate.valid_time(edges, library.named(name, list("abc"[:number])), window))
    for instant in sorted({t for e in raw for t in (e[3], e[3] + window)}):
        pairs: dict = {}
        for s, label, t, ts in raw:
            if ts <= instant < ts + window:
                pairs.setdefault(label, set()).add((s, t))
        assert {(s, t) for s, t, vs, ve in got if vs <= instant < ve} == one_shot(name, pairs), instant


def test_same_answer_by_other_plans(spark):
    edges = spark.createDataFrame(random_edges(5), EDGES)
    at = lambda plan: set(rows(evaluate.at_instant(edges, plan, 30, 20)))
    of = lambda name, n=3: at(library.named(name, list("abc"[:n])))
    assert of("query4") == of("query4-a") == of("query4-pc1") == of("query4-pc2")
    assert of("query2-a", 2) == of("query2", 2) | at(library.Scan("a"))
    assert of("query2", 2) == at(library.query2_joined("a", "b")) and of("query3") == at(library.query3_joined("a", "b", "c"))
    assert of("query3") <= of("query3-a") and of("query6-cq") <= of("query6") and of("query7-cq") <= of("query7")
    assert at(library.named("query3", ["a", "b", "b"])) <= at(library.named("query3-a", ["a", "b", "b"]))  # labels may repeat
    assert at(Path("(a|b)+")) == at(Path("(a|b)*")) == at(Path("(b|a)*/(a|b)"))


def test_string_ids_and_missing_labels(spark):
    edges = spark.createDataFrame([("x", "a", "y", 1), ("y", "a", "z", 2)], "src string, label string, trg string, ts long")
    assert rows(evaluate.valid_time(edges, library.query1("a"), 5)) == [("x", "y", 1, 6), ("x", "z", 2, 6), ("y", "z", 2, 7)]
    assert rows(evaluate.valid_time(edges, library.query1("b"), 5)) == []
    assert rows(evaluate.at_instant(edges.limit(0), library.query2("a", "b"), 1, 5)) == []


def test_rounds_are_guarded(spark):
    edges = spark.createDataFrame([(k, "a", k + 1) for k in range(8)], "src long, label string, trg long")
    with pytest.raises(TooManyRounds):
        path_query(edges, "a+", max_rounds=3)
    assert path_query(edges, "a+").count() == 36


def test_bad_names():
    for name, labels in (("query9", ["a"]), ("query1", []), ("query1", ["__a"]), ("query2", ["a", "b|c d"])):
        with pytest.raises(ValueError):
            library.named(name, labels)


@pytest.mark.parametrize("timed", [False, True])
def test_rows_in_buckets(spark, monkeypatch, timed):
    """Large results are kept in buckets, with the same answer, and what was found isn't shuffled again."""
    raw = random_edges(21, edges=60)
    edges = w.wscan(spark.createDataFrame(raw, EDGES), 15)
    edges = edges if timed else edges.drop("vs", "ve")
    expected = rows(path_query(edges, "(a|b)+/c*", timed=timed))
    monkeypatch.setattr(path, "LARGE_ROWS", 10)
    monkeypatch.setattr(path, "MANY_TABLES", 2)
    assert rows(path_query(edges, "(a|b)+/c*", timed=timed)) == expected
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tideloom")]


def test_buckets_spare_the_exchange(spark, monkeypatch):
    monkeypatch.setattr(path, "LARGE_ROWS", 0)
    held = spark.range(100).selectExpr("id AS root", "id % 7 AS v", "cast(id % 2 AS int) AS st")
    found = path.Found(held, ["root", "v", "st"], False)
    found.add(held)
    found.add(held.selectExpr("root + 100 AS root", "v", "st"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = found.unseen(spark.range(300).selectExpr("id AS root", "id % 7 AS v", "cast(id % 2 AS int) AS st").distinct())
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 2
        assert new.count() == 300 - 200 + sum(k % 7 != (k - 100) % 7 for k in range(100, 200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        found.close()


#: Who acts on what: a hub that many act on, and few pairs that are wanted.
HUB = [(k, label, 1000, 10 + k % 3) for k in range(200) for label in "abc"] + [(k, "b", 2000 + k % 50, 11) for k in range(200)] + [(7, "c", 8, 12), (8, "c", 7, 12)]


def joined_rows(monkeypatch):
    """The numbers of rows that endpoint joins of plans make from now on."""
    made, plain = [], evaluate.endpoint_join

    def counted(*args, **kwargs):
        out = plain(*args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(evaluate, "endpoint_join", counted)
    return made


def plainly(edges, plan, mode):
    """A pair join by the rows of both its sides."""
    held = evaluate.Evaluation(edges, mode)
    left, right = held.run(plan.left), held.run(plan.right)
    return rows(held.canonical(pair_join(left, right, plan.reverse, plan.swap, mode.by, mode.timed)))


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("swap", [False, True])
def test_pairs_of_two_joins(spark, monkeypatch, reverse, swap):
    """What two joins have in common is found from their corners, if that makes fewer rows."""
    plan = PairJoin(Join(Scan("a"), Scan("c"), "TT", "SS"), Join(Scan("b"), Scan("c"), "TT", "SS"), reverse, swap)
    for raw in ([e for e in HUB if e[2] >= 1000 and e[0] < 120], random_edges(3, edges=80)):
        edges = evaluate.coalesce(w.wscan(spark.createDataFrame(raw, EDGES), 15), ["src", "label", "trg"])
        expected = plainly(edges, plan, evaluate.VALID_TIME)
        with monkeypatch.context() as patch:
            made = joined_rows(patch)
            assert rows(evaluate.Evaluation(edges, evaluate.VALID_TIME).run(plan)) == expected
        assert max(made, default=0) < 1000 and expected


def in_mode(spark, raw, mode):
    """Edges as plans take them in a mode."""
    edges = w.wscan(spark.createDataFrame(raw, EDGES), 15)
    if mode is evaluate.VALID_TIME:
        return evaluate.coalesce(edges, ["src", "label", "trg"])
    if mode is evaluate.SNAPSHOT:
        return edges.select("src", "label", "trg").distinct()
    return edges.selectExpr("explode(array(0L, vs % 3 + 1)) AS b", "src", "label", "trg").distinct()


@pytest.mark.parametrize("mode", [evaluate.VALID_TIME, evaluate.BOUNDARIES, evaluate.SNAPSHOT], ids=str)
def test_wanted_pairs_first(spark, monkeypatch, mode):
    """A join whose pairs are looked up is made from those pairs, if that makes fewer rows."""
    for reverse, swap, raw in ((True, False, HUB), (False, True, HUB), (True, True, random_edges(4, edges=80))):
        plan = PairJoin(Join(Scan("a"), Scan("b"), "TT", "SS"), Scan("c"), reverse, swap)
        edges = in_mode(spark, raw, mode)
        expected = plainly(edges, plan, mode)
        with monkeypatch.context() as patch:
            made = joined_rows(patch)
            assert rows(evaluate.Evaluation(edges, mode).run(plan)) == expected
        assert max(made, default=0) < 1000 and expected


@pytest.mark.parametrize("by", [(), ("b",)])
def test_closure_of_what_is_alike(spark, monkeypatch, by):
    """Pairs of a component are listed without a search through them; chains are long, and components larger than a chunk."""
    chain = [(k, k + d) for k in range(40) for d in (0, 1)]
    groups = [(100 + k, 900 + k % 3) for k in range(30)] + [(200, 990)]
    raw = [(b, x, y) for b in (1, 2) for x, y in chain + groups if (b, x, y) != (2, 20, 20)]
    pairs = spark.createDataFrame(raw, "b long, src long, trg long").where("b = 2" if not by else "b > 0").select(*by, "src", "trg")
    monkeypatch.setattr("tideloom.operators.component.CHUNK", 7)
    expected = []
    for b in {1, 2} if by else {2}:
        own = [(x, y) for c, x, y in raw if c == b]
        linked = closure({(x, y) for x, m in own for y, n in own if m == n and x != y})
        expected += [(*[b] * len(by), x, y) for x, y in linked]
    assert rows(alike_closure(pairs, by)) == sorted(expected)
    alone = [(*[b] * len(by), 200, 200) for b in ({1, 2} if by else {2})]
    assert rows(alike_closure(pairs, by, loops=True)) == sorted(expected + alone)
    monkeypatch.setattr(evaluate, "path_query", None)  # no fixpoint over pairs
    edges = pairs.selectExpr(*by, "src", "'a' AS label", "trg")
    mode = evaluate.BOUNDARIES if by else evaluate.SNAPSHOT
    assert rows(evaluate.Evaluation(edges, mode).run(library.query8("a"))) == sorted(expected)


def test_components_at_boundaries(spark, monkeypatch):
    """query8 at all boundaries, as the closure of pairs has it, without that closure."""
    edges = spark.createDataFrame(random_edges(11, edges=90), EDGES)
    plan = library.query8("a")
    closed = Path("(__r|__none)+", plan.inputs)  # the same, searched
    expected = rows(evaluate.at_boundaries(edges, closed, 12, 5))
    monkeypatch.setattr(evaluate, "path_query", None)
    assert rows(evaluate.at_boundaries(edges, plan, 12, 5)) == expected and expected


@pytest.mark.parametrize("mode", [evaluate.SNAPSHOT, evaluate.BOUNDARIES], ids=str)
def test_join_by_classes(spark, monkeypatch, mode):
    """Large joins of a closure are made by classes of vertices with the same neighbours, and are the same."""
    wheel = [(k, label, (k * d) % 6, 10 + k % 3) for k in range(60) for d in (1, 2) for label in "abc" if k != (k * d) % 6]
    for raw in (wheel, random_edges(23, edges=120)):
        edges = in_mode(spark, raw, mode)
        with monkeypatch.context() as patch:
            plain = joined_rows(patch)
            expected = rows(evaluate.Evaluation(edges, mode).run(library.query7("a", "b", "c")))
        with monkeypatch.context() as patch:
            patch.setattr(join, "MANY_PAIRS", 0)
            patch.setattr(join, "MANY_TIMES", 0)
            patch.setattr(join, "FEW_MEMBERS", 0 if raw is wheel else 200_000)
            made = joined_rows(patch)
            assert rows(evaluate.Evaluation(edges, mode).run(library.query7("a", "b", "c"))) == expected
        assert expected and len(made) == len(plain) - 1


def test_components_for_all_time(spark, monkeypatch):
    """query8 for all time, as the closure of pairs has it, without that closure; some links outlast a stretch of time."""
    monkeypatch.setattr(component, "BINS", 8)
    monkeypatch.setattr(component, "CHUNK", 5)
    lasting = [(k, "a", 20 + k % 3, ts) for k in range(9) for ts in range(4, 60, 7)]
    with_loops = Path("__r*", (("__r", Join(Scan("a"), Scan("a"), "SS", "TT")),))
    for changes, raw, plan in ((3, lasting + random_edges(32, edges=60), library.query8("a")), (1000, random_edges(31, edges=60), with_loops)):
        edges = spark.createDataFrame(raw, EDGES)
        expected = rows(evaluate.valid_time(edges, Path("(__r|__none)+", plan.inputs), 9))  # the same, searched
        with monkeypatch.context() as patch:
            patch.setattr(component, "CHANGES", changes)
            patch.setattr(evaluate, "path_query", None)
            assert rows(evaluate.valid_time(edges, plan, 9)) == expected and expected
    edges = spark.createDataFrame([("x", "a", "m", 1), ("y", "a", "m", 3), ("z", "a", "n", 4), ("y", "a", "n", 5)], "src string, label string, trg string, ts long")
    got = rows(evaluate.valid_time(edges, library.query8("a"), 5))
    assert [g for g in got if g[0] == "x"] == [("x", "x", 3, 6), ("x", "y", 3, 6), ("x", "z", 5, 6)]
    assert rows(evaluate.valid_time(edges.limit(0), library.query8("a"), 5)) == []


@pytest.mark.parametrize(("loops", "few"), [(False, 200_000), (True, 0)])
def test_twins_for_all_time(spark, monkeypatch, loops, few):
    """Vertices with the same rows are worked through as one class, of which two are followed, and all are in the result."""
    monkeypatch.setattr(component, "CHUNK", 2)
    monkeypatch.setattr(component, "FEW_MEMBERS", few)
    monkeypatch.setattr(component, "CHANGES", 5)
    once = [(100 + k, "a", 90 + k % 3, 5 * k) for k in range(5)] + [(200, "a", 95, 7), (200, "a", 95, 40)]
    raw = [(x + 1000 * c, label, y, ts) for x, label, y, ts in once for c in range(5)] + [(1, "a", 91, 6), (2, "a", 97, 6)]
    own = Join(Scan("a"), Scan("a"), "TT", "SS")
    plan = Path("__r+", (("__r", own),)) if loops else library.query8("a")
    edges = spark.createDataFrame(raw, EDGES)
    expected = rows(evaluate.valid_time(edges, Path("(__r|__none)+", plan.inputs), 9))  # the same, searched
    assert rows(evaluate.valid_time(edges, plan, 9)) == expected
    assert {(200, 4200, 40, 49), (4200, 4200, 7, 16)} <= set(expected)
    links = spark.createDataFrame([(x, y, ts, ts + 9) for x, _, y, ts in raw], "src long, trg long, vs long, ve long")
    pairs, members = component.alike_classes(links, loops)
    assert {r.src for r in pairs.collect()} <= {r.one for r in members.collect()} == {1, 2, 100, 101, 102, 103, 104, 200}
    assert members.count() == 32


@pytest.mark.parametrize("mode", [evaluate.SNAPSHOT, evaluate.BOUNDARIES], ids=str)
def test_walks_from_inner_vertices(spark, monkeypatch, mode):
    """A closure is searched from vertices with edges in and out; most of these vertices have none in."""
    raw = [(100 + k, "ab"[k % 2], k % 7, 10 + k % 3) for k in range(60)] + random_edges(3, vertices=7, edges=12)
    edges = in_mode(spark, raw, mode)
    seen, plain = [], path.searched
    with monkeypatch.context() as patch:
        patch.setattr(path, "searched", lambda e, *rest: seen.append(e) or plain(e, *rest))
        got = rows(evaluate.Evaluation(edges, mode).run(Path("(a|b)+")))
    monkeypatch.setattr(path, "OUTER_TIMES", 10**6)
    assert got == rows(evaluate.Evaluation(edges, mode).run(Path("(a|b)+"))) and got
    assert len(seen) == 1 and seen[0].where("src >= 100").isEmpty()


@pytest.mark.parametrize("mode", [evaluate.SNAPSHOT, evaluate.BOUNDARIES], ids=str)
def test_walks_from_twins(spark, monkeypatch, mode):
    """What outer vertices reach is found once for all of them with the same targets."""
    raw = [(100 + k, "a", (k % 5) * d % 7, 10 + k % 5) for k in range(50) for d in (1, 2)] + [(x, "a", x + 1, 11) for x in range(6)] + [(5, "a", 2, 12)]
    edges = in_mode(spark, raw, mode)
    expected = rows(evaluate.Evaluation(edges, mode).run(Path("a+")))
    monkeypatch.setattr(path, "MANY_OUTER", 0)
    seen, plain = [], path.stash
    monkeypatch.setattr(path, "stash", lambda df, name: seen.append((name, df)) or plain(df, name))
    assert rows(evaluate.Evaluation(edges, mode).run(Path("a+"))) == expected
    of_classes, reach = (df.where("src >= 100") for name, df in seen if name == "reach")
    assert 5 * of_classes.count() < reach.count() == len([r for r in expected if r[-2] >= 100])
