"""The named queries, as logical plans over up to three labels."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.regex import parse
from .algebra import Join, NotLoop, PairJoin, Path, Plan, Scan


def _closure(plan: Plan) -> Path:
    return Path("__r+", (("__r", plan),))


def join(a: str, b: str) -> Plan:
    """a/b."""
    return Join(Scan(a), Scan(b))


def query1(a: str) -> Plan:
    return Path(f"{a}+")


def query2(a: str, b: str) -> Plan:
    return Path(f"{a}/{b}+")


def query2_joined(a: str, b: str) -> Plan:
    """query2 by a closure and a join."""
    return Join(Scan(a), Path(f"{b}+"))


def query2a(a: str, b: str) -> Plan:
    return Path(f"{a}/{b}*")


def query3(a: str, b: str, c: str) -> Plan:
    return Path(f"{a}/{b}+/{c}+")


def query3_joined(a: str, b: str, c: str) -> Plan:
    """query3 by two closures and two joins."""
    return Join(Join(Scan(a), Path(f"{b}+")), Path(f"{c}+"))


def query3a(a: str, b: str, c: str) -> Plan:
    return Path(f"{a}/{b}*/{c}*")


def query4(a: str, b: str, c: str) -> Plan:
    """(a/b/c)+, by two joins and a closure."""
    return _closure(Join(Join(Scan(a), Scan(b)), Scan(c)))


def query4a(a: str, b: str, c: str) -> Plan:
    """query4 as one path expression."""
    return Path(f"({a}/{b}/{c})+")


def query4_pc1(a: str, b: str, c: str) -> Plan:
    """query4 with a/b made first."""
    return Path(f"(__p/{c})+", (("__p", Join(Scan(a), Scan(b))),))


def query4_pc2(a: str, b: str, c: str) -> Plan:
    """query4 with b/c made first."""
    return Path(f"({a}/__p)+", (("__p", Join(Scan(b), Scan(c))),))


def query5(knows: str, creator: str, reply: str) -> Plan:
    """(m1, m2): m1's creator knows m2's, and m2 replies to m1."""
    befriended = Join(Join(Scan(creator), Scan(knows)), Scan(creator), "TT", "SS")
    return PairJoin(befriended, Scan(reply), reverse=True)


def _recent(likes: str, creator: str, knows: Plan) -> Plan:
    return PairJoin(Join(Scan(likes), Scan(creator)), knows)


def query6(knows: str, likes: str, creator: str) -> Plan:
    """(x, y): x likes a message of y, and is linked to y by knows+."""
    return _recent(likes, creator, Path(f"{knows}+"))


def query6_cq(knows: str, likes: str, creator: str) -> Plan:
    """query6 with knows for knows+."""
    return _recent(likes, creator, Scan(knows))


def query7(knows: str, likes: str, creator: str) -> Plan:
    """(x, m): m is created by someone whom x reaches through pairs of query6."""
    return Join(_closure(query6(knows, likes, creator)), Scan(creator), "TT", "SS")


def query7_cq(knows: str, likes: str, creator: str) -> Plan:
    return Join(_closure(query6_cq(knows, likes, creator)), Scan(creator), "TT", "SS")


def query8(likes: str) -> Plan:
    """The closure of: x and y, not the same, like the same thing."""
    return _closure(NotLoop(Join(Scan(likes), Scan(likes), "TT", "SS")))


#: Fixed names by which runs ask for queries, with their number of labels.
NAMED: dict[str, tuple[int, Callable[..., Plan]]] = {
    "join": (2, join),
    "query1": (1, query1),
    "query2": (2, query2),
    "query2-a": (2, query2a),
    "query3": (3, query3),
    "query3-a": (3, query3a),
    "query4": (3, query4),
    "query4-a": (3, query4a),
    "query4-pc1": (3, query4_pc1),
    "query4-pc2": (3, query4_pc2),
    "query5": (3, query5),
    "query6": (3, query6),
    "query6-cq": (3, query6_cq),
    "query7": (3, query7),
    "query7-cq": (3, query7_cq),
    "query8": (1, query8),
}


def named(name: str, labels: list[str]) -> Plan:
    """The plan of a named query over ``labels``, of which there may be duplicates."""
    if name not in NAMED:
        raise ValueError(f"no query {name!r}; there are {', '.join(NAMED)}")
    number, make = NAMED[name]
    if len(labels) != number:
        raise ValueError(f"{name} takes {number} labels, not {len(labels)}")
    for label in labels:
        if "__" in label[:2]:
            raise ValueError(f"{label!r}: labels don't begin with two underscores")
        parse(label)  # labels stand in path expressions
    return make(*labels)
