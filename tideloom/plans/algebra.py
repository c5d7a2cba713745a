"""Logical plans: what to compute, for any of the ways to evaluate it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Scan:
    """The edges with a label."""

    label: str


@dataclass(frozen=True)
class Union:
    left: Plan
    right: Plan


@dataclass(frozen=True)
class NotLoop:
    """Rows whose endpoints differ."""

    body: Plan


@dataclass(frozen=True)
class Join:
    """Rows that agree in the endpoints ``key``, with the endpoints ``output`` (see ``operators.join``)."""

    left: Plan
    right: Plan
    key: str = "TS"
    output: str = "ST"


@dataclass(frozen=True)
class PairJoin:
    """Rows of the left whose pair, or with ``reverse`` the exchanged pair, is on the right."""

    left: Plan
    right: Plan
    reverse: bool = False
    swap: bool = False


@dataclass(frozen=True)
class Path:
    """A path expression whose labels stand for plans; those without one are labels of edges.  A name with a plan
    begins with two underscores, so that it can't be a label that a user gives."""

    expression: str
    inputs: tuple[tuple[str, Plan], ...] = ()


Plan = Scan | Union | NotLoop | Join | PairJoin | Path


def children(plan: Plan) -> list[Plan]:
    if isinstance(plan, Scan):
        return []
    if isinstance(plan, NotLoop):
        return [plan.body]
    if isinstance(plan, Path):
        return [p for _, p in plan.inputs]
    return [plan.left, plan.right]


def shared(plan: Plan) -> set[Plan]:
    """Parts with work of their own that stand in more than one place."""
    seen: set[Plan] = set()
    twice: set[Plan] = set()

    def walk(p: Plan) -> None:
        if p in seen:
            if not isinstance(p, Scan):
                twice.add(p)
            return
        seen.add(p)
        for c in children(p):
            walk(c)

    walk(plan)
    return twice


def alike(plan: Plan) -> tuple[Plan, str, str, bool] | None:
    """For a closure of pairs that have something in common: the plan of which they are, the endpoint that is paired, the
    one they have in common, and whether pairs of the same are in; None for other plans."""
    if not isinstance(plan, Path) or len(plan.inputs) != 1:
        return None
    name, body = plan.inputs[0]
    if plan.expression not in (f"{name}+", f"{name}*"):
        return None
    loops = True
    while isinstance(body, NotLoop):
        loops, body = False, body.body
    if not isinstance(body, Join) or body.left != body.right:
        return None
    ends = {("TT", "SS"): ("src", "trg"), ("SS", "TT"): ("trg", "src")}.get((body.key, body.output))
    return ends and (body.left, *ends, loops)
