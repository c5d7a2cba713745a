"""Logical plans as ANSI SQL with recursive set unions, for another engine to check results against."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.automata import compile_path
from ..operators.join import SELECTORS
from .algebra import Join, NotLoop, PairJoin, Path, Plan, Scan, Union
from .evaluate import Mode


@dataclass
class SqlText:
    """Builds one statement over ``edges``: a query for the canonical edges, with the mode's columns and ``label``."""

    edges: str
    mode: Mode
    parts: list[str] = field(default_factory=list)
    names: dict[Plan, str] = field(default_factory=dict)

    def add(self, body: str) -> str:
        name = f"t{len(self.parts)}"
        self.parts.append(f"{name} AS ({body})")
        return name

    def canonical(self, body: str, keys: str = "src, trg") -> str:
        by = "".join(f"{c}, " for c in self.mode.by)
        if not self.mode.timed:
            return self.add(f"SELECT DISTINCT {by}{keys} FROM ({body})")
        frame = f"OVER (PARTITION BY {by}{keys} ORDER BY vs, ve ROWS BETWEEN UNBOUNDED PRECEDING AND"
        return self.add(
            f"SELECT {by}{keys}, min(vs) AS vs, max(ve) AS ve FROM (SELECT *, sum(CASE WHEN pm IS NULL OR vs > pm THEN 1 ELSE 0 END) {frame} CURRENT ROW) AS gid "
            f"FROM (SELECT *, max(ve) {frame} 1 PRECEDING) AS pm FROM ({body}) WHERE vs < ve)) GROUP BY {by}{keys}, gid"
        )

    def joined(self, a: str, b: str, on: list[str], src: str, trg: str) -> str:
        on = [*on, *(f"l.{c} = r.{c}" for c in self.mode.by)]
        out = [*(f"l.{c}" for c in self.mode.by), f"{src} AS src", f"{trg} AS trg"]
        if self.mode.timed:
            on.append("greatest(l.vs, r.vs) < least(l.ve, r.ve)")
            out += ["greatest(l.vs, r.vs) AS vs", "least(l.ve, r.ve) AS ve"]
        return self.canonical(f"SELECT {', '.join(out)} FROM {a} l JOIN {b} r ON {' AND '.join(on)}")

    def of(self, p: Plan) -> str:
        if p not in self.names:
            self.names[p] = self.one(p)
        return self.names[p]

    def one(self, p: Plan) -> str:
        columns = ", ".join(self.mode.columns)
        if isinstance(p, Scan):
            return self.add(f"SELECT {columns} FROM e WHERE label = '{p.label}'")
        if isinstance(p, Union):
            return self.canonical(f"SELECT {columns} FROM {self.of(p.left)} UNION ALL SELECT {columns} FROM {self.of(p.right)}")
        if isinstance(p, NotLoop):
            return self.add(f"SELECT {columns} FROM {self.of(p.body)} WHERE src <> trg")
        if isinstance(p, Join):
            (a, b), (x, y) = SELECTORS[p.key], SELECTORS[p.output]
            return self.joined(self.of(p.left), self.of(p.right), [f"l.{a} = r.{b}"], f"l.{x}", f"r.{y}")
        if isinstance(p, PairJoin):
            a, b = ("trg", "src") if p.reverse else ("src", "trg")
            x, y = ("trg", "src") if p.swap else ("src", "trg")
            return self.joined(self.of(p.left), self.of(p.right), [f"l.src = r.{a}", f"l.trg = r.{b}"], f"l.{x}", f"l.{y}")
        dfa = compile_path(p.expression)
        given = dict(p.inputs)
        plain = sorted(dfa.alphabet() - set(given))
        streams = [f"SELECT {columns}, label FROM e WHERE label IN ({', '.join(repr(x) for x in plain)})"] if plain else []
        streams += [f"SELECT {columns}, '{name}' AS label FROM {self.of(q)}" for name, q in p.inputs]
        x = self.add(" UNION ALL ".join(streams))
        moves = ", ".join(f"({s}, '{label}', {t})" for s, label, t in dfa.rows())
        m = self.add(f"SELECT * FROM (VALUES {moves}) AS v(s, label, t)")
        by = "".join(f"{c}, " for c in self.mode.by)
        pby = "".join(f"p.{c}, " for c in self.mode.by)
        same = "".join(f" AND x.{c} = p.{c}" for c in self.mode.by)
        first, more, overlap = (", vs, ve", ", greatest(p.vs, x.vs), least(p.ve, x.ve)", " WHERE greatest(p.vs, x.vs) < least(p.ve, x.ve)") if self.mode.timed else ("", "", "")
        name = f"t{len(self.parts)}"
        self.parts.append(
            f"{name}({by}root, v, st{first}) AS (SELECT {by}src, trg, t{first} FROM {x} x JOIN {m} m ON m.s = 0 AND m.label = x.label UNION "
            f"SELECT {pby}p.root, x.trg, m.t{more} FROM {name} p JOIN {x} x ON x.src = p.v{same} JOIN {m} m ON m.s = p.st AND m.label = x.label{overlap})"
        )
        interval = ", vs, ve" if self.mode.timed else ""
        return self.canonical(f"SELECT {by}root AS src, v AS trg{interval} FROM {name} WHERE st IN ({', '.join(map(str, sorted(dfa.final)))})")

    def statement(self, plan: Plan) -> str:
        result = self.of(plan)
        e = f"raw_edges AS ({self.edges})"
        held, self.parts = self.parts, []
        name = self.canonical("SELECT * FROM raw_edges", "src, label, trg")
        edges = self.parts.pop().removeprefix(f"{name} AS ")
        self.parts = held
        return f"WITH RECURSIVE {e}, e AS {edges}, {', '.join(held)} SELECT {', '.join(self.mode.columns)} FROM {result}"
