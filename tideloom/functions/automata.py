"""Automata of path expressions, small driver-side objects."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from .regex import Choice, Label, Path, Repeat, Sequence, parse


@dataclass
class Nfa:
    """Moves from a state by a label, or by None without one.  State ``start``; one or more ``final`` states."""

    start: int = 0
    final: set[int] = field(default_factory=set)
    moves: dict[int, dict[str | None, set[int]]] = field(default_factory=dict)

    def add(self, source: int, label: str | None, target: int) -> None:
        self.moves.setdefault(source, {}).setdefault(label, set()).add(target)

    def alphabet(self) -> set[str]:
        return {label for out in self.moves.values() for label in out if label is not None}

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        """The states reached without labels."""
        seen, todo = set(states), list(states)
        while todo:
            for target in self.moves.get(todo.pop(), {}).get(None, ()):
                if target not in seen:
                    seen.add(target)
                    todo.append(target)
        return frozenset(seen)

    def move(self, states: Iterable[int], label: str) -> frozenset[int]:
        return self.closure({t for s in states for t in self.moves.get(s, {}).get(label, ())})

    def accepts(self, word: Iterable[str]) -> bool:
        """Whether the word is in the language; a label outside the alphabet is an error."""
        known, at = self.alphabet(), self.closure({self.start})
        for label in word:
            if label not in known:
                raise ValueError(f"{label!r} is not in the alphabet")
            at = self.move(at, label)
        return bool(at & self.final)


@dataclass
class Dfa:
    """At most one move from a state by a label; state 0 starts."""

    final: set[int] = field(default_factory=set)
    moves: dict[tuple[int, str], int] = field(default_factory=dict)

    def add(self, source: int, label: str, target: int) -> None:
        self.moves[source, label] = target

    def alphabet(self) -> set[str]:
        return {label for _, label in self.moves}

    def states(self) -> set[int]:
        return {0} | self.final | {s for s, _ in self.moves} | set(self.moves.values())

    def accepts(self, word: Iterable[str]) -> bool:
        known, at = self.alphabet(), 0
        for label in word:
            if label not in known:
                raise ValueError(f"{label!r} is not in the alphabet")
            if at is not None:
                at = self.moves.get((at, label))
        return at in self.final

    def rows(self) -> list[tuple[int, str, int]]:
        """(state, label, next state), in order."""
        return sorted((s, label, t) for (s, label), t in self.moves.items())


def nfa_of(path: Path) -> Nfa:
    """Thompson's construction: each part between a fresh entry and exit state."""
    out, count = Nfa(), 0

    def fresh() -> int:
        nonlocal count
        count += 1
        return count - 1

    def between(entry: int, part: Path, leave: int) -> None:
        if isinstance(part, Label):
            out.add(entry, part.name, leave)
        elif isinstance(part, Choice):
            between(entry, part.left, leave)
            between(entry, part.right, leave)
        elif isinstance(part, Sequence):
            middle = fresh()
            between(entry, part.left, middle)
            between(middle, part.right, leave)
        elif isinstance(part, Repeat):
            first, last = fresh(), fresh()
            out.add(entry, None, first)
            between(first, part.body, last)
            out.add(last, None, first)
            out.add(last, None, leave)
            if not part.least:
                out.add(first, None, leave)

    start, end = fresh(), fresh()
    # a choice of repeats may not share entry and exit with its other branch: they only leave through fresh states
    between(start, path, end)
    out.start, out.final = start, {end}
    return out


def determinize(nfa: Nfa) -> Dfa:
    """Subset construction."""
    first = nfa.closure({nfa.start})
    number, todo, out = {first: 0}, [first], Dfa()
    while todo:
        states = todo.pop()
        if states & nfa.final:
            out.final.add(number[states])
        for label in sorted(nfa.alphabet()):
            target = nfa.move(states, label)
            if target:
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                out.add(number[states], label, number[target])
    return out


def minimize(dfa: Dfa) -> Dfa:
    """Partition refinement; a missing move tells states apart.  State 0 stays the start, dead ends go."""
    useful, todo = set(dfa.final), list(dfa.final)
    while todo:
        state = todo.pop()
        for (source, _), target in dfa.moves.items():
            if target == state and source not in useful:
                useful.add(source)
                todo.append(source)
    states = sorted((dfa.states() & useful) | {0})
    moves = {k: t for k, t in dfa.moves.items() if t in useful and k[0] in states}
    block = {s: int(s in dfa.final) for s in states}
    alphabet = sorted(dfa.alphabet())
    while True:
        marks = {s: (block[s], *(block.get(moves.get((s, a)), -1) for a in alphabet)) for s in states}
        order: dict[tuple, int] = {}
        for s in states:  # state 0 is first, so its block is 0
            order.setdefault(marks[s], len(order))
        refined = {s: order[marks[s]] for s in states}
        if len(order) == len(set(block.values())):
            return Dfa({refined[s] for s in states if s in dfa.final}, {(refined[s], a): refined[t] for (s, a), t in moves.items()})
        block = refined


def compile_path(text: str) -> Dfa:
    """The minimal automaton of a path expression."""
    return minimize(determinize(nfa_of(parse(text))))
