"""From a pattern to the grams that its candidates must have."""

from __future__ import annotations

from dataclasses import dataclass, field

from siftline.functions.ngrams import covering, fold, gram_hash

from . import regex


@dataclass(frozen=True)
class Branch:
    literal: bytes
    grams: tuple[int, ...]


@dataclass(frozen=True)
class QueryPlan:
    """A candidate has, on each constrained side, all grams of one branch. A side without branches is unconstrained."""

    prefix: tuple[Branch, ...] = ()
    suffix: tuple[Branch, ...] = ()
    java: str = ""
    tree: object = field(default=None, compare=False)

    @property
    def sides(self) -> list[tuple[Branch, ...]]:
        return [s for s in dict.fromkeys((self.prefix, self.suffix)) if s]

    @property
    def unconstrained(self) -> bool:
        return not self.sides

    def gram_count(self) -> int:
        """Over all branches of both sides; a gram that several branches share counts for each."""
        return sum(len(b.grams) for side in (self.prefix, self.suffix) for b in side)


def branches(sequence: regex.Sequence) -> tuple[Branch, ...]:
    """One branch for each literal; none if any literal is too short to have a gram, for then all texts may match."""
    if not sequence:
        return ()
    out = []
    for literal in dict.fromkeys(fold(s) for s, _ in sequence):
        grams = tuple(sorted({gram_hash(g) for g in covering(literal)}))
        if not grams:
            return ()
        out.append(Branch(literal, grams))
    return tuple(out)


def decompose(pattern: str, ignore_case: bool = False) -> QueryPlan:
    """Raises InvalidPattern. Grams are folded in the index and here, with and without ignore_case."""
    tree = regex.parse(pattern, ignore_case)
    return QueryPlan(branches(regex.literals(tree, True)), branches(regex.literals(tree, False)), regex.java(tree), tree)
