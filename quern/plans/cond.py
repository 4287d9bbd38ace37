"""Predicate trees: leaves compare a field with a value, inner nodes are AND, OR and NOT."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class Op(Enum):
    EQ = "="
    NEQ = "!="
    GT = ">"
    GTE = ">="
    LT = "<"
    LTE = "<="
    LIKE = "~"
    NOT_LIKE = "!~"
    IN = ":"
    NOT_IN = "!:"
    HAS = "@"
    NOT_HAS = "!@"
    CLOSE_TO = "~="
    EXISTS = "?"
    NOT_EXISTS = "!?"
    IS_NULL = "!?+"
    IS_NOT_NULL = "?+"


#: Operators that take no value.
EXISTENCE = frozenset({Op.EXISTS, Op.NOT_EXISTS, Op.IS_NULL, Op.IS_NOT_NULL})


class Join(Enum):
    AND = "and"
    OR = "or"
    NOT = "not"


class Cond:
    """A node of a predicate tree."""

    def walk(self) -> Iterator[Cond]:
        yield self

    def leaves(self) -> Iterator[Leaf]:
        return (c for c in self.walk() if isinstance(c, Leaf))

    def filter(self, keep: Callable[[Cond], bool]) -> Cond | None:
        return self if keep(self) else None


@dataclass(frozen=True, eq=False)
class Leaf(Cond):
    field: str
    op: Op
    value: Any = None

    def key(self) -> str:
        return json.dumps([self.field, self.op.value, self.value], sort_keys=True, default=str)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Leaf) and self.key() == other.key()

    def __hash__(self) -> int:
        return hash(self.key())


@dataclass(frozen=True)
class Tree(Cond):
    join: Join
    conds: tuple[Cond, ...] = field(default_factory=tuple)

    def walk(self) -> Iterator[Cond]:
        yield self
        for c in self.conds:
            yield from c.walk()

    def filter(self, keep: Callable[[Cond], bool]) -> Cond | None:
        """Prunes leaves that fail `keep`. An AND or OR left with one child becomes that child; a NOT stays a NOT."""
        kids = tuple(x for c in self.conds if (x := c.filter(keep)) is not None)
        if not kids:
            return None
        if len(kids) == 1 and self.join is not Join.NOT:
            return kids[0]
        return Tree(self.join, kids)


def both(*conds: Cond) -> Cond:
    return conds[0] if len(conds) == 1 else Tree(Join.AND, conds)
