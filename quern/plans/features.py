"""Features as declared vectors: constants, categories, lookups, functions, and composites that explain themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import times
from ..operators.vectors import encoded


@dataclass
class Feature:
    """A named vector of a known width. column() gives it as array<double>; to_dict() its declaration."""

    name: str
    width: int = 1

    def column(self) -> Column:
        raise NotImplementedError

    def checked(self) -> Column:
        c = self.column()
        bad = F.raise_error(F.concat(F.lit(f"feature {self.name} has "), F.size(c).cast("string"), F.lit(f" components, not {self.width}")))
        return F.when(F.size(c) == self.width, c).otherwise(bad.cast("array<double>"))

    def to_dict(self) -> dict[str, Any]:
        return {"kind": type(self).__name__, **{k: v for k, v in self.__dict__.items() if not callable(v)}}


@dataclass
class Constant(Feature):
    values: tuple[float, ...] = (0.0,)

    def __post_init__(self) -> None:
        self.width = len(self.values)

    def column(self) -> Column:
        return F.array(*[F.lit(float(v)) for v in self.values])


@dataclass
class Category(Feature):
    col: str = ""
    values: tuple[str, ...] = ()
    how: str = "onehot"

    def __post_init__(self) -> None:
        self.width = {"onehot": len(self.values), "binary": max(1, (len(self.values) - 1).bit_length())}.get(self.how, 1)

    def column(self) -> Column:
        return encoded(F.col(self.col).cast("string"), list(self.values), self.how)


@dataclass
class Lookup(Feature):
    """A vector by key from a map column."""

    col: str = ""
    key: str = ""

    def column(self) -> Column:
        return F.coalesce(F.try_element_at(F.col(self.col), F.col(self.key)), F.array_repeat(F.lit(0.0), self.width))


@dataclass
class Moment(Feature):
    """Day of the week and hour of an instant."""

    col: str = ""

    def __post_init__(self) -> None:
        self.width = 2

    def column(self) -> Column:
        return times.context(F.col(self.col))


@dataclass
class Recency(Feature):
    """Time between two instants, or its logarithm."""

    a: str = ""
    b: str = ""
    log: bool = False

    def column(self) -> Column:
        return F.array(times.recency(F.col(self.a), F.col(self.b), self.log))


@dataclass
class Function(Feature):
    """Any expression; declared by name only."""

    make: Callable[[], Column] = field(default=lambda: F.array(F.lit(0.0)))

    def column(self) -> Column:
        return self.make()


@dataclass
class Composite(Feature):
    parts: list[Feature] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.width = sum(p.width for p in self.parts)

    def column(self) -> Column:
        return F.concat(*[p.checked() for p in self.parts])

    def explain(self, v: Column) -> Column:
        """A map from the name of each part to its components."""
        pairs, at = [], 1
        for p in self.parts:
            pairs += [F.lit(p.name), F.slice(v, at, p.width)]
            at += p.width
        return F.create_map(*pairs)

    def to_dict(self) -> dict[str, Any]:
        return {"kind": "Composite", "name": self.name, "parts": [p.to_dict() for p in self.parts]}


KINDS = {c.__name__: c for c in (Constant, Category, Lookup, Moment, Recency)}


def from_dict(d: dict[str, Any]) -> Feature:
    """The feature that to_dict() declared; functions cannot come back."""
    if d["kind"] == "Composite":
        return Composite(d["name"], parts=[from_dict(p) for p in d["parts"]])
    if d["kind"] not in KINDS:
        raise ValueError(f"{d['kind']} cannot be rebuilt from its declaration")
    own = {k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k != "kind"}
    return KINDS[d["kind"]](**own)


def pair_scores(left: list[str], right: list[str], score: Callable[[Column, Column], Column], default: float = 0.0) -> Column:
    """The highest score over all pairs of two lists of columns."""
    pairs = [score(F.col(a), F.col(b)) for a in left for b in right]
    if not pairs:
        return F.lit(default)
    return F.coalesce(F.greatest(*pairs) if len(pairs) > 1 else pairs[0], F.lit(default))
