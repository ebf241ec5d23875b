"""Query tree: And / Or / Not over text terms and typed predicates."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Union


@dataclass(frozen=True)
class Text:
    text: str
    phrase: bool = False
    glob: bool = False


@dataclass(frozen=True)
class Macro:
    name: str


@dataclass(frozen=True)
class Relative:
    amount: int
    unit: str  # h, d, w or y


@dataclass(frozen=True)
class Absolute:
    epoch: int


@dataclass(frozen=True)
class Predicate:
    field: str  # ext, size, created or modified
    op: str  # = != < <= > >=
    value: Union[str, int, Macro, Relative, Absolute]


@dataclass(frozen=True)
class And:
    children: tuple = ()


@dataclass(frozen=True)
class Or:
    children: tuple = ()


@dataclass(frozen=True)
class Not:
    child: object


#: The neutral element of AND: matches every file.
TRUE = And(())
