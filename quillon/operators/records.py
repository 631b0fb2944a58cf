"""What a search takes and gives."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

STAGES = ("bm25", "binary_hamming", "fp16_maxsim", "hybrid")
OPERATORS = ("eq", "ne", "lt", "lte", "gt", "gte", "in", "not_in")
Scalar = str | int | float | bool


@dataclass(frozen=True)
class Clause:
    """field op value; the value of ``in`` and ``not_in`` is a tuple."""

    field: str
    op: str
    value: Scalar | tuple[Scalar, ...]

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unsupported filter operator: {self.op}")


@dataclass(frozen=True)
class Filter:
    """All clauses together; no clauses filter nothing."""

    clauses: tuple[Clause, ...] = ()
    combinator: str = "and"

    def __post_init__(self) -> None:
        if self.combinator != "and":
            raise ValueError(f"unsupported filter combinator: {self.combinator}")

    def is_noop(self) -> bool:
        return not self.clauses


@dataclass(frozen=True)
class Query:
    """One query. Each retriever says which of the fields it needs."""

    alert_id: str | None = None
    text: str | None = None
    fp16: Sequence[Sequence[float]] | None = None
    binary: Sequence[int] | None = None
    filter: Filter | None = None
    filter_expr: str | None = None

    def __post_init__(self) -> None:
        if self.filter_expr is not None:
            raise ValueError("Raw SQL filter strings are not supported; use a Filter.")


@dataclass(frozen=True)
class Candidate:
    alert_id: str
    score: float
    stage: str
    debug: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.stage not in STAGES:
            raise ValueError(f"unknown stage: {self.stage}")
