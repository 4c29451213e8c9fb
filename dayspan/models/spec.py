"""What a model contains: outcome, predictors, interaction, and its design columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class ModelSpec:
    """Outcome and predictors; ``interaction`` multiplies every predictor with one more variable."""

    outcome: str
    predictors: tuple[str, ...] = ()
    interaction: str | None = None

    def __post_init__(self):
        if isinstance(self.predictors, str):
            object.__setattr__(self, "predictors", (self.predictors,))
        named = dict.fromkeys("1" if p == "" else p for p in self.predictors)
        object.__setattr__(self, "predictors", tuple(named) or ("1",))

    @classmethod
    def with_interaction(cls, outcome: str, predictors: Sequence[str], variable: str | None) -> ModelSpec:
        if not variable:
            raise ValueError("an interaction needs the name of a variable")
        return cls(outcome, tuple(predictors), variable)

    @property
    def formula(self) -> str:
        parts = [f"{p}*{self.interaction}" if self.interaction else p for p in self.predictors]
        return f"{self.outcome} ~ {' + '.join(parts)}"

    @property
    def predictor_text(self) -> str:
        named = [p for p in self.predictors if p != "1"]
        return ", ".join([*named, *([self.interaction] if self.interaction else [])])

    @property
    def interaction_text(self) -> str:
        if not self.interaction:
            return "N/A"
        return ", ".join(f"{p}*{self.interaction}" for p in self.predictors)

    @property
    def main_effects(self) -> list[str]:
        names: dict[str, None] = {}
        for p in self.predictors:
            if p != "1":
                names[p] = None
            if self.interaction:
                names[self.interaction] = None
        return list(names)

    @property
    def terms(self) -> list[tuple[str, ...]]:
        """Main effects, then products in the order in which their variables first appear."""
        mains = self.main_effects
        products = []
        if self.interaction:
            for p in self.predictors:
                if p not in ("1", self.interaction):
                    products.append(tuple(sorted((p, self.interaction), key=mains.index)))
        return [(m,) for m in mains] + products


@dataclass(frozen=True)
class DesignColumn:
    """One coefficient: its term and, for a factor, its level."""

    name: str
    term: tuple[str, ...]
    level: str | None
    value: Column


def design(spec: ModelSpec, levels: Mapping[str, Sequence[str]]) -> list[DesignColumn]:
    """Intercept, then treatment-coded columns; the first level of a factor is the reference."""
    columns = [DesignColumn(INTERCEPT, (), None, F.lit(1.0))]
    single: dict[str, list[DesignColumn]] = {}
    for name in spec.main_effects:
        if name in levels:
            single[name] = [
                DesignColumn(
                    f"{name}{level}", (name,), level,
                    F.when(F.col(name).isin(*levels[name]), (F.col(name) == level).cast("double")),
                )
                for level in list(levels[name])[1:]
            ]
        else:
            single[name] = [DesignColumn(name, (name,), None, F.col(name).cast("double"))]
    for term in spec.terms:
        if len(term) == 1:
            columns += single[term[0]]
            continue
        for a in single[term[0]]:
            for b in single[term[1]]:
                columns.append(DesignColumn(f"{a.name}:{b.name}", term, None, a.value * b.value))
    return columns
