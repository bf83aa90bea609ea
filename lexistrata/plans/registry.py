"""Named operators that programs add to, and hooks around their runs.

An operator is a callable (spark, parameters) -> DataFrame; hooks see its name, and its result after it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession

Operator = Callable[[SparkSession, Mapping], DataFrame]
#: Entry points of this group are operators that installed packages bring along.
GROUP = "lexistrata.operators"


@dataclass
class Registry:
    operators: dict[str, Operator] = field(default_factory=dict)
    before: list[Callable[[str, Mapping], None]] = field(default_factory=list)
    after: list[Callable[[str, DataFrame], DataFrame | None]] = field(default_factory=list)

    def operator(self, name: str):
        """Decorator: registers under a name that is not taken yet."""

        def add(f: Operator) -> Operator:
            if name in self.operators:
                raise ValueError(f"operator {name} is registered already")
            self.operators[name] = f
            return f

        return add

    def discover(self, allowed: set[str] | None = None) -> list[str]:
        """Operators of installed packages, of allowed names only where given."""
        found = [e for e in entry_points(group=GROUP) if allowed is None or e.name in allowed]
        for e in found:
            self.operators.setdefault(e.name, e.load())
        return [e.name for e in found]

    def run(self, spark: SparkSession, name: str, **parameters) -> DataFrame:
        """Runs hooks and operator; an after-hook may replace the result."""
        if name not in self.operators:
            raise KeyError(f"unknown operator {name}; known: {', '.join(sorted(self.operators))}")
        for hook in self.before:
            hook(name, parameters)
        out = self.operators[name](spark, parameters)
        for hook in self.after:
            out = hook(name, out) or out
        return out


registry = Registry()
