"""Extension points: named functions that a corpus can replace."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


class Registry:
    """Functions by name; an override of a name stands before the built-in one."""

    def __init__(self, builtin: dict[str, Callable] | None = None):
        self.builtin, self.own = dict(builtin or {}), {}

    def register(self, name: str, fn: Callable) -> None:
        self.own[name] = fn

    def __getitem__(self, name: str) -> Callable:
        if name not in self.own and name not in self.builtin:
            raise KeyError(f"no function named {name}")
        return self.own.get(name) or self.builtin[name]

    def names(self) -> list[str]:
        return sorted({*self.builtin, *self.own})


def chain(table: DataFrame, filters: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Load or post filters, one after another."""
    for f in filters:
        table = f(table)
    return table
