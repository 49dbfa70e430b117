"""Demand-driven assembly of wide reports: only the joins that the wanted columns need.

A wide view joins many blocks to a base. A reader of a few of its columns would still pay for all of them: the engine
prunes columns, but it cannot drop a left join, because it does not know that the joined side has at most one row a key. Here
every step states what it needs, what it gives and whether it may change the number of rows. Walking back from the wanted columns,
a step is dropped if nothing it gives is needed and it cannot change the rows; a block that may repeat rows stays with its keys alone, so
the result keeps every repetition of the whole view.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Block:
    """A join on equal names. ``build`` gets the names that are needed of ``gives`` and may leave out what only others need.

    ``many``: several rows may match a key. ``inner``: rows without a match go. Both keep the block whatever is wanted.
    """

    on: Sequence[str]
    gives: Sequence[str]
    build: Callable[[set[str]], DataFrame]
    many: bool = False
    inner: bool = False

    @property
    def needs(self) -> Sequence[str]:
        return self.on

    @property
    def keep(self) -> bool:
        return self.many or self.inner

    def apply(self, df: DataFrame, used: set[str]) -> DataFrame:
        side = self.build(used).select(*self.on, *[c for c in self.gives if c in used])
        return df.join(side, list(self.on), "inner" if self.inner else "left")


@dataclass(frozen=True)
class Derive:
    """A column computed from others."""

    name: str
    needs: Sequence[str]
    value: Column
    keep = False

    @property
    def gives(self) -> Sequence[str]:
        return (self.name,)


@dataclass(frozen=True)
class Expand:
    """A row for each element of an array, or one with NULL where it has none; it may change the rows, so it always stays."""

    name: str
    needs: Sequence[str]
    values: Column
    keep = True

    @property
    def gives(self) -> Sequence[str]:
        return (self.name,)

    def apply(self, df: DataFrame, used: set[str]) -> DataFrame:
        return df.withColumn(self.name, F.explode_outer(self.values))


@dataclass(frozen=True)
class Only:
    """Rows that meet a condition."""

    needs: Sequence[str]
    condition: Column
    gives = ()
    keep = True

    def apply(self, df: DataFrame, used: set[str]) -> DataFrame:
        return df.where(self.condition)


Step = Block | Derive | Expand | Only


def needed_steps(steps: Sequence[Step], wanted: Sequence[str]) -> tuple[list[tuple[Step, set[str]]], set[str]]:
    """(steps that stay, each with the columns needed of it; columns needed of the base)."""
    need, kept = set(wanted), []
    for step in reversed(steps):
        used = need & set(step.gives)
        if used or step.keep:
            need = (need - set(step.gives)) | set(step.needs)
            kept.append((step, used))
    return kept[::-1], need


def assemble(base: DataFrame, steps: Sequence[Step], wanted: Sequence[str]) -> DataFrame:
    """``wanted`` columns of ``base`` after ``steps``, in that order. A step's columns must be new names."""
    kept, need = needed_steps(steps, wanted)
    if missing := need - set(base.columns):
        raise ValueError(f"no step gives {sorted(missing)}")
    df = base.select(*[c for c in base.columns if c in need])
    waiting: dict[str, Column] = {}
    for step, used in kept:
        if waiting and not (isinstance(step, Derive) and not waiting.keys() & set(step.needs)):
            df, waiting = df.withColumns(waiting), {}
        if isinstance(step, Derive):
            waiting[step.name] = step.value
        else:
            df = step.apply(df, used)
    return (df.withColumns(waiting) if waiting else df).select(*wanted)
