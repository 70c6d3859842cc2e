"""Aggregates by specification: what a record becomes, how partial aggregates merge, what comes out.

A spec's ``create`` makes an array of structs (key and fields) from a record;
``divide`` does so from a partial aggregate. ``merge`` names aggregate expressions
for the fields, so that Spark combines before the shuffle; ``finish`` derives the
result's columns. Aggregates that no expression covers merge in Python, first
within each task, then by key.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AggSpec:
    """``create`` and ``divide`` give arrays of structs with the key and the fields that ``merge`` reads."""

    merge: dict[str, Callable[[], Column]]
    create: Callable[[], Column] | None = None
    divide: Callable[[], Column] | None = None
    finish: dict[str, Callable[[], Column]] = field(default_factory=dict)
    key: str = "key"

    def created(self, rows: DataFrame) -> DataFrame:
        if self.create is None:
            raise ValueError("the aggregate has no create")
        return rows.select(F.inline(self.create()))

    def divided(self, partials: DataFrame) -> DataFrame:
        if self.divide is None:
            raise ValueError("the aggregate has no divide")
        return partials.select(F.inline(self.divide()))

    def merged(self, partials: DataFrame, combine: bool = True, reducers: int = 0) -> DataFrame:
        """One row for each key; rows without a key are left out.

        Tasks combine their partial aggregates before the shuffle, unless ``combine`` is
        false: keys are then dealt out first, to ``reducers`` partitions (0: Spark's number).
        """
        known = partials.where(F.col(self.key).isNotNull())
        if not combine:
            known = known.repartition(reducers, self.key) if reducers else known.repartition(self.key)
        out = known.groupBy(self.key).agg(*[f().alias(n) for n, f in self.merge.items()])
        return out.repartition(reducers, self.key) if combine and reducers else out

    def finished(self, merged: DataFrame) -> DataFrame:
        return merged.select(self.key, *[f().alias(n) for n, f in self.finish.items()]) if self.finish else merged


@dataclass(frozen=True)
class PythonAgg:
    """An aggregate in Python: ``create`` maps a pandas frame of rows to partials (key and fields), ``merge`` partials of any
    number of keys to one row for each; merge must not depend on the order or grouping of its rows."""

    create: Callable[[pd.DataFrame], pd.DataFrame]
    merge: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str
    key: str = "key"

    def run(self, rows: DataFrame) -> DataFrame:
        def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, size = [], 0
            for part in parts:
                held.append(self.create(part))
                size += len(held[-1])
                if size > 100_000:
                    held = [self.merge(pd.concat(held))]
                    yield held[0]
                    held, size = [], 0
            if held:
                yield self.merge(pd.concat(held))

        return rows.mapInPandas(partial, self.schema).groupBy(self.key).applyInPandas(self.merge, self.schema)


_specs: dict[str, AggSpec | PythonAgg] = {}


def register(name: str, spec: AggSpec | PythonAgg) -> None:
    """Give a spec a name; a name in use must not change its meaning."""
    if _specs.get(name, spec) is not spec:
        raise ValueError(f"{name!r} names another aggregate")
    _specs[name] = spec


def lookup(name: str) -> AggSpec | PythonAgg:
    """A registered spec, or ``module:attribute`` of one to import."""
    if name in _specs:
        return _specs[name]
    if ":" in name:
        module, attribute = name.split(":", 1)
        return getattr(importlib.import_module(module), attribute)
    raise KeyError(f"no aggregate {name!r}; there are {', '.join(sorted(_specs))}")


def registered() -> list[str]:
    return sorted(_specs)
