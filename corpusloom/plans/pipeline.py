"""Stage graph: named stages with inputs, a function and expectations; one lazy plan from sources to sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Stage:
    """A stage: its inputs (stages or sources), its function of their frames, and what must hold of every row."""

    name: str
    inputs: list[str]
    fn: Callable[..., DataFrame]
    expect: dict[str, Column] = field(default_factory=dict)


def build(stages: list[Stage], sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Frames of all stages. An expectation that fails on a row stops the query that reads it."""
    by = {s.name: s for s in stages}
    frames = dict(sources)
    for name in TopologicalSorter({s.name: s.inputs for s in stages}).static_order():
        if name in frames:
            continue
        if name not in by:
            raise KeyError(f"stage or source {name} is missing")
        s = by[name]
        df = s.fn(*[frames[i] for i in s.inputs])
        for what, ok in s.expect.items():
            df = df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"{name}: {what}")).cast("boolean")))
        frames[name] = df
    return frames
