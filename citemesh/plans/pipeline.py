"""Lazy stage pipelines: named stages pass DataFrames on by name; a flag can end a run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PipelineFlag:
    """Marks a place; a stage's result equal to it cancels the rest."""

    name: str


CANCEL = PipelineFlag("cancel")


@dataclass
class Stage:
    """kwargs are (value, is_stage): where is_stage, the value names an earlier cached stage."""

    name: str
    function: Callable[..., Any]
    kwargs: dict[str, tuple[Any, bool]] = field(default_factory=dict)
    use_preceding: str | None = None
    cache: bool = False
    result: Any = None
    seconds: float | None = None

    def __post_init__(self):
        if not callable(self.function):
            raise ValueError(f"{self.name}: not callable")


class Pipeline:
    """Runs once. Stages build one plan; `cache` persists a stage's rows, `snapshots` writes them."""

    def __init__(self, stages: list[Stage | PipelineFlag], first_kwargs: dict[str, Any] | None = None):
        if not stages or isinstance(stages[0], PipelineFlag):
            raise ValueError("a pipeline starts with a stage")
        names = [s.name for s in stages]
        if len(set(names)) != len(names):
            raise ValueError("stage names repeat")
        self.stages, self.executed, self.cancelled = list(stages), False, False
        known: dict[str, Stage] = {}
        for s in stages:
            if isinstance(s, Stage):
                for k, (v, is_stage) in s.kwargs.items():
                    if is_stage and (v not in known or not known[v].cache):
                        raise ValueError(f"{s.name}.{k}: {v!r} is no earlier cached stage")
                known[s.name] = s
        for k, v in (first_kwargs or {}).items():
            self.stages[0].kwargs[k] = (v, False)

    def run(self, snapshots: str | None = None) -> Any:
        if self.executed:
            raise ValueError("the pipeline has run")
        self.executed = True
        done: dict[str, Stage] = {}
        last = None
        for s in self.stages:
            if isinstance(s, PipelineFlag):
                continue
            kwargs = {k: done[v].result if is_stage else v for k, (v, is_stage) in s.kwargs.items()}
            if s.use_preceding:
                kwargs[s.use_preceding] = last
            began = time.time()
            s.result = s.function(**kwargs)
            if isinstance(s.result, PipelineFlag) and s.result == CANCEL:
                self.cancelled = True
                break
            if isinstance(s.result, DataFrame):
                if s.cache:
                    s.result = s.result.persist()
                if snapshots:
                    s.result.write.mode("overwrite").parquet(f"{snapshots}/{s.name}")
            s.seconds = time.time() - began
            done[s.name] = s
            last = s.result
        return last

    def output(self, name: str) -> Any:
        if not self.executed:
            raise ValueError("the pipeline hasn't run")
        return next(s.result for s in self.stages if s.name == name)

    def report(self) -> list[dict]:
        return [{"stage": s.name, "seconds": s.seconds} for s in self.stages if isinstance(s, Stage) and s.seconds is not None]
