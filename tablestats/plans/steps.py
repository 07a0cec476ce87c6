"""a program as ordered, named steps over DataFrames.

Each step takes earlier results (or sources) by name and returns one
DataFrame. Building a step only extends the lazy plan; nothing runs until a
result is used. A result consumed by more than one later step is persisted
(memory and disk), so it is computed once; a lost executor's blocks are
recomputed from the plan. ``release`` frees them when the results are done with. DataFrames are immutable, which gives the copy
semantics of the source programs for free.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class NamedSteps:
    def __init__(self) -> None:
        self._held: list[DataFrame] = []
        self._steps: list[tuple[str, Callable[..., DataFrame], tuple[str, ...], bool]] = []

    def add(self, name: str, fn: Callable[..., DataFrame], *inputs: str, persist: bool | None = None) -> "NamedSteps":
        if any(name == s[0] for s in self._steps):
            raise ValueError(f"step {name} defined twice")
        self._steps.append((name, fn, inputs, persist))
        return self

    def run(self, **sources: DataFrame) -> dict[str, DataFrame]:
        uses = Counter(i for _, _, inputs, _ in self._steps for i in inputs)
        env: dict[str, DataFrame] = dict(sources)
        for name, fn, inputs, persist in self._steps:
            missing = [i for i in inputs if i not in env]
            if missing:
                raise KeyError(f"step {name} needs {missing}, not defined before it")
            out = fn(*[env[i] for i in inputs])
            if persist or (persist is None and uses[name] > 1):
                out = out.persist(StorageLevel.MEMORY_AND_DISK)
                self._held.append(out)
            env[name] = out
        return env

    def release(self) -> None:
        """Drop what ``run`` has persisted."""
        while self._held:
            self._held.pop().unpersist()
