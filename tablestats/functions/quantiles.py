"""A mergeable digest of quantiles with a proven error, for ``udaf_tree``.

Values lie in buffers of ``SIZE`` sorted values; one of a buffer at level l stands for 2^l
values. Two buffers of a level merge into one of the next, which keeps every other
value; that moves any rank by at most 2^l, and the digest adds these up as its error. So a
digest of n values holds about SIZE * log2(n / SIZE) of them, and its ranks are off by at
most n * log2(n / SIZE) / (2 * SIZE), whatever the order they came in or were merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

SIZE = 2048


class QuantileDigest:
    """A user aggregate (``udf.Aggregate``) over one column: rows (q, value, n, error) for the quantiles asked for.

    ``value`` is one whose rank is within ``error`` of q * n. NaN and NULL are skipped.
    """

    def __init__(self, column: str, quantiles: list[float], size: int = SIZE):
        if size < 2:
            raise ValueError("a buffer holds at least two values")
        self.column, self.quantiles, self.size = column, list(quantiles), size

    def init(self) -> dict:
        return {"n": 0, "error": 0, "rest": np.zeros(0), "levels": {}}

    def _add(self, state: dict, level: int, buffer: np.ndarray) -> None:
        """A full, sorted buffer; those of its level that there are already are merged with it."""
        while level in state["levels"]:
            both = np.sort(np.concatenate([state["levels"].pop(level), buffer]))
            # Every other value; of neighbouring merges one starts at the first, one at the second.
            buffer = both[(state["error"] >> level) & 1::2]
            state["error"] += 1 << level
            level += 1
        state["levels"][level] = buffer

    def _take(self, state: dict, values: np.ndarray) -> dict:
        rest = np.concatenate([state["rest"], values])
        whole = len(rest) // self.size * self.size
        for k in range(0, whole, self.size):
            self._add(state, 0, np.sort(rest[k:k + self.size]))
        state["rest"] = rest[whole:]
        return state

    def update(self, state: dict, rows: pd.DataFrame) -> dict:
        values = rows[self.column].to_numpy(np.float64)
        values = values[~np.isnan(values)]
        state["n"] += len(values)
        return self._take(state, values)

    def merge(self, a: dict, b: dict) -> dict:
        a["n"] += b["n"]
        a["error"] += b["error"]
        for level, buffer in b["levels"].items():
            self._add(a, level, buffer)
        return self._take(a, b["rest"])

    def finish(self, state: dict) -> pd.DataFrame:
        values = np.concatenate([state["rest"], *state["levels"].values()])
        weights = np.concatenate([np.ones(len(state["rest"]), np.int64), *[np.full(len(v), 1 << level) for level, v in state["levels"].items()]])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = [min(int(np.searchsorted(ranks, q * state["n"])), len(values) - 1) for q in self.quantiles]
        found = [values[order][i] if len(values) else None for i in at]
        # The heaviest value itself spans its weight.
        error = state["error"] + (1 << max(state["levels"], default=0)) if state["n"] else 0
        return pd.DataFrame({"q": self.quantiles, "value": found, "n": state["n"], "error": error})
