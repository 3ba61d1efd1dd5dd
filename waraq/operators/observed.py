"""Counts and elapsed time of a search as it runs, without a second job."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Measured:
    """What came of a run: the action's own result, elapsed milliseconds to a tenth, and the counts that were observed."""

    result: object
    elapsed_ms: float
    counts: dict[str, int]


def measure(df: DataFrame, action: Callable[[DataFrame], object], clock: Callable[[], float] = time.perf_counter, **counts: Column) -> Measured:
    """Run ``action`` (a collect or a write) on ``df`` and tell how long it took and ``counts``, aggregates of ``df`` that
    are taken while its rows go by. Without any, the number of rows.
    """
    seen = Observation()
    wanted = counts or {"rows": F.count(F.lit(1))}
    watched = df.observe(seen, *[c.alias(name) for name, c in wanted.items()])
    began = clock()
    result = action(watched)
    elapsed = round((clock() - began) * 1000, 1)
    return Measured(result, elapsed, dict(seen.get))


def answer_search(answers: DataFrame, action: Callable[[DataFrame], object] = DataFrame.collect) -> Measured:
    """Answers (query_id, answer) of a search with the time they took, and how many there are, with and without results."""
    total = F.get_json_object("answer", "$.total").cast("long")
    return measure(answers, action, queries=F.count(F.lit(1)), answered=F.count_if(total > 0), results=F.coalesce(F.sum(total), F.lit(0)))
