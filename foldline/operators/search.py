"""Parameter search by successive halving: many settings on a small budget, the better ones on larger budgets."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from foldline.operators.models import sample_params


def successive_halving(
    spark: SparkSession, score: Callable[[dict, int], float], space: Mapping[str, tuple], n: int, budgets: Sequence[int], direction: str = "minimize",
    keep: float = 0.5, parallelism: int = 4, seed: int = 42,
) -> tuple[list[dict], dict]:
    """Score ``n`` sampled settings on ``budgets[0]``, the better ``keep`` of them (one at least) on ``budgets[1]``, and so on.

    ``score(params, budget)`` runs Spark jobs on a table that the caller wrote once; up to ``parallelism`` of them run
    side by side. The outcome does not depend on it: the settings are drawn beforehand, a rung ends before the next begins, ties
    go to the earlier setting. A setting whose score is null or not finite comes last; one that raises ends the search.
    Returns every trial (trial, params, rung, budget, score, kept) and the best of the last rung.
    """
    if direction not in ("minimize", "maximize"):
        raise ValueError(f"unknown direction {direction}")
    if n < 1 or not budgets or not 0 < keep <= 1:
        raise ValueError("one setting and one budget at least, and a kept share in (0, 1]")
    sign = 1.0 if direction == "minimize" else -1.0
    live, trials = list(enumerate(sample_params(space, n, seed))), []

    def cost(value) -> float:
        return sign * value if value is not None and math.isfinite(value) else math.inf

    with ThreadPool(max(1, parallelism)) as pool:
        for rung, budget in enumerate(budgets):
            run = inheritable_thread_target(spark)(lambda item, b=budget: score(item[1], b))
            values = pool.map(run, live, chunksize=1)
            order = sorted(range(len(live)), key=lambda i: (cost(values[i]), live[i][0]))
            stay = set(order[: max(1, math.ceil(len(live) * keep))] if rung + 1 < len(budgets) else order[:1])
            trials += [
                {"trial": t, "params": json.dumps(p, sort_keys=True), "rung": rung, "budget": int(budget), "score": None if values[i] is None else float(values[i]), "kept": i in stay}
                for i, (t, p) in enumerate(live)
            ]
            best, live = live[order[0]], [live[i] for i in sorted(stay)]
    return trials, {"trial": best[0], **best[1]}
