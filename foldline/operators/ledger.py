"""Append-only experiment ledgers: scores, budgets, decisions, ideas and experiment trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldline.operators.kernels import Policy, decide_one
from foldline.operators.series import CHUNK_ROWS, POS, bounded_frames, lay_out, ordered_positions, running, tidy
from foldline.session import cut_lineage


def assign_ids(df: DataFrame, prefix: str, order: Sequence[str], width: int = 3, out: str = "seq_id") -> DataFrame:
    """Positions from 0 and zero-padded ids from 1 in order."""
    placed = ordered_positions(df, order)
    number = (F.col("pos") + 1).cast("string")
    return placed.withColumn(out, F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.length(number), F.lit(width)), F.lit("0"))))


def signed(score: Column, direction: str) -> Column:
    """Score in which larger is always better."""
    return score if direction == "maximize" else -score


def best_score(ledger: DataFrame, score: str, direction: str, by: Sequence[str] = ()) -> DataFrame:
    agg = (F.max if direction == "maximize" else F.min)(score).alias("best")
    return ledger.groupBy(*by).agg(agg) if by else ledger.agg(agg)


def running_best(
    ledger: DataFrame, score: str, direction: str, order: Sequence[str], part: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Best score so far, whether the row improved it, and scored rows since the last improvement."""
    s = signed(F.col(score), direction)
    ledger, lay, own = lay_out(ledger, order, part, chunk_rows)
    df = running(ledger, {"__prior": ("max", s)}, order, part, exclusive=True, chunk_rows=lay)
    improved = F.col(score).isNotNull() & (F.col("__prior").isNull() | (s > F.col("__prior")))
    df = df.withColumn("improved", improved)
    counted = F.col(score).isNotNull().cast("long")
    df = running(df, {"__nth": ("sum", counted), "__best": ("max", s)}, order, part, chunk_rows=lay)
    df = running(df, {"__at": ("last", F.when(F.col("improved"), F.col("__nth")))}, order, part, chunk_rows=lay)
    return tidy(df, own).withColumns(
        {"best": signed(F.col("__best"), direction), "stale": F.coalesce(F.col("__nth") - F.col("__at"), F.lit(0))}
    ).drop("__prior", "__nth", "__best", "__at")


def score_trend(
    ledger: DataFrame, score: str, direction: str, order: Sequence[str], part: Sequence[str], k: int = 3, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Per ledger: direction of the last ``k`` score differences, the last one and their mean."""

    def diff(w):
        return {"__d": F.col(score) - F.lag(score, 1).over(w)}

    scored = ledger.filter(F.col(score).isNotNull())
    scored, lay, _ = lay_out(scored, order, part, chunk_rows)
    df = bounded_frames(scored, [diff], order, part, before=1, chunk_rows=lay)
    key = F.struct(*[F.col(c) for c in order])
    if lay.small:
        w = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
        last = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)
    else:
        top = df.groupBy(*part).agg(F.max(POS).alias("__max"))
        last = df.join(top, list(part)).filter(F.col(POS) > F.col("__max") - k)
    worse = (F.col("__d") >= 0) if direction == "minimize" else (F.col("__d") <= 0)
    out = last.groupBy(*part).agg(
        F.count("__d").alias("n"),
        F.sum(F.when(F.col("__d").isNotNull(), worse.cast("long"))).alias("bad"),
        F.max_by("__d", key).alias("last_improvement"),
        F.avg("__d").alias("avg_recent_improvement"),
    )
    trend = (
        F.when(F.col("n") == 0, "insufficient_data")
        .when(F.col("bad") == F.col("n"), "stagnating")
        .when(F.col("bad") == 0, "improving")
        .otherwise("mixed")
    )
    return out.select(*part, trend.alias("trend"), "last_improvement", "avg_recent_improvement")


def daily_quota(ledger: DataFrame, ts: str, max_daily: int, by: Sequence[str] = ()) -> DataFrame:
    """Entries per day, what is left of the daily budget, and whether one more fits."""
    out = ledger.groupBy(*by, F.to_date(ts).alias("day")).agg(F.count("*").alias("used"))
    left = F.greatest(F.lit(max_daily) - F.col("used"), F.lit(0))
    return out.withColumns({"remaining": left, "can_submit": left > 0})


def score_gap(ledger: DataFrame, cv: str, lb: str) -> DataFrame:
    """Absolute difference of local and public score where both are known."""
    return ledger.filter(F.col(cv).isNotNull() & F.col(lb).isNotNull()).withColumn("gap", F.abs(F.col(cv) - F.col(lb)))


# ---------------------------------------------------------------- accept / queue decisions


def decide_submissions(events: DataFrame, ledger: str, order: Sequence[str], ts: str, valid: str, cv: str, force: str, policy: Policy) -> DataFrame:
    """Replay events per ledger: validity, mode, budget, then threshold against earlier accepted scores.

    Each decision depends on those before it, so a task walks its ledgers in order with a three-value
    state and never holds a ledger in memory.
    """
    lean = events.withColumn("__day", F.date_format(F.to_date(ts), "yyyy-MM-dd"))
    # A sort after the shuffle keeps ledgers together; batches stream through.
    sorted_rows = lean.repartition(ledger).sortWithinPartitions(ledger, *order)
    schema = lean.drop("__day").withColumn("decision", F.lit("")).schema

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, (None, None, 0)
        for batch in batches:
            decisions = []
            for who, day, ok, score, forced in zip(batch[ledger], batch["__day"], batch[valid], batch[cv], batch[force]):
                if who != current:
                    current, state = who, (None, None, 0)
                score = None if score is None or score != score else float(score)
                decision, state = decide_one(state, day, bool(ok), score, bool(forced), policy)
                decisions.append(decision)
            yield batch.drop(columns="__day").assign(decision=decisions)

    return sorted_rows.mapInPandas(walk, schema)


def pop_best(reserved: DataFrame, score: str, direction: str, id: str, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """The best reserved rows and what remains."""
    best = reserved.orderBy(signed(F.col(score), direction).desc_nulls_last(), F.col(id)).limit(k)
    return best, reserved.join(best.select(id), id, "left_anti")


def top_models(scores: DataFrame, score: str, name: str, n: int, direction: str) -> DataFrame:
    return scores.filter(F.col(score).isNotNull()).orderBy(signed(F.col(score), direction).desc(), F.col(name)).limit(n)


def select_best(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """First row of each group by a composite key, combined map-side."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*keys)).alias("__b"))
    return best.select(*by, "__b.*")


# ---------------------------------------------------------------- ideas


def next_ideas(ideas: DataFrame, n: int, priority: str = "priority", tried: str = "tried", seq: str = "seq") -> DataFrame:
    return ideas.filter(~F.col(tried)).orderBy(F.desc(priority), F.asc(seq)).limit(n)


def dedupe_ideas(ideas: DataFrame, title: str = "title", priority: str = "priority", seq: str = "seq") -> DataFrame:
    """First idea of each title (case ignored) with the highest priority of its duplicates."""
    rest = [c for c in ideas.columns if c != priority]
    first = ideas.groupBy(F.lower(title).alias("__t")).agg(
        F.min_by(F.struct(*rest), F.col(seq)).alias("__f"), F.max(priority).alias(priority)
    )
    return first.select("__f.*", priority)


def idea_outcomes(ideas: DataFrame, direction: str = "minimize", tried: str = "tried", delta: str = "metric_delta") -> DataFrame:
    """``successful`` / ``failed`` / ``untried`` per idea; a tried idea without a delta failed."""
    good = F.coalesce(signed(F.col(delta), direction) > 0, F.lit(False))
    return ideas.withColumn("outcome", F.when(~F.col(tried), "untried").when(good, "successful").otherwise("failed"))


# Ideas derived from model analysis, with their limits and priorities.
ANALYSIS_IDEAS = (
    ("zero_features", 3, "feature", "Remove zero-importance features", 0.7),
    ("concentration", 0.7, "feature", "Diversify feature sources", 0.6),
    ("cv_stability", 0.05, "model", "Reduce model complexity", 0.8),
)
# Default ideas of the pool (category, title, priority).
DEFAULT_IDEAS = (
    ("feature", "Target encoding with smoothing", 0.7),
    ("feature", "Feature interactions (multiply/divide)", 0.6),
    ("feature", "Frequency encoding for categoricals", 0.5),
    ("model", "LightGBM with dart boosting", 0.4),
    ("model", "XGBoost with tuned parameters", 0.5),
    ("ensemble", "Weighted average of LGB + XGB", 0.8),
    ("preprocessing", "Outlier clipping at 1st/99th percentile", 0.4),
    ("preprocessing", "Log transform skewed features", 0.5),
    ("postprocess", "Threshold optimization", 0.6),
)


def derive_ideas(metrics: DataFrame, id: str) -> DataFrame:
    """One row per analysed model and rule that fires."""
    rules = F.array(
        *[
            F.when(
                F.col(metric) > limit,
                F.struct(F.lit(category).alias("category"), F.lit(title).alias("title"), F.lit(priority).alias("priority")),
            )
            for metric, limit, category, title, priority in ANALYSIS_IDEAS
        ]
    )
    return metrics.select(id, F.inline(F.array_compact(rules)))


def ideas_from_notes(notes: DataFrame, text: str, id: str, templates: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Template ideas whose keyword occurs in a note: ``(keyword, category, title, priority)``."""
    low = F.lower(F.col(text))
    hits = F.array(
        *[
            F.when(
                low.contains(keyword.lower()),
                F.struct(F.lit(category).alias("category"), F.lit(title).alias("title"), F.lit(priority).alias("priority")),
            )
            for keyword, category, title, priority in templates
        ]
    )
    return notes.select(id, F.inline(F.array_compact(hits)))


def seed_ideas(notes: DataFrame, text: str, pool: DataFrame | None = None, templates: Sequence[tuple[str, str, float]] = DEFAULT_IDEAS) -> DataFrame:
    """``(category, title, priority, source)``: templates of which one of the first two title words occurs in any note.

    Where that leaves the pool empty (``pool`` has no rows and no note hits), all templates are seeded as defaults.
    """
    low = F.lower(F.col(f"`{text}`"))
    hit = [F.coalesce(F.max(low.contains(words[0]) | (low.contains(words[1]) if len(words) > 1 else F.lit(False))), F.lit(False)) for words in (t.lower().split()[:2] for _, t, _ in templates)]
    held = F.lit(False) if pool is None else pool.select((F.count(F.lit(1)) > 0).alias("h")).scalar()
    rows = notes.agg(*[h.alias(f"h{i}") for i, h in enumerate(hit)])
    found = F.array(*[F.struct(F.col(f"h{i}").alias("hit"), *[F.lit(v).alias(n) for n, v in zip(("category", "title", "priority"), t)]) for i, t in enumerate(templates)])
    none = ~F.exists("all", lambda x: x["hit"])
    long = rows.select(found.alias("all")).withColumn("defaults", none & ~held).select("defaults", F.inline("all"))
    return long.filter("hit OR defaults").select("category", "title", "priority", F.when(F.col("hit"), "research").otherwise("default").alias("source"))


# ---------------------------------------------------------------- experiment trees


def best_node(nodes: DataFrame, metric: str, direction: str, buggy: str, id: str) -> DataFrame:
    ok = nodes.filter(F.col(metric).isNotNull() & ~F.col(buggy))
    return ok.orderBy(signed(F.col(metric), direction).desc(), F.col(id)).limit(1)


def leaf_nodes(nodes: DataFrame, id: str, parent: str) -> DataFrame:
    return nodes.join(nodes.select(F.col(parent).alias(id)).filter(F.col(id).isNotNull()).distinct(), id, "left_anti")


def experiment_tree(nodes: DataFrame, id: str, parent: str, buggy: str, max_rounds: int = 64) -> DataFrame:
    """Root, depth, path and debug depth of every node, by doubling ancestor pointers.

    Each round joins every open node with its current ancestor and so doubles the distance covered: a
    tree of depth ``d`` needs about ``log2 d`` joins. Nodes without a known parent are roots.
    """
    ids = nodes.select(F.col(id).alias("__pid"), F.col(buggy).alias("__parent_buggy"))
    known = nodes.join(ids, F.col(parent) == F.col("__pid"), "left")
    cur = cut_lineage(
        known.select(
            F.col(id).alias("id"), F.col("__pid").alias("up"), F.col("__pid").isNotNull().cast("long").alias("depth"),
            F.col(id).cast("string").alias("path"),
            # consecutive failing ancestors so far, and whether that run is still unbroken
            F.when(F.coalesce("__parent_buggy", F.lit(False)), 1).otherwise(0).cast("long").alias("debug"),
            F.coalesce("__parent_buggy", F.lit(False)).alias("running"),
        )
    )

    cur = cur.withColumn("root", F.col("id"))
    for _ in range(max_rounds):
        if cur.filter(F.col("up").isNotNull()).isEmpty():
            break
        above = cur.select(
            F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"), F.col("path").alias("a_path"),
            F.col("debug").alias("a_debug"), F.col("running").alias("a_running"), F.col("root").alias("a_root"),
        )
        hop = F.col("a_id").isNotNull()
        go = F.col("running") & hop
        cur = cut_lineage(
            cur.join(above, F.col("up") == F.col("a_id"), "left").select(
                "id", F.col("a_up").alias("up"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"),
                F.when(hop, F.concat_ws("/", "a_path", "path")).otherwise(F.col("path")).alias("path"),
                (F.col("debug") + F.when(go, F.col("a_debug")).otherwise(0)).alias("debug"),
                F.when(go, F.col("a_running")).otherwise(F.lit(False)).alias("running"),
                F.coalesce("a_root", "root").alias("root"),
            )
        )
    else:
        raise ValueError("experiment tree has a cycle or is too deep")
    return cur.select(F.col("id").alias(id), "root", "depth", "path", F.col("debug").alias("debug_depth"))
