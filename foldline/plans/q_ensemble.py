"""Ensemble, stacking, selection and rank-geometry queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foldline.operators import ensemble as E
from foldline.operators import geometry as G
from foldline.operators import ledger as L
from foldline.operators import select as S
from foldline.plans.catalog import query, rounded, table
from foldline.plans.stand_ins import LONG_SQL, OOF_SQL, STREAMS, oof, oof_long


def _frame(spark, rows, ddl):
    return rounded(spark.createDataFrame(rows, ddl))


@query("J1 J15", f"SELECT id, round(0.5 * pa + 0.25 * pb + 0.25 * pc, 9) AS pred FROM {OOF_SQL}")
def weighted_blend(spark, sf_dir):
    return rounded(E.blend(oof_long(spark, sf_dir), "id", "version", "pred", {"pa": 2.0, "pb": 1.0, "pc": 1.0}), 9)


@query("J1", f"SELECT id, round((pa + pb) / 2, 6) AS pred FROM {OOF_SQL}")
def equal_blend(spark, sf_dir):
    return rounded(E.blend(oof_long(spark, sf_dir), "id", "version", "pred", {"pa": 0.0, "pb": 0.0}))


@query(
    "J3 P4 F2",
    f"""SELECT wa, wb, wc, round(r, 6) AS corr FROM (SELECT wa, wb, wc, corr(y, wa * pa + wb * pb + wc * pc) AS r FROM {OOF_SQL},
         (SELECT a / 5.0::DOUBLE AS wa, b / 5.0::DOUBLE AS wb, (5 - a - b) / 5.0::DOUBLE AS wc FROM range(6) t(a), range(6) u(b) WHERE a + b <= 5) GROUP BY ALL)""",
)
def simplex_weight_grid(spark, sf_dir):
    w, r = E.simplex_grid(E.blend_stats(oof(spark, sf_dir), "y", ["pa", "pb", "pc"])[()], 5)
    return _frame(spark, [(*map(float, v), float(s)) for v, s in zip(w, r)], "wa double, wb double, wc double, corr double")


@query("J4")
def max_correlation_weights(spark, sf_dir):
    stats = E.blend_stats(oof(spark, sf_dir), "y", STREAMS)[()]
    w, best = E.max_pearson_weights(stats)
    rows = [(s, float(x), float(best)) for s, x in zip(STREAMS, w)]
    return _frame(spark, rows, "stream string, weight double, corr double")


@query("J2")
def searched_weights(spark, sf_dir):
    """Derivative-free weights for error and correlation, next to those of a log-loss style row metric."""
    o = oof(spark, sf_dir)
    rows = []
    chances = o.select(F.when(F.col("y") > 150, 1.0).otherwise(0.0).alias("y"), *[F.least(F.greatest(F.col(c) / 300, F.lit(0.0)), F.lit(1.0)).alias(c) for c in ("pa", "pb", "pc")])
    for metric in ("rmse", "pearson", "mae", "log_loss"):
        w, score = E.optimize_weights(chances if metric == "log_loss" else o, "y", ["pa", "pb", "pc"], metric)
        rows += [(metric, s, float(x), float(score)) for s, x in w.items()]
    return _frame(spark, rows, "metric string, stream string, weight double, score double")


_CHANCES = f"""(SELECT id, (y > 150)::INTEGER::DOUBLE AS y, CASE WHEN id % 7 <> 1 THEN least(greatest(pa / 300, 0), 1) END AS pa, least(greatest(pb / 300, 0), 1) AS pb, least(greatest(pc / 300, 0), 1) AS pc FROM {OOF_SQL})"""


@query(
    "J2 J6 J14",
    f"""WITH b AS (SELECT i * 100 + j AS candidate, y, (i * pa + j * pb + (10 - i - j) * pc) / 10 AS p FROM {_CHANCES}, range(11) a(i), range(11) c(j) WHERE i + j <= 10 AND pa IS NOT NULL)
       SELECT candidate::BIGINT AS candidate, round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) ** 2), 6) AS mse,
         round(-avg(y * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) + (1 - y) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS log_loss FROM b GROUP BY candidate""",
)
def weight_grid_losses(spark, sf_dir):
    """Every weight vector of a simplex grid under three losses, from one scan."""
    o = oof(spark, sf_dir)
    chance = {c: F.least(F.greatest(F.col(c) / 300, F.lit(0.0)), F.lit(1.0)) for c in ("pa", "pb", "pc")}
    o = o.select(F.when(F.col("y") > 150, 1.0).otherwise(0.0).alias("y"), F.when(F.col("id") % 7 != 1, chance["pa"]).alias("pa"), chance["pb"].alias("pb"), chance["pc"].alias("pc"))
    grid = [(i, j) for i in range(11) for j in range(11 - i)]
    found = E.weight_losses(o, "y", ["pa", "pb", "pc"], [[i / 10, j / 10, (10 - i - j) / 10] for i, j in grid])
    return rounded(_frame(spark, [(i * 100 + j, *map(float, v)) for (i, j), v in zip(grid, found)], "candidate long, mae double, mse double, log_loss double"))


@query(
    "J7",
    f"""SELECT k / 40.0::DOUBLE AS weight, round(sqrt(avg((y - ((1 - k / 40.0) * pa + k / 40.0 * pb)) ** 2)), 6) AS rmse FROM {OOF_SQL}, range(41) t(k) GROUP BY k""",
)
def blend_error_curve(spark, sf_dir):
    return rounded(E.blend_curve(oof(spark, sf_dir), "y", "pa", "pb"))


@query(
    "J8",
    f"""SELECT fold, count(*) AS rows, round(sqrt(avg((y - pa) ** 2)), 6) AS rmse_a, round(sqrt(avg((y - pb) ** 2)), 6) AS rmse_b, round(sqrt(avg((y - (0.825 * pa + 0.175 * pb)) ** 2)), 6) AS rmse_blend FROM {OOF_SQL} GROUP BY fold""",
)
def fixed_two_model_blend(spark, sf_dir):
    return rounded(E.fixed_ensemble(oof(spark, sf_dir), "y", "pa", "pb", 0.825, "fold"))


@query(
    "I13",
    f"""WITH q AS (SELECT quantile_cont(y, 0.01) lo, quantile_cont(y, 0.99) hi FROM {OOF_SQL}) SELECT id, round(least(greatest((pa + pd) / 2, lo), hi), 6) AS blend FROM {OOF_SQL}, q""",
)
def clipped_average(spark, sf_dir):
    o = oof(spark, sf_dir)
    return rounded(E.average_blend(o.select("id", "pa", "pd"), "pa", "pd", o, "y").select("id", "blend"))


@query(
    "J16",
    f"""WITH s AS (SELECT fold, sum((pb - pa) ** 2) dd, sum((pb - pa) * (y - pa)) dr FROM {OOF_SQL} GROUP BY fold)
        SELECT fold, round(((SELECT sum(dr) FROM s) - dr) / ((SELECT sum(dd) FROM s) - dd), 6) AS alpha FROM s""",
)
def shrink_by_fold(spark, sf_dir):
    return rounded(E.fold_shrink(oof(spark, sf_dir), "y", "pa", "pb", "fold"))


@query("J15", f"SELECT id, 'ab' AS \"group\", round((pa + pb) / 2, 6) AS pred FROM {OOF_SQL} UNION ALL SELECT id, 'acd', round((pa + pc + pd) / 3, 6) FROM {OOF_SQL}")
def group_means(spark, sf_dir):
    return rounded(E.group_mean(oof_long(spark, sf_dir), "id", "version", "pred", E.parse_groups("ab:pa+pb, acd:pa+pc+pd")))


@query(
    "J15 A17",
    """SELECT n_nationkey AS name, unnest(['v1', 'v2']) AS version, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [round(2.0 / (3 + n_nationkey), 6), round((1.0 + n_nationkey) / (3 + n_nationkey), 6)] ELSE [0.5, 0.5] END)::DOUBLE AS weight FROM nation""",
)
def recorded_anchor_weights(spark, sf_dir):
    k = F.col("n_nationkey")
    meta = F.when(
        k % 2 == 0,
        F.concat(F.lit('{"models":[{"version":"v1"},"v2","v3"],"weights":{"v1":2,"v2":'), (1 + k).cast("string"), F.lit(',"v3":0}}')),
    ).otherwise(F.lit('{"models":[]}'))
    src = table(spark, sf_dir, "nation").select(k.alias("name"), meta.alias("meta"))
    return rounded(E.anchor_spec(src, "meta", "name", ["v1", "v2"]))


@query(
    "J5 E22",
    f"""WITH o AS {OOF_SQL}, r AS (SELECT pd FROM o WHERE fold <> 0), s AS (SELECT avg(pd) m, stddev_pop(pd) d, quantile_cont(pd, 0.001) lo, quantile_cont(pd, 0.999) hi FROM r)
        SELECT id, round((pd - m) / d, 6) AS z, round(least(greatest(pd, lo), hi), 6) AS clipped, round(pd, 6) AS raw FROM o, s WHERE fold = 0""",
)
def prediction_transforms(spark, sf_dir):
    o = oof(spark, sf_dir)
    ref, new = o.filter("fold <> 0").select("pd"), o.filter("fold = 0").select("id", "pd")
    z = E.transform_preds(ref, new, "pd", "zscore").withColumnRenamed("pd", "z")
    c = E.transform_preds(ref, new, "pd", "clip001").withColumnRenamed("pd", "clipped")
    return rounded(z.join(c, "id").join(E.transform_preds(ref, new, "pd", "raw").withColumnRenamed("pd", "raw"), "id"))


@query(
    "J6 F2",
    f"""SELECT segment, round(corr, 6) AS corr FROM (
          SELECT 'full' AS segment, corr(y, 0.4 * pa + 0.3 * pb + 0.2 * pc + 0.1 * pd) AS corr FROM {OOF_SQL}
          UNION ALL SELECT 'tail20', corr(y, 0.4 * pa + 0.3 * pb + 0.2 * pc + 0.1 * pd) FROM (SELECT *, row_number() OVER (ORDER BY day, id) - 1 AS pos, count(*) OVER () AS n FROM {OOF_SQL}) WHERE pos >= floor(n * 0.8)
          UNION ALL SELECT 'ts_fold5', corr(y, 0.4 * pa + 0.3 * pb + 0.2 * pc + 0.1 * pd) FROM (SELECT *, row_number() OVER (ORDER BY day, id) - 1 AS pos, count(*) OVER () AS n FROM {OOF_SQL}) WHERE pos >= n // 6 * 5)""",
)
def segment_blend_scores(spark, sf_dir):
    stats = E.segment_stats(oof(spark, sf_dir), ["day", "id"], "y", STREAMS, ["full", "tail20", "ts_fold5"])
    w = np.array([0.4, 0.3, 0.2, 0.1])
    return _frame(spark, [(k, float(s.pearson(w)[0])) for k, s in stats.items()], "segment string, corr double")


@query("J6")
def random_weight_search(spark, sf_dir):
    stats = E.segment_stats(oof(spark, sf_dir), ["day", "id"], "y", STREAMS, ["full", "tail20", "tail10", "ts_fold5"])
    best = E.random_weight_search(stats, np.array([0.4, 0.3, 0.2, 0.1]), samples=500)
    rows = [(i, *[float(x) for x in b["weights"]], b["composite"], b["full"]) for i, b in enumerate(best)]
    return _frame(spark, rows, "place int, " + ", ".join(f"{s} double" for s in STREAMS) + ", composite double, corr_full double")


@query("J14")
def pool_scan(spark, sf_dir):
    stats = E.segment_stats(oof(spark, sf_dir), ["day", "id"], "y", STREAMS, ["full", "tail50", "tail20"])
    got = E.pool_scan(stats, {"all": STREAMS, "no_pa": STREAMS[1:], "pair": ("pc", "pd")}, [("full", "tail20"), ("tail50", "tail20")])
    rows = [(g["pool"], g["fit_on"], g["score_on"], g["active"], g["fit_corr"], g["eval_corr"]) for g in got]
    return _frame(spark, rows, "pool string, fit_on string, score_on string, active int, fit_corr double, eval_corr double")


_LS3 = f"""WITH m AS (SELECT count(*) n, sum(d1 * d1) a, sum(d1 * d2) b, sum(d2 * d2) c, sum(d1 * r) p, sum(d2 * r) q, sum(r * r) rr FROM (SELECT pb - pa AS d1, pd - pa AS d2, y - pa AS r FROM {OOF_SQL})),
    s AS (SELECT 0.0 AS w1, 0.0 AS w2 UNION ALL SELECT 1, 0 UNION ALL SELECT 0, 1 UNION ALL SELECT p / a, 0 FROM m UNION ALL SELECT 0, q / c FROM m
      UNION ALL SELECT (p - q - b + c) / (a - 2 * b + c), 1 - (p - q - b + c) / (a - 2 * b + c) FROM m UNION ALL SELECT (p * c - q * b) / (a * c - b * b), (q * a - p * b) / (a * c - b * b) FROM m)
    SELECT round(1 - w1 - w2, 6) AS w_pa, round(w1, 6) AS w_pb, round(w2, 6) AS w_pd, round(sqrt((rr - 2 * (w1 * p + w2 * q) + w1 * w1 * a + 2 * w1 * w2 * b + w2 * w2 * c) / n), 6) AS rmse FROM s, m
    WHERE w1 >= 0 AND w2 >= 0 AND w1 + w2 <= 1 + 1e-12 ORDER BY rmse LIMIT 1"""


@query("J9", _LS3)
def simplex_three_streams(spark, sf_dir):
    """Exact simplex least squares; the SQL side solves the seven supports in closed form."""
    names = ["pa", "pb", "pd"]
    o = oof(spark, sf_dir)
    fit = E.simplex_ls(E.delta_stats(o, "y", names)[()], names)
    E.verify_fits(o, "y", names, {None: fit})
    return _frame(spark, [(*map(float, fit.weights), float(np.sqrt(fit.sse / fit.rows)))], "w_pa double, w_pb double, w_pd double, rmse double")


@query("J10 M6")
def simplex_support_audit(spark, sf_dir):
    """Every support of four and five streams with weights, error and whether it is feasible."""
    o = oof(spark, sf_dir).withColumn("pe", F.col("pa") * 0.3 + 90)
    rows = []
    for names in (["pa", "pb", "pc", "pd"], ["pa", "pb", "pc", "pd", "pe"]):
        fit = E.simplex_ls(E.delta_stats(o, "y", names)[()], names)
        E.verify_fits(o, "y", names, {None: fit})
        for a in fit.audit:
            rows.append((len(names), a["support"], a["feasible"], a["support"] == fit.support, None if a["sse"] is None else a["sse"] / fit.rows))
    return _frame(spark, rows, "streams int, support string, feasible boolean, chosen boolean, mse double")


@query(
    "J11",
    f"""WITH o AS {OOF_SQL}, w AS (SELECT f AS fold, least(greatest(sum((pd - pa) * (y - pa)) / sum((pd - pa) ** 2), 0), 1) AS w FROM o, range(5) t(f) WHERE fold <> f GROUP BY f)
        SELECT id, round((1 - w) * pa + w * pd, 6) AS stack FROM o JOIN w USING (fold)""",
)
def cross_fitted_stack(spark, sf_dir):
    o = oof(spark, sf_dir)
    out, fits, _ = E.nested_stack(o, "y", ["pa", "pd"], "fold")
    E.verify_fits(o, "y", ["pa", "pd"], fits, "fold")
    return rounded(out.select("id", "stack"))


@query(
    "J11",
    f"""WITH o AS (SELECT *, pd + 1 AS m0, pd * 0.9 AS m1 FROM {OOF_SQL}),
        w AS (SELECT 0 AS fold, least(greatest(sum((m0 - pa) * (y - pa)) / sum((m0 - pa) ** 2), 0), 1) AS w FROM o WHERE fold <> 0
          UNION ALL SELECT 1, least(greatest(sum((m1 - pa) * (y - pa)) / sum((m1 - pa) ** 2), 0), 1) FROM o WHERE fold <> 1
          UNION ALL SELECT f, least(greatest(sum((pd - pa) * (y - pa)) / sum((pd - pa) ** 2), 0), 1) FROM o, range(2, 5) t(f) WHERE fold <> f GROUP BY f)
        SELECT id, round((1 - w) * pa + w * pd, 6) AS stack FROM o JOIN w USING (fold)""",
)
def cross_fitted_stack_with_meta(spark, sf_dir):
    """Weights fitted on fold-specific meta columns and applied to the canonical ones."""
    o = oof(spark, sf_dir).withColumns({"m0": F.col("pd") + 1, "m1": F.col("pd") * 0.9})
    out, _, _ = E.nested_stack(o, "y", ["pa", "pd"], "fold", {0: ["pa", "m0"], 1: ["pa", "m1"]})
    return rounded(out.select("id", "stack"))


_SUMM = f"""(SELECT fold, version AS candidate, entity, sum((y - pred) ** 2) AS sse, count(*) AS rows FROM ({LONG_SQL}) GROUP BY ALL)"""


def _summary(spark, sf_dir):
    e = F.col("y") - F.col("pred")
    return oof_long(spark, sf_dir).groupBy("fold", F.col("version").alias("candidate"), "entity").agg(F.sum(e * e).alias("sse"), F.count("*").alias("rows"))


_SELECT = f"""WITH p AS (SELECT fold, candidate, sum(sse) s, sum(rows) n FROM {_SUMM} GROUP BY fold, candidate), t AS (SELECT candidate, sum(s) ts, sum(n) tn FROM p GROUP BY candidate),
    a AS (SELECT fold, candidate, sqrt((ts - s) / (tn - n)) AS select_rmse, sqrt(s / n) AS held_out_rmse, n::BIGINT AS rows FROM p JOIN t USING (candidate) UNION ALL SELECT NULL, candidate, sqrt(ts / tn), NULL, tn::BIGINT FROM t)
    SELECT fold, candidate, select_rmse, held_out_rmse, rows FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY select_rmse, candidate) AS k FROM a) WHERE k = 1"""


@query("J12 F3 M5", f"SELECT fold, candidate, round(select_rmse, 6) AS select_rmse, round(held_out_rmse, 6) AS held_out_rmse, rows FROM ({_SELECT})")
def nested_candidate_selection(spark, sf_dir):
    return rounded(E.nested_select(_summary(spark, sf_dir), "fold", "candidate", "sse", "rows"))


@query(
    "J13",
    f"""WITH s AS ({_SELECT}) SELECT id, fold, round(CASE candidate WHEN 'pa' THEN pa WHEN 'pb' THEN pb WHEN 'pc' THEN pc ELSE pd END, 6) AS pred FROM {OOF_SQL} JOIN s USING (fold)""",
)
def selected_oof(spark, sf_dir):
    chosen = E.nested_select(_summary(spark, sf_dir), "fold", "candidate", "sse", "rows")
    return rounded(E.materialize_oof(oof(spark, sf_dir), chosen, "fold", "candidate", STREAMS).select("id", "fold", "pred"))


@query("F3", f"SELECT fold, candidate, entity, round(sse, 4) AS sse, rows FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sse, candidate) AS k FROM {_SUMM}) WHERE k = 1")
def best_candidate_per_entity(spark, sf_dir):
    return rounded(L.select_best(_summary(spark, sf_dir), ["sse", "candidate"], ["entity"]), 4)


@query(
    "B11 C13",
    f"""SELECT id FROM {OOF_SQL} WHERE id % 10 <> 3 AND id % 7 <> 2 AND pa <> 0""",
)
def common_oof_rows(spark, sf_dir):
    keep = ((F.col("version") != "pa") | (F.col("id") % 10 != 3)) & ((F.col("version") != "pb") | (F.col("id") % 7 != 2))
    long = oof_long(spark, sf_dir).filter(F.col("version").isin("pa", "pb")).withColumn("pred", F.when(keep, F.col("pred")).otherwise(F.lit(0.0)))
    return S.common_rows(long, "id", "version", "pred", 2, mask_zero=True)


@query(
    "B12",
    f"""WITH s AS (SELECT fold, sqrt(avg((y - pa) ** 2)) a, sqrt(avg((y - pd) ** 2)) d FROM {OOF_SQL} GROUP BY fold)
        SELECT fold, CASE WHEN d < a - 5 THEN 'accept' WHEN d < a THEN 'promising' ELSE 'reject' END AS status FROM s""",
)
def decision_gates(spark, sf_dir):
    s = E.fixed_ensemble(oof(spark, sf_dir), "y", "pa", "pd", 0.5, "fold")
    a, d = F.col("rmse_a"), F.col("rmse_b")
    return S.gate(s, [("accept", d < a - 5), ("promising", d < a)], "reject").select("fold", "status")


# ---------------------------------------------------------------- rank geometry


def _rk(c: str) -> str:
    return f"(((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE - 0.5) / count(*) OVER () * 2 - 1)"


_RANKS = f"(SELECT id, day, y, {', '.join(f'{_rk(c)} AS {c}' for c in STREAMS)} FROM {OOF_SQL})"


@query(
    "K2 C15 E25",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS spearman, round(avg(abs({a} - {b})) / 2, 6) AS mean_rank_delta FROM {_RANKS}"
        for i, a in enumerate(STREAMS) for b in STREAMS[i + 1:]
    ),
)
def candidate_pair_comparison(spark, sf_dir):
    return rounded(G.compare_candidates(oof(spark, sf_dir), "id", STREAMS))


@query(
    "K3",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS candidate, round(a, 6) AS spearman_to_anchor, round(d, 6) AS rank_delta_to_anchor, round(f, 6) AS max_spearman_to_failed, round(f, 6) AS mean_spearman_to_failed, {s}::DOUBLE AS local_score,
            round(least(greatest(({s} - 0.123) / 0.03, 0), 1), 6) AS local_bonus, round(0.5 * a + 0.25 * (1 - f) + 0.15 * (1 - d) + 0.1 * least(greatest(({s} - 0.123) / 0.03, 0), 1), 6) AS geometry_score
            FROM (SELECT corr(pa, {c}) a, avg(abs(pa - {c})) / 2 d, corr(pc, {c}) f FROM {_RANKS})"""
        for c, s in (("pb", 0.14), ("pd", 0.2))
    ),
)
def candidate_geometry(spark, sf_dir):
    local = spark.createDataFrame([("pb", 0.14), ("pd", 0.2)], "candidate string, local_score double")
    return rounded(G.geometry_score(oof(spark, sf_dir), "id", ["pb", "pd"], "pa", ["pc"], local))


@query(
    "K4",
    f"""SELECT id, 'beta050' AS candidate, round({_rk('x')}, 6) AS pred FROM (SELECT id, pa + 0.05 * (pa - pb) AS x FROM {_RANKS})
        UNION ALL SELECT id, 'w100_200', round({_rk('x')}, 6) FROM (SELECT id, pa + 0.1 * (pa - pb) + 0.2 * (pa - pc) AS x FROM {_RANKS})""",
)
def anti_failed_extrapolation(spark, sf_dir):
    return rounded(G.anti_failed(oof(spark, sf_dir), "id", "pa", ["pb", "pc"], [[0.05], [0.1, 0.2]]))


_SCAN_SRC = f"(SELECT *, row_number() OVER (ORDER BY day, id) - 1 AS pos, count(*) OVER () AS n FROM {_RANKS})"


def _scan_sql() -> str:
    parts = []
    for name, members in (("bc", "(pb + pc) / 2"), ("d", "pd")):
        for alpha in (0.05, 0.2):
            x = f"((1 - {alpha}) * pa + {alpha} * {members})"
            corr = {s: f"corr(y, {x}) FILTER (WHERE pos >= floor(n * {f}))" for s, f in (("full", 0), ("tail20", 0.8), ("tail10", 0.9), ("tail5", 0.95))}
            parts.append(
                f"""SELECT '{name}' AS "group", {alpha}::DOUBLE AS alpha, c.*, s.* FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in corr.items())} FROM {_SCAN_SRC}) c,
                (SELECT corr(r, pa) AS spearman_to_anchor, corr(r, pc) AS spearman_to_failed, avg(abs(r - pa)) / 2 AS mean_rank_delta_to_anchor FROM (SELECT pa, pc, {_rk('x')} AS r FROM (SELECT pa, pc, {x} AS x FROM {_RANKS}))) s"""
            )
    return f"""SELECT *, composite - 0.6 * failed_excess - 0.35 * anchor_shortfall - 0.9 * rank_delta_excess AS utility FROM (
        SELECT *, 0.45 * "full" + 0.3 * tail20 + 0.15 * tail10 + 0.1 * tail5 AS composite, greatest(spearman_to_failed - 0.1, 0) AS failed_excess,
          greatest(0.99 - spearman_to_anchor, 0) AS anchor_shortfall, greatest(mean_rank_delta_to_anchor - 0.02, 0) AS rank_delta_excess FROM ({' UNION ALL '.join(parts)}))"""


_SCAN_COLS = ["full", "tail20", "tail5", "composite", "spearman_to_anchor", "spearman_to_failed", "mean_rank_delta_to_anchor", "utility"]


def _scan(spark, sf_dir):
    o = oof(spark, sf_dir)
    return G.anchor_blend_scan(
        o, o, "id", ["day", "id"], "y", {"pa": 1.0}, {"bc": ["pb", "pc"], "d": ["pd"]}, (0.05, 0.2), "pa", "pc",
        min_spearman=0.99, max_rank_delta=0.02, failed_threshold=0.1,
    )


@query("K1 B13 D25", 'SELECT "group", alpha, ' + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _SCAN_COLS) + f" FROM ({_scan_sql()})")
def anchor_blend_scan(spark, sf_dir):
    return rounded(_scan(spark, sf_dir).select("group", "alpha", *_SCAN_COLS))


@query("B13 F3", f"""SELECT "group", alpha, round(utility, 6) AS utility FROM ({_scan_sql()}) WHERE spearman_to_anchor >= 0.9 AND mean_rank_delta_to_anchor <= 0.2 ORDER BY utility DESC, spearman_to_anchor DESC LIMIT 1""")
def safest_blend(spark, sf_dir):
    return rounded(S.select_safe(_scan(spark, sf_dir), "utility", 0.9, 0.2).select("group", "alpha", "utility"))


@query(
    "K5 E25",
    " UNION ALL ".join(
        f"SELECT '{c}' AS candidate, round(corr({c}, pa), 6) AS spearman, round(avg(abs({c} - pa)) / 2 * count(*) / (count(*) - 1), 6) AS mean_rank_delta FROM {_RANKS}" for c in ("pb", "pc")
    ),
)
def tail_diagnostics(spark, sf_dir):
    return rounded(G.diagnostics_to_reference(oof(spark, sf_dir), "id", ["pb", "pc"], "pa"))


@query("F1", f"SELECT version, round(v, 6) AS value FROM (SELECT version, sqrt(avg((y - pred) ** 2)) AS v FROM ({LONG_SQL}) GROUP BY version) ORDER BY v LIMIT 2")
def top_models(spark, sf_dir):
    from foldline.operators.metrics import rmse

    return rounded(L.top_models(rmse(oof_long(spark, sf_dir), "y", "pred", ["version"]), "value", "version", 2, "minimize"))
