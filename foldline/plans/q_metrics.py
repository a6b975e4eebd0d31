"""Metric, segment and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.operators import metrics as M
from foldline.operators import ranks as R
from foldline.plans.catalog import query, rounded, table
from foldline.plans.stand_ins import LONG_SQL, OOF_SQL, STREAMS, oof, oof_long


@query(
    "D17 D22",
    f"""WITH l AS ({LONG_SQL}), m AS (SELECT version, fold, sqrt(avg((y - pred) ** 2)) AS rmse, avg((y - pred) ** 2) AS mse, avg(abs(y - pred)) AS mae,
          1 - sum((y - pred) ** 2) / sum((y - ym) ** 2) AS r2, corr(y, pred) AS pearson FROM (SELECT *, avg(y) OVER (PARTITION BY version, fold) AS ym FROM l) GROUP BY version, fold)
        SELECT version, fold, metric, round(value, 6) AS value FROM (UNPIVOT m ON rmse, mse, mae, r2, pearson INTO NAME metric VALUE value)""",
)
def regression_metrics_by_fold(spark, sf_dir):
    out = M.metric_table(oof_long(spark, sf_dir), ["rmse", "mse", "mae", "r2", "pearson"], "y", "pred", ["version", "fold"])
    return rounded(out)


_LAB = """(SELECT doc_id, lang, quality AS y, least(greatest((length(text) % 1000) / 1000.0 * 0.6 + quality * 0.3, 0), 1)::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"""


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.length("text") % 1000).alias("n"))
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    p = F.least(F.greatest(F.col("n") / 1000.0 * 0.6 + F.col("y") * 0.3, F.lit(0.0)), F.lit(1.0))
    return docs.join(lab, "doc_id").select("doc_id", "lang", "y", p.alias("p"))


_F1 = """(SELECT avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END)::DOUBLE FROM
    (SELECT c, sum((y = c AND l = c)::INT) tp, sum((y <> c AND l = c)::INT) fp, sum((y = c AND l <> c)::INT) fn FROM lab, (SELECT unnest([0, 1]) AS c) GROUP BY c))"""
_AUC = """(SELECT (sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0) FROM (SELECT y, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0)::DOUBLE AS r,
    (sum(y) OVER ())::DOUBLE AS n1, (sum(1 - y) OVER ())::DOUBLE AS n0 FROM lab) GROUP BY n1, n0)"""


@query(
    "D18 D19 D20 B10",
    f"""WITH lab AS (SELECT *, (p > 0.5)::INTEGER AS l FROM {_LAB}),
        s AS (SELECT 'accuracy' AS metric, avg((y = l)::INTEGER)::DOUBLE AS value FROM lab UNION ALL SELECT 'f1', {_F1} UNION ALL SELECT 'auc', {_AUC}
          UNION ALL SELECT 'log_loss', -avg(y * ln(greatest(p, 2.220446049250313e-16)) + (1 - y) * ln(1 - p)) FROM lab)
        SELECT metric, round(value, 6) AS value FROM s""",
)
def classification_metrics(spark, sf_dir):
    return rounded(M.metric_table(_labelled(spark, sf_dir), ["accuracy", "f1", "auc", "log_loss"], "y", "p"))


@query(
    "D19",
    f"""WITH lab AS {_LAB}, r AS (SELECT lang, y, (rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0)::DOUBLE AS r FROM lab),
        s AS (SELECT lang, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0, sum(CASE WHEN y = 1 THEN r END) AS sr FROM r GROUP BY lang)
        SELECT lang, round((sr - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 6) AS value FROM s""",
)
def auc_by_group(spark, sf_dir):
    return rounded(M.auc(_labelled(spark, sf_dir), "y", "p", ["lang"]))


@query(
    "D21",
    f"""WITH r AS (SELECT version, (rank() OVER (PARTITION BY version ORDER BY y) + (count(*) OVER (PARTITION BY version, y) - 1) / 2.0)::DOUBLE AS ry,
          (rank() OVER (PARTITION BY version ORDER BY pred) + (count(*) OVER (PARTITION BY version, pred) - 1) / 2.0)::DOUBLE AS rp FROM ({LONG_SQL}))
        SELECT version, round(corr(ry, rp), 6) AS value FROM r GROUP BY version""",
)
def spearman_by_version(spark, sf_dir):
    return rounded(M.spearman(oof_long(spark, sf_dir), "y", "pred", ["version"]))


@query(
    "D23",
    f"""SELECT version, round(avg(v), 6) AS mean_score, round(stddev_pop(v), 6) AS std_score, count(*) AS folds FROM
        (SELECT version, fold, sqrt(avg((y - pred) ** 2)) AS v FROM ({LONG_SQL}) GROUP BY version, fold) GROUP BY version""",
)
def fold_score_summary(spark, sf_dir):
    scores = M.rmse(oof_long(spark, sf_dir), "y", "pred", ["version", "fold"])
    return rounded(M.fold_summary(scores, "value", ["version"]))


_SEG = """(SELECT id, y, pa, pb, CASE WHEN pos >= n // 6 THEN pc END AS pc, pd, pos, n FROM (SELECT *, row_number() OVER (ORDER BY day, id) - 1 AS pos, count(*) OVER () AS n FROM {oof}))""".format(oof=OOF_SQL)
_SEGMENTS = {
    "full": "true", "tail20": "pos >= floor(n * 0.8)", "tail10": "pos >= floor(n * 0.9)", "tail5": "pos >= floor(n * 0.95)", "ts_fold5": "pos >= (n // 6) * 5",
    "ts_fold1": "pos >= (n // 6) AND pos < (n // 6) * 2",
}
_SEG_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS segment, '{c}' AS version, count({c}) AS rows, count({c})::DOUBLE / count(*) AS coverage, corr(y, {c}) AS corr FROM {_SEG} WHERE {cond}"
    for s, cond in _SEGMENTS.items() for c in STREAMS
)


def _late_start(spark, sf_dir):
    """Predictions in which one stream misses the untested head, as a forward-chained split leaves it."""
    from foldline.operators.series import ordered_positions

    o = ordered_positions(oof(spark, sf_dir), ["day", "id"])
    n = o.count()
    return o.withColumn("pc", F.when(F.col("pos") >= n // 6, F.col("pc"))).drop("pos")


def _segments(spark, sf_dir):
    return M.segment_scores(_late_start(spark, sf_dir), ["day", "id"], "y", STREAMS, list(_SEGMENTS))


@query("D24", f"SELECT segment, version, rows, round(coverage, 6) AS coverage, round(corr, 6) AS corr FROM ({_SEG_SQL})")
def time_segment_scores(spark, sf_dir):
    return rounded(_segments(spark, sf_dir))


def _comp(weights):
    return " + ".join(f"{w} * sum(corr) FILTER (WHERE segment = '{s}')" for s, w in weights.items())


@query(
    "D25 D24",
    f"""WITH s AS ({_SEG_SQL}) SELECT version, round({_comp(M.TAIL_COMPOSITE)}, 6) AS tail_composite, round({_comp(M.BALANCED_COMPOSITE)}, 6) AS balanced_composite,
        round(avg(corr) FILTER (WHERE segment LIKE 'tail%'), 6) AS late_mean, round(min(corr) FILTER (WHERE segment LIKE 'tail%'), 6) AS late_min,
        round(sum(corr) FILTER (WHERE segment = 'full') - avg(corr) FILTER (WHERE segment LIKE 'tail%'), 6) AS gap FROM s GROUP BY version""",
)
def composite_scores(spark, sf_dir):
    s = _segments(spark, sf_dir)
    a = M.composite(s, M.TAIL_COMPOSITE).withColumnRenamed("composite", "tail_composite")
    b = M.composite(s, M.BALANCED_COMPOSITE).withColumnRenamed("composite", "balanced_composite")
    return rounded(a.join(b, "version").join(M.late_summary(s).drop("full"), "version"))


@query(
    "D12",
    f"""SELECT version, sum(sse_i)::DOUBLE AS squared_error, sum(rows)::BIGINT AS rows, count(error) AS failures, round(sqrt(sum(sse_i) / sum(rows)), 6) AS rmse FROM
        (SELECT version, entity, floor(sum((y - pred) ** 2)) AS sse_i, count(*) AS rows, CASE WHEN entity % 50 = 0 THEN 'failed' END AS error FROM ({LONG_SQL}) GROUP BY version, entity) GROUP BY version""",
)
def pooled_rmse_by_config(spark, sf_dir):
    sse = F.floor(F.sum((F.col("y") - F.col("pred")) * (F.col("y") - F.col("pred")))).cast("double")
    d = oof_long(spark, sf_dir).groupBy("version", "entity").agg(sse.alias("sse"), F.count("*").alias("rows"))
    d = d.withColumn("error", F.when(F.col("entity") % 50 == 0, "failed"))
    return rounded(M.pooled_rmse(d, ["version"], "sse", "rows", "error"))


_CMP = f"""(SELECT entity, count(*) AS rows, sum((y - pa) ** 2) AS sse_a, sum((y - pd) ** 2) AS sse_b, sqrt(sum((y - pa) ** 2) / count(*)) AS rmse_a, sqrt(sum((y - pd) ** 2) / count(*)) AS rmse_b,
    sqrt(sum((y - pd) ** 2) / count(*)) - sqrt(sum((y - pa) ** 2) / count(*)) AS delta FROM {OOF_SQL} GROUP BY entity)"""


@query("D13", f"SELECT entity, rows, round(sse_a, 4) AS sse_a, round(sse_b, 4) AS sse_b, round(rmse_a, 6) AS rmse_a, round(rmse_b, 6) AS rmse_b, round(delta, 6) AS delta FROM {_CMP}")
def candidate_comparison(spark, sf_dir):
    out = M.compare_by_entity(oof(spark, sf_dir), "entity", "y", "pa", "pd")
    return out.select("entity", "rows", *[F.round(c, 4).alias(c) for c in ("sse_a", "sse_b")], *[F.round(c, 6).alias(c) for c in ("rmse_a", "rmse_b", "delta")])


@query(
    "D13 D36",
    f"""SELECT count(*) AS entities, round(sqrt(sum(sse_a) / sum(rows)), 6) AS rmse_a, round(sqrt(sum(sse_b) / sum(rows)), 6) AS rmse_b, sum((delta < 0)::BIGINT)::BIGINT AS better, sum((delta > 0)::BIGINT)::BIGINT AS worse,
        round(quantile_cont(delta, 0.1), 6) AS delta_p10, round(quantile_cont(delta, 0.5), 6) AS delta_p50, round(quantile_cont(delta, 0.9), 6) AS delta_p90 FROM {_CMP}""",
)
def comparison_summary(spark, sf_dir):
    return rounded(M.comparison_summary(M.compare_by_entity(oof(spark, sf_dir), "entity", "y", "pa", "pd")))


@query(
    "D36",
    f"""SELECT decile, count(*) AS rows, round(sqrt(avg((y - pa) ** 2)), 6) AS rmse_a, round(sqrt(avg((y - pb) ** 2)), 6) AS rmse_b, round(sum((pb - pa) * (y - pa)) / sum((pb - pa) ** 2), 6) AS slope,
        round(sqrt(avg((y - pa) ** 2)) - sqrt(avg((y - pb) ** 2)), 6) AS gain FROM
        (SELECT *, least(floor(q * 10), 9)::BIGINT AS decile FROM (SELECT *, coalesce((id - min(id) OVER (PARTITION BY entity))::DOUBLE / nullif(max(id) OVER (PARTITION BY entity) - min(id) OVER (PARTITION BY entity), 0), 0) AS q FROM {OOF_SQL})) GROUP BY decile""",
)
def progress_deciles(spark, sf_dir):
    from foldline.operators.windows import progress

    return rounded(M.decile_report(progress(oof(spark, sf_dir), "entity", "id"), "progress", "y", "pa", "pb"))


@query(
    "D37",
    f"""SELECT fold, round(avg((abs(y - pa) <= sd)::INTEGER), 6) AS within_1_sd, round(avg((abs(y - pa) <= 2 * sd)::INTEGER), 6) AS within_2_sd, round(avg(sd), 6) AS mean_sd
        FROM (SELECT *, 10 + id % 7 AS sd FROM {OOF_SQL}) GROUP BY fold""",
)
def interval_coverage(spark, sf_dir):
    return rounded(M.coverage(oof(spark, sf_dir).withColumn("sd", 10 + F.col("id") % 7), "y", "pa", "sd", by=["fold"]))


@query(
    "D33 C5",
    f"""WITH e AS (SELECT *, ((entity * 7) % 3)::INTEGER AS nf FROM {OOF_SQL}) SELECT nf AS fold, count(*) AS rows, round(sqrt(avg((y - pa) ** 2)), 6) AS rmse FROM e GROUP BY nf
        UNION ALL SELECT NULL, count(*), round(sqrt(avg((y - pa) ** 2)), 6) FROM e""",
)
def rescored_on_manifest(spark, sf_dir):
    o = oof(spark, sf_dir)
    manifest = o.select("entity").distinct().withColumn("fold", (F.col("entity") * 7 % 3).cast("int"))
    return rounded(M.rescore(o, manifest, "entity", "fold", "y", "pa"))


@query(
    "D29",
    f"""SELECT version, count(*) AS rows, sum((pred IS NULL)::BIGINT)::BIGINT AS missing, round(avg(pred), 6) AS mean, round(stddev_pop(pred), 6) AS std, round(min(pred), 6) AS min, round(max(pred), 6) AS max
        FROM (SELECT version, CASE WHEN id % 100 <> 7 THEN pred END AS pred FROM ({LONG_SQL})) GROUP BY version""",
)
def candidate_statistics(spark, sf_dir):
    long = oof_long(spark, sf_dir).withColumn("pred", F.when(F.col("id") % 100 != 7, F.col("pred")))
    return rounded(M.candidate_summary(long, "version", "pred"))


def _rk(c: str) -> str:
    return f"(((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE - 0.5) / count(*) OVER () * 2 - 1)"


@query(
    "D31 E25 G6",
    f"""WITH r AS (SELECT id, pa, pb, {_rk('pa')} AS ra, {_rk('pb')} AS rb, row_number() OVER (ORDER BY pa, id) AS na, row_number() OVER (ORDER BY pb, id) AS nb, count(*) OVER () AS n FROM {OOF_SQL}),
        k AS (SELECT *, greatest(1, floor(n * 0.01)) AS k FROM r)
        SELECT round(corr(pa, pb), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(abs(ra - rb) / 2), 6) AS mean_rank_delta, round(quantile_cont(abs(ra - rb) / 2, 0.9), 6) AS upper_rank_delta,
          round(sum((na > n - k AND nb > n - k)::INTEGER) / max(k), 6) AS top_overlap, round(sum((na <= k AND nb <= k)::INTEGER) / max(k), 6) AS bottom_overlap FROM k""",
)
def submission_difference(spark, sf_dir):
    return rounded(R.submission_delta(oof(spark, sf_dir), "id", "pa", "pb"))


_IMP = """(SELECT feature, fold, CASE WHEN feature = 5 THEN 0 ELSE avg(price * (1 + feature) / 1000) END AS gain FROM
    (SELECT l_suppkey % 12 AS feature, l_linenumber AS fold, l_extendedprice AS price FROM lineitem) GROUP BY feature, fold)"""


def _importance(spark, sf_dir):
    s = F.col("l_suppkey") % 12
    imp = table(spark, sf_dir, "lineitem").groupBy(s.alias("feature"), F.col("l_linenumber").alias("fold")).agg(
        F.avg(F.col("l_extendedprice") * (1 + s) / 1000).alias("gain")
    )
    return imp.withColumn("gain", F.when(F.col("feature") == 5, 0.0).otherwise(F.col("gain")))


@query("D26", f"SELECT feature, round(avg(gain), 6) AS mean, round(stddev_pop(gain), 6) AS std, round(stddev_pop(gain) / greatest(avg(gain), 1e-10), 6) AS instability FROM {_IMP} GROUP BY feature")
def importance_by_feature(spark, sf_dir):
    return rounded(M.importance_summary(_importance(spark, sf_dir), "feature", "gain"))


@query(
    "D26",
    f"""WITH s AS (SELECT feature, avg(gain) AS mean FROM {_IMP} GROUP BY feature) SELECT round(sum(mean), 6) AS total, sum((mean = 0)::BIGINT)::BIGINT AS unused, count(*) AS features,
        round((SELECT sum(mean) FROM (SELECT mean FROM s ORDER BY mean DESC LIMIT 5)) / sum(mean), 6) AS top_share FROM s""",
)
def importance_concentration(spark, sf_dir):
    return rounded(M.importance_concentration(M.importance_summary(_importance(spark, sf_dir), "feature", "gain")))


@query(
    "D30 F1",
    f"""WITH s AS (SELECT version, sqrt(avg((y - pred) ** 2)) AS cv FROM ({LONG_SQL}) GROUP BY version), p AS (SELECT *, row_number() OVER (ORDER BY cv, version) - 1 AS place FROM s)
        SELECT version, round(cv, 6) AS cv, place, (SELECT max(cv) - min(cv) < 1e-6 FROM s WHERE version <> 'pa') AS plateau, CASE WHEN place = 0 THEN 'keep as reference' ELSE 'compare with the best' END AS advice FROM p""",
)
def model_comparison(spark, sf_dir):
    s = M.rmse(oof_long(spark, sf_dir), "y", "pred", ["version"]).withColumnRenamed("value", "cv")
    return rounded(M.compare_models(s, "version", "cv", "version"))


@query(
    "D16",
    """SELECT user_id, count(*) FILTER (WHERE event_id % 7 <> 0) AS observed, count(*) FILTER (WHERE event_id % 7 = 0)::BIGINT AS scored_rows FROM events GROUP BY user_id""",
)
def scored_row_counts(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return M.suffix_counts(ev, "value", "user_id")


@query(
    "D32 C14",
    f"""WITH l AS (SELECT entity, id AS row, version, pred, CASE version WHEN 'pa' THEN -3.0 WHEN 'pb' THEN -1.0 WHEN 'pc' THEN -8.0 ELSE -2.0 END + entity % 3 AS ll FROM ({LONG_SQL})),
        w AS (SELECT *, exp((ll - max(ll) OVER (PARTITION BY entity)) / scale) AS w FROM l, (SELECT unnest([1.0, 8.0]) AS scale)),
        m AS (SELECT entity, row, scale, sum(w * pred) / sum(w) AS pred FROM w GROUP BY ALL)
        SELECT entity, row, scale::DOUBLE AS scale, hold::DOUBLE AS hold, round((1 - hold) * pred + hold * 100, 6) AS pred FROM m, (SELECT unnest([0.0, 0.25]) AS hold)""",
)
def evidence_averaging(spark, sf_dir):
    base = F.when(F.col("version") == "pa", -3.0).when(F.col("version") == "pb", -1.0).when(F.col("version") == "pc", -8.0).otherwise(-2.0)
    long = oof_long(spark, sf_dir).select("entity", F.col("id").alias("row"), "pred", (base + F.col("entity") % 3).alias("ll"), F.lit(100.0).alias("last"))
    return rounded(M.evidence_average(long, ["entity"], "row", "ll", "pred", "last", (1.0, 8.0), (0.0, 0.25)))
