"""Ledger queries: orders stand in for submissions and ideas, lines and nations for experiment trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.operators import ledger as L
from foldline.plans.catalog import query, rounded, table
from foldline.streaming.ledger_stream import replay

_LED = "(SELECT o_custkey AS ledger, o_orderkey AS seq, o_orderdate AS ts, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice / 1000 END AS cv, o_orderkey % 13 <> 0 AS valid, o_orderkey % 17 = 0 AS force FROM orders)"


def _ledger(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ledger"), k.alias("seq"), F.col("o_orderdate").alias("ts"), F.when(k % 6 != 0, F.col("o_totalprice") / 1000).alias("cv"),
        (k % 13 != 0).alias("valid"), (k % 17 == 0).alias("force"),
    )


@query("N1", f"SELECT ledger, round(min(cv), 6) AS best FROM {_LED} GROUP BY ledger")
def best_score_per_ledger(spark, sf_dir):
    return rounded(L.best_score(_ledger(spark, sf_dir), "cv", "minimize", ["ledger"]))


@query("N2 H13", f"SELECT ts::DATE::VARCHAR AS day, count(*) AS used, greatest(7 - count(*), 0) AS remaining, count(*) < 7 AS can_submit FROM {_LED} GROUP BY ts::DATE")
def daily_quota(spark, sf_dir):
    out = L.daily_quota(_ledger(spark, sf_dir), "ts", 7)
    return out.withColumns({"day": F.col("day").cast("string"), "remaining": F.col("remaining").cast("long")})


_RB = """WITH s AS (SELECT *, max(cv) OVER (PARTITION BY {p} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, max(cv) OVER (PARTITION BY {p} ORDER BY seq) AS best, count(cv) OVER (PARTITION BY {p} ORDER BY seq) AS nth FROM {l}),
    i AS (SELECT *, cv IS NOT NULL AND (prior IS NULL OR cv > prior) AS improved FROM s)
    SELECT seq, improved, round(best, 6) AS best, coalesce(nth - max(CASE WHEN improved THEN nth END) OVER (PARTITION BY {p} ORDER BY seq), 0)::BIGINT AS stale FROM i"""


@query("E28", _RB.format(p="ledger", l=_LED))
def running_best_and_stale_rounds(spark, sf_dir):
    out = L.running_best(_ledger(spark, sf_dir), "cv", "maximize", ["seq"], ["ledger"])
    return rounded(out.select("seq", "improved", "best", "stale"))


@query("E28", _RB.format(p="0", l=_LED))
def running_best_global(spark, sf_dir):
    """One ledger over the whole table, through chunk carries."""
    out = L.running_best(_ledger(spark, sf_dir), "cv", "maximize", ["seq"], chunk_rows=1500)
    return rounded(out.select("seq", "improved", "best", "stale"))


_TREND = f"""WITH d AS (SELECT ledger, seq, cv - lag(cv) OVER (PARTITION BY ledger ORDER BY seq) AS d, row_number() OVER (PARTITION BY ledger ORDER BY seq DESC) AS k FROM {_LED} WHERE cv IS NOT NULL),
    a AS (SELECT ledger, count(d) AS n, count(*) FILTER (WHERE d >= 0) AS bad, arg_max(d, seq) FILTER (WHERE d IS NOT NULL) AS last, avg(d) AS mean FROM d WHERE k <= 3 GROUP BY ledger)
    SELECT ledger, CASE WHEN n = 0 THEN 'insufficient_data' WHEN bad = n THEN 'stagnating' WHEN bad = 0 THEN 'improving' ELSE 'mixed' END AS trend, round(last, 6) AS last_improvement, round(mean, 6) AS avg_recent_improvement FROM a"""


@query("E29", _TREND)
def score_trends(spark, sf_dir):
    return rounded(L.score_trend(_ledger(spark, sf_dir), "cv", "minimize", ["seq"], ["ledger"]))


@query("E29", _TREND)
def score_trends_chunked(spark, sf_dir):
    return rounded(L.score_trend(_ledger(spark, sf_dir), "cv", "minimize", ["seq"], ["ledger"], chunk_rows=4))


_DECIDE = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY seq) AS i, date_trunc('month', ts)::DATE AS day FROM {l}),
    w AS (SELECT ledger, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::DOUBLE AS best, NULL::DATE AS day, 0 AS used, '' AS decision FROM (SELECT DISTINCT ledger FROM e)
      UNION ALL SELECT ledger, i, seq, CASE WHEN decision = 'accepted' AND cv IS NOT NULL AND (best IS NULL OR cv < best) THEN cv ELSE best END, day, used + (decision = 'accepted')::INTEGER, decision FROM
        (SELECT e.ledger, e.i, e.seq, e.day, e.cv, w.best, CASE WHEN e.day = w.day THEN w.used ELSE 0 END AS used,
           CASE WHEN NOT e.valid THEN 'invalid' WHEN (CASE WHEN e.day = w.day THEN w.used ELSE 0 END) >= 1 THEN 'queued_budget' WHEN NOT e.force AND e.cv IS NOT NULL AND w.best IS NOT NULL AND e.cv > w.best - 1 THEN 'queued_threshold' ELSE 'accepted' END AS decision
         FROM w JOIN e ON e.ledger = w.ledger AND e.i = w.i + 1))
    SELECT seq, decision FROM w WHERE i > 0"""


@query("N4", _DECIDE.format(l=_LED))
def submission_decisions(spark, sf_dir):
    led = _ledger(spark, sf_dir).withColumn("month", F.trunc(F.to_date("ts"), "month"))
    out = L.decide_submissions(led, "ledger", ["seq"], "month", "valid", "cv", "force", L.Policy(1, 1.0, "minimize"))
    return out.select("seq", "decision")


@query("N4 N2", _DECIDE.format(l=_LED))
def submission_decisions_streamed(spark, sf_dir):
    """The same rules as a stateful stream over the ledger, replayed from the stored table."""
    led = _ledger(spark, sf_dir).withColumn("day", F.date_format(F.trunc(F.to_date("ts"), "month"), "yyyy-MM-dd"))
    lean = led.select("ledger", "seq", "day", "valid", "cv", "force")
    return replay(spark, lean, L.Policy(1, 1.0, "minimize")).select("seq", "decision")


_IDEA = "(SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'Idea ' ELSE 'IDEA ' END || (o_custkey % 900) AS title, (o_orderkey % 89) / 89.0::DOUBLE AS priority, o_orderkey % 4 = 0 AS tried, CASE WHEN o_orderkey % 8 = 0 THEN o_totalprice - 250000 END AS metric_delta FROM orders)"


def _ideas(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"), F.concat(F.when(k % 2 == 0, "Idea ").otherwise("IDEA "), (F.col("o_custkey") % 900).cast("string")).alias("title"),
        ((k % 89) / 89.0).alias("priority"), (k % 4 == 0).alias("tried"), F.when(k % 8 == 0, F.col("o_totalprice") - 250000).alias("metric_delta"),
    )


@query("F5", f"SELECT seq, title, round(priority, 6) AS priority FROM {_IDEA} WHERE NOT tried ORDER BY priority DESC, seq LIMIT 20")
def next_ideas(spark, sf_dir):
    return rounded(L.next_ideas(_ideas(spark, sf_dir), 20).select("seq", "title", "priority"))


@query("G7", f"SELECT min(seq) AS seq, arg_min(title, seq) AS title, round(max(priority), 6) AS priority FROM {_IDEA} GROUP BY lower(title)")
def deduplicated_ideas(spark, sf_dir):
    return rounded(L.dedupe_ideas(_ideas(spark, sf_dir)).select("seq", "title", "priority"))


@query("N5", f"SELECT seq, CASE WHEN NOT tried THEN 'untried' WHEN metric_delta < 0 THEN 'successful' ELSE 'failed' END AS outcome FROM {_IDEA}")
def idea_outcomes(spark, sf_dir):
    return L.idea_outcomes(_ideas(spark, sf_dir)).select("seq", "outcome")


@query(
    "N6",
    """WITH m AS (SELECT l_suppkey AS model, count(*) FILTER (WHERE l_discount = 0) AS z, avg(l_quantity / 50) AS c, stddev_pop(l_tax) AS s FROM lineitem GROUP BY 1)
       SELECT model, 'feature' AS category, 'Remove zero-importance features' AS title, 0.7::DOUBLE AS priority FROM m WHERE z > 3 UNION ALL SELECT model, 'feature', 'Diversify feature sources', 0.6 FROM m WHERE c > 0.7
       UNION ALL SELECT model, 'model', 'Reduce model complexity', 0.8 FROM m WHERE s > 0.05""",
)
def ideas_from_analysis(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(
        F.sum((F.col("l_discount") == 0).cast("long")).alias("zero_features"), F.avg(F.col("l_quantity") / 50).alias("concentration"),
        F.stddev_pop("l_tax").alias("cv_stability"),
    )
    return L.derive_ideas(m, "model")


_WORDS = (("the", "feature", "Use the word", 0.5), ("que", "model", "Use que", 0.4), ("und", "ensemble", "Use und", 0.3))


@query("N6", " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, '{t}' AS title, {p}::DOUBLE AS priority FROM documents WHERE contains(lower(text), '{k}')" for k, c, t, p in _WORDS))
def ideas_from_notes(spark, sf_dir):
    return L.ideas_from_notes(table(spark, sf_dir, "documents"), "text", "doc_id", _WORDS)


def _seeds_sql(text: str, source: str) -> str:
    """Templates of which one of the first two title words is in a note; all of them where none is."""
    rows = []
    for category, title, priority in L.DEFAULT_IDEAS:
        words = title.lower().split()[:2]
        hit = " OR ".join(f"contains(lower({text}), '{w}')" for w in words)
        rows.append(f"SELECT '{category}' AS category, '{title}' AS title, {priority}::DOUBLE AS priority, coalesce(bool_or({hit}), false) AS hit FROM {source}")
    return (
        f"WITH h AS ({' UNION ALL '.join(rows)}) SELECT category, title, priority, CASE WHEN hit THEN 'research' ELSE 'default' END AS source FROM h"
        " WHERE hit OR NOT (SELECT bool_or(hit) FROM h)"
    )


@query("N6", _seeds_sql("html", "pages"))
def ideas_seeded(spark, sf_dir):
    return L.seed_ideas(table(spark, sf_dir, "pages"), "html")


@query("N6", _seeds_sql("o_orderstatus", "orders"))
def ideas_seeded_by_default(spark, sf_dir):
    """Notes without any hit: an empty pool gets every template."""
    return L.seed_ideas(table(spark, sf_dir, "orders"), "o_orderstatus", pool=table(spark, sf_dir, "orders").filter("o_orderkey < 0"))


_TOP = (("the", "alpha"), ("of", "alpha"), ("and", "alpha"), ("que", "beta"), ("les", "beta"), ("und", "beta"), ("der", "beta"))


@query(
    "D27",
    f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), h AS ({' UNION ALL '.join(f"SELECT '{g}' AS family, '{k}' AS keyword, count(*) FILTER (WHERE contains(t, '{k}')) AS documents FROM d" for k, g in _TOP)}),
        k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY documents DESC, keyword) AS place FROM h WHERE documents > 0) SELECT family, keyword, documents, place FROM k WHERE place <= 2""",
)
def keyword_patterns(spark, sf_dir):
    from foldline.operators.patterns import top_keywords

    out = top_keywords(table(spark, sf_dir, "documents"), "text", {"alpha": ["the", "of", "and"], "beta": ["que", "les", "und", "der"]}, 2)
    return out.withColumn("place", F.col("place").cast("long"))


@query(
    "D27",
    """WITH c AS (SELECT page_id, lower(html) AS t FROM pages), m AS (SELECT page_id, contains(t, 'bert') AS bert, contains(t, 'gru') AS gru, contains(t, 'lgbm') AS gbm, CASE WHEN contains(t, 'kfold') THEN 'kfold' ELSE '' END AS cv FROM c)
       SELECT page_id, cv, CASE WHEN gru OR contains(t, 'lstm') OR contains(t, 'transformer') THEN 'deep_learning' WHEN gbm OR contains(t, 'xgb') OR contains(t, 'lightgbm') OR contains(t, 'catboost') THEN 'gradient_boosting' WHEN bert THEN 'nlp_transformer' ELSE 'traditional_ml' END AS approach FROM m JOIN c USING (page_id)""",
)
def solution_approaches(spark, sf_dir):
    from foldline.operators.patterns import mine_patterns

    return mine_patterns(table(spark, sf_dir, "pages").withColumnRenamed("html", "text"), "page_id", "text").select("page_id", "cv", "approach")


@query("F4", f"SELECT seq, 'popped' AS state FROM (SELECT seq FROM {_LED} WHERE NOT valid ORDER BY cv NULLS LAST, seq LIMIT 3) UNION ALL SELECT seq, 'left' FROM {_LED} WHERE NOT valid AND seq NOT IN (SELECT seq FROM {_LED} WHERE NOT valid ORDER BY cv NULLS LAST, seq LIMIT 3)")
def popped_reserves(spark, sf_dir):
    best, rest = L.pop_best(_ledger(spark, sf_dir).filter("NOT valid"), "cv", "minimize", "seq", 3)
    return best.select("seq", F.lit("popped").alias("state")).unionByName(rest.select("seq", F.lit("left").alias("state")))


@query("F6", "SELECT user_id, n FROM (SELECT user_id, n, row_number() OVER (ORDER BY n, user_id) - 1 AS pos, count(*) OVER () AS c FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)) WHERE pos IN (SELECT floor(k * (c - 1) / 5.0) FROM range(6) t(k), (SELECT count(DISTINCT user_id) AS c FROM events))")
def evenly_spaced_entities(spark, sf_dir):
    from foldline.operators.sequence import quantile_sample

    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return quantile_sample(counts, ["n", "user_id"], 6).select("user_id", "n")


# Experiment nodes: parts, whose parent is the part at half the key.
_NODES = "(SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, p_partkey % 3 = 0 AS buggy, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS metric FROM part WHERE p_partkey > 0)"


def _nodes(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_partkey > 0").select(
        k.alias("id"), F.when(k > 1, F.floor(k / 2)).alias("parent"), (k % 3 == 0).alias("buggy"), F.when(k % 5 != 0, F.col("p_retailprice")).alias("metric")
    )


@query(
    "N7",
    f"""WITH RECURSIVE n AS {_NODES}, t AS (SELECT id, id AS root, 0::BIGINT AS depth, id::VARCHAR AS path, 0::BIGINT AS debug_depth, buggy FROM n WHERE parent IS NULL
          UNION ALL SELECT n.id, t.root, t.depth + 1, t.path || '/' || n.id, CASE WHEN t.buggy THEN t.debug_depth + 1 ELSE 0 END, n.buggy FROM n JOIN t ON n.parent = t.id)
        SELECT id, root, depth, path, debug_depth FROM t""",
)
def experiment_tree(spark, sf_dir):
    return L.experiment_tree(_nodes(spark, sf_dir), "id", "parent", "buggy")


@query("N7 G3", f"SELECT id FROM {_NODES} WHERE id NOT IN (SELECT parent FROM {_NODES} WHERE parent IS NOT NULL)")
def leaf_experiments(spark, sf_dir):
    return L.leaf_nodes(_nodes(spark, sf_dir), "id", "parent").select("id")


@query("F8", f"SELECT id, metric FROM {_NODES} WHERE metric IS NOT NULL AND NOT buggy ORDER BY metric DESC, id LIMIT 1")
def best_experiment(spark, sf_dir):
    return L.best_node(_nodes(spark, sf_dir), "metric", "maximize", "buggy", "id").select("id", "metric")
