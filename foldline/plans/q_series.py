"""Time-series queries, on the plain window and on the chunked path for long or global series."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.operators import ranks as R
from foldline.operators import series as SE
from foldline.operators import windows as W
from foldline.plans.catalog import query, rounded, sql_rounded, table
from foldline.plans.stand_ins import ENTITY_SQL, OOF_SQL, entities, oof
from foldline.sources.tables import head_sample, tail_fraction

ORDER = ["ts", "event_id"]
# Events with every seventh value missing.
EV = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 3 THEN value END AS v FROM events)"
BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 3, F.col("value")).alias("v")
    )


def _keep(df, *cols):
    return rounded(df.select("event_id", *cols))


def _lag_sql(over: str) -> str:
    return "SELECT event_id, " + ", ".join(f"lag(v, {k}) OVER ({over}) AS v_lag_{k}" for k in W.LAGS) + f" FROM {EV}"


@query("E1", _lag_sql(BY_USER))
def lags_by_user(spark, sf_dir):
    out = W.lag_features(_events(spark, sf_dir), ["v"], order=ORDER, part=["user_id"])
    return _keep(out, *[f"v_lag_{k}" for k in W.LAGS])


@query("E1 P1 P3", _lag_sql("ORDER BY ts, event_id"))
def lags_global(spark, sf_dir):
    out = W.lag_features(_events(spark, sf_dir), ["v"], order=ORDER, chunk_rows=997)
    return _keep(out, *[f"v_lag_{k}" for k in W.LAGS])


def _roll_sql(over: str) -> str:
    cols = []
    for n in W.WINDOWS:
        f = f"OVER ({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols += [f"round(avg(v) {f}, 9) AS v_roll_mean_{n}", f"round(stddev_samp(v) {f}, 9) AS v_roll_std_{n}",
                 f"min(v) {f} AS v_roll_min_{n}", f"max(v) {f} AS v_roll_max_{n}"]
    return f"SELECT event_id, {', '.join(cols)} FROM {EV}"


_ROLL = [f"v_roll_{k}_{n}" for n in W.WINDOWS for k in ("mean", "std", "min", "max")]


@query("E2", _roll_sql(BY_USER))
def rolling_by_user(spark, sf_dir):
    return rounded(W.rolling_stats(_events(spark, sf_dir), ["v"], order=ORDER, part=["user_id"]).select("event_id", *_ROLL), 9)


@query("E2 P3", _roll_sql("ORDER BY ts, event_id"))
def rolling_global(spark, sf_dir):
    return rounded(W.rolling_stats(_events(spark, sf_dir), ["v"], order=ORDER, chunk_rows=1000).select("event_id", *_ROLL), 9)


def _full(agg: str, col: str, n: int, over: str = BY_USER) -> str:
    f = f"OVER ({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {f} >= {n} THEN {agg}({col}) {f} END"


_RSI = f"""SELECT event_id, round(100 - 100 / (1 + g / nullif(l, 0)), 6) AS value_rsi_14 FROM (
    SELECT event_id, {_full('avg', 'gain', 14)} AS g, {_full('avg', 'loss', 14)} AS l FROM (
      SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0 END AS loss FROM (
        SELECT *, value - lag(value) OVER ({BY_USER}) AS d FROM events)))"""


@query("E3", _RSI)
def relative_strength(spark, sf_dir):
    return _keep(W.rsi(table(spark, sf_dir, "events"), "value", order=ORDER, part=["user_id"]), "value_rsi_14")


def _ema_sql(col: str, span: int, src: str) -> str:
    """All-pairs definition of the exponential mean within a user."""
    b = 1 - 2 / (span + 1)
    return f"""SELECT a.event_id, sum(pow({b!r}, a.pos - b.pos) * b.x) / sum(CASE WHEN b.x IS NOT NULL THEN pow({b!r}, a.pos - b.pos) END) AS m
        FROM (SELECT event_id, user_id, {col} AS x, row_number() OVER ({BY_USER}) AS pos FROM {src}) a
        JOIN (SELECT user_id, {col} AS x, row_number() OVER ({BY_USER}) AS pos FROM {src}) b ON a.user_id = b.user_id AND b.pos <= a.pos GROUP BY a.event_id"""


@query(
    "E4 P5",
    f"""SELECT a.event_id, round(a.m, 6) AS ema_5, round(b.m, 6) AS ema_50 FROM ({_ema_sql('v', 5, EV)}) a JOIN ({_ema_sql('v', 50, EV)}) b USING (event_id)""",
)
def exponential_means(spark, sf_dir):
    out = SE.ema(_events(spark, sf_dir), {"ema_5": (F.col("v"), 5), "ema_50": (F.col("v"), 50)}, ORDER, ["user_id"])
    return _keep(out, "ema_5", "ema_50")


_GEMA = """SELECT event_id, round(sum(pow(0.8, a.pos - b.pos) * b.v) / sum(CASE WHEN b.v IS NOT NULL THEN pow(0.8, a.pos - b.pos) END), 6) AS ema_9 FROM
    (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events) a JOIN
    (SELECT v, row_number() OVER (ORDER BY ts, event_id) AS pos FROM {ev}) b ON b.pos BETWEEN a.pos - 260 AND a.pos GROUP BY event_id"""


@query("E4 P5", _GEMA.format(ev=EV))
def exponential_mean_global(spark, sf_dir):
    """One series over the whole table; the SQL side sums the 260 rows that still count in a double."""
    return _keep(SE.ema(_events(spark, sf_dir), {"ema_9": (F.col("v"), 9)}, ORDER), "ema_9")


@query(
    "E5",
    f"""WITH m AS (SELECT e.event_id, e.user_id, e.ts, a.m - b.m AS macd FROM events e JOIN ({_ema_sql('value', 12, 'events')}) a USING (event_id) JOIN ({_ema_sql('value', 26, 'events')}) b USING (event_id))
        SELECT event_id, round(macd, 6) AS value_macd, round(s.m, 6) AS value_macd_signal FROM m JOIN ({_ema_sql('macd', 9, 'm')}) s USING (event_id)""",
)
def macd_signal(spark, sf_dir):
    return _keep(W.macd(table(spark, sf_dir, "events"), "value", order=ORDER, part=["user_id"]), "value_macd", "value_macd_signal")


@query(
    "E6",
    sql_rounded(
        f"""SELECT event_id, m + 2 * s AS value_bb_upper, m - 2 * s AS value_bb_lower, 4 * s / nullif(m, 0) AS value_bb_width FROM
            (SELECT event_id, {_full('avg', 'value', 20)} AS m, {_full('stddev_samp', 'value', 20)} AS s FROM events)""",
        "event_id", ["value_bb_upper", "value_bb_lower", "value_bb_width"],
    ),
)
def bollinger_bands(spark, sf_dir):
    out = W.bollinger(table(spark, sf_dir, "events"), "value", order=ORDER, part=["user_id"])
    return _keep(out, "value_bb_upper", "value_bb_lower", "value_bb_width")


@query(
    "E7",
    f"""SELECT s.event_id, round(s5, 6) AS value_sma_5, round(s20, 6) AS value_sma_20, round(a.m, 6) AS value_ema_5, round(b.m, 6) AS value_ema_20 FROM
        (SELECT event_id, {_full('avg', 'value', 5)} AS s5, {_full('avg', 'value', 20)} AS s20 FROM events) s
        JOIN ({_ema_sql('value', 5, 'events')}) a USING (event_id) JOIN ({_ema_sql('value', 20, 'events')}) b USING (event_id)""",
)
def moving_averages(spark, sf_dir):
    out = W.moving_averages(table(spark, sf_dir, "events"), "value", (5, 20), order=ORDER, part=["user_id"])
    return _keep(out, "value_sma_5", "value_sma_20", "value_ema_5", "value_ema_20")


_PAD = f"(SELECT event_id, user_id, ts, last_value(v IGNORE NULLS) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM {EV})"


@query(
    "E8",
    f"""SELECT event_id, round(p / nullif(lag(p, 1) OVER ({BY_USER}), 0) - 1, 6) AS v_return_1,
        round(p / nullif(lag(p, 5) OVER ({BY_USER}), 0) - 1, 6) AS v_return_5 FROM {_PAD}""",
)
def returns_with_padding(spark, sf_dir):
    return _keep(W.pct_change(_events(spark, sf_dir), "v", order=ORDER, part=["user_id"]), "v_return_1", "v_return_5")


_RET = f"(SELECT event_id, user_id, ts, value / nullif(lag(value) OVER ({BY_USER}), 0) - 1 AS r FROM events)"


@query("E9", f"SELECT event_id, round({_full('stddev_samp', 'r', 10)}, 6) AS volatility_10, round({_full('stddev_samp', 'r', 20)}, 6) AS volatility_20 FROM {_RET}")
def return_volatility(spark, sf_dir):
    out = W.return_volatility(table(spark, sf_dir, "events"), "value", order=ORDER, part=["user_id"])
    return _keep(out, "volatility_10", "volatility_20")


_TECH = ["value_rsi_14", "value_bb_width", "value_sma_50", "value_return_5", "value_volatility_20"]


@query(
    "E3 E6 E7 E8 E9 P-4",
    f"""SELECT event_id, value_rsi_14, round(4 * s / nullif(m, 0), 6) AS value_bb_width, round(s50, 6) AS value_sma_50, round(r5, 6) AS value_return_5, round(v20, 6) AS value_volatility_20 FROM ({_RSI})
        JOIN (SELECT event_id, {_full('avg', 'value', 20)} AS m, {_full('stddev_samp', 'value', 20)} AS s, {_full('avg', 'value', 50)} AS s50,
              value / nullif(lag(value, 5) OVER ({BY_USER}), 0) - 1 AS r5 FROM events) USING (event_id)
        JOIN (SELECT event_id, {_full('stddev_samp', 'r', 20)} AS v20 FROM {_RET}) USING (event_id)""",
)
def technical_indicators(spark, sf_dir):
    return _keep(W.technical_indicators(table(spark, sf_dir, "events"), "value", order=ORDER, part=["user_id"]), *_TECH)


_OHLC = "(SELECT event_id, user_id, ts, value AS close, value + event_id % 5 AS high, value - event_id % 3 AS low, (10 + event_id % 13)::DOUBLE AS volume FROM events)"


def _ohlc(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.col("value").alias("close"), (F.col("value") + e % 5).alias("high"),
        (F.col("value") - e % 3).alias("low"), (10 + e % 13).cast("double").alias("volume"),
    )


_CRET = f"(SELECT event_id, user_id, ts, close / nullif(lag(close) OVER ({BY_USER}), 0) - 1 AS r FROM {_OHLC})"
_RV = f"(SELECT event_id, user_id, ts, {_full('stddev_samp', 'r', 5)} * sqrt(252) AS rv5, {_full('stddev_samp', 'r', 20)} * sqrt(252) AS rv20 FROM {_CRET})"


@query(
    "E10 E11 E12",
    f"""SELECT a.event_id, round(true_range, 6) AS true_range, round(atr, 6) AS atr_14, round(rv5, 6) AS realized_vol_5, round(rv20, 6) AS realized_vol_20, round(vov, 6) AS vol_of_vol,
          round(vs, 6) AS volume_sma_10, round(volume / vs, 6) AS volume_ratio FROM
        (SELECT event_id, true_range, {_full('avg', 'true_range', 14)} AS atr, volume, {_full('avg', 'volume', 10)} AS vs FROM (SELECT *, high - low AS true_range FROM {_OHLC})) a
        JOIN (SELECT event_id, rv5, rv20, {_full('stddev_samp', 'rv20', 20)} AS vov FROM {_RV}) b USING (event_id)""",
)
def price_volatility(spark, sf_dir):
    out = W.volatility(_ohlc(spark, sf_dir), "high", "low", "close", "volume", ORDER, ["user_id"])
    return _keep(out, "true_range", "atr_14", "realized_vol_5", "realized_vol_20", "vol_of_vol", "volume_sma_10", "volume_ratio")


@query(
    "E10 E11 E12 P3",
    f"""SELECT event_id, round(rv20, 6) AS realized_vol_20, round(vov, 6) AS vol_of_vol FROM (
        SELECT event_id, rv20, {_full('stddev_samp', 'rv20', 20, 'ORDER BY ts, event_id')} AS vov FROM (
          SELECT event_id, ts, {_full('stddev_samp', 'r', 20, 'ORDER BY ts, event_id')} * sqrt(252) AS rv20 FROM (
            SELECT event_id, ts, close / nullif(lag(close) OVER (ORDER BY ts, event_id), 0) - 1 AS r FROM {_OHLC})))""",
)
def realized_volatility_global(spark, sf_dir):
    out = W.realized_vol(_ohlc(spark, sf_dir), "close", order=ORDER, chunk_rows=777)
    return _keep(out, "realized_vol_20", "vol_of_vol")


# ---------------------------------------------------------------- entities

_E = "PARTITION BY entity ORDER BY row_index"
_SEEN = "CASE WHEN row_index % 5 IN (0, 1) THEN truth END"
_GAPPED = f"(SELECT *, {_SEEN} AS gv FROM {ENTITY_SQL})"


def _gapped(spark, sf_dir):
    return entities(spark, sf_dir).withColumn("gv", F.when(F.col("row_index") % 5 < 2, F.col("truth")))


_PREV = f"last_value({{}} IGNORE NULLS) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = f"first_value({{}} IGNORE NULLS) OVER ({_E} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_MD = "CASE WHEN gv IS NOT NULL THEN md END"
_GAP_SQL = f"""SELECT entity, row_index, pv AS prev_value, nv AS next_value, pm AS prev_coord, nm AS next_coord, md - pm AS since_prev, nm - md AS until_next, nm - pm AS gap_span,
    round((md - pm) / nullif(nm - pm, 0), 6) AS gap_fraction FROM (SELECT *, {_PREV.format('gv')} AS pv, {_NEXT.format('gv')} AS nv, {_PREV.format(_MD)} AS pm, {_NEXT.format(_MD)} AS nm FROM {_GAPPED})"""
_GAPC = ["prev_value", "next_value", "prev_coord", "next_coord", "since_prev", "until_next", "gap_span", "gap_fraction"]


@query("E13", _GAP_SQL)
def gap_geometry(spark, sf_dir):
    out = W.gap_features(_gapped(spark, sf_dir), "gv", "md", ["row_index"], ["entity"])
    return rounded(out.select("entity", "row_index", *_GAPC))


@query("E13", _GAP_SQL)
def gap_geometry_chunked(spark, sf_dir):
    """The same through chunk carries, as for entities too long for one task."""
    out = W.gap_features(_gapped(spark, sf_dir), "gv", "md", ["row_index"], ["entity"], chunk_rows=17)
    return rounded(out.select("entity", "row_index", *_GAPC))


@query(
    "E14",
    f"""SELECT entity, row_index, round((z - lag(z) OVER ({_E})) / nullif(md - lag(md) OVER ({_E}), 0), 6) AS z_rate,
        round((gr - lag(gr) OVER ({_E})) / nullif(md - lag(md) OVER ({_E}), 0), 6) AS gr_rate FROM {ENTITY_SQL}""",
)
def rates_of_change(spark, sf_dir):
    out = W.rate_of_change(entities(spark, sf_dir), ["z", "gr"], "md", ["row_index"], ["entity"])
    return rounded(out.select("entity", "row_index", "z_rate", "gr_rate"))


def _centred_sql() -> str:
    cols = []
    for n in (5, 21):
        f = f"OVER ({_E} ROWS BETWEEN {n // 2} PRECEDING AND {n // 2} FOLLOWING)"
        cols += [f"round(avg(gr) {f}, 9) AS gr_cmean_{n}", f"round(stddev_samp(gr) {f}, 9) AS gr_cstd_{n}"]
    return f"SELECT entity, row_index, {', '.join(cols)} FROM {ENTITY_SQL}"


_CENT = [f"gr_c{k}_{n}" for n in (5, 21) for k in ("mean", "std")]


@query("E15", _centred_sql())
def centred_windows(spark, sf_dir):
    out = W.centered_rolling(entities(spark, sf_dir), "gr", order=["row_index"], part=["entity"])
    return rounded(out.select("entity", "row_index", *_CENT), 9)


@query("E15 P3", _centred_sql())
def centred_windows_chunked(spark, sf_dir):
    out = W.centered_rolling(entities(spark, sf_dir), "gr", order=["row_index"], part=["entity"], chunk_rows=23)
    return rounded(out.select("entity", "row_index", *_CENT), 9)


@query(
    "E16",
    f"""WITH e AS {ENTITY_SQL}, a AS (SELECT entity, arg_max(seen, row_index) FILTER (WHERE seen IS NOT NULL) AS anchor_seen, arg_max(md, row_index) FILTER (WHERE seen IS NOT NULL) AS anchor_md, arg_max(z, row_index) FILTER (WHERE seen IS NOT NULL) AS anchor_z,
          count(seen) AS prefix_rows, count(*) - count(seen) AS suffix_rows, avg(seen) AS prefix_mean, stddev_samp(seen) AS prefix_std,
          avg(md) FILTER (WHERE seen IS NULL) AS suffix_md_mean, stddev_samp(md) FILTER (WHERE seen IS NULL) AS suffix_md_std,
          avg(z) FILTER (WHERE seen IS NULL) AS suffix_z_mean, stddev_samp(z) FILTER (WHERE seen IS NULL) AS suffix_z_std FROM e GROUP BY entity)
        SELECT entity, row_index, anchor_seen, anchor_md, anchor_z, prefix_rows, suffix_rows, round(prefix_mean, 6) AS prefix_mean, round(prefix_std, 6) AS prefix_std, round(suffix_md_mean, 6) AS suffix_md_mean,
          round(suffix_md_std, 6) AS suffix_md_std, round(suffix_z_mean, 6) AS suffix_z_mean, round(suffix_z_std, 6) AS suffix_z_std, md - anchor_md AS md_since_anchor, z - anchor_z AS z_since_anchor FROM e JOIN a USING (entity)""",
)
def anchor_offsets(spark, sf_dir):
    out = W.anchor_features(entities(spark, sf_dir), "seen", ["md", "z"], "entity", ["row_index"])
    return rounded(out.drop("md", "z", "gr", "truth", "seen"))


@query(
    "E16",
    f"""WITH e AS {ENTITY_SQL} SELECT entity, row_index, round(lo, 6) AS curve_min, round(hi, 6) AS curve_max, round(mean, 6) AS curve_mean, round(sd, 6) AS curve_std, round(hi - lo, 6) AS curve_range
        FROM e JOIN (SELECT entity, min(gr) lo, max(gr) hi, avg(gr) mean, stddev_samp(gr) sd FROM e WHERE row_index % 2 = 0 GROUP BY entity) USING (entity)""",
)
def curve_summary(spark, sf_dir):
    e = entities(spark, sf_dir)
    out = W.curve_features(e.select("entity", "row_index"), e.filter("row_index % 2 = 0"), "entity", "gr")
    return rounded(out)


@query(
    "E19",
    f"""SELECT entity, row_index, round(q, 6) AS progress, round(greatest(0, 1 - 5 * q), 6) AS taper, round(z + greatest(0, 1 - 5 * q) * (gr - z), 9) AS tapered FROM
        (SELECT *, (row_index - min(row_index) OVER (PARTITION BY entity))::DOUBLE / (max(row_index) OVER (PARTITION BY entity) - min(row_index) OVER (PARTITION BY entity)) AS q FROM {ENTITY_SQL} WHERE seen IS NULL)""",
)
def progress_taper(spark, sf_dir):
    e = entities(spark, sf_dir).filter("seen IS NULL")
    out = W.tapered_stream(W.progress(e, "entity", "row_index", 5.0), "z", "gr")
    return out.select("entity", "row_index", F.round("progress", 6).alias("progress"), F.round("taper", 6).alias("taper"), F.round("tapered", 9).alias("tapered"))


@query("E19", f"SELECT count(*) AS broken FROM {ENTITY_SQL} WHERE false")
def progress_endpoints(spark, sf_dir):
    q = W.progress(entities(spark, sf_dir).filter("seen IS NULL"), "entity", "row_index")
    return W.progress_audit(q, "entity").agg(F.count("*").alias("broken"))


# ---------------------------------------------------------------- positions, ranks and running values


@query("P1 E30", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, format('sub_{:06d}', row_number() OVER (ORDER BY o_orderdate, o_orderkey)) AS seq_id FROM orders")
def sequential_ids(spark, sf_dir):
    from foldline.operators.ledger import assign_ids

    out = assign_ids(table(spark, sf_dir, "orders"), "sub_", ["o_orderdate", "o_orderkey"], width=6)
    return out.select("o_orderkey", "pos", "seq_id")


@query("P1", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def positions_in_large_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return SE.ordered_positions(o, ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "pos")


@query("A4", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def head_with_total(spark, sf_dir):
    return head_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100).drop("o_orderdate")


@query("B6", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) WHERE pos >= floor(n * (1 - 0.3))")
def latest_rows(spark, sf_dir):
    return tail_fraction(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 0.3).select("o_orderkey")


_AVG_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE"


@query("P2", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_AVG_RANK.format(c='l_quantity')} AS rank FROM lineitem")
def average_ranks(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return R.average_rank(table(spark, sf_dir, "lineitem").select(*keys, "l_quantity"), "l_quantity").drop("l_quantity")


@query("E20", f"SELECT o_orderkey, round(({_AVG_RANK.format(c='o_custkey')} - 0.5) / (SELECT count(*) FROM orders) * 2 - 1, 8) AS o_custkey_rank FROM orders")
def rank_normalised(spark, sf_dir):
    return rounded(R.rank_normalize(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey").drop("o_custkey"), 8)


def _gauss_sql() -> str:
    from foldline.functions.normal import probit_sql

    return f"""SELECT id, round({probit_sql('p')}, 6) AS pc_gauss FROM (SELECT id, ({_AVG_RANK.format(c='pc')} - 0.5) / (SELECT count(*) FROM orders) AS p FROM {OOF_SQL})"""


@query("E21", _gauss_sql())
def normal_scores(spark, sf_dir):
    return rounded(R.rank_gauss(oof(spark, sf_dir).select("id", "pc"), "pc").drop("pc"))


def _ecdf_sql() -> str:
    from foldline.functions.normal import probit_sql

    return f"""WITH o AS {OOF_SQL}, r AS (SELECT pc AS v FROM o WHERE fold <> 0), n AS (SELECT id, pc FROM o WHERE fold = 0),
      c AS (SELECT pc, (SELECT count(*) FROM r WHERE v < pc) AS below FROM (SELECT DISTINCT pc FROM n)),
      p AS (SELECT id, least(greatest((below + 0.5) / (SELECT count(*) FROM r), 1e-6), 1 - 1e-6) AS p FROM n JOIN c USING (pc))
      SELECT id, round({probit_sql('p')}, 6) AS pc_gauss FROM p"""


@query("E22", _ecdf_sql())
def ecdf_mapping(spark, sf_dir):
    o = oof(spark, sf_dir)
    return rounded(R.ecdf_map(o.filter("fold <> 0").select("pc"), o.filter("fold = 0").select("id", "pc"), "pc").drop("pc"))


@query("E23", f"WITH o AS {OOF_SQL}, s AS (SELECT avg(pa) m, stddev_pop(pa) d FROM o WHERE fold <> 0) SELECT id, round((pa - m) / d, 6) AS pa_z FROM o, s")
def zscores(spark, sf_dir):
    o = oof(spark, sf_dir)
    return rounded(R.zscore(o.select("id", "pa"), "pa", o.filter("fold <> 0")).drop("pa"))


@query(
    "E24",
    """WITH p AS (SELECT o_orderkey, pow(0.5, 1 - (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) / ((SELECT count(*) FROM orders) - 1)::DOUBLE) AS w FROM orders)
       SELECT o_orderkey, round(w * (SELECT count(*) FROM orders) / (SELECT sum(w) FROM p), 6) AS weight FROM p""",
)
def decay_weights(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rounded(R.time_decay_weights(o, 0.5, ["o_orderdate", "o_orderkey"]).drop("o_orderdate"))


_RUN = """SELECT o_orderkey, min(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS best,
    sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS before FROM orders"""


@query("E28", _RUN)
def running_values_global(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_custkey")
    order = ["o_orderdate", "o_orderkey"]
    o = SE.running(o, {"best": ("min", F.col("o_totalprice"))}, order, chunk_rows=1000)
    o = SE.running(o, {"before": ("sum", F.col("o_custkey"))}, order, exclusive=True, chunk_rows=1000)
    return o.select("o_orderkey", "best", "before")
