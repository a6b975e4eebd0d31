"""Row, group and text feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.functions import scalar as SC
from foldline.functions import textual as TX
from foldline.operators import features as FE
from foldline.operators.ranks import exact_quantiles
from foldline.plans.catalog import query, rounded, table


@query(
    "D10",
    """SELECT event_id, round((coalesce(v, 0) + user_id) / n, 6) AS row_mean,
         CASE WHEN n > 1 THEN round(abs(v - user_id) / sqrt(2), 6) END AS row_std, greatest(v, user_id) AS row_max, least(v, user_id) AS row_min,
         CASE WHEN v IS NULL THEN 1 ELSE 0 END::BIGINT AS row_null_count
       FROM (SELECT event_id, user_id::DOUBLE AS user_id, v, CASE WHEN v IS NULL THEN 1 ELSE 2 END AS n FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events))""",
)
def row_statistics(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    out = FE.row_stats(ev, ["user_id", "v"])
    return rounded(out.select("event_id", "row_mean", "row_std", "row_max", "row_min", "row_null_count"))


@query(
    "H1",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * l_extendedprice, 6) AS l_quantity_x_l_extendedprice, round(l_quantity / nullif(l_extendedprice, 0), 6) AS l_quantity_div_l_extendedprice,
       round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax, round(l_quantity / nullif(l_tax, 0), 6) AS l_quantity_div_l_tax,
       round(l_extendedprice * l_tax, 6) AS l_extendedprice_x_l_tax, round(l_extendedprice / nullif(l_tax, 0), 6) AS l_extendedprice_div_l_tax FROM lineitem""",
)
def pairwise_interactions(spark, sf_dir):
    out = FE.interactions(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(out.select(*keys, *[c for c in out.columns if "_x_" in c or "_div_" in c]))


@query("H2", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS v_is_null FROM events")
def null_flags(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return FE.null_indicators(ev).drop("v")


@query(
    "D11",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS seg FROM customer)
       SELECT c_custkey, round(n::DOUBLE / (SELECT count(seg) FROM c), 6) AS seg_freq FROM c LEFT JOIN (SELECT seg, count(*) n FROM c WHERE seg IS NOT NULL GROUP BY seg) USING (seg)""",
)
def frequency_encoding(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("seg"))
    return rounded(FE.freq_encode(c, ["seg"]).drop("seg"))


@query(
    "D9",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE WHEN l_orderkey % 13 <> 0 THEN l_returnflag END AS flag FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(qm, 6) AS flag_l_quantity_mean, round(qs, 6) AS flag_l_quantity_std, round(em, 4) AS flag_l_extendedprice_mean, round(es, 4) AS flag_l_extendedprice_std
       FROM l LEFT JOIN (SELECT flag, avg(l_quantity) qm, stddev_samp(l_quantity) qs, avg(l_extendedprice) em, stddev_samp(l_extendedprice) es FROM l WHERE flag IS NOT NULL GROUP BY flag) USING (flag)""",
)
def group_statistics(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = table(spark, sf_dir, "lineitem").withColumn("flag", F.when(F.col("l_orderkey") % 13 != 0, F.col("l_returnflag")))
    out = FE.group_stats(li.select(*keys, "flag", "l_quantity", "l_extendedprice"), ["flag"], ["l_quantity", "l_extendedprice"])
    return out.select(
        *keys, *[F.round(f"flag_l_quantity_{k}", 6).alias(f"flag_l_quantity_{k}") for k in ("mean", "std")],
        *[F.round(f"flag_l_extendedprice_{k}", 4).alias(f"flag_l_extendedprice_{k}") for k in ("mean", "std")],
    )


_WS = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}"
_COUNT = "len(regexp_extract_all(text, '{}'))"
_WORDS = _COUNT.format(f"[^{_WS}]+")


@query(
    "H3",
    f"""SELECT doc_id, length(text) AS text_len, {_WORDS}::BIGINT AS text_word_count, {_COUNT.format('[.!?]+')}::BIGINT AS text_sentence_count,
        round(length(text) / greatest({_WORDS}, 1)::DOUBLE, 6) AS text_avg_word_len, round({_COUNT.format('[A-Z]')} / greatest(length(text), 1)::DOUBLE, 6) AS text_uppercase_ratio,
        round({_COUNT.format(chr(92) + 'p{Nd}')} / greatest(length(text), 1)::DOUBLE, 6) AS text_digit_ratio,
        round({_COUNT.format(f'[^a-zA-Z0-9{_WS}]')} / greatest(length(text), 1)::DOUBLE, 6) AS text_special_char_ratio FROM documents""",
)
def text_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rounded(FE.text_stats(docs, ["text", "lang"]).drop("text", "lang"))


@query("H4", f"SELECT conv_id, turn, round({_WORDS} * 1.3::DOUBLE, 6) AS text_approx_tokens FROM conversations")
def approximate_tokens(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return rounded(FE.token_count(turns).drop("text"))


_PEOPLE = """(SELECT c_custkey AS "PassengerId", (1 + c_custkey % 3)::INTEGER AS "Pclass",
    'X' || c_custkey || ', ' || CASE c_custkey % 6 WHEN 0 THEN 'Mr. A' WHEN 1 THEN 'Miss. B' WHEN 2 THEN 'Dr. C' WHEN 3 THEN 'Lady. D' WHEN 4 THEN 'Zz. E' ELSE 'none' END AS "Name",
    CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS "Sex", CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 7 % 103)::DOUBLE END AS "Age",
    (c_custkey % 4)::INTEGER AS "SibSp", (c_custkey % 3)::INTEGER AS "Parch", 'T' || (c_custkey // 3) AS "Ticket", CASE WHEN c_custkey % 4 = 1 THEN chr((65 + c_custkey % 9)::INTEGER) || c_custkey END AS "Cabin",
    CASE WHEN c_custkey % 17 <> 0 THEN abs(c_acctbal) END AS "Fare", CASE c_custkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'C' WHEN 2 THEN 'Q' END AS "Embarked" FROM customer)"""


def _people(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, "Mr. A").when(k % 6 == 1, "Miss. B").when(k % 6 == 2, "Dr. C").when(k % 6 == 3, "Lady. D").when(k % 6 == 4, "Zz. E").otherwise("none")
    return table(spark, sf_dir, "customer").select(
        k.alias("PassengerId"), (1 + k % 3).cast("int").alias("Pclass"), F.concat(F.lit("X"), k.cast("string"), F.lit(", "), name).alias("Name"),
        F.when(k % 2 == 0, "male").otherwise("female").alias("Sex"), F.when(k % 5 != 0, (k * 7 % 103).cast("double")).alias("Age"),
        (k % 4).cast("int").alias("SibSp"), (k % 3).cast("int").alias("Parch"), F.concat(F.lit("T"), F.floor(k / 3).cast("string")).alias("Ticket"),
        F.when(k % 4 == 1, F.concat(F.char(65 + k % 9), k.cast("string"))).alias("Cabin"),
        F.when(k % 17 != 0, F.abs("c_acctbal")).alias("Fare"),
        F.when(k % 4 == 0, "S").when(k % 4 == 1, "C").when(k % 4 == 2, "Q").alias("Embarked"),
    )


@query(
    "H5 H6 H7 H10 H11 C6",
    f"""WITH p AS (SELECT *, regexp_extract("Name", ' ([A-Za-z]+)\\.', 1) AS title FROM {_PEOPLE}),
      g AS (SELECT *, CASE title WHEN 'Mr' THEN 0 WHEN 'Miss' THEN 1 WHEN 'Dr' THEN 4 WHEN 'Lady' THEN 5 ELSE 6 END::INTEGER AS "TitleGroup_enc" FROM p),
      m AS (SELECT "TitleGroup_enc", median("Age") AS med FROM g GROUP BY 1),
      a AS (SELECT g.*, coalesce("Age", med) AS "AgeFilled", "SibSp" + "Parch" + 1 AS "FamilySize" FROM g LEFT JOIN m USING ("TitleGroup_enc")),
      t AS (SELECT "Ticket", count(*) AS n FROM p GROUP BY 1),
      b AS (SELECT a.*, CASE WHEN "AgeFilled" > 0 AND "AgeFilled" <= 5 THEN 0 WHEN "AgeFilled" > 5 AND "AgeFilled" <= 12 THEN 1 WHEN "AgeFilled" > 12 AND "AgeFilled" <= 18 THEN 2 WHEN "AgeFilled" > 18 AND "AgeFilled" <= 25 THEN 3
          WHEN "AgeFilled" > 25 AND "AgeFilled" <= 35 THEN 4 WHEN "AgeFilled" > 35 AND "AgeFilled" <= 50 THEN 5 WHEN "AgeFilled" > 50 AND "AgeFilled" <= 65 THEN 6 WHEN "AgeFilled" > 65 AND "AgeFilled" <= 100 THEN 7 ELSE 3 END::DOUBLE AS "AgeBin",
          coalesce("Fare", (SELECT median("Fare") FROM p)) AS paid, CASE WHEN "Sex" = 'male' THEN 1 ELSE 0 END AS "Sex_enc" FROM a)
      SELECT "PassengerId", "TitleGroup_enc", "Sex_enc", "AgeFilled", "AgeBin", ("AgeFilled" <= 12)::INTEGER AS "IsChild", ("AgeFilled" >= 60)::INTEGER AS "IsElderly",
        "FamilySize", ("FamilySize" = 1)::INTEGER AS "IsAlone", ("FamilySize" BETWEEN 2 AND 4)::INTEGER AS "SmallFamily", ("FamilySize" >= 5)::INTEGER AS "LargeFamily",
        t.n AS "TicketGroupSize", (t.n > 1)::INTEGER AS "SharedTicket", ("Cabin" IS NOT NULL)::INTEGER AS "HasCabin",
        CASE WHEN "Cabin" IS NULL THEN 0.3 ELSE CASE left("Cabin", 1) WHEN 'A' THEN 0.47 WHEN 'B' THEN 0.74 WHEN 'C' THEN 0.59 WHEN 'D' THEN 0.76 WHEN 'E' THEN 0.75 WHEN 'F' THEN 0.62 WHEN 'G' THEN 0.5 WHEN 'T' THEN 0.0 ELSE 0.3 END END::DOUBLE AS "Deck_surv_rate",
        round(paid / greatest("FamilySize", 1), 6) AS "FarePerPerson", (paid > (SELECT quantile_cont(paid, 0.75) FROM b))::INTEGER AS "HighFare",
        (SELECT count(*) FROM (SELECT DISTINCT unnest(quantile_cont(b2.paid, [0, 1/6.0, 2/6.0, 3/6.0, 4/6.0, 5/6.0])) AS e FROM b b2) WHERE e < b.paid) AS below,
        CASE "Embarked" WHEN 'C' THEN 1 WHEN 'Q' THEN 2 ELSE 0 END AS "Embarked_enc", "Sex_enc" * 3 + "Pclass" AS "Sex_Pclass", "AgeBin" * 3 + "Pclass" AS "Age_Pclass",
        "FamilySize" * "Pclass" AS "FamilySize_Pclass", ("AgeFilled" <= 12 OR "Sex_enc" = 0)::INTEGER AS "Child_or_Female" FROM b JOIN t USING ("Ticket")""".replace(
        """(SELECT count(*) FROM (SELECT DISTINCT unnest(quantile_cont(b2.paid, [0, 1/6.0, 2/6.0, 3/6.0, 4/6.0, 5/6.0])) AS e FROM b b2) WHERE e < b.paid) AS below,""",
        """greatest(len(list_filter((SELECT quantile_cont(b2.paid, [0, 1/6.0, 2/6.0, 3/6.0, 4/6.0, 5/6.0, 1]) FROM b b2), lambda e: e < b.paid)) - 1, 0)::BIGINT AS "FareBin",""",
    ),
)
def passenger_recipe(spark, sf_dir):
    out = FE.build_features(_people(spark, sf_dir), FE.preset("titanic"))
    return rounded(out.drop("Pclass", "Name", "Sex", "Age", "SibSp", "Parch", "Ticket", "Cabin", "Fare", "Embarked"))


@query(
    "H8",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0, 1/6.0, 2/6.0, 3/6.0, 4/6.0, 5/6.0, 1]) AS e FROM lineitem)
       SELECT bin, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM
         (SELECT l_extendedprice, greatest(len(list_filter(e, lambda v: v < l_extendedprice)) - 1, 0)::BIGINT AS bin FROM lineitem, q) GROUP BY bin""",
)
def quantile_bins(spark, sf_dir):
    out = FE.bin_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 6, "bin")
    return out.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query(
    "H9",
    "SELECT o_orderkey, (o_totalprice > (SELECT quantile_cont(o_totalprice, 0.75) FROM orders))::INTEGER AS high FROM orders",
)
def above_quantile_flag(spark, sf_dir):
    return FE.above_quantile(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.75, "high").drop("o_totalprice")


@query(
    "H8 D34",
    """SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.5), 6) AS p50,
       round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM orders GROUP BY o_orderstatus""",
)
def distributed_quantiles(spark, sf_dir):
    """Exact group quantiles on the path for groups too large for one task."""
    q = exact_quantiles(table(spark, sf_dir, "orders"), "o_totalprice", (0.1, 0.5, 0.9), ["o_orderstatus"], task_rows=10)
    return rounded(q.select("o_orderstatus", *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("p10", "p50", "p90"))]))


@query(
    "H6",
    """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)
       SELECT event_id, round(coalesce(v, m), 6) AS v FROM e JOIN (SELECT event_type, median(v) AS m FROM e GROUP BY 1) USING (event_type)""",
)
def group_median_fill(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return rounded(FE.impute_group_median(ev, "v", "event_type").drop("event_type"))


@query(
    "H10",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n AS order_lines, (n > 1)::INTEGER AS order_lines_shared FROM lineitem JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) USING (l_orderkey)""",
)
def group_sizes(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return FE.group_size(table(spark, sf_dir, "lineitem").select(*keys), "l_orderkey", "order_lines")


@query(
    "H12 C6",
    """SELECT o_orderkey, 'c_' || o_custkey AS entity, o_orderkey AS row_index, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 9 END AS code FROM orders""",
)
def split_row_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    joined = SC.row_id(F.concat(F.lit("c_"), F.col("o_custkey").cast("string")), F.col("o_orderkey"))
    entity, row = SC.split_id(joined)
    return o.select("o_orderkey", entity.alias("entity"), row.alias("row_index"), SC.map_values(F.col("o_orderstatus"), {"F": 0, "O": 1}, 9).alias("code"))


@query(
    "H13",
    """SELECT o_orderkey, (o_orderdate::DATE = DATE '1996-03-01') AS on_day, (o_orderdate::DATE + 1)::VARCHAR AS reset FROM orders""",
)
def daily_reset(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", SC.same_day(iso, F.lit("1996-03-01")).alias("on_day"), SC.next_reset(iso).cast("string").alias("reset")
    )


@query(
    "H14",
    """SELECT event_id, round(ln(1 + abs(v)), 6) AS log_abs, round(sqrt(abs(v)), 6) AS root, sign(v)::DOUBLE AS side, round(exp(least(greatest(v / 100, -1), 1)), 6) AS grown,
       round(least(greatest((value - 100) / 200, 0), 1), 6) AS soft FROM (SELECT event_id, value, value - 100 AS v FROM events)""",
)
def elementwise_maths(spark, sf_dir):
    v = F.col("value") - 100
    return rounded(
        table(spark, sf_dir, "events").select(
            "event_id", F.log1p(F.abs(v)).alias("log_abs"), F.sqrt(F.abs(v)).alias("root"), F.signum(v).alias("side"),
            F.exp(F.least(F.greatest(v / 100, F.lit(-1.0)), F.lit(1.0))).alias("grown"), SC.soft_clip01(F.col("value"), 100, 200).alias("soft"),
        )
    )


@query(
    "H15",
    """WITH o AS (SELECT try_cast(CASE WHEN o_orderkey % 50 = 1 THEN 'no date' ELSE o_orderdate::DATE::VARCHAR END AS TIMESTAMP) AS day, o_totalprice, o_custkey::DOUBLE AS o_custkey FROM orders)
       SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS day, series, value FROM (SELECT day, 'o_totalprice' AS series, o_totalprice AS value FROM o UNION ALL SELECT day, 'o_custkey', o_custkey FROM o)""",
)
def melted_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 50 == 1, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey")
    )
    return FE.melt_series(o, "day", ["o_totalprice", "o_custkey"], "series").withColumn("day", F.date_format("day", "yyyy-MM-dd HH:mm:ss"))


_TURNS = """(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || ' {"turn": ' || turn || '} and {broken' WHEN 1 THEN 'Note ' || ' ```python' || chr(10) || 'x = ' || turn || chr(10) || '```' || text || '```' || chr(10) || 'y' || chr(10) || '```'
    WHEN 2 THEN 'cut {"k": ' || conv_id ELSE text END AS text FROM conversations)"""


def _turns(spark, sf_dir):
    t = F.col("turn")
    made = (
        F.when(t % 4 == 0, F.concat("text", F.lit(' {"turn": '), t.cast("string"), F.lit("} and {broken")))
        .when(t % 4 == 1, F.concat(F.lit("Note  ```python\nx = "), t.cast("string"), F.lit("\n```"), "text", F.lit("```\ny\n```")))
        .when(t % 4 == 2, F.concat(F.lit('cut {"k": '), F.col("conv_id").cast("string")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("text"))


@query(
    "H16",
    f"""WITH p AS (SELECT conv_id, turn, text, list_filter(regexp_extract_all(text, '(?s)\\{{.*?\\}}'), lambda s: json_valid(s)) AS a,
          list_filter(regexp_extract_all(text || '}}', '(?s)\\{{.*?\\}}'), lambda s: json_valid(s)) AS b FROM {_TURNS}),
        j AS (SELECT *, CASE WHEN len(a) > 0 OR ends_with(text, '}}') THEN a ELSE b END AS found FROM p)
        SELECT conv_id, turn, len(found)::BIGINT AS n_json, found[1] AS first_json,
          len(regexp_extract_all(text, '(?s)```(?:python)?\\n*(.*?)\\n*```', 1))::BIGINT AS n_code, regexp_extract_all(text, '(?s)```(?:python)?\\n*(.*?)\\n*```', 1)[1] AS first_code,
          CASE WHEN contains(text, '```') THEN trim(split_part(text, '```', 1)) ELSE '' END AS lead,
          CASE WHEN length(text) > 300 THEN left(text, 100) || chr(10) || ' ... [' || (length(text) - 200) || ' characters truncated] ... ' || chr(10) || right(text, 100) ELSE text END AS short FROM j""",
)
def transcript_blocks(spark, sf_dir):
    text = F.col("text")
    jsons, codes = TX.json_objects(text), TX.code_blocks(text)
    return _turns(spark, sf_dir).select(
        "conv_id", "turn", F.size(jsons).cast("long").alias("n_json"), F.try_element_at(jsons, F.lit(1)).alias("first_json"),
        F.size(codes).cast("long").alias("n_code"), F.try_element_at(codes, F.lit(1)).alias("first_code"),
        TX.before_fence(text).alias("lead"), TX.head_tail(text, 300, 100).alias("short"),
    )


@query(
    "P-1 P-2 P-4 B1",
    """WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 6 <> 1 THEN c_acctbal END AS bal, c_mktsegment FROM customer),
        r AS (SELECT *, (c_custkey + c_nationkey + coalesce(bal, 0)) / (CASE WHEN bal IS NULL THEN 2 ELSE 3 END) AS m FROM c)
       SELECT c_custkey, round(m, 6) AS row_mean, CASE WHEN bal IS NULL THEN 1 ELSE 0 END::BIGINT AS row_null_count, round(c_custkey * c_nationkey::DOUBLE, 6) AS c_custkey_x_c_nationkey,
         round(c_custkey / nullif(bal, 0), 6) AS c_custkey_div_bal, round(n::DOUBLE / (SELECT count(*) FROM c), 6) AS c_mktsegment_freq, CASE WHEN bal IS NULL THEN 1 ELSE 0 END AS bal_is_null
       FROM r JOIN (SELECT c_mktsegment, count(*) AS n FROM c GROUP BY 1) USING (c_mktsegment)""",
)
def tabular_preset(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 6 != 1, F.col("c_acctbal")).alias("bal"), "c_mktsegment"
    )
    built = FE.build_features(c, ["null_indicator"])
    out = FE.interactions(FE.row_stats(built.drop("bal_is_null")).withColumn("bal_is_null", F.col("bal").isNull().cast("int")), ["c_custkey", "c_nationkey", "bal"])
    out = FE.freq_encode(out, ["c_mktsegment"])
    return rounded(out.select("c_custkey", "row_mean", "row_null_count", "c_custkey_x_c_nationkey", "c_custkey_div_bal", "c_mktsegment_freq", "bal_is_null"))


@query("P-4 H3 H4", f"SELECT conv_id, turn, length(text) AS text_len, {_WORDS}::BIGINT AS text_word_count, round({_WORDS} * 1.3::DOUBLE, 6) AS text_approx_tokens FROM conversations")
def text_preset(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = FE.build_features(turns, FE.preset("text"))
    return rounded(out.select("conv_id", "turn", "text_len", "text_word_count", "text_approx_tokens"))


@query(
    "P-2 P-4 E1 E2",
    """SELECT event_id, lag(value, 3) OVER w AS value_lag_3, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS value_roll_min_10 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def series_preset(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = FE.build_features(ev, FE.preset("crypto")[:2], order=["ts", "event_id"], part=["user_id"])
    return out.select("event_id", "value_lag_3", "value_roll_min_10")


@query(
    "P-2 P-4 E1 E2 E7 E8 E10 E12",
    """WITH e AS (SELECT event_id, user_id, ts, value AS close, value + event_id % 5 AS high, value - event_id % 3 AS low, (event_id % 100)::DOUBLE AS volume FROM events),
         f AS (SELECT *, lag(close, 3) OVER w AS close_lag_3, lag(volume, 1) OVER w AS volume_lag_1, min(high) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS high_roll_min_10,
           CASE WHEN count(*) OVER w5 = 5 THEN avg(close) OVER w5 END AS close_sma_5, close / nullif(lag(close, 5) OVER w, 0) - 1 AS close_return_5,
           CASE WHEN count(*) OVER w14 = 14 THEN avg(high - low) OVER w14 END AS atr_14, CASE WHEN count(*) OVER w10 = 10 THEN volume / nullif(avg(volume) OVER w10, 0) END AS volume_ratio
         FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), w5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
           w10 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w14 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
       SELECT event_id, round(close_lag_3, 6) AS close_lag_3, round(volume_lag_1, 6) AS volume_lag_1, round(high_roll_min_10, 6) AS high_roll_min_10, round(close_sma_5, 6) AS close_sma_5,
         round(close_return_5, 6) AS close_return_5, round(atr_14, 6) AS atr_14, round(volume_ratio, 6) AS volume_ratio FROM f""",
)
def series_preset_in_full(spark, sf_dir):
    """All four generators of the preset over four columns; one column of each kind of output is compared."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.col("value").alias("close"), (F.col("value") + F.col("event_id") % 5).alias("high"), (F.col("value") - F.col("event_id") % 3).alias("low"),
        (F.col("event_id") % 100).cast("double").alias("volume"),
    )
    out = FE.build_features(ev, FE.preset("crypto"), order=["ts", "event_id"], part=["user_id"])
    return rounded(out.select("event_id", "close_lag_3", "volume_lag_1", "high_roll_min_10", "close_sma_5", "close_return_5", "atr_14", "volume_ratio"))


@query(
    "P-5 D22",
    """WITH c AS (SELECT l_linestatus AS part, (l_quantity > 25)::INTEGER::DOUBLE AS y, l_extendedprice / 100000.0 AS p FROM lineitem WHERE l_extendedprice <= 100000)
       SELECT part, metric, round(value, 6) AS value, direction FROM (
         SELECT part, 'rmse' AS metric, sqrt(avg((y - p) ** 2)) AS value, 'minimize' AS direction FROM c GROUP BY part UNION ALL SELECT part, 'mae', avg(abs(y - p)), 'minimize' FROM c GROUP BY part
         UNION ALL SELECT part, 'mse', avg((y - p) ** 2), 'minimize' FROM c GROUP BY part UNION ALL SELECT part, 'pearson', corr(y, p), 'maximize' FROM c GROUP BY part
         UNION ALL SELECT part, 'accuracy', avg((y = (p > 0.5)::INTEGER)::INTEGER), 'maximize' FROM c GROUP BY part
         UNION ALL SELECT part, 'log_loss', -avg(y * ln(greatest(p, 2.220446049250313e-16)) + (1 - y) * ln(1 - least(p, 1 - 2.220446049250313e-16))), 'minimize' FROM c GROUP BY part)""",
)
def metrics_by_name(spark, sf_dir):
    """Metrics looked up by name, with the direction that the registry holds."""
    from foldline.operators import metrics as ME

    rows = table(spark, sf_dir, "lineitem").filter("l_extendedprice <= 100000").select(
        F.col("l_linestatus").alias("part"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("y"), (F.col("l_extendedprice") / 100000.0).cast("double").alias("p")
    )
    names = ["rmse", "mae", "mse", "pearson", "accuracy", "log_loss"]
    direction = F.create_map(*[F.lit(x) for n in names for x in (n, ME.get_metric(n)[1])])
    return rounded(ME.metric_table(rows, names, "y", "p", ["part"]).withColumn("direction", direction[F.col("metric")]))


@query(
    "B9",
    """SELECT count(*) AS rows, round(avg(l_extendedprice), 4) AS price, round(avg(l_quantity), 4) AS amount, max(strftime(l_shipdate, '%Y-%m-%d')) AS last_day FROM lineitem""",
)
def columns_found_by_name(spark, sf_dir):
    """Columns picked by part of their name, candidates in order: the first that any column holds wins."""
    from foldline.roles import find_col

    li = table(spark, sf_dir, "lineitem")
    price, amount, day = (find_col(li.columns, c) for c in (["close", "price", "tax"], ["volume", "quant"], ["date"]))
    return li.agg(
        F.count("*").alias("rows"), F.round(F.avg(price), 4).alias("price"), F.round(F.avg(amount), 4).alias("amount"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day")
    )


@query(
    "B2 D9",
    "SELECT o_orderkey, o_totalprice, n AS cust_orders FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey)",
)
def features_without_target(spark, sf_dir):
    from foldline.operators.select import without_target
    from foldline.roles import Roles

    def build(df):
        assert "o_totalprice" not in df.columns
        return FE.group_size(df, "o_custkey", "cust_orders")

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return without_target(o, Roles(target="o_totalprice", id="o_orderkey"), build).select("o_orderkey", "o_totalprice", "cust_orders")
