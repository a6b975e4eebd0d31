"""Source and sink queries: the given tables are written, published or parsed, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.operators.folds import ensure_manifest
from foldline.plans.catalog import query, rounded, table
from foldline.session import scratch_root
from foldline.sources import files as FI
from foldline.sources import sidecars as SI
from foldline.sources import tables as TA
from foldline.sources.predictions import write_submission


def _fresh(spark) -> str:
    return f"{scratch_root(spark).rstrip('/')}/out-{uuid.uuid4().hex}"


@query("A1 A2 A6", "SELECT o_orderkey, o_totalprice FROM orders")
def pruned_read(spark, sf_dir):
    df = TA.read_table(spark, f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_totalprice"])
    return TA.assert_schema(df, T.StructType().add("o_orderkey", "long").add("o_totalprice", "double"), exact=True)


@query("A1 A13", "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal FROM customer")
def csv_report_roundtrip(spark, sf_dir):
    path = _fresh(spark)
    nan = F.when(F.col("c_custkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    TA.write_report(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", nan.alias("c_acctbal")), path)
    schema = T.StructType().add("c_custkey", "long").add("c_mktsegment", "string").add("c_acctbal", "double")
    return spark.read.schema(schema).csv(path, header=True)


@query("A13", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 1 THEN p_retailprice END AS price FROM part")
def json_report_roundtrip(spark, sf_dir):
    path = _fresh(spark)
    price = F.when(F.col("p_partkey") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    TA.write_report(table(spark, sf_dir, "part").select("p_partkey", price.alias("price")), path, "json")
    return spark.read.schema("p_partkey long, price double").json(path)


@query("A8", "SELECT 'v001' AS version, count(*) AS rows FROM nation UNION ALL SELECT 'v002', count(*) FROM region")
def versioned_outputs(spark, sf_dir):
    root = _fresh(spark)
    paths = [TA.write_versioned(table(spark, sf_dir, t), root) for t in ("nation", "region")]
    parts = [spark.read.parquet(p).agg(F.count("*").alias("rows")).select(F.lit(p.rsplit("/", 1)[1]).alias("version"), "rows") for p in paths]
    return parts[0].unionByName(parts[1])


@query("A9", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def published_table(spark, sf_dir):
    def audit(df):
        if df.filter("o_totalprice <= 1000").limit(1).count():
            raise ValueError("low prices")

    path = TA.publish(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").filter("o_totalprice > 1000"), f"{_fresh(spark)}/orders", audit)
    return spark.read.parquet(path)


@query("A10", "SELECT user_id, count(*) AS rows, sum(event_id)::BIGINT AS ids FROM events GROUP BY user_id")
def clustered_entities(spark, sf_dir):
    path = _fresh(spark)
    TA.write_by_entity(table(spark, sf_dir, "events").drop("props"), path, "user_id", ["ts", "event_id"])
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


@query("A12 A11", "SELECT o_orderkey AS id, o_totalprice AS prediction FROM orders")
def written_submission(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    template = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"))
    preds = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("prediction"))
    path = _fresh(spark)
    write_submission(template, preds, "id", "pos", "prediction", path)
    return spark.read.schema("id long, prediction double").csv(path, header=True)


@query("I5 C5", "SELECT o_custkey, (o_custkey % 5 + 1)::INTEGER AS fold FROM orders GROUP BY o_custkey")
def stored_manifest(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select("o_custkey").distinct().withColumn("fold", (F.col("o_custkey") % 5 + 1).cast("int"))
    path = f"{_fresh(spark)}/manifest"
    ensure_manifest(m, path)
    return ensure_manifest(m, path)


@query("A7", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS amount, NULL::DOUBLE AS ghost FROM customer")
def coerced_numbers(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return TA.coerce_numeric(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("amount")), ["amount", "ghost"])


@query("A16", "SELECT 'OBJECT<k: BIGINT>' AS structure FROM events LIMIT 1")
def json_structure(spark, sf_dir):
    return SI.infer_json(table(spark, sf_dir, "events"), "props")


@query(
    "A17",
    """SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice / 2 WHEN 2 THEN o_custkey END::DOUBLE, 6) AS value,
       CASE o_orderkey % 4 WHEN 0 THEN 'scores.utility' WHEN 1 THEN 'scores.eval_corr' WHEN 2 THEN 'local_cv_score' END AS source FROM orders""",
)
def sidecar_scores(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    meta = (
        F.when(k % 4 == 0, F.to_json(F.struct(F.struct(price.alias("utility"), F.lit(1.0).alias("composite")).alias("scores"), F.lit(2.0).alias("mean_score"))))
        .when(k % 4 == 1, F.to_json(F.struct(F.struct((price / 2).alias("eval_corr")).alias("scores"))))
        .when(k % 4 == 2, F.to_json(F.struct(F.col("o_custkey").alias("local_cv_score"))))
        .otherwise("{}")
    )
    value, source = SI.pick_score(F.col("meta"))
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", meta.alias("meta")).select("o_orderkey", value.alias("value"), source.alias("source")))


@query("A18 A14")
def table_files(spark, sf_dir):
    """Name, size and content digest of every given table file."""
    return FI.file_hashes(spark, [sf_dir], glob="*.parquet").select("name", "length", "digest")


@query("A18", "SELECT count(*) AS lines FROM orders")
def line_inventory(spark, sf_dir):
    path = _fresh(spark)
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string")).write.text(path)
    return FI.file_inventory(spark, path, "*.txt").agg(F.sum("lines").alias("lines"))


@query("A19 A14", "SELECT 0::BIGINT AS changed, true AS same_fingerprint FROM region LIMIT 1")
def input_hash_contract(spark, sf_dir):
    before, after = (FI.snapshot(spark, [sf_dir], glob="*.parquet") for _ in range(2))
    same = FI.fingerprint(spark, [sf_dir], glob="*.parquet") == FI.fingerprint(spark, [sf_dir], glob="*.parquet")
    return FI.hash_contract(before, after).agg(F.count("*").alias("changed")).withColumn("same_fingerprint", F.lit(same))
