"""From raw documents to packed training sequences, stage by stage.

Each stage gets the written result of the one before and returns whole rows with the columns of ``documents``; the last
returns where each piece of each document lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm import best_fit_packing, line_dedup, simhash_dedup, template_decontamination, toxicity
from foldline.llm.common import table
from foldline.llm.queries import END_ID, TOXIC_SCORE, word_bpe
from foldline.llm.template_decontamination import row_key
from foldline.session import cut_lineage, discard

#: Bytes of words a task of the last stage remembers: it also carries tokens through its joins.
CACHE_BYTES = 80 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts stay."""
    scored = toxicity.score(docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    kept = scored.filter(F.col("score") < TOXIC_SCORE).drop("score")
    return kept.withColumnRenamed("__score", "score") if "__score" in kept.columns else kept


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the chunks that an earlier one holds; n_chars follows the text where it was cut."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("cut_runs") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id. Of rows that repeat its doc_id and text one stays, other texts
    under its doc_id stay; of rows without doc_id one of each text stays."""
    found = simhash_dedup.near_duplicates(docs)
    keep = cut_lineage(found.filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct())
    one = docs.filter("doc_id IS NOT NULL").join(keep, F.col("doc_id") == F.col("__kept"), "left_semi")
    one = one.unionByName(docs.filter("doc_id IS NULL")).withColumn("__text", row_key())
    return one.dropDuplicates(["doc_id", "__text"]).drop("__text")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other fillings."""
    return template_decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their tokens, sequence and offset."""
    return best_fit_packing.pack(docs, word_bpe(CACHE_BYTES), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", drop_near_copies),
    ("template_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]

#: No stage but the joins can be said in SQL: trained scores, content-defined chunks and bit-wise hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return docs
