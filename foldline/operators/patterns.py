"""Keyword patterns in documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Keywords looked for in solution write-ups, in the order they are tried.
MODELS = (
    "lightgbm", "lgbm", "xgboost", "xgb", "catboost", "random_forest", "randomforest", "lstm", "gru", "transformer", "tabnet",
    "deberta", "bert", "linear_regression", "logistic_regression", "svm", "knn", "ridge", "lasso",
)
FEATURES = (
    "target_encoding", "label_encoding", "one_hot", "rolling_mean", "rolling_std", "lag", "pca", "svd", "umap", "tfidf", "word2vec",
    "embedding", "interaction", "polynomial", "rsi", "macd", "bollinger", "ema", "sma",
)
SPLITS = ("stratifiedkfold", "kfold", "groupkfold", "timeseriessplit", "repeatedkfold", "train_test_split")
RECURRENT = ("lstm", "gru", "transformer")
BOOSTED = ("lightgbm", "lgbm", "xgboost", "xgb", "catboost")
LANGUAGE = ("deberta", "bert")


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """The listed words that occur in a text, case ignored."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]))


def mine_patterns(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Models, features, first matching split and overall approach of each document."""
    t = F.col(text)
    out = docs.select(
        id, keyword_hits(t, MODELS).alias("models"), keyword_hits(t, FEATURES).alias("features"),
        F.coalesce(F.try_element_at(keyword_hits(t, SPLITS), F.lit(1)), F.lit("")).alias("cv"),
    )
    has = lambda words: F.arrays_overlap("models", F.array(*[F.lit(w) for w in words]))
    approach = (
        F.when(has(RECURRENT), "deep_learning")
        .when(has(BOOSTED) & (F.size("models") > 1), "gradient_boosting_ensemble")
        .when(has(BOOSTED), "gradient_boosting")
        .when(has(LANGUAGE), "nlp_transformer")
        .otherwise("traditional_ml")
    )
    return out.withColumn("approach", approach)


def top_keywords(docs: DataFrame, text: str, families: Mapping[str, Sequence[str]], k: int) -> DataFrame:
    """Most frequent keywords per family by number of documents, counted in one aggregate."""
    low = F.lower(F.col(text))
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.lit(w).alias("keyword"), F.count_if(low.contains(w)).alias("documents"))
            for f, words in families.items()
            for w in words
        ]
    )
    counts = docs.agg(cells.alias("c")).select(F.inline("c")).filter(F.col("documents") > 0)
    w = Window.partitionBy("family").orderBy(F.desc("documents"), "keyword")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def summarize_patterns(patterns: DataFrame) -> DataFrame:
    """Long ``(kind, name, documents, place)``: top models, features and splits over mined documents."""
    kinds = {"model": ("models", 5), "feature": ("features", 10)}
    parts = [
        patterns.select(F.lit(kind).alias("kind"), F.explode(col).alias("name"), F.lit(k).alias("keep")) for kind, (col, k) in kinds.items()
    ]
    parts.append(patterns.filter("cv <> ''").select(F.lit("split").alias("kind"), F.col("cv").alias("name"), F.lit(3).alias("keep")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = rows.groupBy("kind", "name", "keep").agg(F.count("*").alias("documents"))
    w = Window.partitionBy("kind").orderBy(F.desc("documents"), "name")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.col("keep")).drop("keep")
