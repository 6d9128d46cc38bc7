"""Accuracy against labelled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def accuracy(truth: DataFrame, cells: DataFrame, key: list[str], role: str, page: str) -> DataFrame:
    """Hits and totals of each (role, page), each role and overall; missing cells count as ''."""
    right = cells.select(*key, F.col("text").alias("__said"))
    met = truth.join(right, key, "left")
    hit = T.canonical_ditto(F.col("text")) == T.canonical_ditto(F.col("__said"))
    return met.groupBy(role, page, hit.alias("hit")).count().rollup(role, page).agg(F.sum(F.when(F.col("hit"), F.col("count")).otherwise(0)).alias("hits"), F.sum("count").alias("total"))


def first_misses(truth: DataFrame, cells: DataFrame, key: list[str], role: str, n: int = 5) -> DataFrame:
    met = truth.join(cells.select(*key, F.col("text").alias("said")), key, "left")
    missed = met.where(T.canonical_ditto(F.col("text")) != T.canonical_ditto(F.col("said")))
    order = Window.partitionBy(role).orderBy(*key)
    return missed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def compare_voices(labelled: DataFrame, truth: str, voices: list[str]) -> DataFrame:
    """Per voice: exact hits (the truth or its last digit), last-digit hits, empty readings, cells."""
    long = labelled.unpivot([truth], voices, "voice", "reading")
    read, want = F.coalesce(F.col("reading"), F.lit("")), F.col(truth)
    last = F.right(want, F.lit(1))
    return long.groupBy("voice").agg(
        F.count_if((read == want) | (read == last)).alias("exact"), F.count_if((read != "") & (F.right(read, F.lit(1)) == last)).alias("last_digit"), F.count_if(read == "").alias("empty"), F.count("*").alias("cells")
    )


def class_rates(df: DataFrame, label: str, hit: Column) -> DataFrame:
    """Recognition rate of each class in thousandths; the unweighted mean over classes stands under a null class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))
    whole = lambda c: F.floor(c).cast("long").alias("permille")
    rates = counts.select("label", "hits", "total", whole(F.col("hits") * 1000 / F.col("total")))
    mean = counts.agg(F.lit(None).cast("string").alias("label"), F.sum("hits").alias("hits"), F.sum("total").alias("total"), whole(F.avg(F.col("hits") * 1000 / F.col("total"))))
    return rates.union(mean)


def fold(number: Column, k: int = 5, seed: int = 42) -> Column:
    """Fold of an id by plain arithmetic, the same in every engine."""
    return F.pmod(number * 2_654_435_761 + seed, F.lit(1_000_003)) % k


def fold_metrics(history: DataFrame, loss: str, accuracy: str) -> DataFrame:
    """Least loss and best accuracy of each fold of ``history`` (fold, ...), and their mean and population deviation under a null fold."""
    best = history.groupBy("fold").agg(F.min(loss).alias("loss"), F.max(accuracy).alias("accuracy"))
    none = F.lit(None).cast("double")
    rows = best.select("fold", "loss", "accuracy", none.alias("loss_std"), none.alias("accuracy_std"))
    return rows.union(best.agg(F.lit(None).cast(history.schema["fold"].dataType).alias("fold"), F.avg("loss"), F.avg("accuracy"), F.stddev_pop("loss"), F.stddev_pop("accuracy")))
