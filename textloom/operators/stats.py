"""Counts, ratios and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, value: Column, to: str = "value") -> DataFrame:
    """Rows by value; null counts as "?"."""
    return df.groupBy(F.coalesce(value, F.lit("?")).alias(to)).agg(F.count("*").alias("n"))


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group: n, mean_s, p50_s, p95_s, p99_s, min_s, max_s (rounded half-even to six places) and
    checks_per_sec (n over the sum, three places). The p-th percentile is the value at the
    half-even rounding of p * (n - 1), counted from 0. Null values are left out.

    Equal values are counted first; ranks are running sums over the distinct values, so that no
    group is collected.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    ranked = v.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("n") - 1)), F.col(value)))
    total = F.sum(F.col(value) * F.col("c"))
    six = lambda c: F.bround(c, 6)
    return ranked.groupBy(*by).agg(
        F.max("n").alias("n"),
        six(total / F.max("n")).alias("mean_s"),
        six(at(0.5)).alias("p50_s"),
        six(at(0.95)).alias("p95_s"),
        six(at(0.99)).alias("p99_s"),
        six(F.min(value)).alias("min_s"),
        six(F.max(value)).alias("max_s"),
        F.when(total > 0, F.bround(F.max("n") / total, 3)).alias("checks_per_sec"),
    )


def success_rate(df: DataFrame, ok: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ok.cast("int")).alias("success_rate"))


def throughput(df: DataFrame, seconds: Column, by: list[str]) -> DataFrame:
    """Rows per second of work."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.bround(F.count("*") / F.sum(seconds), 3).alias("per_sec"))


def compression(df: DataFrame, chars: Column, tokens: Column, by: list[str]) -> DataFrame:
    """Characters per token and tokens per text (three places); 0 where there are no tokens."""
    out = df.groupBy(*by).agg(F.sum(chars).alias("chars"), F.sum(tokens).alias("tokens"), F.avg(tokens).alias("mean"))
    ratio = F.when(F.col("tokens") > 0, F.bround(F.col("chars") / F.col("tokens"), 3)).otherwise(0.0)
    return out.select(*by, F.col("chars").cast("long").alias("chars"), F.col("tokens").cast("long").alias("tokens"), ratio.alias("compression_ratio"), F.bround("mean", 3).alias("tokens_per_text"))


def tokenizer_decision(base: Column, other: Column, least: float = 0.20) -> tuple[Column, Column]:
    """Improvement of a ratio over another (both already rounded) in percent, and whether it is
    enough to switch."""
    gain = F.when(base > 0, (other - base) / base).otherwise(0.0)
    return F.bround(gain * 100, 1), F.when(gain >= least, "other").otherwise("base")


def sorted_distinct(arrays: Column) -> Column:
    """Distinct values of an array of arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(arrays)))
