"""Reports of a whole job: two tokenizers side by side, and timings of checkers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import lexer as L
from textloom.functions import text as T
from textloom.operators import bpe, grammar, stats
from textloom.sources import process

#: The lexer replaces byte pairs if it compresses better by so much.
LEAST_GAIN = 0.20


def _timed(df: DataFrame) -> float:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def token_sizes(df: DataFrame, tokens: Callable, text: str, error: str) -> DataFrame:
    """One row: characters and tokens of the texts, and mean tokens of a text, of a proof (what
    follows the first :=) and of an error, three places; 0 where there is none."""
    size = lambda c: F.size(tokens(c))
    rows = df.select(F.length(text).alias("chars"), size(F.col(text)).alias("tokens"), F.when(T.proof_of(F.col(text)).isNotNull(), size(F.coalesce(T.proof_of(F.col(text)), F.lit("")))).alias("proof"), F.when(F.col(error) != "", size(F.coalesce(F.col(error), F.lit("")))).alias("error")).where(F.col("chars").isNotNull())
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 3), F.lit(0.0))
    ratio = F.when(F.sum("tokens") > 0, F.bround(F.sum("chars") / F.sum("tokens"), 3)).otherwise(0.0)
    return rows.agg(F.count("*").alias("n_texts"), F.count("proof").alias("n_proofs"), F.count("error").alias("n_errors"), mean("tokens").alias("tokens_per_text"), mean("proof").alias("tokens_per_proof"), mean("error").alias("tokens_per_error"), ratio.alias("compression_ratio"))


def tokenizer_report(spark: SparkSession, df: DataFrame, text: str, error: str, vocab_size: int, timed: bool = False) -> DataFrame:
    """One row for each tokenizer (byte pairs learned from the texts; the rule lexer) with its
    vocabulary size, token_sizes() and the decision between them; with ``timed``, also characters
    a second over all texts."""
    merges = bpe.train(df, text, vocab_size)
    ways = {"bpe": (bpe.vocabulary_size(merges), lambda c: bpe.encode(spark, c, merges)), "lexer": (L.vocabulary_size(), L.tokenize)}
    rows = None
    for name, (size, tokens) in ways.items():
        one = token_sizes(df, tokens, text, error).select(F.lit(name).alias("tokenizer"), F.lit(size).cast("long").alias("vocabulary"), "*")
        if timed:
            seconds = _timed(df.select(F.size(tokens(F.col(text)))))
            chars = df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
            one = one.withColumn("chars_per_sec", F.lit(round(chars / seconds, 1)))
        rows = one if rows is None else rows.unionByName(one)
    ratio = rows.agg(*[F.max(F.when(F.col("tokenizer") == n, F.col("compression_ratio"))).alias(n) for n in ways])
    gain, choice = stats.tokenizer_decision(F.col("bpe"), F.col("lexer"), LEAST_GAIN)
    decided = ratio.select(gain.alias("improvement_pct"), F.when(choice == "other", "lexer").otherwise("bpe").alias("decision"))
    return rows.crossJoin(F.broadcast(decided))


# --- timings of checkers ----------------------------------------------------------------------


def _summary(spark: SparkSession, times: list[tuple[str, float, str]]) -> DataFrame:
    """Latency statistics and success rate by name of (name, seconds, status)."""
    df = spark.createDataFrame(times, "name string, seconds double, status string")
    ok = stats.success_rate(df, F.col("status") == "SUCCESS", ["name"]).drop("n")
    return stats.latency(df, "seconds", ["name"]).join(ok, "name")


def batch_timings(spark: SparkSession, command: list[str], files: dict[str, str], repeats: int, seconds: float = 60.0) -> DataFrame:
    """A run of the program for each file, after one that does not count."""
    times = []
    for name, path in files.items():
        for k in range(repeats + 1):
            t = time.perf_counter()
            code, _ = process.run_once([*command, path], seconds, 1_000_000)
            if k:
                times.append((name, time.perf_counter() - t, "SUCCESS" if code == 0 else "FAIL"))
    return _summary(spark, times)


def cold_timings(spark: SparkSession, command: list[str], sources: dict[str, str]) -> DataFrame:
    """Start of a child and one request, for each source: startup_s, verify_s, total_s, status."""
    rows = []
    for name, source in sources.items():
        with process.LineClient(command) as client:
            t = time.perf_counter()
            client.start()
            startup = time.perf_counter() - t
            said = process.Session(client).submit(source, keep=False)
            rows.append((name, round(startup, 6), round(said["seconds"], 6), round(startup + said["seconds"], 6), said["status"]))
    return spark.createDataFrame(rows, "name string, startup_s double, verify_s double, total_s double, status string")


def warm_timings(spark: SparkSession, command: list[str], sources: dict[str, str], runs: int) -> DataFrame:
    """Repeated requests to one child, after one for each source that does not count."""
    times = []
    with process.LineClient(command) as client:
        session = process.Session(client)
        for name, source in sources.items():
            session.submit(source, keep=False)
            for _ in range(runs):
                said = session.submit(source, keep=False)
                times.append((name, said["seconds"], said["status"]))
    return _summary(spark, times)


def action_timings(spark: SparkSession, command: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """n actions in turn on one child: one row of statistics with actions_per_sec, and the counts
    of statuses."""
    actions = spark.range(n).select("id", grammar.action(F.col("id")).alias("a")).orderBy("id")
    times = []
    with process.LineClient(command) as client:
        session = process.Session(client)
        for r in actions.toLocalIterator():
            said = session.submit(r["a"])
            times.append(("actions", said["seconds"], said["status"]))
    df = spark.createDataFrame(times, "name string, seconds double, status string")
    one = stats.latency(df, "seconds", ["name"]).join(stats.throughput(df, F.col("seconds"), ["name"]).select("name", F.col("per_sec").alias("actions_per_sec")), "name")
    return one, stats.counts(df, F.col("status"), "status")
