"""First-seen de-duplication, duplicate details and leakage between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


def keep_first(df: DataFrame, key: Column, order: str, absent: Column | None = None, to: str | None = None) -> DataFrame:
    """The row of the smallest order of each key (null is larger than any); of several such rows
    one. A grouped minimum combines before the shuffle, and join and choice are dealt by key and
    order together, so a key with a third of all rows costs no more than others; rows with a null
    key all stay. ``absent``: when the key is null, if that is told more cheaply than by the key.
    ``to``: a name under which the key is kept."""
    keyed = df.withColumn("__key", key).withColumn("__order", F.struct(F.col(order).alias("o")))  # as a struct, null equals null
    first = keyed.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.min(order).alias("o")).select("__key", F.struct("o").alias("__order"))
    kept = keyed.join(first, ["__key", "__order"], "left_semi").dropDuplicates(["__key", "__order"])
    kept = kept.select(*df.columns, *([F.col("__key").alias(to)] if to else []))
    rest = df.where(key.isNull() if absent is None else absent)
    return kept.unionByName(rest.withColumn(to, F.lit(None).cast(kept.schema[to].dataType)) if to else rest)


def duplicate_details(df: DataFrame, key: Column, order: str, kind: str) -> DataFrame:
    """(kind, dup_id, first_id) of each row that repeats an earlier key; null keys never repeat."""
    keyed = df.select(F.col(order).alias("dup_id"), key.alias("key")).where(F.col("key").isNotNull())
    first = keyed.groupBy("key").agg(F.min("dup_id").alias("first_id"), F.count("*").alias("n")).where(F.col("n") > 1).select("key", "first_id")
    return keyed.join(first, "key").where(F.col("dup_id") > F.col("first_id")).select(F.lit(kind).alias("kind"), "dup_id", "first_id")


def leakage(df: DataFrame, source: Column, structure: Column, split: Column) -> DataFrame:
    """One row: exact, normalised and structure duplicates (rows less distinct keys; null structures
    do not count), structures that TEST shares with TRAIN and with VALIDATION, and ok (no exact or
    normalised duplicate and no overlap; structure duplicates alone do not fail it). gate_ok also
    asks for no structure duplicate. A missing split counts as TRAIN.
    """
    keys = df.select(T.fingerprint(source).alias("e"), T.normalized_fingerprint(source).alias("n"), structure.alias("s"), F.coalesce(split, F.lit("TRAIN")).alias("split"))
    # one pass for each key, each of them combining before its shuffle
    surplus = lambda c: keys.where(F.col(c).isNotNull()).groupBy(c).agg((F.count("*") - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).cast("long"))
    shared = keys.where(F.col("s").isNotNull()).groupBy("s").agg(*[F.max(F.col("split") == x).alias(x) for x in ("TRAIN", "VALIDATION", "TEST")])
    over = shared.agg(*[F.coalesce(F.sum((F.col("TEST") & F.col(x)).cast("long")), F.lit(0)).alias(f"test_{x.lower()}_overlap") for x in ("TRAIN", "VALIDATION")])
    out = surplus("e").toDF("exact_duplicates").crossJoin(surplus("n").toDF("normalized_duplicates")).crossJoin(surplus("s").toDF("structure_duplicates")).crossJoin(over)
    ok = (F.col("exact_duplicates") == 0) & (F.col("normalized_duplicates") == 0) & (F.col("test_train_overlap") == 0) & (F.col("test_validation_overlap") == 0)
    return out.withColumn("ok", ok).withColumn("gate_ok", ok & (F.col("structure_duplicates") == 0))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both tables."""
    return a.select(key).intersect(b.select(key))


def anti(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been seen."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def parent_join(mutants: DataFrame, originals: DataFrame) -> DataFrame:
    """Mutants with their parents' rows (parent_ columns)."""
    parents = originals.select(*[F.col(c).alias(f"parent_{c}") for c in originals.columns])
    return mutants.join(parents, mutants.parent_id == F.col("parent_sample_id"))


