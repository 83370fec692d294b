"""Ordered sessions of actions, as window functions over a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def action_log(df: DataFrame, session: str, order: list[str], state: Column) -> DataFrame:
    """Each action with seq (from 1) and the state before and after it within its session; the first
    has no previous state. ``order`` must be unique within a session."""
    w = Window.partitionBy(session).orderBy(*order)
    out = df.withColumn("next_state", state).withColumn("seq", F.row_number().over(w).cast("long"))
    return out.withColumn("previous_state", F.lag("next_state").over(w))


def declared_before(df: DataFrame, session: str, order: list[str], declares: Column, uses: Column) -> DataFrame:
    """Is what an action uses declared by an earlier action of its session? A first-declaration
    table is joined, so long sessions are not gathered. Actions that use nothing are fine."""
    w = Window.partitionBy(session).orderBy(*order)
    log = df.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("__declares", declares).withColumn("__uses", uses)
    first = log.where(F.col("__declares").isNotNull()).groupBy(F.col(session).alias("__s"), F.col("__declares").alias("__name")).agg(F.min("seq").alias("__first"))
    joined = log.join(first, (F.col(session) == F.col("__s")) & (F.col("__uses") == F.col("__name")), "left")
    ok = F.col("__uses").isNull() | F.coalesce(F.col("__first") < F.col("seq"), F.lit(False))
    return joined.withColumn("ok", ok).drop("__s", "__name", "__first", "__declares", "__uses")
