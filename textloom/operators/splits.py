"""Reproducible splits of exact sizes without sorting the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources import io

TRAIN, VALIDATION, TEST = "TRAIN", "VALIDATION", "TEST"
#: Hex digits by which a cut is narrowed at once (4,096 counts), and rows that are then ranked.
DIGITS, FEW = 3, 5_000


def hash_order(id_col: str, seed: int) -> Column:
    """The key of the pseudo-random order; a null id counts as the empty text."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)


def cut_at(hashes: DataFrame, rank: int, first: list | None = None, few: int = FEW) -> str:
    """The hash (column h) of the rank-th row in order, from 1; "" for rank 0.

    Rows are counted by the leading digits of the hash and only the block that holds the rank is
    looked into further, so what is fetched is bounded and nothing is sorted or shuffled whole.
    """
    prefix, left = "", rank
    if rank < 1:
        return ""
    while True:
        blocks = first if first is not None and not prefix else counts(hashes, prefix)
        for block, n in blocks:
            if left <= n:
                break
            left -= n
        prefix = block
        if n <= few or len(prefix) >= 64:
            inside = hashes.where(F.col("h").startswith(prefix)).groupBy("h").agg(F.count("*").alias("n")).orderBy("h").limit(few)
            for h, k in inside.collect():
                if left <= k:
                    return h
                left -= k


def counts(hashes: DataFrame, prefix: str) -> list[tuple[str, int]]:
    """Rows by the digits that follow a prefix, in order: at most 4,096 of them."""
    some = hashes.where(F.col("h").startswith(prefix)) if prefix else hashes
    by = F.substring("h", 1, len(prefix) + DIGITS).alias("b")
    return sorted((r["b"], r["n"]) for r in some.groupBy(by).agg(F.count("*").alias("n")).collect())


def split(df: DataFrame, id_col: str, seed: int, train: float = 0.8, validation: float = 0.1, to: str = "split") -> DataFrame:
    """A pseudo-random order by a seeded hash of the id: the first floor(n * train) rows are TRAIN,
    the next floor(n * validation) VALIDATION, the rest TEST.

    Two cuts of the order are found from counts over the written hashes; the rows themselves are
    only compared with them. Sizes are exact if ids are unique; rows with equal ids stay together.
    """
    hashes = io.materialize(df.select(hash_order(id_col, seed).alias("h")))
    first = counts(hashes, "")
    n = sum(k for _, k in first)
    a, b = int(n * train), int(n * validation)
    one, two = cut_at(hashes, a, first), cut_at(hashes, a + b, first)
    h = hash_order(id_col, seed)
    return df.withColumn(to, F.when(h <= one, TRAIN).when(h <= two, VALIDATION).otherwise(TEST))


def split_groups(df: DataFrame, group_col: str, seed: int, train: float = 0.8, validation: float = 0.1, to: str = "split") -> DataFrame:
    """All rows of a group (such as a mutant's root) in one split, by the group's hash alone."""
    x = F.conv(F.substring(hash_order(group_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn(to, F.when(x < train, TRAIN).when(x < train + validation, VALIDATION).otherwise(TEST))
