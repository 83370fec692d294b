"""The corpus build end to end: generate, de-duplicate, mutate, split, verify, audit, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import rules as R
from textloom.functions import text as T
from textloom.operators import audit, dedup, grammar, mutate, random_trees, splits, verify
from textloom.sources import io

VERSION = "1"
COLUMNS = "sample_id string, level string, source string, prop_structure string, proof_structure string, mutation_type string, parent_id string"


#: Draws for each sample wanted: repeats are rejected, so a level can come out short.
ATTEMPTS = 20


def originals(spark: SparkSession, per_level: int, seed: int, levels: tuple[str, ...] = ("S0", "S1", "S2")) -> DataFrame:
    """At most per_level samples of each level, none twice after normalising."""
    every = None
    for level in levels:
        drawn = random_trees.generate(spark, level, per_level * ATTEMPTS, seed)
        every = drawn if every is None else every.unionByName(drawn)
    every = every.withColumn("key", T.normalize(F.col("source")))
    first = dedup.keep_first(every, F.concat_ws("|", "level", "key"), "index")
    return grammar.first_of_each(first, "level", per_level, seed, "key").select(
        grammar.sample_id(F.col("level"), F.col("index"), seed).alias("sample_id"),
        "level",
        "source",
        "prop_structure",
        "proof_structure",
        F.lit(None).cast("string").alias("mutation_type"),
        F.lit(None).cast("string").alias("parent_id"),
    )


def mutants(samples: DataFrame, n: int, seed: int, level: str = "S2") -> DataFrame:
    """At most n edits of a level's samples: of S2 the tree changes and the proof stays, of others
    the text is edited. Edits that change nothing are left out."""
    parents = samples.where(F.col("level") == level).drop("mutation_type", "parent_id")
    edited = mutate.dispatch(parents, "sample_id", seed).where(F.col("mutant") != F.col("source"))
    index = F.pmod(F.xxhash64("sample_id", "mutant"), F.lit(1 << 40))
    named = F.concat(F.lit(f"theorem {level.lower()}_m"), index.cast("string"), F.lit(" : "), F.element_at(F.split("mutant", " : ", 2), 2))
    out = edited.select(
        grammar.sample_id(F.col("level"), index, seed, True).alias("sample_id"),
        "level",
        named.alias("source"),
        F.col("mutant_structure").alias("prop_structure"),
        "proof_structure",
        "mutation_type",
        F.col("sample_id").alias("parent_id"),
    )
    return out.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "sample_id"), 256)).limit(n)


def build(spark: SparkSession, per_level: int, mutations: int, seed: int, policy: R.Policy = R.Policy()) -> DataFrame:
    """Samples with split, status, failure_class, messages, kernel_axioms and mode. S0 rows have no
    structure; their verdict is looked up in the table of surface statements."""
    first = io.materialize(originals(spark, per_level, seed))
    every = dedup.keep_first(first.unionByName(mutants(first, mutations, seed)), T.normalized_fingerprint(F.col("source")), "sample_id")
    placed = io.materialize(splits.split(io.materialize(every), "sample_id", seed))
    relation = io.materialize(grammar.inhabited(spark, 3, "both").distinct())
    check = verify.relation_checker(relation)

    def checker(df: DataFrame) -> DataFrame:
        surface = grammar.s0(spark).where("valid").select(F.concat_ws(" := ", "prop_lean", "proof_lean").alias("__s0"))
        statement = F.element_at(F.split("source", " : ", 2), 2)
        done = check(df)
        joined = done.join(F.broadcast(surface), statement == F.col("__s0"), "left")
        status = F.when(F.col("level") == "S0", F.when(F.col("__s0").isNotNull(), "SUCCESS").otherwise("FAIL_TYPECHECK")).otherwise(F.col("status"))
        return joined.withColumn("status", status).drop("__s0")

    one = lambda df: verify.staged(df, "source", checker, policy)
    return verify.two_tier(placed, one, one)


def summary(samples: DataFrame, seed: int) -> DataFrame:
    """One row: counts, content audit and leakage audit; gate: both are fine."""
    a = audit.summary(samples, "source").select(*[F.col(c).alias(f"audit_{c}") for c in ("n_samples", "n_violations", "imports_seen", "all_imports_allowed", "ok")])
    lk = dedup.leakage(samples, F.col("source"), T.structure_fingerprint(F.col("prop_structure"), F.col("proof_structure")), F.col("split"))
    return a.crossJoin(lk).withColumn("generator_version", F.lit(VERSION)).withColumn("seed", F.lit(seed)).withColumn("gate", F.col("audit_ok") & F.col("ok"))


def write(samples: DataFrame, path: str, seed: int) -> str:
    """Records as JSON lines at path, the summary beside it; returns the summary's text."""
    environment = io.environment_fingerprint(samples.sparkSession, samples.schema, {"seed": seed, "version": VERSION})
    io.write_jsonl(io.sample_records(samples, VERSION, seed, environment), path)
    return io.write_summary(summary(samples, seed), f"{path}.summary", stamp=True)
