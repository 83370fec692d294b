"""Random propositions and proofs of bounded depth, drawn by seeded hashes.

A tree of depth three has fifteen places at most, so a draw is one SQL expression: each place's
choice is a hash of the seed, the row's index and the place's path. The same text of expressions
serves every engine; only the draw itself differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import grammar

# Depths, and the chance of a false leaf.
PROP_DEPTHS, PROOF_DEPTHS, FALSE_LEAF = (1, 3), (0, 3), 0.15
LEFT_SIDE = 0.5


def draw(seed: int, path: str, index: str = "i", sha: str = "sha2({}, 256)", number: str = "CAST(conv({}, 16, 10) AS DOUBLE)") -> str:
    """SQL of a number in [0, 1) for the place ``path`` of row ``index``."""
    digest = sha.format(f"concat('{seed}:', CAST({index} AS STRING), ':{path}')")
    return f"({number.format(f'substr({digest}, 1, 8)')} / 4294967296.0)"


def choice(of: int, u: str) -> str:
    return f"CAST(floor({u} * {of}) AS INT)"


def prop(depth: int, u, path: str = "p", false: bool = False) -> str:
    """SQL of a proposition's key: conjunction, disjunction or truth at random down to the depth."""
    if depth <= 0:
        return f"CASE WHEN {u(path)} < {FALSE_LEAF} THEN 'false' ELSE 'true' END" if false else "'true'"
    left, right = (prop(depth - 1, u, path + side, false) for side in "lr")
    inner = f"CONCAT(' ', {left}, ' ', {right}, ')')"
    return f"CASE {choice(3, u(path))} WHEN 0 THEN CONCAT('(and', {inner}) WHEN 1 THEN CONCAT('(or', {inner}) ELSE 'true' END"


def proof_of(depth: int, u, path: str = "p") -> str:
    """SQL of a right proof of prop(depth, u, path) without false leaves: a disjunction's side is drawn."""
    if depth <= 0:
        return "'MTrue.intro'"
    left, right = (proof_of(depth - 1, u, path + side) for side in "lr")
    side = f"CASE WHEN {u(path + 'c')} < {LEFT_SIDE} THEN CONCAT('(MOr.inl ', {left}, ')') ELSE CONCAT('(MOr.inr ', {right}, ')') END"
    return f"CASE {choice(3, u(path))} WHEN 0 THEN CONCAT('(MAnd.intro ', {left}, ' ', {right}, ')') WHEN 1 THEN {side} ELSE 'MTrue.intro' END"


def proof(depth: int, u, path: str = "q") -> str:
    """SQL of a random proof, whatever it proves: a constructor with one or two arguments."""
    if depth <= 0:
        return "'MTrue.intro'"
    left, right = (proof(depth - 1, u, path + side) for side in "lr")
    return f"CASE {choice(4, u(path))} WHEN 0 THEN 'MTrue.intro' WHEN 1 THEN CONCAT('(MAnd.intro ', {left}, ' ', {right}, ')') WHEN 2 THEN CONCAT('(MOr.inl ', {left}, ')') ELSE CONCAT('(MOr.inr ', {right}, ')') END"


def at_random_depth(depths: tuple[int, int], u, path: str, tree) -> str:
    """tree(depth) at a depth drawn evenly from the range."""
    least, most = depths
    return f"CASE {choice(most - least + 1, u(path))} " + " ".join(f"WHEN {k - least} THEN {tree(k)}" for k in range(least, most + 1)) + " END"


def structures(level: str, u) -> tuple[str, str]:
    """SQL of (prop_structure, proof_structure): S1 draws both alone, S2 a proposition and its proof."""
    if level == "S1":
        return at_random_depth(PROP_DEPTHS, u, "d", lambda k: prop(k, u, false=True)), at_random_depth(PROOF_DEPTHS, u, "e", lambda k: proof(k, u))
    return at_random_depth(PROP_DEPTHS, u, "d", lambda k: prop(k, u)), at_random_depth(PROP_DEPTHS, u, "d", lambda k: proof_of(k, u))


def typed(spark: SparkSession, level: str, n: int, seed: int, start: int = 0) -> DataFrame:
    """n samples of level S1 or S2 by index: index, level, source, prop_structure, proof_structure."""
    a, b = structures(level, lambda path: draw(seed, path))
    rows = spark.range(start, start + n).withColumnRenamed("id", "i").select("i", F.expr(a).alias("prop_structure"), F.expr(b).alias("proof_structure"))
    name = F.concat(F.lit(f"theorem {level.lower()}_t"), F.col("i").cast("string"), F.lit(" : "))
    shown = F.concat(name, grammar.rendered(F.col("prop_structure")), F.lit(" := "), F.regexp_replace("proof_structure", r"^\((.*)\)$", "$1"))
    return rows.select(F.col("i").alias("index"), F.lit(level).alias("level"), shown.alias("source"), "prop_structure", "proof_structure")


def surface(spark: SparkSession, level: str, n: int, seed: int, start: int = 0) -> DataFrame:
    """n S0 samples by index: a proposition and a proof fragment drawn independently."""
    u = lambda path, of: F.expr(choice(of, draw(seed, path)))
    pick = lambda values, path: F.element_at(F.array(*[F.lit(v) for v in values]), u(path, len(values)) + 1)
    rows = spark.range(start, start + n).withColumnRenamed("id", "i")
    shown = F.concat(F.lit("theorem s0_t"), F.col("i").cast("string"), F.lit(" : "), pick(grammar.S0_PROPS, "p"), F.lit(" := "), pick(grammar.S0_PROOFS, "q"))
    return rows.select(F.col("i").alias("index"), F.lit(level).alias("level"), shown.alias("source"), F.lit(None).cast("string").alias("prop_structure"), F.lit(None).cast("string").alias("proof_structure"))


#: Generators by level: (spark, level, n, seed, start) to samples.
GENERATORS = {"S0": surface, "S1": typed, "S2": typed}


def generate(spark: SparkSession, level: str, n: int, seed: int, start: int = 0) -> DataFrame:
    """n samples of a level; an unknown level raises KeyError."""
    return GENERATORS[level](spark, level, n, seed, start)
