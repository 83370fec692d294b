"""Row generators: text fragments, indexed theorems, and the grammar of propositions and proofs
enumerated bottom-up by joins.

The enumerations serve as the checker: a proof is right if (proposition, proof) is a row of the
inhabitation relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
S0_PROPS = ("MTrue", "MFalse", "MAnd MTrue MTrue", "MOr MFalse MTrue", "MAnd (MOr MTrue MFalse) MTrue", "MOr MTrue (MAnd MTrue MFalse)", "MAnd MTrue", "MOr (MAnd MTrue)")
S0_PROOFS = ("MTrue.intro", "MAnd.intro MTrue.intro MTrue.intro", "MOr.inl MTrue.intro", "MOr.inr MTrue.intro", "MAnd.intro MTrue.intro", "by exact MTrue.intro", "by exact MAnd.intro MTrue.intro MTrue.intro")
#: Propositions with a proof each.
BENCH = (
    ("MTrue", "MTrue.intro"),
    ("MAnd MTrue MTrue", "MAnd.intro MTrue.intro MTrue.intro"),
    ("MOr MTrue MTrue", "MOr.inl MTrue.intro"),
    ("MAnd MTrue (MOr MTrue MTrue)", "MAnd.intro MTrue.intro (MOr.inl MTrue.intro)"),
    ("MOr (MAnd MTrue MTrue) MTrue", "MOr.inl (MAnd.intro MTrue.intro MTrue.intro)"),
    ("MAnd (MOr MTrue MTrue) (MAnd MTrue MTrue)", "MAnd.intro (MOr.inl MTrue.intro) (MAnd.intro MTrue.intro MTrue.intro)"),
)
HEADS = {"true": "MTrue", "false": "MFalse", "and": "MAnd", "or": "MOr"}
#: Surface fragments that type-check, by proposition.
S0_VALID = (
    ("MTrue", "MTrue.intro"),
    ("MTrue", "by exact MTrue.intro"),
    ("MAnd MTrue MTrue", "MAnd.intro MTrue.intro MTrue.intro"),
    ("MAnd MTrue MTrue", "by exact MAnd.intro MTrue.intro MTrue.intro"),
    ("MOr MFalse MTrue", "MOr.inr MTrue.intro"),
    ("MOr MTrue (MAnd MTrue MFalse)", "MOr.inl MTrue.intro"),
)


def _literal(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small table of literals, without a Python worker."""
    names = [x.split() for x in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, names, strict=True)]) for r in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def s0(spark: SparkSession) -> DataFrame:
    """All 56 surface statements: prop_lean, proof_lean, source, valid."""
    p = _literal(spark, enumerate(S0_PROPS), "i int, prop_lean string")
    q = _literal(spark, enumerate(S0_PROOFS), "j int, proof_lean string")
    index = F.col("i") * len(S0_PROOFS) + F.col("j")
    out = p.crossJoin(F.broadcast(q)).withColumn("source", F.concat(F.lit("theorem s0_t"), index.cast("string"), F.lit(" : "), "prop_lean", F.lit(" := "), "proof_lean"))
    valid = F.lit(False)
    for a, b in S0_VALID:
        valid = valid | ((F.col("prop_lean") == a) & (F.col("proof_lean") == b))
    return out.select(index.cast("long").alias("index"), "prop_lean", "proof_lean", "source", valid.alias("valid"))


def bench_theorem(i: Column) -> Column:
    """Statement number i: six aligned pairs in turn; every tenth in tactic form."""
    k = (i % len(BENCH) + 1).cast("int")
    prop, proof = F.element_at(F.array(*[F.lit(p) for p, _ in BENCH]), k), F.element_at(F.array(*[F.lit(q) for _, q in BENCH]), k)
    return F.concat(F.lit("theorem bench_t"), i.cast("string"), F.lit(" : "), prop, F.when(i % 10 == 9, " := by exact ").otherwise(" := "), proof)


def shifted_index(i: Column, seed: int) -> Column:
    return (i + F.lit(seed * 7919)) % 1000003


def bench_source(spark: SparkSession, n: int, seed: int = 0, header: str = "") -> DataFrame:
    """One row: n statements, a line each, after the header line."""
    rows = spark.range(n).select("id", bench_theorem(shifted_index(F.col("id"), seed)).alias("s"))
    lines = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "s"))), lambda x: x["s"]).alias("l"))
    return lines.select(F.concat(F.array_join(F.concat(F.array(F.lit(header)), "l") if header else F.col("l"), "\n"), F.lit("\n")).alias("source"))


def action(i: Column) -> Column:
    """Action number i of a stream of six kinds in turn: a definition, a wrong proof, its correction,
    a conjunction, a look at the definition before, a disjunction."""
    n = i.cast("string")
    k = i % 6
    t = lambda *x: F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in x])
    return (
        F.when(k == 0, t("def bench_chain", n, " : MUnit := MUnit.mk"))
        .when(k == 1, t("theorem bench_c", n, " : MTrue := MAnd.intro MTrue.intro MTrue.intro"))
        .when(k == 2, t("theorem bench_c", n, " : MTrue := MTrue.intro"))
        .when(k == 3, t("theorem bench_d", n, " : MAnd MTrue MTrue := MAnd.intro MTrue.intro MTrue.intro"))
        .when(k == 4, t("#check bench_chain", (i - 4).cast("string")))
        .otherwise(t("theorem bench_e", n, " : MOr MTrue (MAnd MTrue MTrue) := MOr.inl MTrue.intro"))
    )


def sample_id(level: Column, index: Column, seed: int, mutated: bool = False) -> Column:
    return F.concat(level, F.lit("_m" if mutated else "_t"), index.cast("string"), F.lit(f"_seed{seed}"))


#: Partitions of a level.
PARTS = 4
#: Levels below this one have 202 rows at most, whatever the leaves: they are broadcast.
SMALL_DEPTH = 3


def _side(df: DataFrame, depth: int) -> DataFrame:
    return F.broadcast(df) if depth < SMALL_DEPTH else df


# --- enumeration ------------------------------------------------------------------------------


def props(spark: SparkSession, depth: int, leaves: str = "deepest") -> DataFrame:
    """Propositions of that depth at most: key, op, left_key, right_key.

    leaves: "true" (only true), "deepest" (false also, at depth 0 only), "both" (false anywhere).
    """
    out = _literal(spark, [("true", "true", None, None)] + ([("false", "false", None, None)] if leaves != "true" else []), "key string, op string, left_key string, right_key string")
    for d in range(depth):
        a, b = out.select(F.col("key").alias("l")), _side(out.select(F.col("key").alias("r")), d)
        ops = _literal(spark, [("and",), ("or",)], "op string")
        inner = a.crossJoin(b).crossJoin(F.broadcast(ops)).select(F.format_string("(%s %s %s)", "op", "l", "r").alias("key"), "op", F.col("l").alias("left_key"), F.col("r").alias("right_key"))
        leaf = [("true", "true", None, None)] + ([("false", "false", None, None)] if leaves == "both" else [])
        out = _literal(spark, leaf, "key string, op string, left_key string, right_key string").unionByName(inner).coalesce(PARTS)
    return out


def inhabited(spark: SparkSession, depth: int, leaves: str = "deepest") -> DataFrame:
    """(prop, proof) keys: all right proofs of propositions of that depth at most, by constructor:
    truth; a conjunction from proofs of both sides; a disjunction from a proof of either side."""
    q = _literal(spark, [("true", "MTrue.intro")], "prop string, proof string")
    for d in range(depth):
        a, b = q.toDF("lp", "lq"), q.toDF("rp", "rq")
        p = _side(props(spark, d, leaves).select(F.col("key").alias("other")), d)
        both = a.crossJoin(_side(b, d)).select(F.format_string("(and %s %s)", "lp", "rp").alias("prop"), F.format_string("(MAnd.intro %s %s)", "lq", "rq").alias("proof"))
        left = a.crossJoin(p).select(F.format_string("(or %s %s)", "lp", "other").alias("prop"), F.format_string("(MOr.inl %s)", "lq").alias("proof"))
        right = b.crossJoin(p).select(F.format_string("(or %s %s)", "other", "rp").alias("prop"), F.format_string("(MOr.inr %s)", "rq").alias("proof"))
        q = _literal(spark, [("true", "MTrue.intro")], "prop string, proof string").unionByName(both).unionByName(left).unionByName(right).coalesce(PARTS)
    return q


def rendered(key: Column) -> Column:
    """Source text of a structure key; the outermost brackets go."""
    out = key
    for op, head in HEADS.items():
        out = F.regexp_replace(out, rf"\b{op}\b", head)
    return F.regexp_replace(out, r"^\((.*)\)$", "$1")


def check(samples: DataFrame, relation: DataFrame) -> DataFrame:
    """samples with a verdict: is (prop_structure, proof_structure) in the relation?"""
    q = relation.distinct().withColumn("__ok", F.lit(True))
    joined = samples.join(q, (samples.prop_structure == q.prop) & (samples.proof_structure == q.proof), "left")
    return joined.withColumn("status", F.when(F.col("__ok"), "SUCCESS").otherwise("FAIL_TYPECHECK")).drop("prop", "proof", "__ok")


def first_of_each(df: DataFrame, by: str, n: int, seed: int, key: str) -> DataFrame:
    """n rows of each group at most, by seeded hash of the key: bounded sampling without repeats."""
    from pyspark.sql import Window

    distinct = df.dropDuplicates([by, key])
    w = Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), key)
    return distinct.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")
