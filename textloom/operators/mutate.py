"""Mutations that make plausible errors. Each gives null where it does not apply."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.grammar import rendered

# What may be replaced, in order, and by what.
REPLACEMENTS = (
    ("MTrue", ("MFalse", "MAnd", "MOr")),
    ("MAnd", ("MOr", "MTrue")),
    ("MOr", ("MAnd", "MTrue")),
    ("MTrue.intro", ("MAnd.intro", "MOr.inl")),
    ("MAnd.intro", ("MOr.inl", "MTrue.intro")),
    ("MOr.inl", ("MOr.inr", "MAnd.intro")),
)
LEAF_FLIP, OPERATOR_SWAP, ARGUMENT_SWAP, IDENTIFIER = 0.5, 0.4, 0.5, 0.6


def unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a seeded hash."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def replace_first(c: Column, old: str, new: Column) -> Column:
    """The first occurrence of old replaced; null if there is none."""
    at = F.locate(old, c)
    return F.when(at > 0, F.overlay(c, new, at, F.lit(len(old))))


def replace_identifier(c: Column, key: Column, seed: int) -> Column:
    """The first pair, in order, whose name occurs and whose draw falls below the rate; the
    replacement is drawn as well. Null if no pair is drawn."""
    out = []
    for k, (old, new) in enumerate(REPLACEMENTS):
        pick = F.element_at(F.array(*[F.lit(x) for x in new]), (F.floor(unit(seed, key, F.lit(f"n{k}")) * len(new)) + 1).cast("int"))
        out.append(F.when(c.contains(old) & (unit(seed, key, F.lit(f"d{k}")) < IDENTIFIER), replace_first(c, old, pick)))
    return F.coalesce(*out)


def replace_tactic(c: Column) -> Column:
    return replace_first(c, "by exact", F.lit("by apply"))


def delete_tactic(c: Column) -> Column:
    return replace_first(c, "by exact ", F.lit("by "))


def swap_arguments(op: Column, left: Column, right: Column) -> Column:
    return F.when(left.isNotNull(), F.format_string("(%s %s %s)", op, right, left))


def swap_operator(op: Column, left: Column, right: Column) -> Column:
    return F.when(left.isNotNull(), F.format_string("(%s %s %s)", F.when(op == "and", "or").otherwise("and"), left, right))


def root(key: Column) -> Column:
    return F.when(key.startswith("("), F.regexp_extract(key, r"^\((\w+) ", 1)).otherwise(key)


def label(before: Column, after: Column) -> Column:
    """By the root alone: a changed operator, or else a permutation (nested and empty edits too)."""
    return F.when(root(before) != root(after), "operator_replacement").otherwise("argument_permutation")


def exact_label(before: Column, after: Column) -> Column:
    """As label(), but null where nothing changed, and nested edits by name."""
    swapped = F.when(root(before) != root(after), "operator_replacement").when(before == after, None)
    return swapped.otherwise("argument_permutation")


def parse(key: str):
    """Nested (op, left, right) of a structure key; a string for a leaf; None if malformed."""
    stack, out = [[]], key.replace("(", " ( ").replace(")", " ) ").split()
    for t in out:
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) < 2 or len(stack[-1]) != 3:
                return None
            stack[-2].append(tuple(stack.pop()))
        else:
            stack[-1].append(t)
    return stack[0][0] if len(stack) == 1 and len(stack[0]) == 1 else None


def _show(node) -> str:
    return node if isinstance(node, str) else f"({node[0]} {_show(node[1])} {_show(node[2])})"


def _draw(seed: int, key: str, path: str) -> float:
    return zlib.crc32(f"{seed}:{key}:{path}".encode()) / 2**32


def mutated_tree(key: str, draw_key: str, seed: int) -> str | None:
    """A tree edit drawn by a seeded hash: leaves flip, operators swap, arguments swap, or both
    sides are edited in turn."""
    node = parse(key)
    if node is None:
        return None

    def edit(n, path: str):
        u = _draw(seed, draw_key, path)
        if isinstance(n, str):
            return {"true": "false", "false": "true"}.get(n, n) if u < LEAF_FLIP else n
        op, left, right = n
        if u < OPERATOR_SWAP:
            return ("or" if op == "and" else "and", left, right)
        if _draw(seed, draw_key, path + "a") < ARGUMENT_SWAP:
            return (op, right, left)
        return (op, edit(left, path + "0"), edit(right, path + "1"))

    return _show(edit(node, ""))


def tree(key: Column, draw_key: Column, seed: int) -> Column:
    """mutated_tree() over columns, in Arrow batches: trees have no native form."""

    @F.pandas_udf("string")
    def run(k: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else mutated_tree(x, str(y), seed) for x, y in zip(k, d, strict=True)])

    return run(key, draw_key)


TEXT_KINDS = ("identifier_replacement", "tactic_replacement", "tactic_deletion")


def dispatch(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df (level, source, prop_structure, proof_structure, ...) with mutant, mutant_structure and
    mutation_type, for rows to which their edit applies.

    S2 rows with a structure get a tree edit and keep their proof; an edit that changes nothing
    keeps its label, as only the checker decides. Other rows draw one of TEXT_KINDS.
    """
    kind = F.element_at(F.array(*[F.lit(x) for x in TEXT_KINDS]), (F.floor(unit(seed, F.col(key), F.lit("kind")) * len(TEXT_KINDS)) + 1).cast("int"))
    by_tree = (F.col("level") == "S2") & F.col("prop_structure").isNotNull()
    text = df.where(~F.coalesce(by_tree, F.lit(False))).withColumn("mutation_type", kind)
    c = F.col("source")
    edited = F.when(F.col("mutation_type") == TEXT_KINDS[0], replace_identifier(c, F.col(key), seed)).when(F.col("mutation_type") == TEXT_KINDS[1], replace_tactic(c)).otherwise(delete_tactic(c))
    text = text.withColumn("mutant", edited).withColumn("mutant_structure", F.col("prop_structure")).where(F.col("mutant").isNotNull() & (F.col("mutant") != c))
    trees = df.where(by_tree).withColumn("mutant_structure", tree(F.col("prop_structure"), F.col(key), seed)).where(F.col("mutant_structure").isNotNull())
    shown = F.concat(F.substring_index("source", " : ", 1), F.lit(" : "), rendered(F.col("mutant_structure")), F.lit(" := "), F.element_at(F.split("source", " := ", 2), 2))
    trees = trees.withColumn("mutation_type", label(F.col("prop_structure"), F.col("mutant_structure"))).withColumn("mutant", shown)
    return text.unionByName(trees)
