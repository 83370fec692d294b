"""A rule lexer for formal statements with its small vocabulary, as built-in array functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T

# Fixed values.
SPECIALS = ("<PAD>", "<BOS>", "<EOS>", "<UNK>")
TAGS = ("<GOAL>", "<CONTEXT>", "<STATE>", "<ERROR>", "<HISTORY>", "<ACTION>", "<GOAL_END>", "<PAD>", "<BOS>", "<EOS>")
KEYWORDS = (
    "theorem", "def", "inductive", "structure", "instance", "example", "abbrev", "axiom", "by", "exact", "intro", "apply", "rfl", "simp",
    "constructor", "cases", "induction", "assumption", "refine", "obtain", "have", "let", "show", "calc", "fun", "forall", "exists", "from", "where",
    "with", "at", "in", "do", "return", "if", "then", "else", "match", "true", "false", "And", "Or", "Not", "Eq", "Iff",
)
OPERATORS = (":=", "->", "→", "←", "↔", "∧", "∨", "¬", "∀", "∃", "λ", "×", "<|>", "|>", "<;", ">", "(", ")", "[", "]", "{", "}", ":", ";", ",", ".", "|", "=", "<>", "≠")
UNKNOWN = 3

VOCABULARY = (*SPECIALS, *TAGS, *KEYWORDS, *OPERATORS)
#: The later of two equal entries gives the id.
IDS = {t: i for i, t in enumerate(VOCABULARY)}
IDENTIFIER = r"[A-Za-z_Ͱ-Ͽ][A-Za-z0-9_Ͱ-Ͽ.!?'⟨⟩]*"


def pattern(whitespace: str = T.WS + "+", digits: str = r"\p{Nd}+", escape: str = r"\u") -> str:
    """Alternatives in order: tags, identifiers, digits, white space, operators (longest first,
    as no operator is a prefix of a later, longer one), any other character."""
    ops = sorted(OPERATORS, key=len, reverse=True)
    quoted = [re.sub(r"([\[\](){}|.*+?^$\\])", r"\\\1", x) for x in (*TAGS,)]
    ops = [re.sub(r"([\[\](){}|.*+?^$\\])", r"\\\1", x) for x in ops]
    return "|".join([*quoted, IDENTIFIER.replace(r"\u", escape), digits, whitespace, *ops, "."])


def tokenize(c: Column) -> Column:
    """Tokens in order; a run of white space is one space."""
    raw = F.regexp_extract_all(c, F.lit("(?s)" + pattern()), F.lit(0))
    return F.transform(raw, lambda t: F.when(t.rlike(f"^{T.WS}"), " ").otherwise(t))


def encode(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in IDS.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(UNKNOWN)))


def decode(ids: Column) -> Column:
    names = F.array(*[F.lit(x) for x in VOCABULARY])
    return F.array_join(F.transform(ids, lambda i: F.element_at(names, i + 1)), "")


def vocabulary_size() -> int:
    return len(VOCABULARY)
