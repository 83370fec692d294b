"""Column functions on source text: fingerprints, normalising, stripping, imports, proofs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the four separators that only some engines count; by Unicode category,
#: which Java tests faster than its Unicode white space or a list of ranges.
SPACES = r"\x09-\x0d\x1c-\x1f\x85\p{Z}"
WS, NOT_WS = f"[{SPACES}]", f"[^{SPACES}]"
WORD = r"[A-Za-z_][A-Za-z0-9_.!]*"
IMPORT = rf"(?md)^{WS}*import{WS}+([A-Za-z_][A-Za-z0-9_.]*)"


def fingerprint(c: Column) -> Column:
    """Exact fingerprint: SHA-256 of the UTF-8 text, lower-case hex; null for null."""
    return F.sha2(c, 256)


def fingerprint_all(parts: Column) -> Column:
    """One fingerprint of an ordered array of texts."""
    return F.sha2(F.array_join(parts, "\n\x00\n"), 256)


def normalize(c: Column) -> Column:
    """Names of theorems blanked (where a colon follows the name), white space collapsed, ends trimmed."""
    named = F.when(c.contains("theorem"), F.regexp_replace(c, rf"theorem{WS}+{NOT_WS}+{WS}*:", "theorem _ :")).otherwise(c)
    # single spaces, most of all runs, stay as they are
    return F.trim(F.regexp_replace(named, rf" {WS}+|[{SPACES}&&[^ ]]{WS}*", " "))


def normalized_fingerprint(c: Column) -> Column:
    return fingerprint(normalize(c))


def structure_fingerprint(prop: Column, proof: Column) -> Column:
    """Of a pair of structure keys; null only if both are null, else a missing side reads None."""
    text = F.concat_ws("|", F.coalesce(prop, F.lit("None")), F.coalesce(proof, F.lit("None")))
    return F.when(prop.isNotNull() | proof.isNotNull(), fingerprint(text))


def strip_code(c: Column) -> Column:
    """Block comments, then line comments, to one space each; then string literals to two quotes.
    A text without the opening mark of a kind is not searched for it."""
    where = lambda x, mark, pattern, to: F.when(x.contains(mark), F.regexp_replace(x, pattern, to)).otherwise(x)
    c = where(c, "/-", r"(?sd)/-.*?(-/|$)", " ")
    c = where(c, "--", r"--[^\n]*", " ")
    return where(c, '"', r'(?s)"(?:[^"\\]|\\.)*"', '""')


#: String literals of a Python source, those of three quotes first, and comments.
PYTHON_NOISE = (
    r'(?s)"""' + r'.*?(?:"""|\z)' + r"|'{3}.*?(?:'{3}|\z)" + r'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"?' + r"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'?" + r"|#[^\n]*"
)


def strip_python(c: Column) -> Column:
    """A Python source with each string literal and each comment turned into a space, in one scan
    from the left; a literal that is not closed ends with its line (three quotes: with the text)."""
    return F.regexp_replace(c, PYTHON_NOISE, " ")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def last_offset(cleaned: Column, word: str) -> Column:
    """Offset of the last whole-token occurrence of word, any case; null if there is none."""
    pattern = token_pattern(word)
    return F.when(cleaned.rlike(pattern), F.length(F.regexp_extract(cleaned, pattern, 1)))


def token_pattern(word: str) -> str:
    """Finds the last token equal to word; tokens are maximal runs that begin with a letter or _."""
    return rf"(?is)^((?:.*[^A-Za-z0-9_.!])?[0-9.!]*){word}(?:[^A-Za-z0-9_.!].*)?\z"


def imports(c: Column) -> Column:
    """Modules imported by lines of the raw source, comments included."""
    return F.when(c.contains("import"), F.regexp_extract_all(c, F.lit(IMPORT), F.lit(1))).when(c.isNotNull(), F.array().cast("array<string>"))


def drop_imports(c: Column) -> Column:
    """The source without its import lines."""
    return F.array_join(F.filter(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: ~F.regexp_replace(x, rf"^{WS}+", "").startswith("import ")), "\n")


def proof_of(c: Column) -> Column:
    """What follows the first := , trimmed; null where there is none."""
    return F.when(c.contains(":="), F.trim(F.element_at(F.split(c, ":=", 2), 2)))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
