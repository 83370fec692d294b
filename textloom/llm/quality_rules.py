"""Quality rules: one threshold table compiled into one Spark projection, without user functions.

Every measure is a DataFrame expression over the whole text. Arrays are bound once with
``let`` (a one-element transform), so that a lambda never recomputes the array it indexes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent short words of the languages in use; their share tells prose from noise.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "der", "die", "und", "de", "la", "que", "el", "en", "le", "les", "et", "y", "los")
WINDOW = 5

#: (rule, measure, weight, comparison, bound, base measure, base measure's offset): a text fails if
#: weight * measure is below or above bound * (base measure - offset). All are whole numbers, so
#: that any engine decides alike.
RULES = (
    ("min_words", "n_words", 1, "<", 10, None, 0),
    ("repeated_words", "n_repeat_words", 100, ">", 20, "n_words", 0),
    ("mean_word_length", "word_chars", 1, ">", 30, "n_words", 0),
    ("symbol_ratio", "n_symbols", 100, ">", 25, "n_words", 0),
    ("duplicate_lines", "n_dup_lines", 100, ">", 60, "n_lines", 0),
    ("stop_words", "n_stop_words", 1000, "<", 5, "n_words", 40),
)
BASE_RULES = ("min_words", "repeated_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hashes of their words: one sort of the hashes tells whether
    any repeats; only then are (hash, position) pairs sorted and the covered words counted from
    the gaps between positions. Nothing is quadratic in the text's length.
    """
    size = F.size(w)

    def paired(a: Column, b: Column, step: int) -> Column:
        """Hashes of a[i] and b[i + step]: two runs of words become one."""
        rest = F.slice(b, step + 1, F.size(b) - step)
        return F.zip_with(F.slice(a, 1, F.size(b) - step), rest, lambda x, y: F.xxhash64(x, y))

    def hashes(w: Column) -> Column:
        """Of each window: words to pairs, pairs to fours, a four and a word to five."""
        return let(paired(w, w, 1), lambda two: let(paired(two, two, 2), lambda four: paired(four, w, 4)))

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        get = lambda a, i: F.get(a, i)
        twice = lambda a: F.sort_array(
            F.transform(
                F.filter(F.transform(a, lambda x, i: F.struct(x["p"].alias("p"), (F.coalesce(get(a, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(get(a, i + 1)["h"] == x["h"], F.lit(False))).alias("d"))), lambda x: x["d"]),
                lambda x: x["p"],
            )
        )
        total = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x)
        return let(pairs, lambda a: let(twice(a), total))

    return F.when(size <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(w, lambda v: let(hashes(v), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))))
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs with the measures of its whole text.

    Null and empty texts have no words, lines or symbols. Repeated rows give repeated rows.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("text"))
    pieces = base.withColumns({"pieces": F.split(F.translate("text", SPACE, " " * len(SPACE)), " "), "lines": F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")})
    split = pieces.withColumn("w", F.array_remove("pieces", ""))
    w = F.col("w")
    return split.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        (F.length("text") - (F.size("pieces") - 1)).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS, *(y.capitalize() for y in STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )


def compile_rules(rules=RULES) -> dict[str, Column]:
    """One boolean column (failed) for each row of the threshold table."""
    out = {}
    for name, measure, weight, op, bound, per, offset in rules:
        left = F.col(measure) * F.lit(weight).cast("long")
        right = F.lit(bound).cast("long") * (F.col(per) - offset if per else F.lit(1).cast("long"))
        out[name] = left < right if op == "<" else left > right
    return out


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Measures, failed rules by name, base_failed and kept, for every row of docs.

    Nulls and empty texts fail min_words. Extra columns of docs are not looked at.
    """
    failed = compile_rules(rules)
    base = F.lit(False)
    for name in BASE_RULES:
        base = base | failed[name] if name in failed else base
    every = F.lit(False)
    for c in failed.values():
        every = every | c
    m = measures(docs, id_col, text_col)
    return m.select("*", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in failed.items()])).alias("failed_rules"), base.alias("base_failed"), (~every).alias("kept"))
