"""Compiler output to diagnostics (islands of lines), and word offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

# Fixed value: a header line is FILE:LINE:COLUMN: SEVERITY: text.
HEADER = r"^(.+?):(\d+):(\d+): (error|warning|info): ?(.*)$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def parse(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number, severity, line, column, message) of each diagnostic: a header line begins one,
    later lines that are not blank continue it, lines before the first header are dropped.

    A text is cut within its row at its header lines, so nothing is shuffled.
    """
    lines = df.select(F.col(id_col).alias("id"), F.split(F.col(text_col), LINE_END).alias("lines"))
    named = lambda x: x.contains(": error") | x.contains(": warning") | x.contains(": info")  # noqa: E731  before the pattern
    places = F.filter(F.transform("lines", lambda x, i: F.when(named(x) & x.rlike(HEADER), i + 1)), lambda i: i.isNotNull())
    heads = lines.withColumn("heads", places).where(F.size("heads") > 0)
    begun = heads.select("id", "lines", "heads", F.posexplode("heads").alias("k", "at"))
    until = F.coalesce(F.try_element_at("heads", F.col("k") + 2), F.size("lines") + 1)
    own = begun.select("id", (F.col("k") + 1).cast("long").alias("number"), F.element_at("lines", F.col("at")).alias("head"), F.slice("lines", F.col("at") + 1, until - F.col("at") - 1).alias("more"))
    part = lambda g: F.regexp_extract("head", HEADER, g)
    said = F.regexp_replace(part(5), rf"^{T.WS}+|{T.WS}+$", "")
    message = F.array_join(F.concat(F.array(said), F.filter("more", lambda x: x.rlike(T.NOT_WS))), "\n")
    return own.select("id", "number", part(4).alias("severity"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), message.alias("message"))


def error_messages(diagnostics: DataFrame) -> DataFrame:
    """(id, messages) of the error diagnostics, in order."""
    errors = diagnostics.where(F.col("severity") == "error").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("number", "message"))).alias("e"))
    return errors.select("id", F.transform("e", lambda x: x["message"]).alias("messages"))


def word_offsets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word, offset) of each word token: offsets are running sums of the lengths of the pieces
    (words, and what is between them) before it."""
    pieces = df.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(rf"{T.WORD}|[^A-Za-z_]+"), F.lit(0))).alias("pos", "word"))
    before = F.coalesce(F.sum(F.length("word")).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pieces.withColumn("offset", before.cast("long")).where(F.col("word").rlike("^[A-Za-z_]")).select("id", "word", "offset")


def first_error(errors: DataFrame) -> DataFrame:
    """(id, text) of the first error of each id that has one: its message or, if that is empty, its
    raw message; of (id, number, message, raw_message)."""
    text = F.coalesce(F.nullif(F.col("message"), F.lit("")), F.nullif(F.col("raw_message"), F.lit("")))
    return errors.groupBy("id").agg(F.min_by(text, "number").alias("text")).where(F.col("text").isNotNull())


def repl_message(c):
    """Of a serialised message: severity, line, column (0 means unknown) and text."""
    m = F.from_json(c, "severity string, line int, column int, message string")
    return F.struct(m["severity"].alias("severity"), F.nullif(m["line"], F.lit(0)).alias("line"), F.nullif(m["column"], F.lit(0)).alias("column"), m["message"].alias("message"))
