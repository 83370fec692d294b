"""Content audit of a corpus: violations by row, and the one-row summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import rules as R
from textloom.functions import text as T


def violations(df: DataFrame, id_col: str, text_col: str, policy: R.Policy = R.Policy()) -> DataFrame:
    """(id, position, violation), one row for each violation, in rule order."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("clean", T.strip_code(F.col("text")))  # a column of its own: stripped once
    return rows.select("id", F.posexplode(R.audit_violations(F.col("text"), policy, clean=F.col("clean"))).alias("position", "violation"))


def report_lines(df: DataFrame, id_col: str, text_col: str, policy: R.Policy = R.Policy()) -> DataFrame:
    """violations() as lines of a report: (id, position, line), the id before each; "?" if null."""
    return violations(df, id_col, text_col, policy).select("id", "position", F.concat(F.coalesce(F.col("id").cast("string"), F.lit("?")), F.lit(": "), "violation").alias("line"))


def report_fingerprint(df: DataFrame, id_col: str, text_col: str, policy: R.Policy = R.Policy()) -> DataFrame:
    """One row: n_samples, n_violations and one fingerprint of the whole report, whatever the order
    of rows: of the counts and of the sum of the lines' own fingerprints, which combines before
    the shuffle."""
    lines = report_lines(df, id_col, text_col, policy)
    own = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("position").cast("string"), "line"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    told = lines.agg(F.count("*").alias("n_violations"), F.coalesce(F.sum(own), F.lit(0)).cast("string").alias("digest"))
    n = df.agg(F.count("*").alias("n_samples"))
    return n.crossJoin(told).select("n_samples", "n_violations", F.sha2(F.concat_ws("|", F.col("n_samples").cast("string"), F.col("n_violations").cast("string"), "digest"), 256).alias("fingerprint"))


def rule_counts(df: DataFrame, id_col: str, text_col: str, policy: R.Policy = R.Policy()) -> DataFrame:
    return violations(df, id_col, text_col, policy).groupBy("violation").agg(F.count("*").alias("n"))


def summary(df: DataFrame, text_col: str = "source", policy: R.Policy = R.Policy()) -> DataFrame:
    """One row: n_samples, n_violations, sorted imports, whether all are allowed, and ok.

    Violations are counted in the rows, so nothing but counts and distinct imports is shuffled.
    """
    per = df.select(F.col(text_col)).withColumn("__clean", T.strip_code(F.col(text_col)))
    per = per.select(F.size(R.audit_violations(F.col(text_col), policy, clean=F.col("__clean"))).alias("v"), T.imports(F.col(text_col)).alias("i"), F.size(R.import_violations(F.col(text_col), policy)).alias("bad"))
    seen = per.select(F.explode("i").alias("m")).distinct().agg(F.array_sort(F.collect_list("m")).alias("imports_seen"))
    total = per.agg(F.count("*").alias("n_samples"), F.coalesce(F.sum("v"), F.lit(0)).alias("n_violations"), F.coalesce(F.max("bad"), F.lit(0)).alias("bad"))
    return total.crossJoin(seen).select("n_samples", "n_violations", "imports_seen", (F.col("bad") == 0).alias("all_imports_allowed"), (F.col("n_violations") == 0).alias("ok"))


def level_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("level", F.lit("?")).alias("level")).agg(F.count("*").alias("n"))


def mutation_counts(df: DataFrame) -> DataFrame:
    """Rows by kind of mutation; null and empty kinds do not count."""
    return df.where(F.col("mutation_type").isNotNull() & (F.col("mutation_type") != "")).groupBy("mutation_type").agg(F.count("*").alias("n"))


def audit_files(spark, paths: list[str]) -> DataFrame:
    """Violations of generators' Python sources (declarations and markers outside literals and
    comments), by file; a missing file is one itself."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if hadoop.Path(p).getFileSystem(conf).exists(hadoop.Path(p))]
    missing = spark.createDataFrame([(p, "generator file missing") for p in paths if p not in there], "file string, violation string")
    if not there:
        return missing
    files = spark.read.text(there, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    files = files.withColumn("clean", T.strip_python(F.col("value")))
    clean = F.col("clean")
    found = [F.when(clean.rlike(rf"\b{w}\b"), F.lit(f"forbidden declaration '{w}'")) for w in R.AUDIT_DECLARATIONS] + [F.when(clean.rlike(rf"\b{w}\b"), F.lit(f"forbidden marker '{w}'")) for w in R.AUDIT_MARKERS]
    return missing.unionByName(files.select("file", F.explode(F.array_compact(F.array(*found))).alias("violation")))
