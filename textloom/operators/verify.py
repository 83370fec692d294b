"""Staged verification: cheap text rules first, then the checker on the rows that are left.

The first stage that fails decides. Rows that a stage rejects never reach the next one: the
table is filtered, not only guarded by CASE, so that a costly checker sees no more than it must.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import rules as R
from textloom.functions import text as T
from textloom.operators import diagnostics
from textloom.sources import io, process
from textloom.sources.io import Limits

NOT_CHECKED = "RESOURCE_LIMIT"
CHECKED = "status string, messages array<string>, axioms_output string"


def staged(df: DataFrame, source: str, checker: Callable[[DataFrame], DataFrame], policy: R.Policy = R.Policy()) -> DataFrame:
    """df with status, failure_class, messages (array) and kernel_axioms; a null source is empty.

    1. safety rules, 2. imports: FAIL_SAFETY with the violations joined by "; ".
    3. checker(df) adds status, messages and axioms_output to the remaining rows.
    4. Axioms outside the trusted ones turn SUCCESS into FAIL_SAFETY (class INVALID_ACTION).
    """
    unsafe = R.safety_violations(F.col(source), policy, F.col("__clean"))
    text = F.coalesce(F.col(source), F.lit(""))
    foreign = R.import_violations(text, policy)
    marked = df.withColumn("__clean", T.strip_code(text)).withColumn("__v", F.when(F.size(unsafe) > 0, unsafe).otherwise(foreign))
    marked = io.materialize(marked.drop("__clean"))  # both branches read what the rules said
    bad = marked.where(F.size("__v") > 0).select(*df.columns, F.lit("FAIL_SAFETY").alias("status"), F.array(F.array_join("__v", "; ")).alias("messages"), F.array().cast("array<string>").alias("kernel_axioms"))
    done = checker(marked.where(F.size("__v") == 0).drop("__v"))
    report = R.axiom_report(F.coalesce("axioms_output", F.lit("")))
    extra = R.axiom_violations(report)
    flat = F.array_sort(F.array_distinct(F.flatten(F.transform(report, lambda r: r["axioms"]))))
    rest = done.select(
        *df.columns,
        F.when((F.col("status") == "SUCCESS") & (F.size(extra) > 0), "FAIL_SAFETY").otherwise(F.col("status")).alias("status"),
        F.when((F.col("status") == "SUCCESS") & (F.size(extra) > 0), extra).otherwise(F.col("messages")).alias("messages"),
        flat.alias("kernel_axioms"),
    )
    return bad.unionByName(rest).withColumn("failure_class", R.failure_class(F.col("status")))


def relation_checker(relation: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Checks (prop_structure, proof_structure) by membership in an inhabitation relation; rows
    without structures are not decided."""

    def check(df: DataFrame) -> DataFrame:
        q = relation.distinct().select(F.col("prop").alias("__prop"), F.col("proof").alias("__proof"))
        joined = df.join(q, (df.prop_structure == F.col("__prop")) & (df.proof_structure == F.col("__proof")), "left")
        known = F.col("prop_structure").isNotNull() & F.col("proof_structure").isNotNull()
        status = F.when(~known, NOT_CHECKED).when(F.col("__prop").isNotNull(), "SUCCESS").otherwise("FAIL_TYPECHECK")
        message = F.when(status == "FAIL_TYPECHECK", F.array(F.lit("type mismatch"))).otherwise(F.array().cast("array<string>"))
        return joined.select(*df.columns, status.alias("status"), message.alias("messages"), F.lit("").alias("axioms_output"))

    return check


def process_checker(command: list[str], source: str, limits: Limits = Limits(), extra: dict[str, str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Runs an external program on a scratch file for each row, one child at a time in each task.

    Exit code 0 is SUCCESS; else the error lines are classified; no answer in time is TIMEOUT; a
    program that cannot be run is NOT_CHECKED, never a verdict. Of the output no more is kept than
    the limits say. Null sources are empty files.
    """

    def check(df: DataFrame) -> DataFrame:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "code int", "output string"])

        def run(batches):
            for pdf in batches:
                with tempfile.TemporaryDirectory() as folder:
                    path = Path(folder) / "candidate.txt"
                    done = []
                    for text in pdf[source]:
                        path.write_text(text or "", encoding="utf-8")
                        done.append(process.run_once([*command, str(path)], limits.batch_seconds, limits.max_output_bytes, extra))
                yield pdf.assign(code=pd.Series([c for c, _ in done], dtype="int32", index=pdf.index), output=[o for _, o in done])

        out = df.mapInPandas(run, schema)
        said = F.transform(F.split("output", "\n"), lambda x: F.when(F.regexp_extract(x, diagnostics.HEADER, 4) == "error", F.regexp_extract(x, diagnostics.HEADER, 5)))
        lines = F.filter(said, lambda x: x.isNotNull())
        status = F.when(F.col("code") == 0, "SUCCESS").when(F.col("code") == process.TIMED_OUT, "TIMEOUT").when(F.col("code") == process.NOT_RUN, NOT_CHECKED).otherwise(R.classify_failure(lines))
        return out.select(*df.columns, status.alias("status"), F.when(F.col("code") == 0, F.array().cast("array<string>")).otherwise(F.when(F.size(lines) > 0, lines).otherwise(F.array("output"))).alias("messages"), F.col("output").alias("axioms_output"))

    return check


ACTION = "previous_state string, next_state string, status string, failure_class string, messages array<string>, infos array<string>, seconds double"


def session_checker(command: list[str], source: str, imports: tuple[str, ...] = (), keep: bool = False, limits: Limits = Limits(), extra: dict[str, str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Asks a lasting child for each row, one child for each task; a child that dies is replaced
    and its row is NOT_CHECKED. With ``keep`` declarations last within a task, in row order."""

    def check(df: DataFrame) -> DataFrame:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), ACTION])

        def run(batches):
            with process.LineClient(command, limits.startup_seconds, limits.action_seconds, extra) as client:
                session = process.Session(client, imports)
                for pdf in batches:
                    records = pd.DataFrame([session.submit(x, keep) for x in pdf[source]], index=pdf.index)
                    yield pd.concat([pdf, records], axis=1) if len(pdf) else pd.concat([pdf, pd.DataFrame(columns=[c.split()[0] for c in ACTION.split(", ")])], axis=1)

        out = df.mapInPandas(run, schema)
        return out.withColumn("axioms_output", F.array_join("infos", "\n"))

    return check


def verdict(status: Column, mode: str) -> Column:
    """struct: verdict and mode, as kept with a sample."""
    return F.struct(F.when(status == "SUCCESS", "verified").otherwise("rejected").alias("verdict"), F.lit(mode).alias("mode"))


def two_tier(df: DataFrame, warm: Callable[[DataFrame], DataFrame], fresh: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows by the warm checker, but TEST rows by the fresh one."""
    test = F.coalesce(F.col("split") == "TEST", F.lit(False))
    a = warm(df.where(~test)).withColumn("mode", F.lit("interactive"))
    return a.unionByName(fresh(df.where(test)).withColumn("mode", F.lit("batch")))
