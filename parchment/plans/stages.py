"""Runs of several stages over a batch: in order of what they need, lazily, previewed or applied by one commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators import review
from parchment.plans import jobs
from parchment.runtime import materialize
from parchment.streaming.intake import _rename

#: fixed values: statuses of a whole run
PREVIEWED, DONE, PARTLY = "DOCUMENT_PREVIEW_READY", "DOCUMENT_PROCESSING_OK", "DOCUMENT_PROCESSING_PARTIAL"


@dataclass(frozen=True)
class StageResult:
    """documents (name, status, deletions, failures) of a stage, and the tables that it writes if the run is applied."""

    documents: DataFrame
    outputs: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Stage:
    """A named step: from the results of the stages it needs, by name, to its own. Its status is fixed if it changes nothing."""

    name: str
    make: Callable[[dict[str, StageResult]], StageResult]
    needs: tuple[str, ...] = ()
    status: str | None = None


@dataclass(frozen=True)
class Run:
    """report (position, stage, status, documents, failures, deletions), a row a stage and one for the whole run; the results; where they were committed."""

    report: DataFrame
    results: dict[str, StageResult]
    output: str | None


def in_order(stages: list[Stage]) -> list[Stage]:
    """The stages, each behind those it needs, otherwise as given; an error for unknown needs, repeated names and circles."""
    named = {s.name: s for s in stages}
    if len(named) < len(stages):
        raise ValueError("stages need names of their own")
    if lost := {n for s in stages for n in s.needs} - set(named):
        raise ValueError(f"no stage is named {', '.join(sorted(lost))}")
    graph = TopologicalSorter({s.name: s.needs for s in stages})
    try:
        graph.prepare()
    except CycleError as circle:
        raise ValueError(f"stages need each other: {circle.args[1]}") from circle
    out: list[Stage] = []
    while graph.is_active():
        ready = sorted(graph.get_ready(), key=list(named).index)
        out += [named[n] for n in ready]
        graph.done(*ready)
    return out


def run_stages(spark: SparkSession, stages: list[Stage], selected: list[str], apply: bool = False, target: str | None = None) -> Run:
    """Make the selected stages' results and their report; applied, write all outputs and make them visible by one rename to ``target``.

    Stages that aren't selected are SKIPPED and make nothing, and so does a stage that needs a skipped one. A preview writes nothing. If a
    write fails, nothing is visible in the target; the run can be made again. An existing target is an error before anything is written.
    """
    ordered, results, rows = in_order(stages), {}, []
    columns = "position int, stage string, status string, documents long, failures long, deletions long"
    for i, s in enumerate(ordered):
        if s.name not in selected or any(n not in results for n in s.needs):
            rows.append(spark.createDataFrame([(i, s.name, "SKIPPED", 0, 0, 0)], columns))
            continue
        made = s.make({n: results[n] for n in s.needs})
        results[s.name] = StageResult(materialize(made.documents, s.name), made.outputs)  # the report and the commit both read them
        total = results[s.name].documents.agg(
            F.count("*").alias("documents"), F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions")
        )
        status = F.when(F.col("failures") > 0, "PARTIAL").otherwise(s.status or ("APPLIED" if apply else "READY_FOR_REVIEW"))
        rows.append(total.select(F.lit(i).alias("position"), F.lit(s.name).alias("stage"), status.alias("status"), "documents", "failures", "deletions"))
    report = rows[0]
    for r in rows[1:]:
        report = report.unionByName(r)
    sums = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "failures", "deletions")])
    status = F.when(F.col("failures") > 0, PARTLY).otherwise(DONE) if apply else F.lit(PREVIEWED)
    report = report.unionByName(sums.select(F.lit(len(ordered)).alias("position"), F.lit("total").alias("stage"), status.alias("status"), "documents", "failures", "deletions"))
    return Run(report, results, _commit(spark, results, report, target) if apply and target else None)


def _commit(spark: SparkSession, results: dict[str, StageResult], report: DataFrame, target: str) -> str:
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(make(target)):
        raise FileExistsError(target)
    staged = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        for name, result in results.items():
            result.documents.write.parquet(f"{staged}/{name}/documents")
            for table, rows in result.outputs.items():
                rows.write.parquet(f"{staged}/{name}/{table}")
        report.write.parquet(f"{staged}/report")
        if not _rename(spark, staged, target):
            raise FileExistsError(target)
    except BaseException:
        files.delete(make(staged), True)
        raise
    return target


def document_stages(
    samples: DataFrame, texts: DataFrame, covers: DataFrame, code: DataFrame, files: DataFrame, target_year: int, ranges, apply: bool = False, can_rewrite=None, **years
) -> list[Stage]:
    """The stages manual, code and txt of a batch of document packages.

    samples (project, status) and texts (project, text) go through the relevance gates and get their years updated; covers (project and
    the flags of review.COVER_RULES, and error, a message where a manual could not be read) get plans of actions; code (doc, idx, text)
    loses comments in the script; files (path, role) of the role txt are only registered. A project fails where a gate stops it (when
    applied) or its cover could not be read; a code document is REVIEW where something is unclear.
    """

    def manual(_: dict[str, StageResult]) -> StageResult:
        projects, rewrites = jobs.content_preflight(texts, samples, target_year, can_rewrite, **years)
        plans = covers.select("project", F.when(F.col("error").isNull(), review.plan_actions()).alias("actions"), F.col("error").isNotNull().alias("unread"))
        stopped = F.col("status").isin("BATCH_FUSED", "BLOCKED_IRRELEVANT", "DATE_REWRITER_UNAVAILABLE") & F.lit(apply)
        unread = plans.groupBy("project").agg(F.count_if("unread").alias("unread"))
        rows = projects.select("project", "status").join(unread, "project", "full_outer")
        failures = F.coalesce(stopped.cast("long"), F.lit(0)) + F.coalesce("unread", F.lit(0))
        rows = rows.select(F.col("project").cast("string").alias("name"), F.coalesce("status", F.lit("NOT_SAMPLED")).alias("status"), F.lit(0).cast("long").alias("deletions"), failures.alias("failures"))
        return StageResult(rows, {"rewrites": rewrites, "cover_plan": plans.where("not unread").drop("unread")})

    def comments_of(_: dict[str, StageResult]) -> StageResult:
        spans, cleaned = jobs.comment_audit(code, "doc", "idx", "text", ranges)
        per = spans.groupBy("doc").agg(F.count_if(F.col("kind") != "uncertain").alias("deletions"), F.count_if(F.col("kind") == "uncertain").alias("doubts"))
        rows = code.select("doc").distinct().join(per, "doc", "left").na.fill(0, ["deletions", "doubts"])
        rows = rows.select(F.col("doc").cast("string").alias("name"), F.when(F.col("doubts") > 0, "REVIEW").otherwise("CLEANED").alias("status"), "deletions", F.lit(0).cast("long").alias("failures"))
        return StageResult(rows, {"cleaned": cleaned, "spans": spans})

    def registered(_: dict[str, StageResult]) -> StageResult:
        none = F.lit(0).cast("long")
        return StageResult(files.where("role = 'txt'").select(F.col("path").alias("name"), F.lit("UNCHANGED").alias("status"), none.alias("deletions"), none.alias("failures")))

    return [Stage("manual", manual), Stage("code", comments_of), Stage("txt", registered, status="REGISTERED")]


def combined_run(spark: SparkSession, stages: list[Stage], chosen: str, apply: bool = False, target: str | None = None) -> Run:
    """A run of the stages that a text such as "code, manual" names; see review.select_stages."""
    return run_stages(spark, stages, review.select_stages(chosen, tuple(s.name for s in stages)), apply, target)
