"""Gates: sampling, verdict shares, batch fuse, statuses and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.operators import ordered


def sample_size(total: Column, ratio: float = 0.25, minimum: int = 4) -> Column:
    """How many rows of ``total`` a sample takes: the share rounded up, at least the minimum, at most all."""
    return F.least(total, F.greatest(F.lit(minimum), F.ceil(total * F.lit(float(ratio))))).cast("long")


def is_sampled(place: Column, total: Column, n: Column) -> Column:
    """Whether a place (from 0) is one of n equidistant places with both ends, half-way ones at the even place; n = 1 takes the first.

    Sample i stands at the rounded i * (total - 1) / (n - 1). Steps are at least 1, so only three samples can stand at a place: those
    beside place * (n - 1) / (total - 1). In whole numbers, whatever the size of the group.
    """
    steps, last = F.greatest(n - 1, F.lit(1)), F.greatest(total - 1, F.lit(1))
    near = F.call_function("div", place * steps, last)

    def stands(i: Column) -> Column:
        down, rest = F.call_function("div", i * (total - 1), steps), i * (total - 1) % steps
        up = (2 * rest > steps) | ((2 * rest == steps) & (down % 2 == 1))
        return (i >= 0) & (i < n) & (down + up.cast("long") == place)

    found = stands(near - 1) | stands(near) | stands(near + 1)
    return (total > 0) & (n > 0) & F.when(n == 1, place == 0).otherwise(found)


def equidistant_sample(df: DataFrame, key: str | list[str], order: list, ratio: float = 0.25, minimum: int = 4, window_rows: int = ordered.WINDOW_ROWS) -> DataFrame:
    """Rows at the equidistant places of each group in the given total order, with their 0-based place. See ordered.places for large groups."""
    rows = ordered.places(df, [key] if isinstance(key, str) else key, order, window_rows)
    n = sample_size(F.col("total"), ratio, minimum)
    return rows.where(is_sampled(F.col("place"), F.col("total"), n)).drop("total")


def bounded_review_sample(df: DataFrame, key: str | list[str], order: list, k: int, undecided: Column) -> DataFrame:
    """At most k undecided rows of each group, equidistant; none for k = 0."""
    if k <= 0:
        return df.where("false").withColumn("place", F.lit(0).cast("long"))
    return equidistant_sample(df.where(undecided), key, order, 0.0, k)


def project_gate(samples: DataFrame, key: str, status: str = "status", limit: float = 0.5) -> DataFrame:
    """(key, samples, relevant, irrelevant, blocked): more than ``limit`` of the decided samples are irrelevant."""
    out = samples.groupBy(key).agg(
        F.count("*").alias("samples"),
        F.count_if(F.col(status) == "relevant").alias("relevant"),
        F.count_if(F.col(status) == "irrelevant").alias("irrelevant"),
    )
    share = F.try_divide(F.col("irrelevant"), F.col("relevant") + F.col("irrelevant"))
    return out.withColumn("blocked", F.coalesce(share > limit, F.lit(False)))


def batch_fuse(projects: DataFrame, limit: float = 0.2, blocked: str = "blocked") -> DataFrame:
    """projects with fused: more than ``limit`` of all are blocked. The aggregate is one row, so its join broadcasts."""
    share = projects.agg(F.try_divide(F.count_if(F.col(blocked)), F.count("*")).alias("__share"))
    return projects.crossJoin(F.broadcast(share)).withColumn("fused", F.coalesce(F.col("__share") > limit, F.lit(False))).drop("__share")


def gate_status(projects: DataFrame, can_rewrite: Column | None = None) -> DataFrame:
    """projects with status: BATCH_FUSED, BLOCKED_IRRELEVANT, DATE_REWRITER_UNAVAILABLE or PREFLIGHT_PASSED, in this order."""
    ok = F.lit(True) if can_rewrite is None else can_rewrite
    status = F.when(F.col("fused"), "BATCH_FUSED").when(F.col("blocked"), "BLOCKED_IRRELEVANT").when(~ok, "DATE_REWRITER_UNAVAILABLE")
    return projects.withColumn("status", status.otherwise("PREFLIGHT_PASSED"))


def all_checks(df: DataFrame, key: str, strict: list[str], lenient: list[str]) -> DataFrame:
    """(key, passed, failures): every strict check is true and no lenient one false; failures lists failing checks in order."""
    ok = {c: F.bool_and(F.coalesce(F.col(c), F.lit(c in lenient))) for c in [*strict, *lenient]}
    out = df.groupBy(key).agg(*[x.alias(c) for c, x in ok.items()])
    failures = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in ok]))
    return out.select(key, (F.size(failures) == 0).alias("passed"), failures.alias("failures"))


def status_rollup(df: DataFrame, keys: list[str], status: str = "status", good: tuple[str, ...] = ("READY", "CLEANED"), deletions: str | None = None) -> DataFrame:
    """Roll-up over the keys from outer to inner: documents, failed, deletions and COMPLETE or PARTIAL."""
    bad = ~F.coalesce(F.col(status).isin(*good), F.lit(False))
    gone = F.coalesce(F.sum(deletions), F.lit(0)) if deletions else F.lit(0).cast("long")
    out = df.rollup(*keys).agg(F.count("*").alias("documents"), F.count_if(bad).alias("failed"), gone.alias("deletions"))
    return out.withColumn("rollup_status", F.when(F.col("failed") > 0, "PARTIAL").otherwise("COMPLETE"))


def failure_count(projects: DataFrame, applied: bool) -> DataFrame:
    """One row, failures: projects in a failing status; a preview fails nothing."""
    failing = F.col("status").isin("BATCH_FUSED", "BLOCKED_IRRELEVANT", "DATE_REWRITER_UNAVAILABLE")
    return projects.agg(F.count_if(failing & F.lit(applied)).alias("failures"))


def cover_failures(results: DataFrame, status: str = "status", failures: str = "failures") -> DataFrame:
    """One row, failures: results that aren't OK or list a failure."""
    return results.agg(F.count_if((F.col(status) != "OK") | (F.size(failures) > 0)).alias("failures"))


def modal_outliers(df: DataFrame, key: str, attr: str) -> DataFrame:
    """Rows whose attribute differs from their group's most frequent value (ties: the smallest), with that value as modal."""
    counts = df.where(F.col(attr).isNotNull()).groupBy(key, attr).count()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), attr))
    modal = counts.withColumn("__rank", rank).where("__rank = 1").select(key, F.col(attr).alias("modal"))
    return df.join(modal, key).where(~F.col(attr).eqNullSafe(F.col("modal")))


def median_outliers(df: DataFrame, key: str, metric: str, tolerance: float) -> DataFrame:
    """Rows whose metric is further than ``tolerance`` from their group's median, with the median."""
    middle = df.groupBy(key).agg(F.median(metric).alias("middle"))
    return df.join(middle, key).where(F.abs(F.col(metric) - F.col("middle")) > tolerance)


def section_layout(sections: DataFrame, doc: str, section: str, has_text: str, pages: str) -> DataFrame:
    """(doc, sections, ok): every section has header text and exactly one page field over its header and footer."""
    per = sections.groupBy(doc, section).agg(F.bool_or(has_text).alias("t"), F.sum(F.col(pages).cast("int")).alias("n"))
    return per.groupBy(doc).agg(F.count("*").alias("sections"), F.bool_and(F.col("t") & (F.col("n") == 1)).alias("ok"))


def batch_totals(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """(key, n, one column for each sum)."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])


def findings_report(findings: DataFrame, doc: str, order: str, kind: str, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """(doc, findings, one count for each kind): the findings of a document as an ordered list."""
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    return findings.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, kind, text))).alias("findings"), *counts)
