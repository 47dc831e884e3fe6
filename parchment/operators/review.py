"""Review: pairs, attribution of issues, selections, action plans and change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import fold

#: fixed values: stages in their canonical order
STAGES = ("manual", "code", "txt")


def pair_audit(left: DataFrame, right: DataFrame, keys: list[str], batches: DataFrame | None = None, names: tuple[str, str] = ("DOCX", "PDF")) -> DataFrame:
    """(keys, status): READY for keys on both sides, else SKIPPED_MISSING_ the other side.

    With ``batches`` (the first key), a batch without either file is a row with status MISSING_ the left side.
    """
    a = left.select(*[fold(F.col(k).cast("string")).alias(k) for k in keys]).distinct().withColumn("__l", F.lit(1))
    b = right.select(*[fold(F.col(k).cast("string")).alias(k) for k in keys]).distinct().withColumn("__r", F.lit(1))
    status = F.when(F.col("__r").isNull(), f"SKIPPED_MISSING_{names[1]}").when(F.col("__l").isNull(), f"SKIPPED_MISSING_{names[0]}").otherwise("READY")
    out = a.join(b, keys, "full_outer").select(*keys, status.alias("status"))
    if batches is None:
        return out
    empty = batches.select(fold(F.col(keys[0]).cast("string")).alias(keys[0])).distinct().join(out, keys[0], "left_anti")
    return out.unionByName(empty.select(keys[0], *[F.lit(None).cast("string").alias(k) for k in keys[1:]], F.lit(f"MISSING_{names[0]}").alias("status")))


def attribute_issues(issues: DataFrame, projects: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """issues with attributed: their own folder, or that of the only project of their name; null if there isn't just one."""
    known = projects.groupBy(F.col(name).alias("__name")).agg(F.count("*").alias("__n"), F.min(folder).alias("__folder"))
    blank = F.coalesce(F.col(folder), F.lit("")) == ""
    own = F.when(F.col("__n") == 1, F.col("__folder"))
    return issues.join(known, F.col(name) == F.col("__name"), "left").withColumn("attributed", F.when(blank, own).otherwise(F.col(folder))).drop("__name", "__n", "__folder")


def drop_resolved(findings: DataFrame, results: DataFrame, key: str, message: str, stale: str, final: str, passed: str) -> DataFrame:
    """findings without those of the stale message whose key has since passed."""
    done = results.where(F.col(final) == passed).select(F.col(key).alias("__key")).distinct()
    return findings.join(done, (F.col(key) == F.col("__key")) & (F.col(message) == stale), "left_anti")


def apply_selection(df: DataFrame, selection: DataFrame, index: str = "index", mode: str = "keep") -> DataFrame:
    """Rows whose index is selected, or with mode 'drop' those whose isn't."""
    return df.join(selection.select(index).distinct(), index, {"keep": "left_semi", "drop": "left_anti"}[mode])


def unknown_keys(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested keys that, folded, are not known."""
    return requested.select(fold(F.col(key)).alias(key)).distinct().join(known.select(fold(F.col(key)).alias(key)), key, "left_anti")


def common_keys(*tables: DataFrame) -> DataFrame:
    """Rows that all the tables have."""
    out = tables[0]
    for t in tables[1:]:
        out = out.intersect(t)
    return out


def select_stages(arg: str, stages: tuple[str, ...] = STAGES, executable: tuple[str, ...] = ("manual", "code")) -> list[str]:
    """The named stages in canonical order; an error for unknown ones, none, or none that does anything."""
    asked = {x.strip().lower() for x in arg.split(",") if x.strip()}
    if not asked or asked - set(stages):
        raise ValueError(f"stages must be some of {', '.join(stages)}; got {arg!r}")
    if not asked & set(executable):
        raise ValueError(f"at least one of {', '.join(executable)} is needed")
    return [s for s in stages if s in asked]


#: fixed values: audit flags (SQL) and the actions they call for, in order
COVER_RULES = (
    ("not cover_found", "ADD_COVER"),
    ("duplicate_cover or residual_label", "REMOVE_DUPLICATE_COVER_TEXT"),
    ("cover_found and not cover_style_ok", "NORMALIZE_COVER_STYLE"),
    ("title_has_version", "REMOVE_COVER_VERSION"),
    ("title_has_version", "NORMALIZE_COVER_STYLE"),
    ("not header_ok", "NORMALIZE_HEADER"),
    ("body_style_differs", "NORMALIZE_BODY_TEXT_STYLE"),
    ("first_heading_differs", "NORMALIZE_FIRST_POST_COVER_HEADING"),
    ("true", "EXPORT_PDF"),
)


def plan_actions(rules=COVER_RULES) -> Column:
    """Actions of the rules that hold, in order and without repeats; a null flag doesn't hold."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(F.expr(test), F.lit(False)), F.lit(action)) for test, action in rules])))


def review_table(audit: DataFrame, results: DataFrame, issues: DataFrame, accepted: tuple[str, ...], folder: str = "folder", name: str = "name", final: str = "final") -> DataFrame:
    """One row a project: index (folded folder order), its errors after attribution, and pass or fail of its final label."""
    from parchment.functions.text import result_status
    from parchment.operators.paragraphs import with_index

    errors = attribute_issues(issues, audit, folder, name).where("attributed is not null").groupBy(F.col("attributed").alias(folder)).agg(F.count("*").alias("errors"))
    rows = with_index(audit, None, folder).join(results.select(folder, final), folder, "left").join(errors, folder, "left")
    status = result_status(F.coalesce(F.col(final), F.lit("")), accepted)
    return rows.select("index", name, folder, F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), status.alias("status"))
