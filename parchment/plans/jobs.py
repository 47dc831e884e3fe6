"""User-level jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import MANUAL_LABELS, is_label
from parchment.functions.years import rewrite_years
from parchment.operators import comments, gates, inventory, ordered, paragraphs, review, similarity
from parchment.runtime import materialize

#: fixed values: option phrases and the title keywords that justify them
CATEGORY_RULES = [
    ("软件的技术特点选项：教育软件", ("教育", "英语", "学习", "教学", "培训", "数学", "代数", "助教", "辅导", "训练", "测评", "评估", "思维")),
    ("软件的技术特点选项：大数据软件", ("数据", "分析", "大数据")),
]
ROLES = ("txt", "code_pdf", "manual_docx", "manual_pdf")


def audit_packages(
    files: DataFrame, texts: DataFrame, pages: DataFrame, manuals: DataFrame, headers: DataFrame, similar: DataFrame,
    rules=CATEGORY_RULES, labels: tuple[str, ...] = MANUAL_LABELS, login: str = "登录", version: str = "V1.0", band: tuple[int, int] = (70, 130),
) -> DataFrame:
    """(project, severity, code): sure errors, candidates for review and facts of every project.

    files (project, role); texts (project, text) of TXT files; pages (project, page, text) of code PDFs; manuals (project,
    idx, text) paragraphs; headers (project, text, has_page); similar (project) with an image like the first. A project
    without all roles has that error alone; one without paragraphs or headers lacks what they should hold. Facts tell
    whether the first and last page hold the name and the version.
    """
    name, flag = F.col("project"), lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    whole = inventory.completeness(files, "project", "role", ROLES)
    category = similarity.category_mismatch(texts, rules, "project", "project", "text").select("project", F.lit(True).alias("category")).distinct()
    ends = paragraphs.edges(pages.select("project", "page", F.coalesce("text", F.lit("")).alias("text")), "project", "page", "text")
    ends = ends.join(pages.groupBy("project").agg(F.count("*").alias("pages")), "project")
    top = F.col("idx") <= 60
    body = manuals.groupBy("project").agg(flag(top & (F.btrim("text") == name)).alias("title"), flag(top & is_label(F.col("text"), labels, whole=False)).alias("label"))
    body = body.join(similarity.mentions(manuals, "project", "text", {"login": login}), "project")
    head = headers.groupBy("project").agg(flag(F.col("text").contains(name)).alias("head_title"), flag(F.col("has_page")).alias("head_page"))
    out = whole
    for part in (category, ends, body, head, similar.select("project", F.lit(True).alias("alike")).distinct()):
        out = out.join(part, "project", "left")
    lacks = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    holds = lambda c, x: F.coalesce(F.col(c).contains(x), F.lit(False))
    found = [
        (F.col("category"), "error", "category"), (~F.coalesce("pages", F.lit(0)).between(*band), "candidate", "page_count"),
        (lacks("title"), "error", "cover_title"), (lacks("label"), "error", "cover_label"), (lacks("login"), "candidate", "login"),
        (lacks("head_title"), "error", "header_title"), (lacks("head_page"), "error", "page_field"), (F.col("alike"), "candidate", "similar_image"),
        (holds("first", name), "fact", "first_has_name"), (holds("last", name), "fact", "last_has_name"),
        (holds("first", version), "fact", "first_has_version"), (holds("last", version), "fact", "last_has_version"),
    ]
    row = lambda severity, code: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    rows = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), row(severity, code)) for test, severity, code in found]))
    rows = F.when(F.col("complete"), rows).otherwise(F.array(row("error", "missing_role")))
    return out.select("project", F.explode(rows).alias("x")).select("project", "x.*")


def content_preflight(docs: DataFrame, samples: DataFrame, target: int, can_rewrite: Column | None = None, **years) -> tuple[DataFrame, DataFrame]:
    """(projects, rewrites): gates of every project, and its texts with updated years.

    docs (project, text), samples (project, status). The rewrites depend on the batch fuse: no row of a fused batch or a
    blocked project is rewritten, so a write of them waits for the global gate.
    """
    out = gates.gate_status(gates.batch_fuse(gates.project_gate(samples, "project")), can_rewrite)
    passed = out.where("status = 'PREFLIGHT_PASSED'").select("project")
    done = docs.join(passed, "project").select("project", rewrite_years(F.col("text"), target, **years).alias("r")).select("project", "r.*")
    return out, done


def comment_audit(paras: DataFrame, doc: str, order: str, text: str, ranges) -> tuple[DataFrame, DataFrame]:
    """(spans, cleaned): comments of each document in the script, and its paragraphs without them and without doubled blanks.

    The spans are written once, as both read them. comments.comment_findings makes of these what a reviewer reads.
    """
    spans = materialize(comments.comment_spans(comments.joined_text(paras, doc, order, text), doc, text, ranges), "spans")
    cut = comments.strip_spans(paras, spans.where("kind <> 'uncertain'"), doc, order, text)
    cleaned = paragraphs.collapse_blanks(cut, doc, order, text, "emptied")
    return spans, cleaned


def comment_findings(paras: DataFrame, doc: str, order: str, text: str, ranges) -> DataFrame:
    """The findings of comment_audit: paragraphs that lose comments, with their text before and after, and unclear places with a reason."""
    spans = comments.comment_spans(comments.joined_text(paras, doc, order, text), doc, text, ranges)
    spans = materialize(spans, "spans")
    cut = comments.strip_spans(paras, spans.where("kind <> 'uncertain'"), doc, order, text)
    return comments.comment_findings(paras, spans, cut, doc, order, text)


def unified_run(stages: str, results: dict[str, DataFrame]) -> DataFrame:
    """(stage, documents, failed, deletions, status) of the chosen stages, from their document rows (status, deletions)."""
    out = None
    for name in review.select_stages(stages):
        rows = results[name].agg(
            F.count("*").alias("documents"), F.count_if(~F.col("status").isin("READY", "CLEANED")).alias("failed"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions")
        )
        rows = rows.select(F.lit(name).alias("stage"), "*", F.when(F.col("failed") > 0, "PARTIAL").otherwise("COMPLETE").alias("status"))
        out = rows if out is None else out.unionByName(rows)
    return out


def delivery_manifest(
    files: DataFrame, selection: DataFrame, batch: str = "batch", folder: str = "folder", path: str = "path", chunk: int | None = ordered.CHUNK
) -> DataFrame:
    """(batch, folder, files, bytes, fingerprint) of the approved projects' files to deliver, in folded path order.

    files (batch, folder, path, length, sha256); selection (batch, folder), folders folded. See ordered.digest_tree for large folders;
    without a chunk, ordered.digest_chain gives one SHA-256 over all of a folder's files.
    """
    wanted = selection.select(F.col(batch).alias("__b"), F.lower(folder).alias("__f")).distinct()
    rows = inventory.delivery_files(files, path).join(wanted, (F.col(batch) == F.col("__b")) & (F.lower(folder) == F.col("__f")), "left_semi")
    given = (rows, [batch, folder], [F.lower(path).alias("o"), path], F.col("sha256"), {"bytes": F.col("length")})
    out = ordered.digest_chain(*given) if chunk is None else ordered.digest_tree(*given, chunk)
    return out.select(batch, folder, F.col("n").alias("files"), "bytes", "fingerprint")
