"""Runs of stages: order, preview and apply, commits that fail, and a whole run against plain Python."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from parchment.operators import comments
from parchment.plans import stages as G

DOCS = "name string, status string, deletions long, failures long"


def stage(spark, name, needs=(), rows=(("a", "OK", 2, 0),), seen=None, **more):
    def make(given):
        if seen is not None:
            seen.append((name, tuple(sorted(given))))
        return G.StageResult(spark.createDataFrame(list(rows), DOCS), {"made": spark.range(3)})

    return G.Stage(name, make, needs, **more)


def test_order_and_errors(spark):
    seen = []
    run = G.run_stages(spark, [stage(spark, "z", ("x", "y"), seen=seen), stage(spark, "y", ("x",), seen=seen), stage(spark, "x", seen=seen)], ["x", "y", "z"])
    assert seen == [("x", ()), ("y", ("x",)), ("z", ("x", "y"))] and run.output is None
    for bad, what in (([stage(spark, "a", ("b",)), stage(spark, "b", ("a",))], "each other"), ([stage(spark, "a", ("q",))], "no stage"), ([stage(spark, "a")] * 2, "names")):
        with pytest.raises(ValueError, match=what):
            G.run_stages(spark, bad, ["a"])


def test_report(spark):
    parts = [stage(spark, "x", rows=[("a", "OK", 2, 0), ("b", "BAD", 1, 1)]), stage(spark, "y", ("s",)), stage(spark, "s"), stage(spark, "t", status="REGISTERED", rows=[])]
    got = {r.stage: tuple(r)[2:] for r in G.run_stages(spark, parts, ["x", "y", "t"], apply=True).report.collect()}
    assert got == {"x": ("PARTIAL", 2, 1, 3), "s": ("SKIPPED", 0, 0, 0), "y": ("SKIPPED", 0, 0, 0), "t": ("REGISTERED", 0, 0, 0), "total": ("DOCUMENT_PROCESSING_PARTIAL", 2, 1, 3)}
    assert {r.status for r in G.run_stages(spark, [stage(spark, "x")], ["x"]).report.collect()} == {"READY_FOR_REVIEW", "DOCUMENT_PREVIEW_READY"}


def test_commit_is_whole_or_not_at_all(spark, tmp_path):
    target = str(tmp_path / "out")
    broken = G.Stage("b", lambda given: G.StageResult(spark.createDataFrame([("a", "OK", 0, 0)], DOCS), {"bad": spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))}))
    with pytest.raises(Exception, match="lost"):
        G.run_stages(spark, [stage(spark, "a"), broken], ["a", "b"], apply=True, target=target)
    assert not list(pathlib.Path(tmp_path).glob("out*"))
    assert G.run_stages(spark, [stage(spark, "a")], ["a"], apply=False, target=target).output is None and not list(pathlib.Path(tmp_path).glob("out*"))
    run = G.run_stages(spark, [stage(spark, "a")], ["a"], apply=True, target=target)
    assert run.output == target and spark.read.parquet(f"{target}/a/made").count() == 3 and spark.read.parquet(f"{target}/report").count() == 2
    with pytest.raises(FileExistsError):
        G.run_stages(spark, [stage(spark, "a")], ["a"], apply=True, target=target)


def test_document_run(spark, tmp_path):
    samples = spark.createDataFrame([(p, s) for p in "abcdef" for s in (["irrelevant"] * 2 if p == "a" else ["relevant", "unknown"])], "project string, status string")
    texts = spark.createDataFrame([(p, f"截至2023年{p}") for p in "abcdef"], "project string, text string")
    flags = "cover_found boolean, duplicate_cover boolean, residual_label boolean, cover_style_ok boolean, title_has_version boolean, header_ok boolean, body_style_differs boolean, first_heading_differs boolean"
    covers = spark.createDataFrame(
        [("b", None, False, None, None, None, None, False, None, None), ("c", None, True, False, True, False, True, True, True, True), ("g", "broken file", *[None] * 8)], f"project string, error string, {flags}"
    )
    lines = {"x": ["int a; // 甲", "", "/* 乙", "丙 */"], "y": ["v = n // 数"], "z": ["plain"]}
    code = spark.createDataFrame([(d, i, t) for d, ts in lines.items() for i, t in enumerate(ts)], "doc string, idx int, text string")
    files = spark.createDataFrame([("p/a.txt", "txt"), ("p/b.docx", "other")], "path string, role string")
    run = G.combined_run(spark, G.document_stages(samples, texts, covers, code, files, 2025, ((0x4E00, 0x9FFF),), apply=True), "txt,code,manual", True, str(tmp_path / "run"))
    han = re.compile("[一-鿿]")
    found = {d: comments.scan_comments("\n".join(ts), han) for d, ts in lines.items()}
    want = {d: ("REVIEW" if doubts else "CLEANED", len(spans)) for d, (spans, doubts) in found.items()}
    assert {r.name: (r.status, r.deletions) for r in run.results["code"].documents.collect()} == want
    got = {r.stage: tuple(r)[2:] for r in spark.read.parquet(f"{run.output}/report").collect()}
    assert got["manual"] == ("PARTIAL", 7, 2, 0)  # a is blocked, g could not be read
    assert got["code"] == ("APPLIED", 3, 0, sum(len(s) for s, _ in found.values())) and got["txt"] == ("REGISTERED", 1, 0, 0)
    assert got["total"] == ("DOCUMENT_PROCESSING_PARTIAL", 11, 2, 2)
    done = {r.project: r.text for r in spark.read.parquet(f"{run.output}/manual/rewrites").collect()}
    assert done == {p: f"截至2025年{p}" for p in "bcdef"}
    plans = {r.project: r.actions for r in spark.read.parquet(f"{run.output}/manual/cover_plan").collect()}
    assert plans == {
        "b": ["ADD_COVER", "NORMALIZE_HEADER", "EXPORT_PDF"],
        "c": ["REMOVE_DUPLICATE_COVER_TEXT", "NORMALIZE_COVER_STYLE", "REMOVE_COVER_VERSION", "NORMALIZE_BODY_TEXT_STYLE", "NORMALIZE_FIRST_POST_COVER_HEADING", "EXPORT_PDF"],
    }
