"""Files written here, read back through the sources and the streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from parchment.sources import files as S
from parchment.streaming.intake import intake_stream
from parchment.streaming.progress import progress_stream, progress_windows

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def docx(lines, images=0):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    parts = {"word/document.xml": f"<w:document {NS}><w:body>{body}<w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"}
    parts["word/header1.xml"] = f"<w:hdr {NS}><w:p><w:r><w:t>H</w:t></w:r><w:r><w:instrText> PAGE </w:instrText></w:r></w:p></w:hdr>"
    return zipped(parts | {f"word/media/image{i}.png": b"\x89PNG" + bytes([i]) for i in range(images)})


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.docx").write_bytes(docx(["one", " ", "two"], 2))
    (tmp_path / "b.docx").write_bytes(b"broken")
    files = S.list_material(spark, str(tmp_path), with_content=True)
    assert sorted((r.name, r.suffix) for r in files.collect()) == [("a.docx", ".docx"), ("b.docx", ".docx")]
    assert "content" not in S.list_material(spark, str(tmp_path)).columns
    parsed = S.read_docx(files)
    paras, headers, media = S.docx_tables(parsed)
    assert [(r.idx, r.text, r.is_blank) for r in paras.orderBy("idx").collect()] == [(1, "one", False), (2, " ", True), (3, "two", False), (4, "", True)]
    assert [(r.text, r.has_page) for r in headers.collect()] == [("H", True)]
    assert media.count() == 2 and parsed.where("part = 'error'").count() == 1


def test_zip_members(spark):
    inner = zipped({"x.txt": b"1", "deep.ZIP": zipped({"y.txt": b"2"})})
    data = zipped({"a.txt": b"0", "in.zip": inner, "../bad.txt": b"-"})
    got = S.read_zip_members(spark.createDataFrame([("p", data), ("q", b"no zip")], "path string, content binary"), depth=2)
    assert sorted((r.member_path, r.level) for r in got.collect()) == [("a.txt", 1), ("in.zip", 1), ("in.zip/deep.ZIP", 2), ("in.zip/x.txt", 2)]


def test_decoding(spark):
    cases = ["汉".encode("utf-8-sig"), "汉".encode("utf-16"), "汉".encode(), "汉字".encode("gb18030"), b"\xff\xfa\x80", b"", None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c binary").select("i", S.decode_text(F.col("c")).alias("d")).orderBy("i").collect()
    got = [r.d and (r.d.encoding, r.d.text) for r in rows]
    assert got[:4] == [("utf-8-sig", "汉"), ("utf-16", "汉"), ("utf-8", "汉"), ("gb18030", "汉字")]
    assert got[4][0] == "unknown" and "�" in got[4][1] and got[5] == ("utf-8", "") and got[6] is None


def test_fields_and_status(spark):
    df = spark.createDataFrame([(1, "名称：甲\n版本: V1.0\r\n无\n名称： \n")], "k int, t string")
    got = [(r.field, r.value, r.is_empty, r.is_duplicate) for r in S.parse_fields(df, "k", "t").orderBy("line").collect()]
    assert got == [("名称", "甲", False, True), ("版本", "V1.0", False, False), ("名称", "", True, True)]
    log = [("a", 1, '{"status":"OK"}'), ("a", 2, "text"), ("a", 3, "{bad"), ("b", 1, "text")]
    got = S.last_json_status(spark.createDataFrame(log, "run string, i int, line string"), "run", "i", "line")
    assert {r.run: r.status for r in got.collect()} == {"a": "OK", "b": "FAILED"}


def test_report_keeps_preview_apart(spark, tmp_path):
    df = spark.range(3)
    a, b = S.write_report(df, str(tmp_path), applied=False), S.write_report(df.where("id > 0"), str(tmp_path), applied=True)
    assert spark.read.parquet(a).count() == 3 and spark.read.parquet(b).count() == 2


def test_intake_once_per_content(spark, tmp_path):
    root, state, seen = tmp_path / "in", tmp_path / "state", []
    root.mkdir()

    def run():
        q = intake_stream(spark, str(root), str(state / "manifest"), lambda df: seen.extend((r.path.split("/")[-1], r.state) for r in df.select("path", "state").collect()))
        q = q.option("checkpointLocation", str(state / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    (root / "a.txt").write_bytes(b"1")
    run()
    run()
    assert seen == [("a.txt", "NEW")]
    (root / "b.txt").write_bytes(b"2")
    run()
    assert seen == [("a.txt", "NEW"), ("b.txt", "NEW")]


def test_progress_streams(spark, tmp_path):
    lines = [{"run": "r", "ts": f"2024-01-01T00:0{i}:00", "c": c, "f": i % 2, "s": s} for i, (c, s) in enumerate([(1, "RUNNING"), (3, "RUNNING"), (2, "FAILED")])]
    lines.append({"run": "r", "ts": "2024-01-01T09:00:00", "c": 9, "f": 0, "s": "LATE"})
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, lines)))
    stream = spark.readStream.schema("run string, ts timestamp, c int, f int, s string").json(str(tmp_path))
    for name, df, mode in (("p", progress_stream(stream, "run", "ts", "c", "f", "s"), "complete"), ("w", progress_windows(stream, "run", "ts", "c"), "append")):
        q = df.writeStream.format("memory").queryName(f"progress_{name}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r.current, r.failures, r.status) for r in spark.table("progress_p").collect()] == [(9, 1, "LATE")]
    assert [r.current for r in spark.table("progress_w").collect()] == [3]


def test_sweep(spark):
    """Intermediate tables lie in one folder of the application, and go when it is swept."""
    import pathlib

    from parchment import runtime

    table = runtime.materialize(spark.range(5).toDF("n"), "swept")
    files = [pathlib.Path(f.removeprefix("file://").removeprefix("file:")) for f in table.inputFiles()]
    assert table.count() == 5 and all(f.exists() and spark.sparkContext.applicationId in str(f) for f in files)
    assert runtime.sweep(spark) and not any(f.exists() for f in files)
    assert runtime.materialize(spark.range(3).toDF("n"), "again").count() == 3
