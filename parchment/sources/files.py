"""Sources: material files, text decoding, DOCX and ZIP contents, key/value lines, log status; and the report sink."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.functions.text import is_unsafe_path
from parchment.operators.ordered import digest_tree
from parchment.runtime import materialize, ship

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: fixed values: image suffixes in a document's media folder
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")

#: what reading a member may raise: encrypted, of an unknown method, broken or cut short
UNREADABLE = (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error, EOFError, ValueError)


def list_material(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """Every file below root: path, name, suffix, length, mtime and, on demand, content and its SHA-256.

    Without content only the listing is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(
        "path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"),
        "length", F.col("modificationTime").alias("mtime"), *(["content"] if with_content else []),
    )
    return out.withColumn("sha256", F.sha2("content", 256)) if with_content else out


def decode_text(content: Column) -> Column:
    """Struct of encoding and text, by BOM, then UTF-8, then GB18030; undecodable bytes are replaced under 'unknown'."""

    @F.arrow_udf("string")
    def gb(raws: pa.Array) -> pa.Array:  # Spark's decode refuses this charset
        out = []
        for raw in raws.to_pylist():
            try:
                out.append(None if raw is None else raw.decode("gb18030"))
            except UnicodeDecodeError:
                out.append(None)
        return pa.array(out, pa.string())

    start = lambda n: F.hex(F.substring(content, 1, n))
    rest = F.substring(content, F.lit(4), F.greatest(F.length(content) - 3, F.lit(0)))
    utf16 = start(2).isin("FFFE", "FEFF")
    valid = F.is_valid_utf8(content.cast("string"))
    other = gb(F.when(~valid & ~utf16, content))  # others are nulls on the way to Python
    encoding = (
        F.when((start(3) == "EFBBBF") & valid, "utf-8-sig").when(utf16, "utf-16").when(valid, "utf-8").when(other.isNotNull(), "gb18030").otherwise("unknown")
    )
    text = (
        F.when((start(3) == "EFBBBF") & valid, rest.cast("string")).when(utf16, F.decode(content, "UTF-16"))
        .when(valid, content.cast("string")).otherwise(F.coalesce(other, F.make_valid_utf8(content.cast("string"))))
    )
    return F.when(content.isNotNull(), F.struct(encoding.alias("encoding"), text.alias("text")))


def _docx_rows(path: str, content: bytes) -> list[dict]:
    """Rows of one document; a broken one is a row with an error."""
    rows = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            text = lambda node: "".join(x.text or "" for x in node.iter(W + "t"))
            for name in z.namelist():
                low = name.lower()
                if low == "word/document.xml":
                    body = ElementTree.fromstring(z.read(name)).find(W + "body")
                    for i, p in enumerate(() if body is None else body.iter(W + "p"), 1):
                        rows.append({"part": "paragraph", "idx": i, "name": f"paragraph:{i}", "text": text(p)})
                elif low.startswith(("word/header", "word/footer")) and low.endswith(".xml"):
                    root = ElementTree.fromstring(z.read(name))
                    page = any("PAGE" in (x.text or "") for x in root.iter(W + "instrText"))
                    rows.append({"part": low[5:11], "name": name, "text": text(root), "has_page": page})
                elif low.startswith("word/media/") and low.endswith(IMAGES):
                    rows.append({"part": "media", "name": name, "content": z.read(name)})
    except (*UNREADABLE, ElementTree.ParseError, KeyError) as e:
        rows.append({"part": "error", "text": f"{type(e).__name__}: {e}"})
    return [{"doc": path, **r} for r in rows]


_DOCX = pa.schema(
    [("doc", pa.string()), ("part", pa.string()), ("idx", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("has_page", pa.bool_()), ("content", pa.binary())]
)


def read_docx(files: DataFrame) -> DataFrame:
    """(doc, part, idx, name, text, has_page, content) of files with path and content.

    part is paragraph (all of the body in order, tables and blanks included), header, footer, media or error.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(_docx_rows(path, content or b""), _DOCX)

    ship(files.sparkSession)
    schema = "doc string, part string, idx int, name string, text string, has_page boolean, content binary"
    return files.select("path", "content").mapInArrow(parse, schema)


def docx_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paragraphs, headers, media) of read_docx: blank paragraphs are marked, media have sizes and hashes."""
    paragraphs = rows.where("part = 'paragraph'").select("doc", "idx", "text", (F.btrim("text") == "").alias("is_blank"))
    headers = rows.where("part in ('header', 'footer')").select("doc", "part", "name", "text", "has_page")
    media = rows.where("part = 'media'").select("doc", F.col("name").alias("media_path"), "content", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return paragraphs, headers, media


def read_zip_members(files: DataFrame, depth: int = 3, most_bytes: int = 1 << 30) -> DataFrame:
    """(archive, member_path, level, content) of ZIP files, those inside them included down to ``depth``.

    Members with unsafe paths are left out, as are encrypted or broken ones and those that unpack to more than
    ``most_bytes``. The loop over levels is bounded by depth; each level is one distributed pass over the archives that
    the level before wrote.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    archive = zipfile.ZipFile(io.BytesIO(row["content"] or b""))
                except (zipfile.BadZipFile, ValueError):
                    continue
                for m in archive.infolist():
                    if m.is_dir() or m.file_size > most_bytes:
                        continue
                    try:
                        content = archive.read(m)
                    except UNREADABLE:
                        continue
                    path = f"{row['member_path']}/{m.filename}" if row["member_path"] else m.filename
                    yield pa.RecordBatch.from_pylist([{"archive": row["archive"], "member_path": path, "raw": m.filename, "content": content}], schema)

    schema = pa.schema([("archive", pa.string()), ("member_path", pa.string()), ("raw", pa.string()), ("content", pa.binary())])
    ship(files.sparkSession)
    level, out = files.select(F.col("path").alias("archive"), F.lit("").alias("member_path"), "content"), None
    for i in range(1, depth + 1):
        level = level.mapInArrow(expand, "archive string, member_path string, raw string, content binary").where(~is_unsafe_path(F.col("raw"))).drop("raw")
        here = level.withColumn("level", F.lit(i))
        out = here if out is None else out.unionByName(here)
        if i < depth:
            level = materialize(level.where(F.lower("member_path").endswith(".zip")), "archives")
    return out.select("archive", "member_path", "level", "content")


#: bytes of a member that one row holds, and of a nested archive that is kept in memory before it goes to the task's own disk
PART_BYTES, SPOOL_BYTES = 4 << 20, 16 << 20


def _opened(path: str):
    """A file of any file system that Arrow knows, for reading at any place; a path without a scheme is local."""
    if re.match(r"^file:/", path) or "://" not in path:
        return open(re.sub(r"^file:/+", "/", path), "rb")
    where, inside = pa.fs.FileSystem.from_uri(path)
    return where.open_input_file(inside)


def _member_parts(file, prefix: str, level: int, depth: int, chosen: tuple[int, int] | None, part_bytes: int) -> Iterator[tuple[str, int, int, bytes]]:
    """(member_path, level, part, content) of a ZIP file's members, of those numbered from chosen[0] to chosen[1] only if given.

    Only the directory at its end, and one part of one member, are in memory; a nested archive is copied to a spooled file to be read in turn.
    """
    try:
        archive = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, ValueError, OSError):
        return
    low, high = chosen or (0, len(archive.infolist()))
    for m in archive.infolist()[low:high]:
        if m.is_dir() or _unsafe(m.filename):
            continue
        path = f"{prefix}{m.filename}"
        nested = tempfile.SpooledTemporaryFile(SPOOL_BYTES) if level < depth and m.filename.lower().endswith(".zip") else None
        try:
            with archive.open(m) as stream:
                part = 0
                while (content := stream.read(part_bytes)) or not part:
                    yield path, level, part, content
                    part += 1
                    if nested:
                        nested.write(content)
        except UNREADABLE:
            continue  # parts that were read stay: digests of members tell by their length
        if nested:
            with nested:
                nested.seek(0)
                yield from _member_parts(nested, f"{path}/", level + 1, depth, None, part_bytes)


def _unsafe(name: str) -> bool:
    p = name.replace("\\", "/")
    return p.startswith("/") or bool(re.match("[A-Za-z]:", p)) or ".." in p.split("/")


def stream_zip_members(paths: DataFrame, path: str = "path", depth: int = 3, part_bytes: int = PART_BYTES, members_a_task: int = 256) -> DataFrame:
    """(archive, member_path, level, part, content) of ZIP files by path, in parts of at most ``part_bytes``; an empty member is one empty part.

    First the directory of each archive is read, a few bytes at its end, and dealt out in ranges of members; each range is then read by
    its own task, so neither archives nor members need fit in memory, and one archive is many tasks. Archives inside archives down to
    ``depth`` are read by the task that meets them, through a spooled file. Members with unsafe paths are left out, as are encrypted and
    broken ones from where they can't be read, and files that are no ZIP files. Paths are of file systems that Arrow can open.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with _opened(name) as file:
                        n = len(zipfile.ZipFile(file).infolist())
                except (zipfile.BadZipFile, ValueError, OSError):
                    continue
                starts = list(range(0, n, members_a_task))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts), pa.string()), pa.array(starts, pa.int32())], ["archive", "first"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _opened(r["archive"]) as file:
                    for member, level, part, content in _member_parts(file, "", 1, depth, (r["first"], r["first"] + members_a_task), part_bytes):
                        row = {"archive": r["archive"], "member_path": member, "level": level, "part": part, "content": content}
                        yield pa.RecordBatch.from_pylist([row], _MEMBER_PART)

    ship(paths.sparkSession)
    dealt = paths.select(F.col(path).alias("archive")).distinct().mapInArrow(ranges, "archive string, first int")
    return dealt.repartition("archive", "first").mapInArrow(read, "archive string, member_path string, level int, part int, content binary")


_MEMBER_PART = pa.schema([("archive", pa.string()), ("member_path", pa.string()), ("level", pa.int32()), ("part", pa.int32()), ("content", pa.binary())])


def member_digests(parts: DataFrame) -> DataFrame:
    """(archive, member_path, level, length, parts, fingerprint) of streamed members: a digest of their parts' digests, as a tree. See ordered.digest_tree."""
    rows = parts.select("archive", "member_path", "level", "part", F.sha2("content", 256).alias("digest"), F.length("content").cast("long").alias("bytes"))
    out = digest_tree(rows, ["archive", "member_path", "level"], ["part"], F.col("digest"), {"length": F.col("bytes")})
    return out.select("archive", "member_path", "level", "length", F.col("n").alias("parts"), "fingerprint")


def parse_fields(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines 'name：value' (or ':') of each text as (key, line, field, value, is_empty, is_duplicate); other lines are left out."""
    lines = df.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line", "raw"))
    pattern = r"^\s*([^:：]+?)\s*[:：]\s*(.*?)\s*$"
    out = lines.where(F.col("raw").rlike(pattern)).select(
        key, "line", F.regexp_extract("raw", pattern, 1).alias("field"), F.regexp_extract("raw", pattern, 2).alias("value")
    )
    again = F.count("*").over(Window.partitionBy(key, "field")) > 1
    return out.select("*", (F.col("value") == "").alias("is_empty"), again.alias("is_duplicate"))


def last_json_status(df: DataFrame, run: str, seq: str, line: str, failed: str = "FAILED") -> DataFrame:
    """(run, status): of the last line by ``seq`` that is a JSON object, its status; ``failed`` where there is none."""
    is_object = F.try_parse_json(line).isNotNull() & F.btrim(line).startswith("{")
    at = F.max_by(F.when(is_object, F.get_json_object(line, "$.status")), F.when(is_object, F.col(seq)))
    return df.groupBy(run).agg(F.coalesce(at, F.lit(failed)).alias("status"))


def write_report(df: DataFrame, path: str, applied: bool, fmt: str = "parquet", parts: tuple[str, ...] = ()) -> str:
    """Write a result set under path/preview or path/applied, in folders by ``parts``, replacing that one only; gives the folder."""
    where = f"{path.rstrip('/')}/{'applied' if applied else 'preview'}"
    df.write.mode("overwrite").format(fmt).partitionBy(*parts).save(where)
    return where
