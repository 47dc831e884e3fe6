"""Queries over pages: inventories from addresses, comments in markup, fields in queries, and the composite jobs."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.functions import text as X
from parchment.operators import comments, inventory
from parchment.plans import jobs, stages
from parchment.plans.document_queries import GATES, verdicts
from parchment.plans.registry import Tables, query
from parchment.runtime import materialize, new_path
from parchment.sources import files as S

SUFFIXES = (".txt", "代码.docx", "代码.pdf", "说明.docx", ".zip", ".tar.gz", ".bak.tmp")


def urls(t: Tables) -> DataFrame:
    """(page_id, batch, folder, name, path, role, length, html): pages as files; host = batch, a suffix of each of seven kinds."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    tail = F.regexp_replace("url", "^[a-z]+://[^/]+/?", "")
    last = F.regexp_replace(F.element_at(F.split(tail, "/"), -1), "[?#].*$", "")
    folder = F.concat(F.lit("d"), (F.col("page_id") % 3).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("page_id") % 7 + 1).cast("int"))
    name = F.concat(F.col("last"), F.lit("-"), F.col("page_id").cast("string"), kind)
    out = t.pages.select("page_id", host.alias("batch"), last.alias("last"), "html").withColumn("folder", F.concat_ws("/", "batch", folder)).withColumn("name", name)
    return out.select(
        "page_id", "batch", "folder", "name", F.concat_ws("/", "folder", "name").alias("path"), inventory.classify_role(F.col("name")).alias("role"),
        F.length("html").cast("long").alias("length"), "html",
    )


URLS = """
u AS (
  SELECT page_id, host AS batch, host || '/d' || page_id % 3 AS folder, last || '-' || page_id || ['.txt', '代码.docx', '代码.pdf', '说明.docx', '.zip', '.tar.gz', '.bak.tmp'][page_id % 7 + 1] AS name,
         ['txt', 'code_docx', 'code_pdf', 'manual_docx', 'other', 'other', 'temp'][page_id % 7 + 1] AS role, length(html) AS length, html
  FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
          regexp_replace(string_split(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '/')[-1], '[?#].*$', '') AS last FROM pages))
"""


@query(f"""
WITH {URLS} SELECT page_id, role, CASE page_id % 7 WHEN 0 THEN '.txt' WHEN 4 THEN '.zip' WHEN 5 THEN '.tar.gz' WHEN 6 THEN '.tmp' WHEN 2 THEN '.pdf' ELSE '.docx' END AS suffix,
  page_id % 7 IN (4, 5) AS is_archive, CASE WHEN page_id % 7 = 4 THEN 'zip' ELSE '' END AS delivery, page_id % 4 = 0 OR page_id % 5 = 0 AS unsafe FROM u
""")
def url_classes(t: Tables) -> DataFrame:
    kind = inventory.classify_archive(F.col("name"))
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("a\\..\\"), "name")).when(F.col("page_id") % 5 == 0, F.concat(F.lit("C:"), "name")).otherwise(F.col("path"))
    return urls(t).select("page_id", "role", kind["suffix"].alias("suffix"), kind["is_archive"].alias("is_archive"), kind["delivery"].alias("delivery"), X.is_unsafe_path(path).alias("unsafe"))


@query(f"""
WITH {URLS}, f AS (SELECT folder, min(regexp_replace(name, '[.][^.]*$', '')) FILTER (role = 'txt') AS txt FROM u GROUP BY folder)
SELECT page_id, coalesce(txt, string_split(u.folder, '/')[-1]) AS project FROM u JOIN f ON u.folder = f.folder
""")
def project_names(t: Tables) -> DataFrame:
    return inventory.with_project_name(urls(t)).select("page_id", "project")


@query(f"""
WITH {URLS}, p AS (SELECT batch, folder, bool_or(role = 'txt') AND bool_or(role IN ('code_docx', 'code_pdf', 'manual_docx')) AS is_project FROM u GROUP BY ALL),
b AS (SELECT batch, bool_or(is_project) AS found FROM p GROUP BY batch)
SELECT batch, folder FROM p WHERE is_project UNION SELECT p.batch, string_split(folder, '/')[1] FROM p JOIN b ON p.batch = b.batch WHERE NOT found
""")
def url_projects(t: Tables) -> DataFrame:
    return inventory.discover_projects(urls(t))


@query(f"""
WITH {URLS}, a AS (SELECT *, folder || '/' || name AS path FROM u WHERE page_id % 7 IN (4, 5)),
d AS (SELECT regexp_replace(path, '[.][^./]+$', '') AS dir FROM a WHERE page_id % 3 = 0)
SELECT path FROM a WHERE page_id % 2 = 0 AND regexp_replace(path, '[.][^./]+$', '') NOT IN (SELECT dir FROM d)
""")
def pending_archives(t: Tables) -> DataFrame:
    f = urls(t).withColumn("bare", inventory.stem(F.col("path")))
    dirs = f.where("page_id % 7 in (4, 5) and page_id % 3 = 0").select(F.col("bare").alias("dir"))
    f = f.withColumn("path", F.when(F.col("page_id") % 2 == 1, F.concat("bare", F.lit("_已处理_"), inventory.archive_suffix(F.col("name")))).otherwise(F.col("path")))
    return inventory.pending_archives(f.select("path"), dirs)


@query(f"""
WITH {URLS}, r AS (SELECT batch, page_id, CASE WHEN page_id % 7 = 4 THEN 'zip' END AS fmt, page_id % 2 = 0 AS named FROM u)
SELECT batch, coalesce(arg_max(fmt, page_id) FILTER (named AND fmt IS NOT NULL), CASE WHEN count(DISTINCT fmt) = 1 THEN min(fmt) END) AS format FROM r GROUP BY batch
""")
def detect_format(t: Tables) -> DataFrame:
    named = F.when(F.col("page_id") % 2 == 0, F.concat(F.upper("batch"), inventory.archive_suffix(F.col("name")))).otherwise(F.col("name"))
    return inventory.detect_format(urls(t).withColumn("name", named), "batch", "name", "page_id")


@query(f"""
WITH {URLS},
f AS (SELECT batch, page_id, batch || CASE WHEN length(batch) % 3 = 0 THEN '/in' ELSE '' END || ['/a', '/a-b', '/a b', '/a.c', '/a/c', '/a'][
        (CASE length(batch) % 2 WHEN 0 THEN page_id % 5 ELSE 4 + page_id % 2 END)::INTEGER + 1] AS folder FROM u),
p AS (SELECT batch, string_split(folder, '/') AS parts, unnest(range(1, len(string_split(folder, '/')) + 1)) AS n FROM f),
c AS (SELECT batch, n FROM p GROUP BY batch, n HAVING count(DISTINCT array_to_string(parts[1:n], '/')) = 1
        AND count(*) = (SELECT count(*) FROM f WHERE f.batch = p.batch)),
m AS (SELECT batch, max(n) AS n FROM c GROUP BY batch),
g AS (SELECT batch, count(DISTINCT folder) AS folders, min(folder) AS one FROM f GROUP BY batch)
SELECT g.batch, array_to_string(string_split(one, '/')[1:coalesce(n, 0) - CASE WHEN folders = 1 THEN 1 ELSE 0 END], '/') AS root FROM g LEFT JOIN m ON g.batch = m.batch
""")
def common_root(t: Tables) -> DataFrame:
    """Siblings whose names sort before a slash, and batches with one deeper folder."""
    kind = F.when(F.length("batch") % 2 == 0, F.col("page_id") % 5).otherwise(F.col("page_id") % 2 + 4)
    tail = F.element_at(F.array(*map(F.lit, ("/a", "/a-b", "/a b", "/a.c", "/a/c", "/a"))), (kind + 1).cast("int"))
    deep = F.when(F.length("batch") % 3 == 0, "/in").otherwise("")
    return inventory.common_root(urls(t).withColumn("folder", F.concat("batch", deep, tail)), "batch", "folder")


@query(f"""
WITH {URLS} SELECT batch, count(*) AS n, sha256(array_to_string(list(sha256(html) ORDER BY page_id), chr(10))) AS fingerprint FROM u GROUP BY batch
""")
def batch_fingerprint(t: Tables) -> DataFrame:
    return inventory.fingerprint(urls(t).withColumn("digest", F.sha2("html", 256)), "batch", "page_id", "digest", chunk=None)


def _tree_sql(levels: int, chunk: int) -> str:
    node = f"CASE WHEN count(*) = 1 AND c // {chunk} = 0 THEN min(v) ELSE sha256(array_to_string(list(v ORDER BY c), chr(10))) END"
    return ",\n".join(f"l{i} AS (SELECT batch, c // {chunk} AS c, {node} AS v, sum(n)::BIGINT AS n FROM l{i - 1} GROUP BY batch, c // {chunk})" for i in range(1, levels))


@query(f"""
WITH r AS (SELECT page_id % 3 AS batch, sha256(html) AS d, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) - 1 AS place FROM pages),
l0 AS (SELECT batch, place // 8 AS c, sha256(array_to_string(list(d ORDER BY place), chr(10))) AS v, count(*) AS n FROM r GROUP BY batch, place // 8),
{_tree_sql(4, 8)}
SELECT batch, n, v AS fingerprint FROM l3
""")
def fingerprint_tree(t: Tables) -> DataFrame:
    """Pages in three batches, their digests in chunks of eight."""
    rows = t.pages.select((F.col("page_id") % 3).alias("batch"), "page_id", F.sha2("html", 256).alias("digest"))
    return inventory.fingerprint(rows, "batch", "page_id", "digest", chunk=8)


@query(f"""
WITH {URLS} SELECT batch, folder, count(*) AS files, sum(length)::BIGINT AS bytes, sha256(array_to_string(list(sha256(html) ORDER BY lower(folder || '/' || name)), chr(10))) AS fingerprint
FROM u WHERE role <> 'temp' AND folder NOT LIKE '%/d2' GROUP BY ALL
""")
def delivery_manifest(t: Tables) -> DataFrame:
    f = urls(t)
    approved = f.where(~F.col("folder").endswith("/d2")).select("batch", F.upper("folder").alias("folder"))
    return jobs.delivery_manifest(f.withColumn("sha256", F.sha2("html", 256)), approved, chunk=None)


@query("SELECT page_id, (instr(html, '<!--') - 1)::INTEGER AS at_char, regexp_extract(html, '(?s)<!--.*?-->') AS comment FROM pages WHERE contains(html, '<!--')")
def html_comments(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.explode(comments.html_comments(F.col("html"))).alias("c"))
    return rows.select("page_id", F.col("c.at").alias("at_char"), F.col("c.text").alias("comment"))


#: comments count where they hold a letter: the tables have no Han characters
LETTERS = ((0x61, 0x7A),)


def page_lines(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.posexplode(F.split("html", "\n")).alias("idx", "line"))


@query()
def comment_spans(t: Tables) -> DataFrame:
    return comments.comment_spans(t.pages, "page_id", "html", LETTERS)


@query()
def comment_audit(t: Tables) -> DataFrame:
    return jobs.comment_audit(page_lines(t), "page_id", "idx", "line", LETTERS)[1]


@query("""
WITH p AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS s, html FROM pages)
SELECT page_id, (length(html) - length(s))::BIGINT AS removed FROM p
""")
def stripped_markup(t: Tables) -> DataFrame:
    spans = t.pages.select("page_id", F.explode(comments.html_comments(F.col("html"))).alias("c"))
    spans = spans.select("page_id", F.col("c.at").alias("start"), (F.col("c.at") + F.length("c.text")).alias("stop"))
    one = t.pages.select("page_id", F.lit(0).alias("idx"), F.concat("html", F.lit("|")).alias("line"))
    left = comments.strip_spans(one, spans, "page_id", "idx", "line").join(t.pages, "page_id")
    return left.select("page_id", (F.length("html") + 1 - F.length("line")).cast("long").alias("removed"))


@query("""
WITH l AS (SELECT page_id, unnest(['host: ' || regexp_extract(url, '^[a-z]+://([^/]+)', 1), 'no field', 'id：' || page_id, 'id: ', 'size : ' || length(html)]) AS raw,
                  unnest(range(5)) AS line FROM pages),
f AS (SELECT page_id, line::INTEGER AS line, trim(regexp_extract(raw, '^([^:：]+?)\\s*[:：]', 1)) AS field, trim(regexp_extract(raw, '[:：](.*)$', 1)) AS value FROM l WHERE line <> 1)
SELECT *, value = '' AS is_empty, count(*) OVER (PARTITION BY page_id, field) > 1 AS is_duplicate FROM f
""")
def parse_fields(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    lines = [
        F.concat(F.lit("host: "), host), F.lit("no field"), F.concat(F.lit("id："), F.col("page_id").cast("string")), F.lit("id: "),
        F.concat(F.lit("size : "), F.length("html").cast("string")),
    ]
    return S.parse_fields(t.pages.select("page_id", F.concat_ws("\n", *lines).alias("text")), "page_id", "text")


def _docx(html: str) -> bytes:
    """A small document with the lines of a page."""
    from xml.sax.saxutils import escape

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    clean = "".join(c if c >= " " or c == "\n" else " " for c in html)
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in clean.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {ns}><w:p><w:r><w:t>head</w:t></w:r><w:r><w:instrText>PAGE</w:instrText></w:r></w:p></w:hdr>")
    return out.getvalue()


@query("SELECT page_id::VARCHAR AS doc, len(string_split(html, chr(10)))::BIGINT AS paragraphs, true AS has_page FROM pages")
def docx_paragraphs(t: Tables) -> DataFrame:
    from parchment.runtime import ship

    ship(t.spark)
    make = F.udf(_docx, "binary")
    rows = S.read_docx(t.pages.select(F.col("page_id").cast("string").alias("path"), make("html").alias("content")))
    paragraphs, headers, _ = S.docx_tables(rows)
    return paragraphs.groupBy("doc").agg(F.count("*").alias("paragraphs")).join(headers.groupBy("doc").agg(F.bool_or("has_page").alias("has_page")), "doc")


def _nested_zip(name: str, html: str) -> bytes:
    def pack(members: dict[str, bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
        return out.getvalue()

    return pack({"a.html": html.encode(), "../b.html": b"x", "in.zip": pack({f"{name}.txt": html.encode()})})


@query("""
SELECT page_id::VARCHAR AS archive, unnest(['a.html', 'in.zip', 'in.zip/' || page_id || '.txt']) AS member_path, unnest([1, 1, 2])::INTEGER AS level,
       unnest([sha256(html), NULL, sha256(html)]) AS sha256 FROM pages
""")
def zip_members(t: Tables) -> DataFrame:
    from parchment.runtime import ship

    ship(t.spark)
    make = F.udf(_nested_zip, "binary")
    path = F.col("page_id").cast("string")
    rows = S.read_zip_members(t.pages.select(path.alias("path"), make(path, "html").alias("content")))
    return rows.select("archive", "member_path", "level", F.when(~F.col("member_path").endswith(".zip"), F.sha2("content", 256)).alias("sha256"))


@query("""
SELECT page_id // 64 AS part, 'p' || page_id || '.html' AS member_path, 1 AS level, strlen(html)::BIGINT AS length, 1::BIGINT AS parts, sha256(sha256(html)) AS fingerprint FROM pages
""")
def zip_stream(t: Tables) -> DataFrame:
    """Pages in archives of 64 in the shared folder, read back member by member."""
    import pyarrow as pa
    import pyarrow.fs

    from parchment.runtime import ship

    ship(t.spark)
    root = new_path(t.spark, "archives")

    def pack(rows: pa.Table) -> pa.Table:
        where, inside = pyarrow.fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        where.create_dir(inside)
        name = f"{inside}/{rows.column('part')[0]}.zip"
        with where.open_output_stream(name) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
            for r in rows.to_pylist():
                out.writestr(f"p{r['page_id']}.html", r["html"])
        return pa.table({"path": [f"{root}/{rows.column('part')[0]}.zip"]})

    rows = t.pages.select(F.expr("page_id div 64").alias("part"), "page_id", "html")
    paths = materialize(rows.groupBy("part").applyInArrow(pack, "path string"), "paths")  # written once
    out = S.member_digests(S.stream_zip_members(paths, members_a_task=20))
    return out.select(F.regexp_extract("archive", r"/([0-9]+)[.]zip$", 1).cast("long").alias("part"), "member_path", "level", "length", "parts", "fingerprint")


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' ELSE 'gb18030' END AS encoding,
       CASE page_id % 4 WHEN 3 THEN '汉字' ELSE html END AS text FROM pages
""")
def decoded_text(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    raw = (
        F.when(k == 0, F.encode("html", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8")))
        .when(k == 2, F.encode("html", "UTF-16")).otherwise(F.unhex(F.lit("BABAD7D6")))
    )
    return t.pages.select("page_id", S.decode_text(raw).alias("d")).select("page_id", "d.*")


@query("""
WITH d AS (SELECT 'p' || doc_id // 5 AS project, doc_id // 5 AS g, text, CASE WHEN doc_id % 5 = 0 AND doc_id // 5 % 7 = 3 THEN 'other'
             ELSE ['txt', 'code_pdf', 'manual_docx', 'manual_pdf', 'manual_pdf'][doc_id % 5 + 1] END AS role FROM documents),
w AS (SELECT project, g, count(DISTINCT role) FILTER (role <> 'other') = 4 AS complete FROM d GROUP BY ALL),
l AS (SELECT project, g, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM d),
p AS (SELECT project, idx, CASE WHEN g % 2 = 0 AND idx = 0 THEN project || ' ' || line WHEN g % 3 = 0 THEN line || ' V1.0' ELSE line END AS line FROM l WHERE role = 'code_pdf'),
e AS (SELECT project, count(*) AS n, arg_min(line, idx) AS first, arg_max(line, idx) AS last FROM p GROUP BY project),
m AS (SELECT project, bool_or(idx <= 60 AND trim(line) = project) AS title, bool_or(idx <= 60 AND contains(line, 'tion')) AS label, bool_or(contains(line, 'that')) AS login
      FROM (SELECT project, idx, CASE WHEN g % 3 > 0 AND idx = 0 THEN project ELSE line END AS line FROM l WHERE role = 'manual_docx') GROUP BY project),
c AS (SELECT DISTINCT project FROM d WHERE role = 'txt' AND contains(text, 'License') AND NOT contains(project, '1')),
a AS (SELECT w.*, n, title, label, login, c.project IS NOT NULL AS category, first, last FROM w LEFT JOIN e ON w.project = e.project LEFT JOIN m ON w.project = m.project LEFT JOIN c ON w.project = c.project),
r AS (SELECT project, unnest(CASE WHEN NOT complete THEN ['error missing_role'] ELSE list_filter([
        CASE WHEN category THEN 'error category' END, CASE WHEN n NOT BETWEEN 3 AND 30 THEN 'candidate page_count' END, CASE WHEN NOT title THEN 'error cover_title' END,
        CASE WHEN NOT label THEN 'error cover_label' END, CASE WHEN NOT login THEN 'candidate login' END,
        CASE WHEN g % 4 = 0 OR g % 11 = 0 THEN 'error header_title' END, CASE WHEN g % 5 = 0 OR g % 11 = 0 THEN 'error page_field' END, CASE WHEN g % 6 = 0 THEN 'candidate similar_image' END,
        CASE WHEN contains(first, project) THEN 'fact first_has_name' END, CASE WHEN contains(last, project) THEN 'fact last_has_name' END,
        CASE WHEN contains(first, 'V1.0') THEN 'fact first_has_version' END, CASE WHEN contains(last, 'V1.0') THEN 'fact last_has_version' END], lambda x: x IS NOT NULL) END) AS x FROM a)
SELECT project, string_split(x, ' ')[1] AS severity, string_split(x, ' ')[2] AS code FROM r
""")
def package_audit(t: Tables) -> DataFrame:
    """Five documents in a row are the files of a project; every seventh project lacks its TXT."""
    g, kind = F.expr("doc_id div 5"), F.col("doc_id") % 5
    role = F.element_at(F.array(*map(F.lit, ("txt", "code_pdf", "manual_docx", "manual_pdf", "manual_pdf"))), (kind + 1).cast("int"))
    role = F.when((kind == 0) & (g % 7 == 3), "other").otherwise(role)
    f = t.documents.select(F.concat(F.lit("p"), g.cast("string")).alias("project"), g.alias("g"), role.alias("role"), "text")
    lines = f.select("project", "g", "role", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    g, line, start = F.col("g"), F.col("line"), F.col("idx") == 0
    page = F.when((g % 2 == 0) & start, F.concat("project", F.lit(" "), "line")).when(g % 3 == 0, F.concat("line", F.lit(" V1.0"))).otherwise(line)
    paras = lines.where("role = 'manual_docx'").select("project", "idx", F.when((g % 3 > 0) & start, F.col("project")).otherwise(line).alias("text"))
    headers = f.where("role = 'manual_docx' and g % 11 > 0").select(
        "project", F.when(g % 4 == 0, "other").otherwise(F.concat("project", F.lit(" V1.0"))).alias("text"), (g % 5 > 0).alias("has_page")
    )
    return jobs.audit_packages(
        f, f.where("role = 'txt'").select("project", "text"), lines.where("role = 'code_pdf'").select("project", F.col("idx").alias("page"), page.alias("text")),
        paras, headers, f.where("role = 'manual_pdf' and g % 6 = 0").select("project"), [("License", ("1",))], ("tion",), "that", band=(3, 30),
    )


@query(f"""
WITH g AS ({GATES.format(limit=0.2)}), d AS (SELECT doc_id % 100 AS project, count(*) AS texts FROM documents GROUP BY ALL)
SELECT g.project::VARCHAR AS project, samples, relevant, irrelevant, blocked, fused, status, CASE WHEN status = 'PREFLIGHT_PASSED' THEN texts ELSE 0 END AS texts,
       CASE WHEN status = 'PREFLIGHT_PASSED' THEN texts ELSE 0 END AS updated FROM g JOIN d ON g.project = d.project
""")
def content_preflight(t: Tables) -> DataFrame:
    samples = verdicts(t).withColumn("project", F.col("project").cast("string"))
    docs = t.documents.select(F.pmod("doc_id", F.lit(100)).cast("string").alias("project"), F.concat(F.lit("current 1998: "), "text").alias("text"))
    out, done = jobs.content_preflight(docs, samples, 1999, update=("(?:current).{0,16}YEAR",))
    n = done.groupBy("project").agg(F.count("*").alias("texts"), F.count_if(F.get("decisions", F.lit(0))["decision"] == "UPDATE").alias("updated"))
    return out.join(n, "project", "left").na.fill(0, ["texts", "updated"])


@query()
def unified_run(t: Tables) -> DataFrame:
    """The gates of content_preflight by project and the findings of comment_audit by page, rolled up by stage."""
    gate = F.when(F.col("status") == "PREFLIGHT_PASSED", "READY").otherwise(F.col("status"))
    manual = content_preflight(t).select(gate.alias("status"), F.lit(0).cast("long").alias("deletions"))
    found, _ = jobs.comment_audit(page_lines(t), "page_id", "idx", "line", LETTERS)
    per = found.groupBy("page_id").agg(F.count_if(F.col("kind") != "uncertain").alias("deletions"), F.count_if(F.col("kind") == "uncertain").alias("doubts"))
    code = t.pages.select("page_id").join(per, "page_id", "left").na.fill(0, ["deletions", "doubts"])
    code = code.select(F.when(F.col("doubts") > 0, "REVIEW").otherwise("CLEANED").alias("status"), "deletions")
    return jobs.unified_run("code, manual", {"manual": manual, "code": code})


@query(f"""
WITH {URLS}, g AS ({GATES.format(limit=0.2)}),
m AS (SELECT count(*) AS documents, (count(*) FILTER (status <> 'PREFLIGHT_PASSED') + count(*) FILTER (project % 17 = 0))::BIGINT AS failures FROM g),
c AS (SELECT count(*) AS documents, count(*) FILTER (regexp_matches(p_name, '[a-z]')) AS deletions FROM part),
f AS (SELECT count(*) AS documents FROM u WHERE role = 'txt')
SELECT 0 AS position, 'manual' AS stage, CASE WHEN failures > 0 THEN 'PARTIAL' ELSE 'APPLIED' END AS status, documents, failures, 0::BIGINT AS deletions FROM m
UNION ALL SELECT 1, 'code', 'APPLIED', documents, 0, deletions FROM c
UNION ALL SELECT 2, 'txt', 'REGISTERED', documents, 0, 0 FROM f
UNION ALL SELECT 3, 'total', CASE WHEN m.failures > 0 THEN 'DOCUMENT_PROCESSING_PARTIAL' ELSE 'DOCUMENT_PROCESSING_OK' END, m.documents + c.documents + f.documents, m.failures, c.deletions FROM m, c, f
""")
def combined_run(t: Tables) -> DataFrame:
    """All stages, applied: projects of documents, parts as code with a comment each and here and there an open one, pages as files. The committed report."""
    project = F.pmod("doc_id", F.lit(100)).cast("string").alias("project")
    texts = t.documents.select(project, F.concat(F.lit("current 1998: "), "text").alias("text"))
    samples = verdicts(t).withColumn("project", F.col("project").cast("string"))
    n = F.col("project").cast("int")
    flags = {"cover_found": n % 3 > 0, "duplicate_cover": n % 5 == 0, "residual_label": F.lit(False), "cover_style_ok": n % 2 == 0, "title_has_version": n % 7 == 0, "header_ok": n % 4 > 0, "body_style_differs": F.lit(None).cast("boolean"), "first_heading_differs": n % 11 == 0}
    covers = texts.select("project").distinct().select("project", F.when(n % 17 == 0, "not a document").alias("error"), *[c.alias(k) for k, c in flags.items()])
    lines = F.array(F.concat(F.lit("int a = 1; // "), "p_name"), F.when(F.col("p_partkey") % 5 == 0, "/* open").otherwise("b();"))
    code = t.part.select(F.col("p_partkey").alias("doc"), F.posexplode(lines).alias("idx", "text"))
    parts = stages.document_stages(samples, texts, covers, code, urls(t).select("path", "role"), 1999, LETTERS, apply=True, update=("(?:current).{0,16}YEAR",))
    run = stages.combined_run(t.spark, parts, "manual, code, txt", apply=True, target=new_path(t.spark, "run"))
    return t.spark.read.parquet(f"{run.output}/report")


@query("""
SELECT page_id // 1024 AS part, '.txt' AS suffix, strlen(string_agg(html || chr(10), '' ORDER BY page_id))::BIGINT AS length,
       sha256(string_agg(html || chr(10), '' ORDER BY page_id)) AS sha256 FROM pages GROUP BY part
""")
def material_listing(t: Tables) -> DataFrame:
    """Pages as report files of 1,024 each in the shared folder, and the listing of these files."""
    root = new_path(t.spark, "material")
    rows = t.pages.select(F.expr("page_id div 1024").alias("part"), "page_id", "html").repartition("part").sortWithinPartitions("part", "page_id")
    S.write_report(rows.select("part", "html"), root, applied=True, fmt="text", parts=("part",))
    files = S.list_material(t.spark, root, with_content=True)
    return files.select(F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long").alias("part"), "suffix", "length", "sha256")
