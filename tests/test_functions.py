"""Literal cases of the column functions, and random ones against plain statements of the same rules."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from parchment.functions import media, text, years
from parchment.operators import inventory
from parchment.operators.gates import is_sampled, sample_size
from parchment.plans.queries import ORACLE, QUERIES


def column(spark, values, c, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", c.alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def val():
    return F.col("v")


def test_sampling(spark):
    def plain(n, ratio=0.25, least=4):
        k = min(n, max(least, math.ceil(n * ratio)))
        return [] if n <= 0 else [0] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})

    def sampled(totals, **how):
        every = spark.createDataFrame([(t, p) for t in totals for p in range(t)], "total long, place long")
        rows = every.where(is_sampled(F.col("place"), F.col("total"), sample_size(F.col("total"), **how))).collect()
        return [sorted(r.place for r in rows if r.total == t) for t in totals]

    totals = [0, 1, 2, 3, 8, 20, *range(21, 90, 7)]
    got = sampled(totals)
    assert got == [plain(n) for n in totals]
    assert got[3:5] == [[0, 1, 2], [0, 2, 5, 7]] and len(got[5]) == 5
    assert sampled([8], ratio=0.0, minimum=2) == [[0, 7]]
    assert sampled([300], ratio=0.6, minimum=1) == [plain(300, 0.6, 1)]


def test_normal_forms(spark):
    assert column(spark, ["  a \t\n b　c ", ""], text.clean_text(val())) == ["a b c", ""]
    assert column(spark, [" A b\tC"], text.compact_text(val())) == ["abc"]
    assert column(spark, ["x汉", "x", "𠀀", "é"], text.contains_script(val())) == [True, False, True, False]
    assert column(spark, ["某软件  v 1.0 ", "V1.0软件"], text.header_text(val())) == ["某软件 V1.0", "V1.0软件 V1.0"]
    assert column(spark, ['a<b>:"/\\|?*'], text.safe_name(val())) == ["a_b________"]
    assert column(spark, ["a-b 汉.c"], text.safe_name(val(), True)) == ["a_b_汉_c"]
    flags = column(spark, ["ok", "a�", "\x01", "Ã©"], text.text_damage(val()))
    assert [tuple(f) for f in flags] == [(False,) * 3, (True, False, False), (False, True, False), (False, False, True)]


def test_paths(spark):
    paths = ["a/b", "/a", "C:\\x", "..\\escape.txt", "a/../b", "a..b/c"]
    assert column(spark, paths, text.is_unsafe_path(val())) == [False, True, True, True, True, False]


def test_labels(spark):
    assert column(spark, ["使用说明书", "【用户手册】", "[操作手册] ", "关于用户手册", "手册"], text.is_label(val())) == [True, True, True, False, False]
    assert column(spark, ["关于用户手册的话"], text.is_label(val(), whole=False)) == [True]
    assert column(spark, ['叫"甲"的“甲”和"乙"'], text.unquote_name(val(), F.lit("甲"))) == ['叫甲的甲和"乙"']


def test_field_rules(spark):
    got = column(spark, ["提供查询功能", "", "共3项", "管理（数据）", "查询，，导出", None], text.field_violations(val(), verbs=("查询", "管理")))
    assert got == [[], ["empty", "verb"], ["digit", "verb"], ["parenthesis"], ["punctuation"], ["empty", "verb"]]
    (r,) = column(spark, ['1. 查询（"数据"）。。\n2、导出'], text.repair_field(val()))
    assert tuple(r) == ("查询,数据,。\n导出", 2, 2, 2, 1)


def test_archives(spark):
    names = ["a.tar.gz", "B.ZIP", "c.7z", "d.txt", "e", "x/f.rar"]
    got = [tuple(r) for r in column(spark, names, inventory.classify_archive(val()))]
    assert got == [(".tar.gz", True, ""), (".zip", True, "zip"), (".7z", True, ""), (".txt", False, ""), ("", False, ""), (".rar", True, "rar")]
    roles = ["某代码.docx", "某代码 .PDF", "某说明.docx", "某.txt", "~$某.docx", "x.tmp", "图.png"]
    assert column(spark, roles, inventory.classify_role(val())) == ["code_docx", "code_pdf", "manual_docx", "txt", "temp", "temp", "other"]


def test_tokens(spark):
    rng = random.Random(2)
    pool = ["Alpha", "beta_2", "x", "智能", "系统管理", "数据", "-", "9a", "é", "照明控制"]
    values = [" ".join(rng.choice(pool) for _ in range(8)) for _ in range(30)] + [""]

    def plain(v):
        out = {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_-]+", v)}
        for run in re.findall(r"[\u4e00-\u9fff]{2,}", v):
            out |= {a + b for a, b in zip(run, run[1:], strict=False)}
        return out - set(text.GENERIC_TERMS)

    assert [set(x) for x in column(spark, values, text.semantic_tokens(val()))] == [plain(v) for v in values]
    other = F.lit("alpha 智能 照明")
    got = column(spark, values, text.set_cosine(text.semantic_tokens(val()), text.semantic_tokens(other)))
    b = plain("alpha 智能 照明")
    for v, x in zip(values, got, strict=True):
        a = plain(v)
        assert abs(x - (len(a & b) / math.sqrt(len(a) * len(b)) if a else 0)) < 1e-12


def test_selection(spark):
    cases = {
        "1,3-5": [1, 3, 4, 5], "5-3；1": [1, 3, 4, 5], "all": list(range(1, 7)), "全选": list(range(1, 7)), "2 ~ 3、6": [2, 3, 6], "1至2": [1, 2],
        "7": None, "0": None, "x": None, "": None, "1,,2": [1, 2], "1-999999999": None, "1-2-3": None,
    }
    got = column(spark, list(cases), text.parse_selection(val(), F.lit(6)))
    assert [r.indexes if r.valid else None for r in got] == list(cases.values())


def test_verdicts(spark):
    replies = ['```json\n{"status":"irrelevant","confidence":0.9,"evidence":"long enough text"}\n```', '{"status":"irrelevant","confidence":0.9,"evidence":""}', "none", '{"status":"odd"}']
    got = column(spark, replies, text.parse_verdict(val()))
    assert [g and (g.status, g.confidence) for g in got] == [("irrelevant", 0.9), ("unknown", 0.9), None, ("unknown", 0.0)]
    got = column(spark, [0.84, 0.85], text.normalise_relevance(F.lit("irrelevant"), val()), "double")
    assert [g.status for g in got] == ["unknown", "irrelevant"]
    got = column(spark, ["智能照明页面", "其他", " "], text.default_relevance(val(), F.lit("智能照明 LED"), F.lit("")))
    assert [tuple(g) for g in got] == [("relevant", 0.9), ("unknown", 0.4), ("unknown", 0.0)]


def test_year_rules(spark):
    cases = {
        "公司成立于2019年": ("KEEP", 0.95), "截至2023年": ("UPDATE", 0.95), "在2021年": ("REVIEW", 0.5), "预计2033年": ("KEEP", 1.0), "目标2025年": ("KEEP", 1.0),
        "GB/T 2018 标准": ("KEEP", 0.95), "2022年度版": ("UPDATE", 0.95), "当前成立于2020": ("KEEP", 0.95),
    }
    got = column(spark, list(cases), F.get(years.rewrite_years(val(), 2025)["decisions"], F.lit(0)))
    assert [(g.decision, g.confidence) for g in got] == list(cases.values())
    (r,) = column(spark, ["截至2023年" + "，" * 40 + "号12023和2019年生"], years.rewrite_years(val(), 2025))
    assert r.text == "截至2025年" + "，" * 40 + "号12023和2019年生" and [d.source for d in r.decisions] == ["2023", "2019"]
    low = lambda c, y: F.struct(F.lit("update").alias("decision"), F.lit(0.84).alias("confidence"))
    (r,) = column(spark, ["x 2020"], years.rewrite_years(val(), 2025, classifier=low))
    assert r.text == "x 2020" and r.decisions[0].decision == "REVIEW"


def test_year_contexts_random(spark):
    rng = random.Random(8)
    values = ["".join(rng.choice("19 20 a é 2019 1999 20211 x".split(" ")) + rng.choice(["", " "]) for _ in range(30)) for _ in range(40)] + [""]
    plain = [[(m.start(), m[0], v[max(0, m.start() - 32) : m.end() + 32]) for m in re.finditer(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", v)] for v in values]
    assert [[tuple(m) for m in x] for x in column(spark, values, years.year_mentions(val()))] == plain


def test_dates(spark):
    good = {"2024-03-01": (0, 4), "日期2023年5月": (2, 6), "十二月 2022": (4, 8), "1916-04-19": (0, 4), "3月2021": (2, 6), "2020/12/31日": (0, 4)}
    assert [[tuple(s) for s in x] for x in column(spark, list(good), years.date_year_spans(val(), 2025))] == [[s] for s in good.values()]
    bad = ["2024-02-29", "2026-02-30", "1916", "04-19 16:06", "2025-01-01", "2030年5月", "12024-03-01", "2024-13", "2024-03-011", "员工1999", "2024", ""]
    assert column(spark, bad, years.date_year_spans(val(), 2025)) == [[] for _ in bad]
    assert column(spark, ["从2023-01-02到2024年3月"], years.rewrite_date_years(val(), 2025)) == ["从2025-01-02到2025年3月"]
    box = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((3, 9), (10, 2), (5, 5))])
    (r,) = column(spark, ["于2023-01-02"], years.line_date_fields(box, val(), 2025))
    assert [tuple(f) for f in r] == [(3, 2, 11, 10, 1, 5)]


def test_images(spark):
    png, jpg, webp = b"\x89PNG\r\n\x1a\nxx", b"\xff\xd8\xffxx", b"RIFF0000WEBPx"
    rows = spark.createDataFrame([(png, ".png"), (jpg, ".JPG"), (webp, ".webp"), (png, ".jpg"), (b"", ".png"), (png, ".gif")], "c binary, s string")
    assert [r[0] for r in rows.select(media.image_signature_ok(F.col("c"), F.col("s"))).collect()] == [True, True, True, False, False, False]
    rng = random.Random(1)
    grid = [[rng.randrange(256) for _ in range(72)] for _ in range(5)]

    def plain(v):
        h = 0
        for y in range(8):
            for x in range(8):
                h = h << 1 | (v[y * 9 + x] > v[y * 9 + x + 1])
        return h - (1 << 64) if h >> 63 else h

    assert column(spark, grid, media.gradient_hash(val(), 9), "array<int>") == [plain(v) for v in grid]


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_places_are_code_points(spark, form):
    value = unicodedata.normalize(form, "é😀 2019 é")
    (m,) = column(spark, [value], years.year_mentions(val()))[0]
    assert value[m.at : m.at + 4] == "2019"


def test_running_sum(spark):
    """Either side of the block size, and arrays of no elements."""
    data = [(n, list(range(n))) for n in (0, 1, 2, 255, 256, 257, 1000)]
    got = spark.createDataFrame(data, "n int, a array<int>").select("n", "a", years.running_sum(F.col("a")).alias("s")).collect()
    assert all(r.s == [sum(r.a[: i + 1]) for i in range(r.n)] for r in got) and len(got) == len(data)


def test_each_mention_of_a_year_has_its_own_context(spark):
    """Two mentions of one year within 32 characters: what stands around one says nothing of the other."""
    keep, update = ("YEAR.{0,8}(?:HIGH|LOW)", "(?:since).{0,8}YEAR"), ("(?:current|now).{0,16}YEAR",)
    texts = ["since 1996, order 1996", "now 1996 and then, for the rest, 1996", "\U0001f600\U0001f600 1996 it is 1996 HIGH", "1996"]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select(years.rewrite_years(F.col("c"), 1999, keep, update).alias("r"))
    got = [(r.r.text, [(d.decision, d.confidence) for d in r.r.decisions]) for r in df.collect()]
    review, kept, updated = ("REVIEW", 0.5), ("KEEP", 0.95), ("UPDATE", 0.95)
    assert got == [(texts[0], [kept, review]), (texts[1].replace("now 1996", "now 1999"), [updated, review]), (texts[2], [review, kept]), ("1996", [review])]


def test_year_rewrite_of_an_order_numbered_like_its_year(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"copy (select 1990 + i as o_orderkey, timestamp '1990-01-01' + to_years(i::integer) as o_orderdate, '1-URGENT' as o_orderpriority from range(12) r(i)) to '{tmp_path}/orders.parquet'")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    want = con.sql(ORACLE["year_rewrite"])
    got = QUERIES["year_rewrite"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
