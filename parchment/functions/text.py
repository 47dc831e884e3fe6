"""Column functions over text: normal forms, predicates, labels, field rules, tokens and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: code-point ranges of Han characters
HAN = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x30000, 0x3134F))
#: fixed values: labels under a cover title
MANUAL_LABELS = (
    "使用说明书", "使用说明", "说明书", "使用手册", "用户手册", "用户使用手册", "用户操作手册", "用户操作说明",
    "操作说明书", "操作说明", "操作手册", "软件设计说明书", "软件设计说明",
)
#: fixed values: words that say nothing about a topic
GENERIC_TERMS = ("系统", "平台", "软件", "管理", "功能", "模块", "用户", "操作", "页面", "数据", "信息")
MOJIBAKE = ("Ã", "Â", "â€", "锟斤拷", "烫烫")


def fold(c: Column) -> Column:
    """Our case fold: Spark's lower (full case folding, as of ß, has no native form)."""
    return F.lower(c)


def clean_text(c: Column) -> Column:
    """Line ends go, then runs of white space become one space; ends are trimmed."""
    return F.btrim(F.regexp_replace(F.translate(c, "\r\n", ""), r"(?U)\s+", " "))


def compact_text(c: Column) -> Column:
    """Without white space, folded."""
    return fold(F.regexp_replace(c, r"(?U)\s+", ""))


def contains_script(c: Column, ranges=HAN) -> Column:
    """Whether any character lies in the code-point ranges."""
    return c.rlike("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]")


def text_damage(c: Column, mojibake: tuple[str, ...] = MOJIBAKE) -> Column:
    """Struct of flags: replacement characters, control characters, mojibake."""
    bad = reduce(lambda a, b: a | b, [c.contains(x) for x in mojibake])
    return F.struct(
        c.contains("�").alias("replacement"),
        c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]").alias("control"),
        bad.alias("mojibake"),
    )


def in_band(c: Column, low=70, high=130) -> Column:
    """Whether a count lies in the accepted band, ends included."""
    return c.between(low, high)


def is_unsafe_path(c: Column) -> Column:
    """Absolute paths, drive letters and '..' parts."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    return p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), "..")


def safe_name(c: Column, only_alphanumeric: bool = False) -> Column:
    """A name for a file system: forbidden characters, or all but letters and digits, become underscores."""
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]" if only_alphanumeric else r'[<>:"/\\|?*]', "_")


def header_text(c: Column, version: str = "V1.0") -> Column:
    """The canonical running header: the title without a version at its end, then the version."""
    major, minor = version[1:].split(".")
    return F.concat(F.btrim(F.regexp_replace(c, rf"(?i)\s*V\s*{major}\.{minor}\s*$", "")), F.lit(f" {version}"))


def is_label(c: Column, labels: tuple[str, ...] = MANUAL_LABELS, whole: bool = True) -> Column:
    """Whether the text is (or holds, if not ``whole``) a label, bare or in 【】 or [ ]."""
    any_ = "|".join(sorted(labels, key=len, reverse=True))
    if not whole:
        return c.rlike(f"(?:{any_})")
    return F.btrim(c).rlike(f"^(?:(?:{any_})|【(?:{any_})】|\\[(?:{any_})\\])$")


def unquote_name(c: Column, name: Column) -> Column:
    """Drop ASCII or typographic double quotes that wrap exactly the name."""
    out = F.replace(c, F.concat(F.lit('"'), name, F.lit('"')), name)
    return F.replace(out, F.concat(F.lit("“"), name, F.lit("”")), name)


def field_violations(c: Column, verbs: tuple[str, ...] = (), ranges=None) -> Column:
    """Names of the rules that a field text breaks, in a fixed order; a null text is empty."""
    text = F.coalesce(c, F.lit(""))
    rules = [
        (F.btrim(text) == "", "empty"),
        (text.rlike("[0-9]"), "digit"),
        (text.rlike("[()（）]"), "parenthesis"),
        (text.rlike("([,.;:!?，。；：！？])\\1"), "punctuation"),
    ]
    if ranges:
        rules.append((~contains_script(text, ranges), "script"))
    if verbs:
        rules.append((~reduce(lambda a, b: a | b, [text.contains(v) for v in verbs]), "verb"))
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))


def repair_field(c: Column) -> Column:
    """Struct of the repaired text and the number of each repair: parentheses, quotes, punctuation, ordinals."""
    steps = (
        ("ordinal_markers_removed", r"(?m)^\s*\d+[.)、]\s*", ""),
        ("parentheses_to_commas", r"[()（）]", ","),
        ("quotes_removed", '["“”]', ""),
        ("duplicate_punctuation_removed", r"([,.;:!?，。；：！？])\1+", "$1"),
    )
    text, counts = c, []
    for name, pattern, to in steps:
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(name))
        text = F.regexp_replace(text, pattern, to)
    return F.struct(text.alias("text"), *counts)


def semantic_tokens(c: Column, stop: tuple[str, ...] = GENERIC_TERMS) -> Column:
    """Distinct folded Latin words of two letters or more, and pairs of neighbouring Han characters, without stop words."""
    words = F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9_-]+"), F.lit(0)), fold)
    runs = F.regexp_extract_all(c, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_except(F.array_union(words, pairs), F.array(*[F.lit(x) for x in stop]))


def set_cosine(a: Column, b: Column) -> Column:
    """Common elements over the geometric mean of the sizes; 0 if either set is empty."""
    root = F.sqrt((F.size(a) * F.size(b)).cast("double"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / root)


def count_of(c: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a substring; 0 for an empty one."""
    gone = F.octet_length(c) - F.octet_length(F.replace(c, term, F.lit("")))  # bytes, which are known without a pass over the text
    return F.coalesce(F.try_divide(gone, F.octet_length(term)), F.lit(0)).cast("int")


def coalesce_keys(*c: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*[F.nullif(F.btrim(x), F.lit("")) for x in c])


def parse_selection(c: Column, maximum: Column) -> Column:
    """Struct of the sorted indexes that a selection text names and of whether it is valid.

    "1,3-5" with , ， 、 ; ； or white space between tokens and - ~ — or 至 in ranges, which may be reversed; all, 全部
    and 全选 select everything. A token of another form, no index at all, or one outside 1..maximum makes it invalid,
    with no indexes.
    """
    text = F.lower(F.btrim(F.regexp_replace(c, r"\s*([-~—至])\s*", "$1")))
    tokens = F.filter(F.split(text, r"[,，、;；\s]+"), lambda t: t != "")
    good = F.forall(tokens, lambda t: t.rlike(r"^\d{1,9}([-~—至]\d{1,9})?$")) & (F.size(tokens) > 0)

    def expand(t: Column) -> Column:
        a = F.regexp_extract(t, r"^(\d+)", 1).cast("int")
        b = F.regexp_extract(t, r"(\d+)$", 1).cast("int")
        # cut just beyond the bounds, so that a wild range can't grow an array
        low = F.least(F.greatest(F.least(a, b), F.lit(0)), maximum + 1)
        return F.sequence(low, F.least(F.greatest(a, b), maximum + 1))

    everything = F.when(maximum >= 1, F.sequence(F.lit(1), F.greatest(maximum, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    named = F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, expand))))
    indexes = F.when(text.isin("all", "全部", "全选"), everything).when(good, named).otherwise(F.array().cast("array<int>"))
    valid = (F.size(indexes) > 0) & (F.array_min(indexes) >= 1) & (F.array_max(indexes) <= maximum)
    valid = F.coalesce(valid, F.lit(False))
    return F.struct(F.when(valid, indexes).otherwise(F.array().cast("array<int>")).alias("indexes"), valid.alias("valid"))


def result_status(c: Column, accepted: tuple[str, ...]) -> Column:
    """'pass' if the trimmed label is an accepted one, else 'fail'."""
    return F.when(F.btrim(c).isin(*accepted), "pass").otherwise("fail")


def default_relevance(text: Column, title: Column, context: Column) -> Column:
    """Relevant at 0.9 if any token of title or context occurs in the text; empty text unknown at 0, otherwise unknown at 0.4."""
    both = F.concat_ws(" ", title, context)
    tokens = F.regexp_extract_all(both, F.lit(r"[A-Za-z0-9]{2,}|[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    low = fold(text)
    hit = F.exists(F.transform(tokens, fold), lambda t: F.contains(low, t))
    blank = F.coalesce(F.btrim(text), F.lit("")) == ""
    status = F.when(~blank & hit, "relevant").otherwise("unknown")
    return F.struct(status.alias("status"), F.when(blank, 0.0).when(hit, 0.9).otherwise(0.4).alias("confidence"))


def normalise_relevance(status: Column, confidence: Column, threshold: float = 0.85) -> Column:
    """An unknown label, and an irrelevant one below the threshold, becomes unknown."""
    s = F.lower(F.coalesce(status, F.lit("unknown")))
    c = F.coalesce(confidence, F.lit(0.0))
    s = F.when(~s.isin("relevant", "irrelevant", "unknown") | ((s == "irrelevant") & (c < threshold)), "unknown").otherwise(s)
    return F.struct(s.alias("status"), c.alias("confidence"))


def parse_verdict(c: Column, evidence_chars: int = 8) -> Column:
    """The verdict in the outermost braces of a reply; irrelevant needs evidence of enough characters. Null if none parses."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    got = F.from_json(body, "status string, confidence double, evidence string")
    s = F.lower(F.coalesce(got["status"], F.lit("unknown")))
    thin = F.length(F.btrim(F.coalesce(got["evidence"], F.lit("")))) < evidence_chars
    s = F.when(~s.isin("relevant", "irrelevant", "unknown") | ((s == "irrelevant") & thin), "unknown").otherwise(s)
    out = F.struct(s.alias("status"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(got["evidence"], F.lit("")).alias("evidence"))
    return F.when((body != "") & got["status"].isNotNull(), out)


ACTIONS = {
    "RESUME_CODE_GEN": "submitted for code recovery",
    "PLAN_ONLY": "preview: recoverable orders found",
}


def action_label(c: Column, labels: dict[str, str] | None = None, other: str = "needs manual handling") -> Column:
    """What an action means to a reader."""
    out = F.lit(other)
    for key, label in (ACTIONS if labels is None else labels).items():
        out = F.when(c == key, label).otherwise(out)
    return out
