"""Column functions over years and dates in text. Nothing here consumes context: places come from the gaps between matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"
#: fixed values: contexts that keep or update a year; YEAR stands for the year
KEEP_PATTERNS = (
    "(?:历史|成立于|发布于|颁布于|修订于|自).{0,8}YEAR",
    "YEAR.{0,8}(?:年生|年成立|年发布|年颁布|年修订|年度数据|年统计)",
    "(?:GB|GB/T|ISO|IEC|RFC|标准|法规|条例|法律|版权|©|版本|合同|案例).{0,16}YEAR",
)
UPDATE_PATTERNS = (
    "(?:当前|目前|现行|最新|截至|截止|今年|本年度|本年|近期|现阶段).{0,16}YEAR",
    "YEAR.{0,12}(?:当前|最新版|最新版本|最新|现行|本年度|年度版)",
)
_Y = r"(?:19|20|21)[0-9]{2}"
#: fixed values: forms of dates
FULL_DATE = r"(?<![0-9])(?:19|20|21)[0-9]{2}[-/.年](?:1[0-2]|0?[1-9])[-/.月](?:3[01]|[12][0-9]|0?[1-9])日?(?![0-9])"
YEAR_MONTH = r"(?<![0-9])(?:19|20|21)[0-9]{2}[-/.年](?:1[0-2]|0?[1-9])月?(?![-/.月0-9])"
MONTH_YEAR = r"(?<![0-9])(?:十[一二]?|[一二三四五六七八九]|(?:1[0-2]|0?[1-9]))月\s*(?:19|20|21)[0-9]{2}(?![0-9])"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


#: places of a running sum, and characters of a text, that are worked on at once
BLOCK, TEXT_BLOCK = 256, 1024


def _running(values: Column, block: int, add: Callable[[Column, Column], Column]) -> Column:
    """Array of ``add`` over the values of an integer array up to each place, from 0 on, by blocks, so that long arrays don't take quadratic time."""
    zero = F.lit(0).cast("long")

    def folded(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(add(F.coalesce(F.get(acc, F.size(acc) - 1), zero), x))))

    def shifted(blocks: Column) -> Column:
        ends = _running(F.transform(blocks, lambda b: F.coalesce(F.get(b, F.size(b) - 1), zero)), 0, add)
        before = lambda e, i: F.coalesce(F.get(e, i - 1), zero)
        return bind(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: add(before(e, i), x).cast("int")))))

    few = F.transform(folded(values), lambda x: x.cast("int"))
    if not block:
        return few
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(block))
    out = bind(F.transform(starts, lambda at: folded(F.slice(values, at, F.lit(block)))), shifted)
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).when(F.size(values) <= block, few).otherwise(out)


def running_sum(values: Column, block: int = BLOCK) -> Column:
    """Array of the sums of an integer array up to each place."""
    return _running(values, block, lambda a, x: a + x)


def running_max(values: Column, block: int = BLOCK) -> Column:
    """Array of the greatest of the values, none below 0, of an integer array up to each place."""
    return _running(values, block, lambda a, x: F.greatest(a, x.cast("long")))


def text_blocks(c: Column) -> Column:
    """c in parts of TEXT_BLOCK characters, for cut; made once, so that cutting doesn't count characters from the start each time."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def cut(blocks: Column, at: Column, size: Column) -> Column:
    """The characters from ``at`` (from 0) on of a text in blocks, at most ``size`` and none for a negative size."""
    first, last = (at / TEXT_BLOCK).cast("int"), ((at + size - 1) / TEXT_BLOCK).cast("int")
    few = F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0)))
    return F.when(size > 0, F.substring(F.array_join(few, ""), at - first * TEXT_BLOCK + 1, size)).otherwise("")


def match_places(c: Column, pattern: str) -> Column:
    """Array of (at, text) of every match, at counted from 0 in code points."""

    def of(found: Column) -> Column:
        def ends(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
            last = bind(steps, lambda s: running_sum(s))
            return bind(last, lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("at"), m.alias("text"))))

        # most texts have no match, and then no places to work out
        return F.when(F.size(found) == 0, F.array().cast("array<struct<at:int,text:string>>")).otherwise(bind(F.split(c, pattern, -1), ends))

    return bind(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), of)


#: characters of context on either side of a year
SIDE = 32


def year_mentions(c: Column, side: int = SIDE) -> Column:
    """Array of (at, year, context) of every year from 1900 to 2099 that stands alone; context has ``side`` characters either way."""

    def with_context(found: Column) -> Column:
        def built(blocks: Column) -> Column:
            low = lambda m: F.greatest(m["at"] - side, F.lit(0))
            whole = lambda m: F.least(m["at"], F.lit(side)) + F.length(m["text"]) + side
            return F.transform(found, lambda m: F.struct(m["at"].alias("at"), m["text"].alias("year"), cut(blocks, low(m), whole(m)).alias("context")))

        none = F.array().cast("array<struct<at:int,year:string,context:string>>")
        return F.when(F.size(found) == 0, none).otherwise(bind(text_blocks(c), built))

    return bind(match_places(c, YEAR), with_context)


def classify_year(context: Column, year: Column, target: int, keep=KEEP_PATTERNS, update=UPDATE_PATTERNS, at: Column | None = None) -> Column:
    """Struct of decision (KEEP, UPDATE, REVIEW), confidence and reason; keep patterns win over update patterns.

    ``at`` is where in the context the year stands (from 0, in code points): then only what is around this mention counts, not what is
    around another one of the same year in the context. Without it any of them counts.
    """
    if at is not None:
        before, after = F.substring(context, F.lit(1), at), F.substring(context, at + F.length(year) + 1, F.length(context))

    def any_of(patterns) -> Column:
        out = F.lit(False)
        for p in patterns:
            a, b = p.split("YEAR")
            if at is None:
                out = out | F.rlike(context, F.concat(F.lit("(?i)" + a), year, F.lit(b)))
            else:
                ends, begins = F.lit(rf"(?i)(?:{a})\z"), F.lit(rf"(?i)\A(?:{b})")
                out = out | ((F.rlike(before, ends) if a else F.lit(True)) & (F.rlike(after, begins) if b else F.lit(True)))
        return out

    late = F.coalesce(year.cast("int") >= target, F.lit(True))
    kept, updated = any_of(keep), any_of(update)
    decision = F.when(late | kept, "KEEP").when(updated, "UPDATE").otherwise("REVIEW")
    confidence = F.when(late, 1.0).when(kept | updated, 0.95).otherwise(0.5)
    reason = F.when(late, "target year or later").when(kept, "context of a fixed record").when(updated, "context of the present").otherwise("context says too little")
    return F.struct(decision.alias("decision"), confidence.alias("confidence"), reason.alias("reason"))


def normalise_decision(decision: Column, confidence: Column, threshold: float = 0.85) -> Column:
    """An unknown label becomes REVIEW, and so does an UPDATE below the threshold."""
    d = F.upper(F.coalesce(decision, F.lit("REVIEW")))
    c = F.coalesce(confidence.cast("double"), F.lit(0.0))
    d = F.when(~d.isin("UPDATE", "KEEP", "REVIEW") | ((d == "UPDATE") & (c < threshold)), "REVIEW").otherwise(d)
    return F.struct(d.alias("decision"), c.alias("confidence"))


def splice(c: Column, spans: Column) -> Column:
    """c with each (at, size, text) of spans, in ascending order without overlaps, replaced by text. Each gap is cut once, the parts joined once."""

    def built(spans: Column, blocks: Column) -> Column:
        end = lambda i: F.coalesce(F.get(spans, i)["at"] + F.get(spans, i)["size"], F.lit(0))
        parts = F.transform(spans, lambda x, i: F.concat(cut(blocks, end(i - 1), x["at"] - end(i - 1)), x["text"]))
        rest = end(F.size(spans) - 1)
        return F.concat(F.array_join(parts, ""), cut(blocks, rest, F.length(c) - rest))

    return bind(spans, lambda x: F.when(F.size(x) == 0, c).otherwise(bind(text_blocks(c), lambda b: built(x, b))))


def rewrite_years(c: Column, target: int, keep=KEEP_PATTERNS, update=UPDATE_PATTERNS, threshold: float = 0.85, classifier=None, explains: bool = False) -> Column:
    """Struct of the text with updated years and of the decisions (source, replacement, context, decision, confidence, reason).

    classifier maps (context, year) to a struct of decision and confidence, and of reason if it ``explains``; the default is
    classify_year at the mention itself. A year that is not before the target stays, whatever the classifier says.
    """

    def decide(m: Column) -> Column:
        place = F.least(m["at"], F.lit(SIDE))
        raw = classifier(m["context"], m["year"]) if classifier else classify_year(m["context"], m["year"], target, keep, update, place)

        def judged(r: Column) -> Column:
            late = m["year"].cast("int") >= target
            d = normalise_decision(F.when(late, "KEEP").otherwise(r["decision"]), r["confidence"], threshold)
            reason = F.when(late, "target year or later").otherwise(F.coalesce(r["reason"], F.lit("")) if explains or not classifier else F.lit("said by the classifier"))
            new = F.when(d["decision"] == "UPDATE", F.lit(str(target))).otherwise(m["year"])
            return F.struct(
                m["at"].alias("at"), m["year"].alias("source"), new.alias("replacement"), m["context"].alias("context"),
                d["decision"].alias("decision"), d["confidence"].alias("confidence"), reason.alias("reason"),
            )

        return bind(raw, judged)

    def build(decisions: Column) -> Column:
        spans = F.transform(decisions, lambda d: F.struct(d["at"].alias("at"), F.length(d["source"]).alias("size"), d["replacement"].alias("text")))
        shown = F.transform(decisions, lambda d: d.dropFields("at"))
        return F.struct(splice(c, spans).alias("text"), shown.alias("decisions"))

    return bind(F.transform(year_mentions(c), decide), build)


def distinct_sorted(a: Column) -> Column:
    """The sorted distinct elements; unlike array_distinct in n log n also for structs."""
    return bind(F.array_sort(a), lambda x: F.filter(x, lambda v, i: (i == 0) | (v != F.get(x, i - 1))))


def union_spans(*arrays: Column) -> Column:
    """Distinct spans of several arrays, sorted."""
    return distinct_sorted(F.concat(*arrays))


def date_year_spans(c: Column, target: int) -> Column:
    """Sorted distinct (at, stop) of years before ``target`` that belong to a full date, year-month or month-year.

    A full date must exist in its own year and in the target year.
    """

    def span(m: Column) -> Column:
        at = m["at"] + F.regexp_instr(m["text"], F.lit(_Y)) - 1
        return F.struct(at.alias("at"), (at + 4).alias("stop"), F.regexp_extract(m["text"], _Y, 0).cast("int").alias("year"))

    def real(m: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(m["text"], F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
        day = lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))
        return day(F.get(parts, F.lit(0))).isNotNull() & day(F.lit(target)).isNotNull()

    full = F.transform(F.filter(match_places(c, FULL_DATE), real), span)
    # a month-year's number may stand before its year: only the year at its end counts
    tail = F.transform(
        match_places(c, MONTH_YEAR),
        lambda m: F.struct(
            (m["at"] + F.length(m["text"]) - 4).alias("at"), (m["at"] + F.length(m["text"])).alias("stop"), F.right(m["text"], F.lit(4)).cast("int").alias("year")
        ),
    )
    both = union_spans(full, F.transform(match_places(c, YEAR_MONTH), span), tail)
    early = F.filter(both, lambda s: s["year"] < target)
    return distinct_sorted(F.transform(early, lambda s: F.struct(s["at"].alias("at"), s["stop"].alias("stop"))))


def date_years(c: Column, target: int) -> Column:
    """Struct of text, c with the years of date_year_spans replaced by the target year and nothing else changed, and spans."""
    new = F.lit(str(target))

    def build(spans: Column) -> Column:
        edits = F.transform(spans, lambda s: F.struct(s["at"].alias("at"), F.lit(4).alias("size"), new.alias("text")))
        return F.struct(F.when(F.size(spans) == 0, c).otherwise(bind(edits, lambda x: splice(c, x))).alias("text"), spans.alias("spans"))

    return bind(date_year_spans(c, target), build)


def rewrite_date_years(c: Column, target: int) -> Column:
    """The text of date_years."""
    return date_years(c, target)["text"]


def line_date_fields(polygon: Column, text: Column, target: int) -> Column:
    """Array of (left, top, right, bottom, at, stop): the rectangle around a recognised line, for each date year in it."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.transform(
        date_year_spans(text, target),
        lambda s: F.struct(
            F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), (F.array_max(xs) + 1).alias("right"), (F.array_max(ys) + 1).alias("bottom"),
            s["at"].alias("at"), s["stop"].alias("stop"),
        ),
    )
