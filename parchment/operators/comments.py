"""Comment clean-up: where comments are, which go, and what the paragraphs become."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import HAN
from parchment.functions.years import bind, match_places, running_max, splice
from parchment.runtime import materialize, ship

HTML_COMMENT = r"(?s)<!--.*?-->"
#: a text is a row of these; order decides between those at one place
TOKENS = re.compile(
    r"""(?P<end>\n)|(?P<blank>[^\S\n]+)|(?P<word>\w+)|(?P<triple>\"{3}|'{3})|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<template>`(?:\\.|[^`\\])*`?)|(?P<html><!--)|(?P<block>/\*)|(?P<line>//)|(?P<hash>\#)|(?P<dashes>--)|(?P<slash>/)|(?P<other>.)""",
    re.S,
)
CLOSERS = {"html": "-->", "block": "*/"}
REGEX_LITERAL = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: fixed values: what tells that a script is near, and how many characters away it may stand
SCRIPT_MARKS = re.compile(r"\b(?:const|let|var|function|new)\b|=>|\bthis\.")
NEAR = 1200
#: words that stand beside an operand without an operator between
JOINERS = frozenset("and assert await else for from if import in is lambda not or print raise return while yield".split())


def _is_expression(code: str) -> bool:
    """Whether operands and operators take turns in a line of code, as they do in Python: no two operands meet, none is missing."""
    operand, depth = False, 0
    for found in TOKENS.finditer(code):
        kind, token = found.lastgroup, found[0]
        if kind in ("blank", "end"):
            continue
        if kind in ("word", "string"):
            if token in JOINERS:
                operand = False
                continue
            if operand:
                return False
            operand = True
        elif token in "([":
            depth, operand = depth + 1, False
        elif token in ")]":
            depth, operand = depth - 1, True
            if depth < 0:
                return False
        elif kind not in ("other", "line", "slash", "dashes") or token in ";{}?!$@`。，、；：（）":
            return False
        else:
            operand = False
    return operand and not depth


@dataclass
class _Place:
    """What stands before a token on its line."""

    start: int = 0  # of the line
    empty: bool = True  # nothing but blanks
    operand: bool = False  # the last token ends a value, so an operator is expected
    name: bool = False  # a single name without blanks, as of a selector or a property
    value: bool = False  # a single name and a colon, as before the value of a property
    call: str = ""  # url or var, while their parenthesis is open
    divides: bool | None = None  # what // was found to do on the line

    def pass_over(self, kind: str, token: str, last: str, stop: int) -> None:
        if kind == "end":
            self.__init__(start=stop)
        elif kind == "blank":
            self.name = self.name and self.empty
        else:
            self.value = self.name and token == ":"
            self.name = (self.name or self.empty) and (kind == "word" or token in "-.")
            if token == "(":
                self.call = last.lower() if last.lower() in ("url", "var") else self.call
            elif token == ")":
                self.call = ""
            self.empty, self.operand = False, kind in ("word", "string", "template", "triple", "literal") or token in ")]}"


def _hash_comments(at: _Place, text: str, i: int, end: int) -> bool:
    """Whether a # begins a comment. Not within url(), nor as a property's value (a colour), nor in front of the name of a selector:
    one that stands first in a line with a brace or a comma, or that is glued to a name before it."""
    glued = text[i + 1 : i + 2].strip() != ""
    if at.call == "url" or at.value or (at.name and glued):
        return False
    return not (at.empty and glued and any(text.find(x, i, end) >= 0 for x in "{,"))


#: fixed values: what may follow -- behind a value that it decrements, by one sign or two
AFTER_DECREMENT = (";", ",", ".", "?", "]", ")", "}", ":", "//", "/*")
_BLANKS, _NAME, _COLON = re.compile(r"[^\S\n]*"), re.compile(r"[\w-]+"), re.compile(r"\s*:")


def _dashes_comment(at: _Place, text: str, i: int) -> bool:
    """Whether a -- begins a comment: it may also decrement the value before or behind it, or begin a property's name."""
    if at.operand:
        return not text.startswith(AFTER_DECREMENT, _BLANKS.match(text, i + 2).end())
    head = text[i + 2 : i + 3]
    if at.call == "var" or not _NAME.match(head):
        return at.call != "var"
    return not (head.isascii() or (at.empty and _COLON.match(text, _NAME.match(text, i + 2).end())))


class _Literals:
    """Where regular expression literals end. A scan that fails may have run to the end of its line; then the line's rest is worked out once."""

    def __init__(self, text: str):
        self.text, self.low, self.high = text, 0, 0

    def end(self, i: int, eol: int) -> int:
        """The end of the literal that the / at i opens on a line that ends at eol, or -1."""
        if not self.low <= i < self.high:
            if found := REGEX_LITERAL.match(self.text, i):
                return found.end()
            self._work_out(i, eol)
            return -1
        k = bisect_left(self.places, i + 1)
        close = self.outside[k]
        return -1 if close in (-1, i + 1) else _FLAGS.match(self.text, close + 1).end()

    def _work_out(self, i: int, eol: int) -> None:
        """The slash that closes a literal's body, from each / [ ] and escape on: outside a class of characters, and inside one."""
        self.low, self.high = i, eol
        self.places = [m.start() for m in _MARKS.finditer(self.text, i, eol)]
        n = len(self.places)
        self.outside, inside = [-1] * (n + 2), [-1] * (n + 2)
        for k in range(n - 1, -1, -1):
            p, after = self.places[k], k + 1
            sign = self.text[p]
            if sign == "\\":
                if p + 1 == eol:
                    continue
                after += after < n and self.places[after] == p + 1
            self.outside[k] = p if sign == "/" else inside[after] if sign == "[" else self.outside[after]
            inside[k] = self.outside[after] if sign == "]" else inside[after]


_MARKS, _FLAGS = re.compile(r"[/\[\]\\]"), re.compile("[A-Za-z]*")
#: what may be open where a line begins, and what closes it; a template's closer isn't escaped
CODE = "code"
OPEN = {"html": re.compile("-->"), "block": re.compile(r"\*/"), "'" * 3: re.compile("'" * 3), '"' * 3: re.compile('"' * 3), "template": re.compile(r"(?s)(?:\\.|[^`\\])*`")}


@dataclass
class Scanned:
    """What a part of a text holds, entered in some state: closed comments in the script, unclear places, and how it is left.

    ``closed`` is where what was open at the part's start ends, or -1; ``opened`` where what is open at its end began, or -1 if it was
    open before; ``script`` tells whether the stretch before ``closed`` and that after ``opened`` are in the script.
    """

    spans: list[tuple[int, int, str]]
    doubts: list[tuple[int, str]]
    exit: str = CODE
    opened: int = -1
    closed: int = -1
    script: tuple[bool, bool] = (False, False)
    #: the start of a line at which the scan met one entered in the code state, or -1
    joins: int = -1


def scan_part(text: str, script: re.Pattern, low: int, high: int, entry: str, marks: list[int], lines: dict[int, tuple[int, int]], first: bool) -> Scanned:
    """Scan text[low:high], which begins at a line's start, in one pass. See scan_comments.

    ``lines`` holds the starts of lines that a scan entered in the code state reached in that state, with the numbers of spans and
    doubts before them: the ``first`` scan of a part writes it, and scans from other states stop where they meet such a line.
    """
    out, i, last, eol = Scanned([], []), low, "", -1
    if entry != CODE:
        close = OPEN[entry].match(text, low, high) if entry == "template" else OPEN[entry].search(text, low, high)
        if not close:
            return Scanned([], [], entry, script=(False, bool(script.search(text, low, high))))
        i = out.closed = close.end()
        out.script = (bool(script.search(text, low, i)), False)
    at = _Place(i) if entry in (CODE, *CLOSERS) else _Place(i, empty=False, operand=True)
    literals = _Literals(text)
    while i < high and (found := TOKENS.match(text, i, high)):
        kind, token, stop = found.lastgroup, found[0], found.end()
        if i > eol:
            eol = text.find("\n", i, high)
            eol = high if eol < 0 else eol
        open_as = token if kind == "triple" else kind
        if kind == "triple" or kind in CLOSERS:
            close = OPEN[open_as].search(text, stop, high)
            stop = close.end() if close else -1
        elif kind == "template" and (len(token) < 2 or not OPEN[kind].fullmatch(token, 1)):
            stop = -1
        elif kind == "slash" and not at.operand and (end := literals.end(i, eol)) >= 0:
            kind, stop = "literal", end
        if stop < 0:
            out.exit, out.opened = open_as, i
            out.script = (out.script[0], bool(script.search(text, i, high)))
            break
        comment = kind in CLOSERS
        if kind == "hash" and _hash_comments(at, text, i, eol):
            kind, stop, comment = "python", eol, True
        elif kind == "dashes" and _dashes_comment(at, text, i):
            kind, stop, comment = "sql", eol, True
        elif kind == "line" and at.call != "url":
            if at.operand and at.divides is None:
                code, sign, _ = text[i + 2 : eol].partition("#")
                near = bisect_left(marks, at.start - NEAR) < bisect_right(marks, eol + NEAR)
                at.divides = (bool(sign) or not near) and _is_expression(text[at.start : i] + "//" + code.removeprefix("="))
                if at.divides and not sign and script.search(code):
                    out.doubts.append((i, "comment or division"))
                    stop = eol
            if not (at.operand and at.divides):
                stop, comment = eol, True
        if comment and script.search(text, i, stop):
            out.spans.append((i, stop, kind))
        if kind in ("triple", "template", *CLOSERS) and stop > eol:
            # what goes over several lines ends its line: behind it, a line begins
            at = _Place(stop) if comment else _Place(stop, empty=False, operand=True)
            last = ""
        elif not comment:
            at.pass_over(kind, token, last, stop)
            last = token
        i = stop
        if kind == "end":
            if first:
                lines[i] = (len(out.spans), len(out.doubts))
            elif i in lines:
                out.joins = i
                break
    return out


def scan_comments(text: str, script: re.Pattern) -> tuple[list[tuple[int, int, str]], list[tuple[int, str]]]:
    """(start, stop, kind) of closed comments in the script, and (place, reason) of what is unclear.

    Kinds are html, block, line, python (#) and sql (--). One pass over the tokens knows whether a value or an operator is
    expected. Literals are stepped over; an unclosed block, html comment, triple quote or template ends the scan. A // that
    follows a value in a line of operands and operators divides, or is unclear where the script follows; it is a comment
    where a script is near and no # follows.
    """
    got = scan_part(text, script, 0, len(text), CODE, [m.start() for m in SCRIPT_MARKS.finditer(text)], {}, True)
    if got.exit != CODE:
        got.doubts.append((got.opened, f"unclosed {_shown(got.exit)}"))
    return got.spans, got.doubts


def _shown(state: str) -> str:
    return state if state in (*CLOSERS, "template") else "triple"


#: characters of a long text that are scanned at once, or more where a line is longer
CHUNK = 1 << 17
STATES = (CODE, *OPEN)
_SPANS = "array<struct<start: int, stop: int, kind: string>>"
_DOUBTS = "array<struct<at: int, reason: string>>"


def line_chunks(text: str, size: int) -> list[tuple[int, int]]:
    """(start, stop) of parts of at least ``size`` characters that begin where lines do, none behind an escaped line end, which a string may hold."""
    out, low = [], 0
    while low < len(text):
        cut = text.find("\n", min(low + size, len(text)) - 1)
        while cut > 0 and text[cut - 1] == "\\":
            cut = text.find("\n", cut + 1)
        out.append((low, cut + 1 or len(text)))
        low = out[-1][1]
    return out


def _chunker(size: int):
    """mapInArrow function: (row, text) to row, chunk, offset, low, high, part: chunks with as much text around them as decides on scripts nearby."""
    side = NEAR + 32

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                for j, (a, b) in enumerate(line_chunks(text, size)):
                    low = max(a - side, 0)
                    row = [pa.array([x], kind) for x, kind in ((j, pa.int32()), (low, pa.int32()), (a - low, pa.int32()), (b - low, pa.int32()), (text[low : b + side], pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *row], ["row", "chunk", "offset", "low", "high", "part"])

    return chunks


def transfers(text: str, script: re.Pattern, low: int, high: int) -> list[Scanned]:
    """What text[low:high] does from each of STATES. Scans from an open state share the rest of the first where they meet a line that it began as code."""
    marks = [m.start() for m in SCRIPT_MARKS.finditer(text)]
    lines: dict[int, tuple[int, int]] = {}
    code = scan_part(text, script, low, high, CODE, marks, lines, True)
    out = [code]
    for state in OPEN:
        got = scan_part(text, script, low, high, state, marks, lines, False)
        if got.joins >= 0:
            spans, doubts = lines[got.joins]
            got.spans += code.spans[spans:]
            got.doubts += code.doubts[doubts:]
            got.exit, got.opened, got.script = code.exit, code.opened, (got.script[0], code.script[1])
        out.append(got)
    return out


def _transfer_rows(script: re.Pattern):
    """mapInArrow function: chunks to row, chunk, entry, exit, opened, closed, script_before, script_after, spans and doubts, a row a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.select(["chunk", "offset", "low", "high", "part"]).to_pylist()):
                at = lambda x, r=r: x + r["offset"] if x >= 0 else None
                rows = [
                    {
                        "chunk": r["chunk"], "entry": j, "exit": STATES.index(got.exit), "opened": at(got.opened), "closed": at(got.closed), "script_before": got.script[0],
                        "script_after": got.script[1], "spans": [{"start": at(a), "stop": at(b), "kind": k} for a, b, k in got.spans], "doubts": [{"at": at(a), "reason": w} for a, w in got.doubts],
                    }
                    for j, got in enumerate(transfers(r["part"], script, r["low"], r["high"]))
                ]
                keys = batch.column("row").take(pa.array([i] * len(rows)))
                table = pa.RecordBatch.from_pylist(rows, _TRANSFER)
                yield pa.RecordBatch.from_arrays([keys, *table.columns], ["row", *table.schema.names])

    return run


_TRANSFER = pa.schema([
    ("chunk", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32()), ("opened", pa.int32()), ("closed", pa.int32()), ("script_before", pa.bool_()), ("script_after", pa.bool_()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))), ("doubts", pa.list_(pa.struct([("at", pa.int32()), ("reason", pa.string())]))),
])


def _in_chunks(docs: DataFrame, script: re.Pattern, size: int) -> DataFrame:
    """(key, start, stop, kind, reason) of long texts: chunks are scanned from every state by themselves, then the states are put in order.

    docs are (key, text); equal texts are scanned once. The states of a text, one for each chunk, are one row.
    """
    docs = docs.withColumn("row", F.sha2("text", 256))
    parts = docs.select("row", "text").dropDuplicates(["row"]).mapInArrow(_chunker(size), "row string, chunk int, offset int, low int, high int, part string")
    got = parts.repartition("row", "chunk").mapInArrow(
        _transfer_rows(script), f"row string, chunk int, entry int, exit int, opened int, closed int, script_before boolean, script_after boolean, spans {_SPANS}, doubts {_DOUBTS}"
    )
    got = materialize(got, "comments")
    exits = got.groupBy("row", "chunk").agg(F.array_sort(F.collect_list(F.struct("entry", "exit"))).alias("exits"))
    exits = exits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", F.transform("exits", lambda x: x["exit"]).alias("exits")))).alias("all"))
    states = F.aggregate("all", F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.get(x["exits"], F.element_at(done, -1)))))
    states = exits.select("row", F.posexplode(F.slice(states, F.lit(1), F.size("all"))).alias("chunk", "entry"))
    real = got.join(states, ["row", "chunk", "entry"])
    before = Window.partitionBy("row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # a new stretch is open from each opening on; the closing belongs to the last one before it
    real = real.withColumn("began", F.max("opened").over(before)).withColumn("since", F.sum(F.col("opened").isNotNull().cast("int")).over(before))
    inside = Window.partitionBy("row", "since").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # the chunk that opens a stretch still counts to the one before, so its own part is carried by a window over the openings
    opening = F.max_by("script_after", "opened").over(before)
    held = F.coalesce(opening, F.lit(False)) | F.coalesce(F.bool_or(F.when(F.col("opened").isNull() & F.col("closed").isNull(), F.col("script_after"))).over(inside), F.lit(False))
    real = real.withColumn("held", held)
    comment = (F.col("entry") > 0) & F.col("closed").isNotNull() & (F.col("held") | F.col("script_before"))
    names = F.array(*[F.lit(x) for x in STATES])
    far = F.when(comment & F.get(names, F.col("entry")).isin(*CLOSERS), F.array(F.struct(F.col("began").alias("start"), F.col("closed").alias("stop"), F.get(names, F.col("entry")).alias("kind"))))
    closed = F.transform(F.concat(F.coalesce(far, F.array().cast(_SPANS)), "spans"), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), F.lit("").alias("reason")))
    doubts = F.transform("doubts", lambda x: F.struct(x["at"].alias("start"), x["at"].alias("stop"), F.lit("uncertain").alias("kind"), x["reason"].alias("reason")))
    last = Window.partitionBy("row")
    shown = F.array(*[F.lit(_shown(x)) for x in STATES])
    at = F.coalesce("opened", "began")
    open_end = F.when(
        (F.col("chunk") == F.max("chunk").over(last)) & (F.col("exit") > 0),
        F.array(F.struct(at.alias("start"), at.alias("stop"), F.lit("uncertain").alias("kind"), F.concat(F.lit("unclosed "), F.get(shown, F.col("exit"))).alias("reason"))),
    )
    four = "array<struct<start: int, stop: int, kind: string, reason: string>>"
    every = F.concat(closed, doubts, F.coalesce(open_end.cast(four), F.array().cast(four)))
    found = real.select("row", every.alias("every")).select("row", F.explode("every").alias("x"))
    return docs.select("key", "row").join(found, "row").select("key", "x.*")


def comment_spans(docs: DataFrame, key: str, text: str, ranges=HAN, chunk: int = CHUNK) -> DataFrame:
    """(key, start, stop, kind, reason): comments in the script, and unclear places with kind 'uncertain' and a reason.

    Texts of more than ``chunk`` characters are scanned in chunks of whole lines, each by itself from every state in which a line may
    begin, and the states are then put in order; the result is that of one scan. Null texts have no comments; repeated keys are rows of their own.
    """
    pattern = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column(0), []
            for i, value in enumerate(batch.column(1)):
                spans, doubts = scan_comments(value.as_py() or "", pattern)
                rows += [(i, a, b, kind, "") for a, b, kind in spans] + [(i, a, a, "uncertain", why) for a, why in doubts]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                [key, "start", "stop", "kind", "reason"],
            )

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    long = F.coalesce(F.length(text) > chunk, F.lit(False))
    short = docs.where(~long).select(key, F.col(text).alias("__text")).mapInArrow(scan, f"{key} {kind}, start int, stop int, kind string, reason string")
    rows = docs.where(long).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return short.unionByName(_in_chunks(rows, pattern, chunk).withColumnRenamed("key", key))


def html_comments(c: Column) -> Column:
    """Array of (at, text) of markup comments, natively."""
    return match_places(c, HTML_COMMENT)


def joined_text(paras: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, text): the paragraphs of a document in order, one a line. A document is one row, so it is bounded by 2 GB as any text is."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return paras.groupBy(doc).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias(text))


#: characters of a document in a bucket of the interval join
BUCKET = 4096


def overlapping(rows: DataFrame, spans: DataFrame, doc: str, bucket: int = BUCKET) -> DataFrame:
    """rows (doc, low, high, ...) joined with spans (doc, start, stop) that overlap them: each pair once, with the span's start and stop.

    Both go to the buckets of places that they touch, and a pair is kept in the first bucket that they share; so work follows what
    lies near, and a long document is many keys. An empty row lies in the spans that begin before it and end behind it; empty spans in nothing.
    """
    touched = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor((b - 1) / bucket)))
    left = rows.withColumn("__bucket", touched(F.col("low"), F.greatest(F.col("high"), F.col("low") + 1)))
    right = spans.where("stop > start").select(F.col(doc).alias("__doc"), "start", "stop").withColumn("__b", touched(F.col("start"), F.col("stop")))
    first = F.floor(F.greatest("low", "start") / bucket)
    pairs = left.join(right, (F.col(doc) == F.col("__doc")) & (F.col("__bucket") == F.col("__b")))
    return pairs.where((F.col("start") < F.col("high")) & (F.col("stop") > F.col("low")) & (F.col("__bucket") == first)).drop("__doc", "__b", "__bucket")


def strip_spans(paras: DataFrame, spans: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, order, text, removed, emptied): paragraphs without the spans (start, stop over the joined text) that cross them.

    A paragraph that lost something is trimmed at its end; a span over k paragraphs counts in each of them. Spans may overlap.
    """
    here = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.col(text), F.lit(""))
    rows = paras.select(doc, order, base.alias(text), F.coalesce(F.sum(F.length(base) + 1).over(here), F.lit(0)).alias("low"))
    rows = rows.withColumn("high", F.col("low") + F.length(text))
    low, high = F.greatest(F.col("start") - F.col("low"), F.lit(0)), F.least("stop", "high") - F.col("low")
    hit = overlapping(rows.select(doc, order, "low", "high"), spans, doc)
    per = hit.groupBy(doc, order).agg(F.array_sort(F.collect_list(F.struct(low.cast("int").alias("a"), high.cast("int").alias("b")))).alias("__cuts"))

    def left(cuts: Column) -> Column:
        """The text between the cuts; one that begins within another adds what goes beyond it."""
        ends = running_max(F.transform(cuts, lambda x: x["b"]))
        edits = lambda e: F.transform(
            cuts,
            lambda x, i: F.struct(
                F.greatest(x["a"], F.coalesce(F.get(e, i - 1), F.lit(0))).alias("at"),
                F.greatest(x["b"] - F.greatest(x["a"], F.coalesce(F.get(e, i - 1), F.lit(0))), F.lit(0)).alias("size"), F.lit("").alias("text"),
            ),
        )
        return F.rtrim(bind(ends, lambda e: splice(F.col(text), edits(e))))

    out = rows.drop("low", "high").join(per, [doc, order], "left")
    removed = F.coalesce(F.size("__cuts"), F.lit(0))
    cleaned = F.when(F.col("__cuts").isNull(), F.col(text)).otherwise(bind(F.col("__cuts"), left))
    out = out.select(doc, order, cleaned.alias(text), removed.alias("removed"))
    return out.withColumn("emptied", (F.col("removed") > 0) & (F.btrim(text) == ""))


def comment_findings(paras: DataFrame, spans: DataFrame, cleaned: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, order, kind, original, result, reason): what a reviewer reads of each paragraph that lost comments or holds something unclear.

    kind is deleted, with the paragraph before and after, or uncertain, with the paragraph as it stays and the reason; spans are
    those of comment_spans over the joined text, cleaned is what strip_spans made of them.
    """
    here = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.col(text), F.lit(""))
    rows = paras.select(doc, order, base.alias("original"), F.coalesce(F.sum(F.length(base) + 1).over(here), F.lit(0)).alias("low"))
    gone = cleaned.where("removed > 0").select(doc, order, F.col(text).alias("result"))
    deleted = rows.join(gone, [doc, order]).select(doc, order, F.lit("deleted").alias("kind"), "original", "result", F.lit("comment in the script").alias("reason"))
    # an unclear place is a point; a paragraph holds those up to its line end
    points = spans.where("kind = 'uncertain'").select(doc, "start", (F.col("start") + 1).alias("stop"), "reason")
    held = overlapping(rows.select(doc, order, "low", (F.col("low") + F.length("original") + 1).alias("high")), points, doc)
    held = held.join(points.select(doc, "start", "reason"), [doc, "start"]).join(rows.select(doc, order, "original"), [doc, order])
    return deleted.unionByName(held.select(doc, order, F.lit("uncertain").alias("kind"), "original", F.col("original").alias("result"), "reason"))
