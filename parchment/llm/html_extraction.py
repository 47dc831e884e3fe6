"""Main text of web pages: blocks are judged by stop words, length and links, then short ones by their nearest decided neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.runtime import ship

# fixed values: frequent words of languages written with spaces, and particles of those without
STOP_WORDS = {
    "en": "the of and to a in is it that was for on are as with at be this by from or an have not you his he they we but had which her she were been their has would there what all if when will can more no so out do than them who its into".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son sa ses mais comme ou si leur y dont elle ils nous vous tout aux cette être était fait on".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde nos".split(),
    "it": "di e il la che in un a per è una sono con non si da come le dei nel alla del più anche ma al gli della lo ha i o se delle questo".split(),
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo".split(),
    "nl": "de van een het en in is dat op te voor met die zijn niet aan er om ook als dan maar bij uit nog worden door naar heeft hij ze wordt".split(),
}
PARTICLES = "的了是在和有我不这就也与而及の は を に が と で も た て 은 는 이 가".replace(" ", "")
#: fixed values: elements of HTML by what they hold
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title noembed noframes xmp".split())
HEAD_ONLY = frozenset("meta link base script style title noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section select summary table caption tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head nav footer aside menu dialog search select button template svg math object audio video canvas fieldset legend".split())
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: fixed values: parts of class names and ids, and roles, of what is no article
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertorial banner sponsor sponsored sponsors promo promos promoted promotion outbrain taboola cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription paywall signup login register sidebar side aside widget widgets menu submenu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead topbar share sharing social related recommended recommendations trending popular teaser teasers comment "
    "comments commentlist commentary disqus respond replies reply discussion skip toc".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: fixed values: words before a hint that tell of a page's layout, not of the element
LAYOUT = frozenset("with has no without".split())
#: of an article or a whole page, only these hints count
OF_ARTICLES = frozenset("ad ads advert advertisement sponsored promo promoted related recommended teaser comment comments reply".split())

_STOPS = frozenset(w for words in STOP_WORDS.values() for w in words)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_VALUE_OR_END = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_SPACELESS = re.compile("[぀-ヿ㐀-鿿가-힣]")
_WORD_EDGE = " .,;:!?\"'()[]«»„“”‘’¿¡…-"


@dataclass(frozen=True)
class Rules:
    """Thresholds in characters and shares: a block under ``short`` is decided by its neighbours; one with more than ``most_links`` of its
    characters in links is bad; one with ``many_stops`` of stop words and over ``long`` is good; between, and with ``few_stops``, it is near."""

    short: int = 70
    long: int = 200
    few_stops: float = 0.30
    many_stops: float = 0.32
    most_links: float = 0.2


@dataclass
class Block:
    text: str
    links: float
    stops: float
    never: bool
    form: bool
    #: the number of the outermost article or main element around it, 0 without one, and how many articles are around it
    main: int
    articles: int
    heading: bool = False
    label: str = ""


@dataclass(slots=True)
class _Open:
    name: str
    never: bool
    form: bool
    main: int
    articles: int
    inline: bool
    header: bool


def _stop_share(text: str) -> float:
    if len(_SPACELESS.findall(text)) * 2 > len(text):
        return min(1.0, 3 * sum(map(text.count, PARTICLES)) / len(text))
    words = text.lower().split()
    return sum(w.strip(_WORD_EDGE) in _STOPS for w in words) / max(len(words), 1)


def _hinted(names: str, known: frozenset[str]) -> bool:
    for name in names.split():
        before = ""
        for part in map(str.lower, _PART.findall(name)):
            if part in known and before not in LAYOUT:
                return True
            before = part
    return False


def _attributes(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class _Reader:
    """Reads one page from its start to its end once; what is open is a stack, and a closing tag goes back to what it closes."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack = [_Open("", False, False, 0, 0, False, False)]
        self.count: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.link_depth = 0  # how much was open where the link began; 0 outside links
        self.mains = 0
        self.breaks = 0
        self.owner = self.stack[0]
        self.heading = False

    def text(self, s: str) -> None:
        here = self.stack[-1]
        if here.inline and here.never:
            return
        if "&" in s:
            s = unescape(s)
        if not self.parts:
            self.owner = here
        self.parts.append(s)
        if not s.isspace():
            self.breaks = 0
        if self.link_depth:
            self.linked += sum(map(len, s.split()))

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            o = self.owner
            full = len(text) - text.count(" ")
            self.blocks.append(Block(text, self.linked / full, 0.0 if o.never else _stop_share(text), o.never, o.form, o.main, o.articles, self.heading))
        self.parts, self.linked, self.breaks, self.heading = [], 0, 0, False

    def pop(self) -> None:
        name = self.stack.pop().name
        self.count[name] -= 1
        if len(self.stack) < self.link_depth:
            self.link_depth = 0

    def start(self, name: str, tag: str) -> None:
        if name == "br":
            self.parts.append(" ")
            self.breaks += 1
            if self.breaks > 1:
                self.flush()
            return
        if self.count.get("head") and name not in HEAD_ONLY:
            while self.count["head"]:
                self.pop()
        block = name in BLOCK
        if block:
            self.flush()
            closes = CLOSES.get(name, {"p"})
            while self.stack[-1].name in closes:
                self.pop()
            self.heading = name in HEADINGS
        if name == "a":
            self.link_depth = len(self.stack) if "href" in tag.lower() else 0
            return
        if name in VOID:
            return
        up = self.stack[-1]
        known = _attributes(tag) if tag else {}
        is_main = name in ("article", "main") or known.get("role") in ("main", "article") or "articleBody" in known.get("itemprop", "")
        header = name == "header"
        hints = OF_ARTICLES if is_main or name in ("body", "html") else HINTS
        never = name in NEVER or known.get("role", "") in ROLES or "hidden" in known or known.get("aria-hidden") == "true"
        never = never or bool(_HIDES.search(known.get("style", ""))) or _hinted(f"{known.get('class', '')} {known.get('id', '')}", hints)
        never = never or header and not up.main  # that of a page; an article's own may hold its title
        if not (block or is_main or never):
            return
        main = up.main
        if is_main and not main and not (never or up.never):
            self.mains += 1
            main = self.mains
        title = name in HEADINGS and up.header and not up.never
        inside = up.never or never or up.header and not title
        here = _Open(name, inside, up.form or name == "form", main, up.articles + (name == "article"), not block and not is_main, header and bool(up.main) or up.header and not title)
        self.stack.append(here)
        self.count[name] = self.count.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name == "a":
            self.link_depth = 0
            return
        if name in BLOCK:
            self.flush()
        if self.count.get(name):
            while self.stack[-1].name != name:
                self.pop()
            self.pop()


def read_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, without labels. Every character is passed once, so the time is linear in the page."""
    r, at, n = _Reader(), 0, len(page)
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            r.text(page[at:])
            break
        if cut > at:
            r.text(page[at:cut])
        follow = page[cut + 1 : cut + 2]
        if follow == "!" or follow == "?":
            if page.startswith("<!--", cut):
                stop = cut + 4 if page.startswith((">", "->"), cut + 4) else page.find("-->", cut + 4)
                at = n if stop < 0 else page.find(">", stop) + 1
            else:
                at = page.find(">", cut) + 1 or n
            continue
        closing = follow == "/"
        m = _NAME.match(page, cut + 1 + closing)
        if not m:
            if closing:
                at = page.find(">", cut) + 1 or n
            else:
                r.text("<")
                at = cut + 1
            continue
        name, pos = m[0].lower(), m.end()
        while (x := _VALUE_OR_END.search(page, pos)) and x[1]:
            pos = page.find(x[1], x.end()) + 1
            if not pos:
                x = None
                break
        if not x:  # a tag that doesn't end
            break
        tag, at = page[m.end() : x.start()], x.end()
        if closing:
            r.end(name)
        elif name in RAW:
            stop = _RAW_END[name].search(page, at)
            at = n if not stop else page.find(">", stop.end()) + 1 or n
        else:
            r.start(name, tag)
    r.flush()
    return r.blocks


def _first_pass(blocks: list[Block], rules: Rules, inside: bool) -> None:
    """Labels none (no article by its markup), good, bad, near, short, or odd: long without stop words, which only in an article may be text."""
    for b in blocks:
        size = len(b.text)
        if b.never or b.form and size < rules.long:
            b.label = "none"
        elif b.links > rules.most_links or inside and not b.main:
            b.label = "bad"
        elif size < rules.short:
            b.label = "bad" if not b.main and ("©" in b.text or b.links) else "short"
        elif b.stops >= rules.many_stops and size > rules.long:
            b.label = "good"
        elif b.stops >= rules.few_stops:
            b.label = "near"
        else:
            b.label = "odd" if b.main else "bad"


def _second_pass(blocks: list[Block]) -> list[bool]:
    """Whether each block is kept. Blocks that are no article by their markup go and are nobody's neighbours. Undecided ones inherit from the nearest decided neighbour, of an article's own if they are in one.

    A heading belongs to what follows it, so it takes the next decided one. Equally near neighbours count as good if one is and the
    block is in an article or near. Without a decided neighbour a block of an article is good; outside, the ends of the page count as bad, but near blocks of a page without any good one are good.
    """
    n = len(blocks)
    near: list[list[tuple[int, bool] | None]] = []
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}
        found: list[tuple[int, bool] | None] = [None] * n
        for i in order:
            b = blocks[i]
            if b.label in ("good", "bad"):
                last[b.main] = (i, b.label == "good")
            elif b.label != "none":
                found[i] = last.get(b.main)
        near.append(found)
    lonely = not any(b.label == "good" for b in blocks)
    keep = []
    for i, b in enumerate(blocks):
        if b.label in ("good", "bad", "none"):
            keep.append(b.label == "good")
            continue
        left, right = near[0][i], near[1][i]
        if not b.main:
            left, right = left or (-1, False), right or (n, False)
        if b.heading and right:
            left = None
        sides = sorted((abs(x[0] - i), not x[1] if b.main or b.label == "near" else x[1]) for x in (left, right) if x)
        if not sides or not b.main and b.label == "near" and lonely:
            keep.append(True)
        else:
            good = sides[0][1] if not (b.main or b.label == "near") else not sides[0][1]
            keep.append(good)
    return keep


def label_blocks(page: str, rules: Rules = Rules()) -> list[tuple[Block, bool]]:  # noqa: B008
    """(block, kept) of a page. If it has an article or main element with text, what is outside is bad, unless the text outside is thrice as long."""
    blocks = read_blocks(page)
    own = [b for b in blocks if b.main and not b.never]
    if any(b.articles < 2 and len(b.text) >= rules.short for b in own):
        for b in own:
            b.never = b.articles > 1  # an article in an article is a comment on it
    _first_pass(blocks, rules, False)
    if own:
        keep = _second_pass(blocks)
        size = [sum(len(b.text) for b, k in zip(blocks, keep, strict=True) if k and bool(b.main) == side) for side in (False, True)]
        if 3 * size[1] < size[0]:
            for b in blocks:
                b.main = 0
        _first_pass(blocks, rules, 3 * size[1] >= size[0])
    return list(zip(blocks, _second_pass(blocks), strict=True))


def main_text(page: str, rules: Rules = Rules()) -> str:  # noqa: B008
    return "\n".join(b.text for b, kept in label_blocks(page, rules) if kept)


def _in_parts(batches: Iterator[pa.RecordBatch], rows_of, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Output batches of a few MB from pages, one at a time."""
    for batch in batches:
        rows, size = [], 0
        for i in range(batch.num_rows):
            page = batch.column("html")[i].as_py() or ""
            for values in rows_of(page):
                rows.append((i, *values))
            size += len(page)
            if size > 1 << 22 or i == batch.num_rows - 1:
                at = pa.array([r[0] for r in rows], pa.int64())
                values = [pa.array([r[j + 1] for r in rows], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("url").take(at), *values], ["id", "url", *names])
                rows, size = [], 0


def _run(pages: DataFrame, id_col: str, url_col: str, html_col: str, rows_of, outputs: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    ship(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"id {kinds[id_col]}, url {kinds[url_col]}, " + ", ".join(f"{n} {k}" for n, k, _ in outputs)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    names, types = [n for n, _, _ in outputs], [t for _, _, t in outputs]
    out = rows.mapInArrow(lambda batches: _in_parts(batches, rows_of, names, types), schema)
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def page_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row per text block: id, url, block (from 0), text, label of the first pass, kept, link_share and stop_share.

    Pages without text give no rows; otherwise as extract_text says.
    """

    def rows_of(page: str):
        return ((i, b.text, b.label, kept, b.links, b.stops) for i, (b, kept) in enumerate(label_blocks(page, rules)))

    outputs = [
        ("block", "int", pa.int32()), ("text", "string", pa.string()), ("label", "string", pa.string()), ("kept", "boolean", pa.bool_()),
        ("link_share", "double", pa.float64()), ("stop_share", "double", pa.float64()),
    ]
    return _run(pages, id_col, url_col, html_col, rows_of, outputs)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row per page: id, url, the main text (kept blocks joined by line feeds, empty if none) and n_chars.

    Null html counts as empty; null ids and urls and repeated rows are rows like others; pages of any length are read whole, in
    linear time; tags and comments that don't end run to the end of the page, as in browsers; an empty table gives no rows; other
    columns are ignored.
    """

    def rows_of(page: str):
        text = main_text(page, rules)
        return [(text, len(text))]

    return _run(pages, id_col, url_col, html_col, rows_of, [("text", "string", pa.string()), ("n_chars", "long", pa.int64())])
