"""Main-text extraction by consensus paths of a host.

1. Each page's containers are scored: a text block gives its characters outside links to
   the container it stands in, and half as many to the next one out; menus, headers,
   footers, sidebars, notices, adverts, forms and comments give nothing.
2. A container's path is its chain of tags with first classes, digits generalised, as one number made
   from its parent's.  Pages vote with score shares; Spark sums the votes by host and path.
3. Of the paths a page has, the one with most votes on its host wins, and with it those whose
   own text has ``SHARE`` of these votes there.  Each is widened to the nearest article or main
   around it; where there is none, outwards as long as the next container has text of its
   own (body excepted).  A winner in an article or main takes only others in one with it.
4. The page is extracted again at all elements with these paths, in page order, and with the
   headings before them: an h1 that stands in a container around them, any heading where
   that is within an article or main.

Votes are summed map-side before they are shuffled, so a host with a third of all pages is
one small row per path and task, and its pages' own paths join them with the host's key
salted.  Winners are keyed by page content and join the pages by that key, which copies share and hosts do not.

Defined results
---------------
* null or empty html: empty text, 0 characters.  Null url: the empty host.
* no element with text: empty text.  Text outside any element belongs to the page, whose path is empty.
* markup that never closes: closed where its parent ends; a broken tag is text from ``<`` on.
  script, style, textarea and title without an end tag run to the page's end; iframe, template, select and
  old frames without one are their start tag only.  Other embedded elements (svg, math, object, noscript, ...)
  are markup like any other: their text stays.
* boilerplate names: outside article and main any part of a class or id counts; inside, only whole names
  (``FIRM_NAMES``) do, and none of a paragraph or heading.
* repeated rows: each returned, with equal text.  Ties: higher own score, then the path's number.
* very long pages: whole.  Time and memory are linear in the page, however deep or broken: nothing
  is looked for twice.
* empty table: empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import join_counted, scope, table
from .textops import small_batches
from .url_filters import url_parts

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*)")
_QUOTED = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN = re.compile(r"([^<>]*+)>")
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: HTML's void elements, elements whose content is not markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noembed noframes select".split())
#: RAW elements that are text to the page's end where no end tag follows, and elements inside of which any may close itself.
_TEXT_ONLY = frozenset("script style textarea title".split())
_FOREIGN = ("svg", "math")
_VALUE_END = re.compile(r"=\s*[^\s\"']*/$")
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("body div article main section td center blockquote".split())
#: Tags that a start tag of the key closes (with what is open inside), up to the nearest of the barrier tags.
_P_CLOSERS = BLOCK - {"br", "body", "html", "head", "option", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead"}, "tfoot": {"tbody"}}
_BARRIER = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Boilerplate by tag, by role and by parts of class and id (these not of an article's headings and paragraphs, which they describe).
NOISE_TAG = frozenset("nav aside footer form button menu dialog search fieldset head".split())
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banners?|breadcrumbs?|comments?|commentlist|respond|disqus\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|sidebars?|side|widgets?|menus?|nav|navbar|navigation|topbar|toolbar|pagination|pager|"
    r"footers?|related|recommended|promo|promotion|sponsor\w*|sponsored|search|form|skip|reactions?|replies|reviews?)(?:$|[\s_-])", re.I)  # fmt: skip
#: Whole names of boilerplate inside an article.
FIRM_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments comment-list commentlist comments-area comment-section "
    "comments-section respond disqus disqus_thread cookie cookies cookie-banner cookie-notice cookie-consent cookie-bar consent gdpr notice notices notification notifications alert "
    "alerts popup modal overlay newsletter subscribe subscription signup sign-up login share sharing share-buttons social social-share social-links sidebar side-bar widget widgets "
    "widget-area menu menus main-menu nav navbar navigation main-nav site-nav topbar toolbar pagination pager footer site-footer page-footer related-posts related-articles "
    "recommended promo promotion sponsor sponsored search-form search-box skip-link reactions replies".split()
)
_NUMBERED = re.compile(r"[-_]?\d+$")
_HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:headers?|masthead)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Own text of a path, as a share of the winner's votes on the host, from which it is taken with the winner.
SHARE = 0.25
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEVER = frozenset("html body article main".split())
_DIGITS = re.compile(r"\d+")


class _Node:
    __slots__ = ("tag", "path", "noise", "article", "link", "near", "outer", "declared", "lead")

    def __init__(self, tag: str, label: str, up: _Node | None, noise: bool):
        self.tag, self.lead = tag, None
        if up is None:  # the page
            self.path, self.noise, self.article, self.link, self.near, self.outer, self.declared = 0, False, False, False, self, None, -1
            return
        self.path = xxhash.xxh64_intdigest(label, up.path) >> 1
        self.noise = up.noise or noise
        own = tag in ("article", "main")
        self.article, self.link = up.article or own, up.link or tag == "a"
        self.declared = self.path if own else up.declared
        #: the innermost container at or around the node, and the next one out
        self.near, self.outer = (self, up.near) if tag in CONTAINER and not self.noise else (up.near, up.outer)


def _noisy(tag: str, attr: dict[str, str], article: bool) -> bool:
    if tag in _NEVER:
        return False
    if tag in NOISE_TAG or (tag == "header" and not article):
        return True
    if not attr:
        return False
    if "hidden" in attr or attr.get("aria-hidden") == "true" or attr.get("role", "").lower() in NOISE_ROLE or _HIDDEN.search(attr.get("style", "")):
        return True
    name = f"{attr.get('class', '')} {attr.get('id', '')}"
    if not article:
        return bool(NOISE_NAME.search(name) or _HEADER_NAME.search(name))
    return tag != "p" and tag not in _HEADING and any(_NUMBERED.sub("", x) in FIRM_NAMES for x in name.lower().split())


class _Stack(list):
    """Open elements, with the places of each tag: nothing below the top is ever searched."""

    def __init__(self) -> None:
        super().__init__([_Node("", "", None, False)])
        self.places: dict[str, list[int]] = {}

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def open(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self))
        self.append(node)

    def down_to(self, place: int) -> Iterator[_Node]:
        while len(self) > place:
            yield self[-1]
            self.places[self.pop().tag].pop()


def walk(page: str):
    """Events of a page: ("open", node), ("close", node) and ("text", node, text); block edges are ("break",)."""
    stack = _Stack()
    at, size, last = 0, len(page), page.rfind(">")
    quotes = True  # whether attribute values may hold > : given up once a quote runs to the page's end
    unended: set[str] = set()  # tags of which no end tag follows
    while at < size:
        lt = page.find("<", at)
        if lt != at:
            yield "text", stack[-1], page[at:lt] if lt >= 0 else page[at:]
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        if lt > last:  # no tag ends any more
            yield "text", stack[-1], page[lt:]
            break
        if page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1
            continue
        name = _NAME.match(page, lt + 1)
        body = None
        if name:
            body = _QUOTED.match(page, name.end()) if quotes else None
            if body is None:
                quotes = False
                body = _PLAIN.match(page, name.end())
        if body is None:
            yield "text", stack[-1], "<"
            at = lt + 1
            continue
        at, tag, raw = body.end(), name[2].lower(), body[1]
        if name[1]:  # an end tag
            if tag in BLOCK:
                yield "break", stack[-1]
            if place := stack.last((tag,)):
                for node in stack.down_to(place):
                    yield "close", node
            continue
        if tag in RAW:
            close = None if tag in unended else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            elif tag in _TEXT_ONLY:
                at = size
            else:
                unended.add(tag)
            continue
        if tag in BLOCK:
            yield "break", stack[-1]
        if tag in VOID or (raw.endswith("/") and (tag in _FOREIGN or stack.last(_FOREIGN)) and not _VALUE_END.search(raw)):
            continue
        closes, barrier = _CLOSES.get(tag), _BARRIER.get(tag, ())
        if closes is None and tag in _P_CLOSERS:
            closes, barrier = ("p",), _P_BARRIER
        if closes and (place := stack.last(closes)) > stack.last(barrier):
            for node in stack.down_to(place):
                yield "close", node
        attr = {}
        if raw and not raw.isspace():
            for k, a, b, c in _ATTR.findall(raw):
                attr.setdefault(k.lower(), a or b or c)
        up = stack[-1]
        first = attr.get("class", "").split()
        stack.open(node := _Node(tag, f"{tag}.{_DIGITS.sub('#', first[0])}" if first else tag, up, _noisy(tag, attr, up.article)))
        yield "open", node
    for node in stack.down_to(1):
        yield "close", node


_P_BARRIER = ("article", "body", "td", "div", "section", "main", "li", "table")


def container_scores(page: str) -> dict[int, list]:
    """Path -> [score, characters of its own, the next container's path, the path of the article or main around it], of a
    page's containers with text; -1 where there is no such container (body does not count as a next one)."""
    scores: dict[int, list] = {}
    for event in walk(page):
        if event[0] != "text" or event[1].noise or event[1].link or event[2].isspace():
            continue
        n = float(len(event[2].strip()))
        inner = event[1].near
        for x, share in ((inner, 1.0), (inner.outer, 0.5)):
            if x is not None:
                s = scores.get(x.path)
                if s is None:
                    s = scores[x.path] = [0.0, 0.0, x.outer.path if x.outer and x.outer.tag not in ("", "body") else -1, x.declared]
                s[0] += n * share * (1.5 if x.tag in ("article", "main") else 1.0)
                s[1] += n if x is inner else 0.0
    return scores


def region(winner: int, votes: int, own: dict[int, int], around: dict[int, tuple[int, int]]) -> list[int]:
    """The paths to extract.  ``own``: a page's paths with own text, and its votes on the host; ``around``: the next
    container and the article or main around each."""

    def widen(path: int) -> tuple[int, bool]:
        if around[path][1] >= 0:
            return around[path][1], True
        while own.get(around[path][0]):
            path = around[path][0]
        return path, False

    first, declared = widen(winner)
    out = {first}
    for path, n in own.items():
        if n and n >= SHARE * votes:
            wide, also = widen(path)
            if also or not declared:
                out.add(wide)
    return sorted(out)


def extract(page: str, paths: list[int]) -> str:
    """The text of all elements of ``page`` with one of ``paths``, without boilerplate, one line a block."""
    wanted = frozenset(paths)
    blocks: list[tuple[str, int | None]] = []  # with the container that a heading before the elements stands in
    run: list[str] = []
    up: dict[int, int] = {}
    inside = int(0 in wanted)  # path 0 is the page itself
    lead: int | None = None
    open_ = [0]

    def end_block() -> None:
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            if text:
                blocks.append((text, None if inside else lead))
            run.clear()

    for event in walk(page):
        kind, node = event[0], event[1]
        if kind == "text":
            if (inside or lead is not None) and not node.noise:
                run.append(event[2])
        elif kind == "break":
            end_block()
        elif kind == "open":
            up.setdefault(node.path, open_[-1])
            open_.append(node.path)
            if node.path in wanted:
                end_block()
                inside += 1
            elif not inside and lead is None and node.tag in _HEADING and not node.noise and (node.tag == "h1" or node.article):
                end_block()
                node.lead = lead = node.near.path
        else:
            open_.pop()
            if node.path in wanted:
                end_block()
                inside -= 1
            elif node.lead is not None:
                end_block()
                lead = None
    end_block()
    above: set[int] = set()
    for path in wanted:
        while path and (path := up.get(path, 0)) not in above:
            above.add(path)
    return "\n".join(text for text, stands_in in blocks if stands_in is None or stands_in in above)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "k1", "k2", "path", "vote", "own", "next", "declared"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for host, k1, k2, page in zip(*(batch.column(c) for c in ("host", "k1", "k2", "html")), strict=True):
            scores = container_scores(page.as_py() or "")
            best = max((s[0] for s in scores.values()), default=0.0)
            for path, (s, own, next_, declared) in scores.items():
                for col, v in zip(cols, (host.as_py(), k1.as_py(), k2.as_py(), path, s / best, own / best, next_, declared), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [
            region(path, votes, {x["path"]: x["owns"] for x in of if x["has"]}, {x["path"]: (x["next"], x["declared"]) for x in of})
            for path, votes, of in zip(*(batch.column(c).to_pylist() for c in ("path", "votes", "of")), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(paths, pa.list_(pa.int64()))], ["k1", "k2", "paths"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = zip(batch.column("html"), batch.column("paths").to_pylist(), strict=True)
        texts = [extract(page.as_py(), paths) if page.is_valid and paths is not None else "" for page, paths in pages]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])


def html_extraction(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    small_batches(df.sparkSession)
    pages = url_parts(df.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html")), "url")
    pages = pages.select("id", "url", "host", "html", F.xxhash64("host", "html").alias("k1"), F.xxhash64(F.lit("b"), "host", "html").alias("k2"))
    with scope(df.sparkSession) as kept:
        fields = "host string, k1 long, k2 long, path long, vote double, own double, next long, declared long"
        scored = table(pages.select("host", "k1", "k2", "html").mapInArrow(_score, fields))
        summed = [F.sum(F.round(F.col(c) * 1_000_000).cast("long")).alias(c + "s") for c in ("vote", "own")]
        votes = table(scored.groupBy("host", "path").agg(*summed, F.count("*").alias("n")))
        ranked = join_counted(scored, votes, ["host", "path"], "n")
        ranked = ranked.select("k1", "k2", F.struct("votes", "vote", "path").alias("w"), F.struct("path", "owns", (F.col("own") > 0).alias("has"), "next", "declared").alias("of"))
        # copies of a page give the same structs
        won = ranked.groupBy("k1", "k2").agg(F.max("w").alias("w"), F.collect_set("of").alias("of"))
        won = table(won.select("k1", "k2", "w.path", "w.votes", "of").mapInArrow(_regions, "k1 long, k2 long, paths array<long>"))
        kept.append(won)
    out = pages.join(won, ["k1", "k2"], "left").select("id", "url", "html", "paths").mapInArrow(_extract, "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", page_id).withColumnRenamed("url", url)
