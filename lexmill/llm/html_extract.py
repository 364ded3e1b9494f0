"""HTML extraction: page structure, and a host suffix array for what structure leaves open.

A parser cuts a page into blocks and tells main and article elements from their
surroundings by elements, roles and class names; main and articles are weighed
by their text, and where neither has the greater part of a page's text the page
counts as unmarked. Inside a marked element a name that may as well be the
author's word ("social", "notices") is no verdict: such blocks stay open.

Then every page goes through its host's suffixes. Each is cut at the least
length of a repeat and equal ones (neighbours in the host's suffix array) are
counted by the distinct pages they start in, all but those inside a marked
article: what unmarked pages, open blocks and surroundings repeat on half of a
host's pages is the host's, while an article's copies say nothing. Such runs go
from unmarked pages and open blocks. From a marked article they go if three
articles of the host hold them, as what surrounds a page may well quote one
article's heading. Unique runs stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from .common import cut, lean, mix, word_bounds, word_hashes

#: Least tokens of a repeated run.
RUN = 8
#: Least distinct streams, and least share of a host's streams, that a run must start in: what half of a site's pages
#: say is the site's; a passage that some pages quote is theirs.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: Repeated runs of all hosts up to which they are broadcast to the pages; more meet them by a join.
BROADCAST = 500_000
#: Shares of a host in that join.
SALT = 64

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_DROP = frozenset("nav aside footer form dialog menu script style noscript template iframe svg math canvas object audio video select button textarea input datalist search head title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Class and id words of what surrounds an article.
_WORDS = frozenset(
    [
        "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation",
        "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal",
        "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "commentlist", "disqus", "replies", "reply", "share", "sharing", "social",
        "related", "recommended", "recommendations", "trending", "widget", "widgets", "pagination", "pager", "toolbar", "masthead", "skip", "hidden",
    ]
)
#: Of these, words that inside an article may as well be about its subject.
_OPEN = frozenset(["banner", "menu", "notice", "notices", "notification", "alert", "overlay", "replies", "reply", "share", "sharing", "social", "skip", "toolbar", "masthead", "trending", "widget", "widgets"])
#: Words that only say what kind of box it is: inside an article a name counts if it has one of the words above and no others than these.
_BOX = frozenset(
    [
        "area", "bar", "block", "bottom", "box", "button", "buttons", "column", "container", "content", "footer", "form", "group", "header", "inline", "inner", "item", "items", "left",
        "link", "links", "list", "main", "module", "outer", "panel", "post", "posts", "right", "row", "section", "slot", "top", "unit", "wrap", "wrapper",
    ]
)
#: Elements that hold text rather than other boxes: inside an article one plain word in their name says nothing.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption span b i em strong a small cite q mark code".split())
_CLOSES_P = _BLOCK - {"body", "html", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_BARRIER = frozenset("ul ol dl table div section article main aside nav footer header form blockquote body td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Share of link text from which an open box counts as surroundings.
LINKS = 0.5
_GONE, _OPENED = -1, -2


def _judge(tag: str, attrs: str, inside: bool) -> int:
    """-1: surroundings, -2: open (inside only), 2: article, 1: main element, 0: neither; ``inside``: within an article or main element."""
    if tag in _DROP or (tag == "header" and not inside):
        return _GONE
    kind = 2 if tag == "article" else 1 if tag == "main" else 0
    if attrs and not attrs.isspace():
        a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(a.get("style", "")):
            return _GONE
        role = a.get("role", "").strip().lower()
        if role in _ROLES:
            return _GONE
        if tag not in ("body", "html", "main") and (names := f"{a.get('class', '')} {a.get('id', '')}") != " ":
            for name in unescape(names).split():
                words = {w for w in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if w}
                if _WORDS.isdisjoint(words):
                    continue
                if not inside:
                    return _GONE
                if words <= _WORDS | _BOX:  # "related-posts" surrounds an article, "related-work" is its own
                    if len(words) > 1:
                        return _GONE
                    if tag not in _TEXTUAL:
                        kind = _GONE if kind == _GONE or not words <= _OPEN else _OPENED
            if kind < 0:
                return kind
        if not kind:
            kind = 2 if role == "article" or a.get("itemprop") == "articleBody" else 1 if role == "main" else 0
    return kind


def parse(html: str) -> tuple[list[str], list[str]]:
    """(article blocks, other blocks) of a page, in page order; the first is empty if no main or article element holds most of the text."""
    found, rest, _ = regions(html)
    return [t for t, _ in found], rest


def regions(html: str) -> tuple[list[tuple[str, bool]], list[str], list[str]]:
    """As ``parse``, with each article block whether it is open; and what neither holds: texts of surroundings by their element, name or links."""
    blocks: list[tuple[int, int, str]] = []  # 0 other, 1 main, 2 article outside of it; number of the open box, if any; text
    stack: list[tuple[str, int, int, int, int]] = []  # tag, region, surroundings that are open, open box, links that are open
    places: dict[str, list[int]] = {}  # of the tags in the stack
    walls: list[int] = []  # places that close no element beyond them
    boxes: list[list[int]] = [[0, 0]]  # signs, and those in links, of each open box
    level = dropped = box = links = 0
    text: list[str] = []
    aside: list[str] = []
    gone: list[str] = []

    def end_block() -> None:
        if aside:
            if t := " ".join("".join(aside).split()):
                gone.append(t)
            aside.clear()
        if text:
            if t := " ".join("".join(text).split()):
                blocks.append((level, box, t))
            text.clear()

    def pop(i: int) -> None:
        nonlocal level, dropped, box, links
        for j in range(len(stack) - 1, i - 1, -1):
            places[stack[j][0]].pop()
            if walls and walls[-1] == j:
                walls.pop()
        del stack[i:]
        level, dropped, box, links = stack[-1][1:] if stack else (0, 0, 0, 0)

    pos, n = 0, len(html)
    while pos < n:
        m = _TOKEN.search(html, pos)
        at = m.start() if m else n
        if at > pos and dropped:
            t = html[pos:at]
            aside.append(unescape(t) if "&" in t else t)
        elif at > pos:
            t = html[pos:at]
            t = unescape(t) if "&" in t else t
            text.append(t)
            if box:
                signs = len(t) - t.count(" ")
                boxes[box][0] += signs
                boxes[box][1] += signs if links else 0
        if not m:
            break
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in _BLOCK:
                end_block()
            if places.get(tag):
                i = places[tag][-1]
                if (stack[i - 1][3] if i else 0) != box:
                    end_block()
                pop(i)
            continue
        if tag == "br":
            (aside if dropped else text).append(" ")
            continue
        if tag in _BLOCK:
            end_block()
        if tag in _RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?|\\Z", re.I).search(html, pos)
            pos = close.end()
            continue
        if tag in _CLOSES_P or tag in _SAME:
            over = _SAME.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
            i = max((places[x][-1] for x in over if places.get(x)), default=-1)
            if i >= 0 and i >= (walls[-1] if walls else 0):
                pop(i)
        if tag in _VOID:
            continue
        kind = 0 if dropped else _judge(tag, m[3] or m[6] or "", level > 0)
        if kind == _GONE:
            end_block() if tag in _BLOCK else None
            dropped += 1
        elif kind == _OPENED and not box:
            end_block()
            boxes.append([0, 0])
            box = len(boxes) - 1
        elif kind > 0 and not level:
            level = kind
        links += tag == "a"
        places.setdefault(tag, []).append(len(stack))
        if tag in _BARRIER:
            walls.append(len(stack))
        stack.append((tag, level, dropped, box, links))
    end_block()
    size = [sum(len(t) for k, _, t in blocks if k == want) for want in (0, 1, 2)]
    if size[0] > size[1] + size[2] or not any(size[1:]):
        return [], [t for _, _, t in blocks], gone
    least = (1,) if size[1] >= size[2] else (1, 2)
    linked = {i for i, (signs, inside) in enumerate(boxes) if i and inside >= LINKS * signs}
    gone += [t for k, b, t in blocks if k in least and b in linked]
    return [(t, b > 0) for k, b, t in blocks if k in least and b not in linked], [t for k, _, t in blocks if k not in least], gone


class Page:
    """A page's kept blocks, and the texts whose suffixes, each cut at ``RUN`` words, may be its host's."""

    def __init__(self, html: str):
        found, rest, gone = regions(html)
        self.blocks = [t for t, _ in found] or rest
        self.around = " ".join(gone + rest if found else gone)
        #: ranges of blocks of open and of marked text; runs cross the blocks of a range
        self.open: list[tuple[int, int]] = []
        self.own: list[tuple[int, int]] = []
        #: whether an open text shorter than a run is a run
        self.short = bool(found)
        if not found:
            self.open.append((0, len(rest)))
        lo, flags = 0, [o for _, o in found]
        for i, o in enumerate(flags):
            if o:
                self.open.append((i, i + 1))
                lo = i + 1
            elif i + 1 == len(flags) or flags[i + 1]:
                self.own.append((lo, i + 1))

    def texts(self, ranges: list[tuple[int, int]]) -> list[str]:
        return [" ".join(self.blocks[i:j]) for i, j in ranges]

    def name(self) -> int:
        """Equal for pages of equal kept words."""
        return xxhash.xxh64_intdigest(" ".join(self.blocks).encode()) - (1 << 63)

    def text(self, repeated: list[int], quoted: list[int]) -> str:
        """The blocks without the host's runs: ``repeated`` ones in open text, ``quoted`` ones in marked text."""
        todo = [(r, k, s) for ranges, k, s in ((self.open, repeated, self.short), (self.own, quoted, False)) for r in ranges if k]
        if not todo:
            return "\n".join(self.blocks)
        ends = np.cumsum([0, *(t.count(" ") + 1 for t in self.blocks)])
        steps = np.zeros(int(ends[-1]) + 1, np.int64)
        for (i, j), known, short in todo:
            keys = _keys(self.texts([(i, j)]), [short])[0]
            at = ends[i] + np.flatnonzero(np.isin(keys, np.array(known, np.int64)))
            np.add.at(steps, at, 1)
            np.add.at(steps, np.minimum(at + RUN, ends[j]), -1)
        gone = np.cumsum(steps) > 0
        out = []
        for t, a, b in zip(self.blocks, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if gone[a:b].any():
                t = " ".join(w for w, g in zip(t.split(" "), gone[a:b].tolist(), strict=True) if not g)
            if t:
                out.append(t)
        return "\n".join(out)


def _keys(texts: list[str], short: list[bool]) -> list[np.ndarray]:
    """64-bit keys of the runs of ``RUN`` words that start at each word of each text; a text of fewer words, where ``short``, is a run itself."""
    buf = np.frombuffer("\n".join(texts).encode(), np.uint8)
    words = word_hashes(buf, *word_bounds(buf))

    def runs(w: np.ndarray, n: int) -> np.ndarray:
        g = mix(w[: max(0, len(w) - n + 1)] + np.uint64(n))
        for j in range(1, n):
            g = mix(g + w[j : j + len(g)])
        return g.view(np.int64)

    every, a, out = runs(words, RUN), 0, []
    for t, s in zip(texts, short, strict=True):
        n = t.count(" ") + 1 if t else 0
        out.append(runs(words[a : a + n], n) if s and 0 < n < RUN else every[a : max(a, a + n - RUN + 1)])
        a += n
    return out


def _suffixes(marked: bool):
    """(host, page, runs): keys of the runs of each page's open text and surroundings, or of its ``marked`` article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                names, sizes, texts, short = [], [], [], []
                for h in part.column(1).to_pylist():
                    p = Page(h or "")
                    own = p.texts(p.own) if marked else [p.around, *p.texts(p.open)]
                    names.append(p.name())
                    sizes.append(len(own))
                    texts += own
                    short += [False] * len(own) if marked else [False, *[p.short] * len(p.open)]
                keys = _keys(texts, short)
                ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))))[np.cumsum([0, *sizes])]
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate((np.zeros(0, np.int64), *keys))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.int64()), runs], ["host", "page", "runs"])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for h, repeated, quoted in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            texts.append(Page(h or "").text(repeated or [], quoted or []))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["__u", "text"])


def _met(pages: DataFrame, runs: DataFrame, few: bool) -> DataFrame:
    """``pages`` with the columns of ``runs``, a row for each host; a host's many pages are dealt out if not few runs."""
    if few:
        return pages.join(F.broadcast(runs), "host", "left")
    dealt = runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in pages.columns if c in ("html", "page")]), F.lit(SALT)).cast("int")
    return pages.withColumn("salt", salt).join(dealt, ["host", "salt"], "left").drop("salt")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, ``text``, ``n_chars``) for each row of ``pages``.

    A null or empty html, and a page of surroundings alone, gives the empty text.
    Null ids and urls stay; pages without a host are settled as one host. Other
    columns, whatever their names, aren't looked at; very long pages are read whole.
    Repeated rows are one page for the host's suffixes and give equal results.
    An empty table gives an empty result.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[a-zA-Z][-+.\w]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    given = pages.select(F.struct(F.col(id_col).alias("i"), F.col(url_col).alias("u")).alias("__u"), F.xxhash64(host).alias("host"), F.col(html_col).alias("html"))
    suffixes = lambda marked: given.select("host", "html").mapInArrow(lean(_suffixes(marked)), "host long, page long, runs array<long>")
    # a run that is null stands for the page itself
    starts = suffixes(False).select("host", "page", F.explode(F.concat(F.array(F.lit(None).cast("long")), "runs")).alias("run")).distinct()
    counts = cut(starts.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST_PAGES) | F.col("run").isNull()))
    hosts = counts.where("run IS NULL").select("host", F.col("n").alias("pages"))
    often = counts.where("run IS NOT NULL").join(hosts, "host").where(F.col("n") >= LEAST_SHARE * F.col("pages"))
    repeated = cut(often.groupBy("host").agg(F.collect_list("run").alias("repeated")))
    few = (repeated.agg(F.sum(F.size("repeated"))).first()[0] or 0) <= BROADCAST
    inside = _met(suffixes(True), repeated, few).select("host", "page", F.explode(F.array_intersect("runs", "repeated")).alias("run")).distinct()
    quoted = inside.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES).groupBy("host").agg(F.collect_list("run").alias("quoted"))
    runs = cut(repeated.join(quoted, "host", "left"))
    schema = D.StructType([given.schema["__u"], D.StructField("text", D.StringType())])
    settled = _met(given, runs, few).select("__u", "html", "repeated", "quoted").mapInArrow(lean(_settle), schema)
    return settled.select(F.col("__u.i").alias(id_col), F.col("__u.u").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
