"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, quoted, unpacked

#: Elements by their part in a page.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("nav footer aside form menu dialog select option button head fieldset".split())
CONTAINERS = frozenset(("article", "main"))
#: Words of class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations comment comments disqus replies reply widget "
    "pager pagination toolbar login search complementary contentinfo masthead topbar tags paywall".split()
)
#: Of those, what readers wrote: it may be longer than the article.
ANSWERS = frozenset("comment comments disqus replies reply".split())
#: Words that make a name with a mark one of a wrapper: no-sidebar, content-with-sidebar, has-banner, ad-free.
BEFORE = frozenset("no not non without with has have is hide disable".split())
AFTER = frozenset("free off none less disabled closed".split())
#: Elements that no class word marks.
NEVER = frozenset("html body article main".split())
#: Elements that may wrap a whole page as well as a part outside the article.
WRAPPERS = frozenset(("form", "fieldset"))
#: A mark does not hold for an element with more than this share of the page's text (of text that readers wrote).
MOST, MOST_ANSWERS = 0.5, 0.9
#: What the score of a path counts for in a marked element, and in an article or main element. Where a page has such names and
#: elements they decide, not the ratios; with bounded factors (0.5 and 1.5) some pages keep text beside their article.
MARKED, CONTAINED = 0.05, 20.0
#: What a level between two paths takes from their smoothing, up to so many levels.
LEVEL, LEVELS = 0.75, 8
#: What the ratios of all text around a path add to its own.
AROUND = 0.5
#: A start tag of the first set ends an open element of the second.
ENDS = {
    **{t: frozenset(("p",)) for t in BLOCKS - {"html", "head", "body"}},
    "li": frozenset(("p", "li")), "dt": frozenset(("p", "dt", "dd")), "dd": frozenset(("p", "dt", "dd")),
    "tr": frozenset(("p", "tr", "td", "th")), "td": frozenset(("p", "td", "th")), "th": frozenset(("p", "td", "th")),
    "option": frozenset(("option",)),
}
#: What an implied end does not reach across.
SCOPES = frozenset("article aside body div dl fieldset footer form header html main nav ol section table td th ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？،؟]")
SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    """A piece of text: its element, its tag path, and how many of its characters are in links."""

    element: int
    path: int
    text: str
    links: int


@dataclass
class Page:
    """Elements and tag paths as parent numbers, smaller than their own; number 0 is the page.

    ``marks`` holds for each element the share of the page's text beyond which its mark falls (over 1: never), or 0 if it has
    none. Paths are equal if their tags and first class words are, from the root on.
    """

    parent: list[int] = field(default_factory=lambda: [0])
    marks: list[float] = field(default_factory=lambda: [0.0])
    inside: list[bool] = field(default_factory=lambda: [False])
    main: list[bool] = field(default_factory=lambda: [False])
    above: list[int] = field(default_factory=lambda: [0])
    root: list[bool] = field(default_factory=lambda: [True])
    blocks: list[Block] = field(default_factory=list)


@dataclass
class Ratio:
    """Sums over the blocks of a path, or of all paths below one."""

    chars: int = 0
    marks: int = 0
    links: int = 0
    blocks: int = 0

    def add(self, other: Ratio) -> None:
        self.chars += other.chars
        self.marks += other.marks
        self.links += other.links
        self.blocks += other.blocks

    def fused(self) -> float:
        """Text ratio and punctuation ratio, characters and marks per block, as one number; text in links does not count."""
        if not self.blocks:
            return 0.0
        plain = max(0, self.chars - self.links) / self.chars
        return math.log1p(self.chars / self.blocks) * math.log(1.5 + self.marks / self.blocks) * plain


def _named(value: str) -> set[str]:
    """Marks among the words of a class, id or role, without those in names of wrappers."""
    found: set[str] = set()
    for name in value.split():
        parts = [x for x in SPLIT.split(name) if x]
        for k, x in enumerate(parts):
            if x in MARKS and not BEFORE.intersection(parts[:k]) and not AFTER.intersection(parts[k + 1:]):
                found.add(x)
    return found


def _marked(attributes: str) -> tuple[str, bool, set[str]]:
    """The first class word, whether an element is hidden, and the words of class, id or role that mark it."""
    first, hidden, words = "", False, set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif name in ("class", "id", "role"):
            words |= _named(value)
            if name == "class" and not first and SPLIT.sub("", value):
                first = value.split()[0]
    return first, hidden, words


def parse(source: str) -> Page:
    """The text blocks of a page in order, with their elements and tag paths.

    Missing end tags are implied as browsers do for paragraphs, list items and table cells; stray end tags are
    passed over; an element that is never closed runs to the end. Inline elements are no part of a path; hidden ones have
    no text. Time and memory grow with the page, however deep it is nested.
    """
    page = Page()
    known: dict[tuple[int, str], int] = {}
    # Open elements: number, tag, path, hidden.
    stack = [(0, "", 0, False)]
    open_tags: Counter = Counter()
    buffer: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if buffer:
            element, _, path, hidden = stack[-1]
            text = "" if hidden else " ".join(entities.unescape("".join(buffer)).split())
            if text:
                page.blocks.append(Block(element, path, text, min(links, len(text))))
            buffer.clear()
        links = 0

    def close(k: int) -> None:
        for _, tag, _, _ in stack[k:]:
            open_tags[tag] -= 1
        del stack[k:]

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        text = source[at: m.start() if m else end]
        if text:
            buffer.append(text)
            if in_link:
                links += len(text)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCKS and open_tags[tag]:
                flush()
                k = len(stack) - 1
                while stack[k][1] != tag:
                    k -= 1
                close(k)
            continue
        if tag in RAW and not m[3].endswith("/"):
            shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = shut.end() if shut else end
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            buffer.append(" " if tag == "br" else "")
        elif tag == "a":
            in_link += 1
        elif tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            closes = ENDS.get(tag, frozenset())
            if any(open_tags[t] for t in closes):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] in closes:
                        close(k)
                        break
                    if stack[k][1] in SCOPES:
                        break
            if tag == "p":
                in_link = 0
            first, hidden, words = _marked(m[3]) if m[3] else ("", False, ())
            up, _, above, gone = stack[-1]
            label = f"{tag}.{first}" if first else tag
            path = known.setdefault((above, label), len(page.above))
            if path == len(page.above):
                page.above.append(above)
                page.root.append(page.root[above] and tag in ("html", "body"))
            mark = 0.0
            if tag in WRAPPERS:
                mark = MOST
            elif tag in OUTSIDE or (tag == "header" and not page.inside[up]):
                mark = 2.0
            elif words and tag not in NEVER:
                mark = MOST_ANSWERS if ANSWERS.issuperset(words) else MOST
            page.parent.append(up)
            page.marks.append(mark)
            # There is one main element: no mark by class words reaches into it.
            page.main.append(tag == "main" and not page.inside[up])
            page.inside.append(page.inside[up] or tag in CONTAINERS)
            stack.append((len(page.parent) - 1, tag, path, gone or (hidden and tag not in ("html", "body"))))
            open_tags[tag] += 1
    flush()
    return page


def marked_elements(page: Page) -> list[bool]:
    """Which elements are in one whose mark holds. A mark on an element with most of the page's text names a wrapper and falls."""
    n = len(page.parent)
    never = [False] * n
    for e in range(1, n):
        never[e] = never[page.parent[e]] or page.marks[e] > 1
    seen = [0] * n
    for b in page.blocks:
        if not never[b.element]:
            seen[b.element] += len(b.text) - b.links
    for e in range(n - 1, 0, -1):
        seen[page.parent[e]] += seen[e]
    # A mark by class words, and any mark that holds.
    soft, held = [False] * n, [False] * n
    for e in range(1, n):
        holds = 0 < page.marks[e] <= 1 and seen[e] <= page.marks[e] * seen[0]
        soft[e] = holds or (soft[page.parent[e]] and not page.main[e])
        held[e] = never[e] or soft[e]
    return held


def path_scores(page: Page, held: list[bool], sigma: float = 1.0) -> dict[int, float]:
    """The score of each tag path: its ratios, smoothed over the paths in page order, with the ratios around it.

    Ratios are text length and punctuation per block (``Ratio.fused``). The Gaussian over neighbouring paths is narrowed by
    the levels between two paths, so that a heading is lifted by the paragraphs after it and a menu is not; neighbours in
    marked elements count for little. What is around a path is all unmarked text below its parent, if that is not the body.
    """
    own: dict[int, Ratio] = {}
    marked: dict[int, bool] = {}
    for b in page.blocks:
        own.setdefault(b.path, Ratio()).add(Ratio(len(b.text), len(PUNCTUATION.findall(b.text)), b.links, 1))
        marked[b.path] = marked.get(b.path, True) and held[b.element]
    below = [Ratio() for _ in page.above]
    for path, ratio in own.items():
        if not marked[path]:
            below[path].add(ratio)
    for path in range(len(page.above) - 1, 0, -1):
        below[page.above[path]].add(below[path])
    order = list(own)
    raw = [own[p].fused() * (MARKED if marked[p] else 1.0) for p in order]
    reach = max(1, round(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    lines = [_line(page, p) for p in order]
    scores = {}
    for i, p in enumerate(order):
        near = [(kernel[abs(i - j)] * _closeness(lines[i], lines[j]), raw[j]) for j in range(max(0, i - reach), min(len(order), i + reach + 1))]
        smooth = sum(k * x for k, x in near) / sum(k for k, _ in near)
        up = page.above[p]
        around = 0.0 if page.root[up] else below[up].fused()
        scores[p] = (smooth + AROUND * around) * max(0, own[p].chars - own[p].links) / own[p].chars
    return scores


def _line(page: Page, path: int) -> list[int]:
    """A path and the nearest ones above it."""
    out = [path]
    while len(out) <= LEVELS and out[-1]:
        out.append(page.above[out[-1]])
    return out


def _closeness(x: list[int], y: list[int]) -> float:
    """``LEVEL`` for each step from two paths up to where they meet."""
    at = {p: k for k, p in enumerate(x)}
    for k, p in enumerate(y):
        if p in at:
            return LEVEL ** min(k + at[p], 2 * LEVELS)
    return LEVEL ** (2 * LEVELS)


def main_text(source: str | None, share: float = 0.2) -> str:
    """The article of a page; empty if there is none.

    Its blocks are those whose path scores at least ``share`` of the page's best. What the markup says is a factor of the
    score: ``MARKED`` below an element that is named like a part outside the article, ``CONTAINED`` below an article or
    main element. As only the best of the same page counts, a factor that all of a page's text has changes nothing.
    """
    page = parse(source or "")
    if not page.blocks:
        return ""
    held = marked_elements(page)
    scores = path_scores(page, held)
    values = [
        scores[b.path] * (MARKED if held[b.element] else 1.0) * (CONTAINED if page.inside[b.element] else 1.0) for b in page.blocks
    ]
    least = share * max(values)
    return "\n".join(b.text for b, x in zip(page.blocks, values) if x >= least and x > 0)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Replace the column ``html`` by ``text``: each page's main text.

    Null or empty html gives an empty text. Pages are read one by one: no shuffle, one Arrow batch in memory. Other
    columns stay; one named like ``out`` is replaced. Repeated rows give equal texts; an empty table stays empty.
    """
    rows = packed(pages, html=F.col(quoted(html)))
    schema = T.StructType([rows.schema["row"], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([main_text(x.as_py()) for x in batch.column(1)], pa.string())], names=schema.names)

    return unpacked(rows.mapInArrow(run, schema), without=(html,), **{out: F.col(quoted(out))})
