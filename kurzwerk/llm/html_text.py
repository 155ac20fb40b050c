"""Main text of web pages by the distribution of text over blocks of lines.

Markup and parts that elements name as menus, footers and the like are stripped; what is
left is a line per block. Text lengths are summed over windows of lines: a stretch of
lines is kept from where a window surges to where one dives to nothing.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kurzwerk.llm.common import map_batches

#: Lines per sliding window, and the smallest sum that counts as a surge of text. A page
#: whose largest window is small takes a tenth of that instead.
WINDOW_LINES = 3
SURGE_CHARS = 60
SURGE_SHARE = 0.1
#: Where elements that name the article hold most of a page's text, a character within
#: them counts so many times, and so many characters outside of them count once.
NAMED_WEIGHT = 4

#: Names of elements, by their part in a page.
RAW = frozenset("script style noscript template textarea iframe svg math object title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
ASIDE = frozenset("head nav footer aside menu dialog select button fieldset label".split())
MAIN = frozenset(("article", "main"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Words in class, id and role that name parts outside of the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment"
    " comments consent contentinfo cookie cookies disqus footer gdpr login masthead menu modal"
    " nav navbar navigation newsletter notice notices notification outbrain pager pagination"
    " popup promo promoted promotion recommended related replies reply respond search share"
    " sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription"
    " taboola toolbar widget widgets".split()
)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"(?:\A|\s)hidden(?:\s|=|/|\Z)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WHITE = re.compile(r"\s+")


def is_aside(name: str, attributes: str, inside_main: bool) -> bool:
    """Whether an element is outside of the article by its own name, or hidden."""
    if name in ASIDE or (name == "header" and not inside_main):
        return True
    return bool(attributes) and name not in ("html", "body", "main") and bool(HIDDEN.search(attributes))


def is_doubtful(name: str, attributes: str) -> bool:
    """Whether an element's class, id or role names such a part: it may be a wrapper, too."""
    if name == "form":
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    return any(
        not ASIDE_WORDS.isdisjoint(w.lower() for w in WORD_PARTS.findall(value))
        for _, value in NAMED.findall(attributes)
    )


class Lines:
    """A page as lines, one per block, each in pieces of (text, linked, doubtful part).

    Doubtful parts are numbered as they open; number 0 is the page itself. For each there
    are its parent, the characters directly in it and the article marks directly in it
    (article, main and h1 elements).
    """

    def __init__(self, page: str):
        self.lines: list[tuple[list[tuple[str, bool, int]], bool, bool]] = []
        self.pieces: list[tuple[str, bool, int]] = []
        self.open: list[tuple[str, bool, int]] = []
        #: Depths at which elements of a name are open.
        self.depths: dict[str, list[int]] = {}
        self.asides = self.mains = self.links = self.prose = 0
        self.part = 0
        self.parents, self.sizes, self.marks = [0], [0], [0]
        self.read(page)

    def flush(self) -> None:
        if self.pieces:
            self.lines.append((self.pieces, self.mains > 0, self.prose > 0))
        self.pieces = []

    def add(self, text: str) -> None:
        if not self.asides:
            text = html.unescape(text)
            self.pieces.append((text, self.links > 0, self.part))
            self.sizes[self.part] += len(text.strip())

    def count(self, name: str, by: int) -> None:
        self.mains += by * (name in MAIN)
        self.links += by * (name == "a")
        self.prose += by * (name in PROSE)

    def push(self, name: str, attributes: str) -> None:
        aside = is_aside(name, attributes, self.mains > 0)
        self.open.append((name, aside, self.part))
        self.depths.setdefault(name, []).append(len(self.open) - 1)
        self.asides += aside
        self.count(name, 1)
        if self.asides:
            return
        if is_doubtful(name, attributes):
            self.parents.append(self.part)
            self.sizes.append(0)
            self.marks.append(0)
            self.part = len(self.parents) - 1
        elif name in MAIN or name == "h1":
            self.marks[self.part] += 1

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            name, aside, self.part = self.open.pop()
            self.depths[name].pop()
            self.asides -= aside
            self.count(name, -1)

    def close(self, name: str, within: tuple[str, ...] = ()) -> None:
        """Close the last open ``name``, unless one of ``within`` was opened after it."""
        depth = self.last(name)
        if depth >= 0 and all(self.last(other) < depth for other in within):
            self.pop_to(depth)

    def last(self, name: str) -> int:
        depths = self.depths.get(name)
        return depths[-1] if depths else -1

    def read(self, page: str) -> None:
        at = 0
        while m := MARKUP.search(page, at):
            if m.start() > at:
                self.add(page[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if name in BLOCK:
                    self.flush()
                self.close(name, ("td", "th", "table") if name not in BLOCK else ())
                continue
            attributes = m[3] or m[6] or ""
            if name in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in BLOCK:
                self.flush()
                self.close("p", ("td", "th", "table", "div", "section", "article", "li", "button"))
                if name == "li":
                    self.close("li", ("ul", "ol", "menu"))
                elif name == "body":
                    self.pop_to(0)
            elif name == "br":
                self.add(" ")
            if name not in VOID:
                self.push(name, attributes)
        if at < len(page):
            self.add(page[at:])
        self.flush()

    def kept_parts(self) -> list[bool]:
        """Which doubtful parts are wrappers of the article and stay.

        Such a part holds a mark of an article (or the page has none), and more than half
        of the text of the part around it, other candidates included.
        """
        n = len(self.parents)
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            children[self.parents[k]].append(k)
        unmarked = not any(self.marks)
        sizes, marked = list(self.sizes), [m > 0 for m in self.marks]
        kept = [False] * n
        for k in range(n - 1, -1, -1):
            candidates = [c for c in children[k] if marked[c] or unmarked]
            around = sizes[k] + sum(sizes[c] for c in candidates)
            for c in candidates:
                if 2 * sizes[c] > around:
                    kept[c] = True
                    sizes[k] += sizes[c]
                    marked[k] = marked[k] or marked[c]
        kept[0] = True
        for k in range(1, n):
            kept[k] = kept[k] and kept[self.parents[k]]
        return kept

    def stripped(self) -> list[tuple[str, int, bool]]:
        """(text, characters that count, within an article element) of lines with text.

        Characters of links count in no line but prose (paragraphs, headings), which
        counts as one character at least: a linked headline is no menu.
        """
        kept, out = self.kept_parts(), []
        for pieces, main, prose in self.lines:
            pieces = [piece for piece in pieces if kept[piece[2]]]
            text = WHITE.sub(" ", "".join(piece[0] for piece in pieces)).strip()
            if text:
                linked = sum(len(WHITE.sub(" ", t)) for t, in_link, _ in pieces if in_link)
                out.append((text, max(int(prose), len(text) - linked), main))
        return out


def chosen(weights: np.ndarray, surge_chars: int = SURGE_CHARS) -> np.ndarray:
    """Which lines lie between a dive, a surge and the next dive.

    ``weights``: characters that count. A dive is a window of lines without any; lines
    between dives stay if a window that touches them reaches the threshold. Lines without
    characters that count are left out at either end of a stretch.
    """
    n = len(weights)
    keep = np.zeros(n, bool)
    if not n or not weights.any():
        return keep
    total = np.concatenate([[0], np.cumsum(weights)])
    starts = np.arange(1 - WINDOW_LINES, n)
    sums = total[np.minimum(starts + WINDOW_LINES, n)] - total[np.maximum(starts, 0)]
    surge = sums >= max(1, min(surge_chars, SURGE_SHARE * sums.max()))
    text = np.flatnonzero(weights)
    # Neighbouring lines with text that are a window or more apart have a dive between them.
    first = np.concatenate([[True], np.diff(text) > WINDOW_LINES])
    begins = text[first]
    ends = text[np.append(first[1:], True)] + 1
    for a, b in zip(begins, ends):
        # Windows that touch lines a to b - 1 start at a - WINDOW_LINES + 1 and later.
        keep[a:b] = surge[a : b - 1 + WINDOW_LINES].any()
    return keep


def main_text(page: str | None) -> str:
    """The article of a page; empty if it has none.

    The distribution of text decides on every page. Where article and main elements hold
    more than half of the text that is left, their lines weigh more, links included, the
    others less, and their borders are dives; no line is left out for its place alone.
    """
    if not page:
        return ""
    lines = Lines(page).stripped()
    named = sum(len(text) for text, _, main in lines if main)
    if 2 * named > sum(len(text) for text, _, _ in lines):
        weights, places, before = [], [], None
        for text, counted, main in lines:
            if before not in (None, main):
                weights.extend([0] * WINDOW_LINES)
            before = main
            places.append(len(weights))
            weights.append(len(text) * NAMED_WEIGHT if main else counted // NAMED_WEIGHT)
        keep = chosen(np.array(weights, np.int64))[places]
    else:
        keep = chosen(np.array([counted for _, counted, _ in lines], np.int64))
    return "\n".join(line[0] for line, kept in zip(lines, keep) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    Reads page_id, url, html; a null html is an empty page and gives an empty text. Null
    ids and urls stay; repeated rows are handled each; other columns are ignored; no rows
    give no rows. Row-local.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes],
            ["page_id", "url", "text", "n_chars"],
        )

    rows = pages.selectExpr(
        "cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html"
    )
    return map_batches(rows, step, "page_id bigint, url string, text string, n_chars bigint")
