"""Main text of HTML pages by line-block distribution.

The markup is stripped to lines, one for each block element, each with the length of its text.  Lengths are
summed over windows of neighbouring lines; where the sums rise to a share of the page's mean sum, or to SURE, a region surges, where they fall to nothing
or an article ends it dives, and the text between is kept.  In an article or main element any text surges.  Tags are
weights only: the text of links outside articles, and of elements whose tag, role or class names them
navigation, adverts, notices, forms or comments, has length 0, unless such an element holds the page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, to either side of its middle.
REACH = 1
#: A region outside articles surges at this share of the page's mean sum (each sum counted by the weight of its line),
#: and at this many characters in any case.
SURGE, SURE = 0.2, 40
#: Lines without weight between a heading below the first level and the text that it leads.
LEAD = 5

# fixed values: elements by their standard roles
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
HIDDEN = frozenset("head title template noscript select textarea button option svg math iframe object audio video canvas datalist map noframes".split())
NEVER_TEXT = frozenset("nav footer aside dialog".split())
SELDOM_TEXT = frozenset("header form menu fieldset search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("body button caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split())
NEVER_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
SELDOM_ROLES = frozenset("banner form".split())
# fixed values: words of class names and ids of reader comments; of what else is not the text; and of what may be part of it
COMMENTS = r"comments?|commentlist|disqus|respond|replies"
STRONG = r"ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|nav\w*|menu|breadcrumbs?|sidebar|related|recommend\w*|share|sharing|social|pagination|pager|login"
WEAK = r"banner|notice|notification|alert|overlay|aside|widget|footer|header|masthead|topbar|toolbar|reply|tags?|skip\w*|search"
_COMMENTS = re.compile(rf"(?:^|[_-])(?:{COMMENTS})(?:$|[_-])", re.I)
_STRONG = re.compile(rf"(?:^|[_-])(?:{STRONG})(?:$|[_-])", re.I)
_WEAK = re.compile(rf"(?:^|[_-])(?:{WEAK})(?:$|[_-])", re.I)
_WEAK_ALONE = re.compile(rf"(?!header$)(?:{WEAK})$", re.I)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Class names that say how a container is laid out, not what it holds.
_LAYOUT = re.compile(r"^(?:has|with|no|without)[_-]|(?:^|[_-])(?:wrap|wrapper|layout|main|body)(?:$|[_-])", re.I)
#: Share of a text that an element marked as noise must hold to count as that text; if it also holds the main article, the second.
MOST_TEXT, MORE_TEXT = 0.8, 0.5
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))|[^>])*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=$|[\s"'/])""", re.I)
_SPACE = re.compile(r"\s+")


# what an element marked as noise is: by a weak name, by a tag that may stand around a whole page, by a strong name,
# by a name of comments, by a tag or role that is never the text
WEAK_NAME, WRAPPER, STRONG_NAME, COMMENT_NAME, NEVER = 1, 2, 3, 4, 5


def _named(word: str, inside: bool) -> int:
    word = _HUMP.sub("-", word)
    if _LAYOUT.search(word):
        return 0
    if _COMMENTS.search(word):
        return COMMENT_NAME
    if _STRONG.search(word):
        return STRONG_NAME
    return WEAK_NAME if (_WEAK_ALONE.match(word) if inside else _WEAK.search(word)) else 0


def _marks(tag: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """The kind of noise that an element is marked as, or 0, and whether it is hidden.

    inside: in an article, where words that may also mark parts of a text must stand alone, and a header is part of it.
    """
    kind, hidden = NEVER if tag in NEVER_TEXT else WRAPPER if tag in SELDOM_TEXT and not (inside and tag == "header") else 0, tag in HIDDEN
    if not attributes or tag in ("html", "body", "main", "article"):
        return kind, hidden
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            kind = max([kind, *(_named(word, inside) for word in value.split())])
        elif name == "role":
            kind = max(kind, NEVER if value.lower() in NEVER_ROLES else WRAPPER if value.lower() in SELDOM_ROLES else 0)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return kind, hidden


class _Line:
    """Pieces of a line with the noise each stands in, and what is known of the line."""

    __slots__ = ("pieces", "article", "level", "linked")

    def __init__(self):
        self.pieces: list[tuple[str, bool, int]] = []  # text, counts as a link, innermost element marked as noise
        self.article = self.level = 0
        self.linked = False


class _Marked:
    """The elements of a page that are marked as noise, as a tree; 0 is the page."""

    def __init__(self):
        self.kind, self.parent, self.article = [0], [-1], [0]  # article: number of the one around it
        self.prose, self.title = [False], [False]  # whether it holds a paragraph or article; a heading of the first level
        self.around: dict[int, int] = {}  # of each article, the innermost element around it

    def add(self, kind: int, parent: int, article: int) -> int:
        self.kind.append(kind)
        self.parent.append(parent)
        self.article.append(article)
        self.prose.append(False)
        self.title.append(False)
        return len(self.kind) - 1

    def chain(self, i: int) -> list[int]:
        out = []
        while i > 0:
            out.append(i)
            i = self.parent[i]
        return out

    def noise(self, lines: list[_Line]) -> list[bool]:
        """Whether each element is noise.  One that holds the text of its page, or of the article around it, is none."""
        n = len(self.kind)
        size, inside = [0] * n, {}
        for x in lines:
            for piece, link, at in x.pieces:
                if not link:
                    length = len(piece.strip())
                    size[at] += length
                    inside[x.article] = inside.get(x.article, 0) + length
        never = [False] * n
        for i in range(1, n):
            never[i] = never[self.parent[i]] or self.kind[i] == NEVER
        held, comments = [0 if never[i] else size[i] for i in range(n)], [False] * n
        for i in range(1, n):
            comments[i] = comments[self.parent[i]] or self.kind[i] == COMMENT_NAME
        text = sum(held[i] for i in range(n) if not comments[i])
        whole = sum(held)
        for i in range(n - 1, 0, -1):
            if self.kind[i] != COMMENT_NAME:
                held[self.parent[i]] += held[i]
            self.prose[self.parent[i]] |= self.prose[i]
            self.title[self.parent[i]] |= self.title[i]
        # the main article: with the least noise around it, then the longest
        main = min(self.around, key=lambda a: (len(self.chain(self.around[a])), -inside.get(a, 0)), default=0)
        free = main and not self.around[main]
        holders = set(self.chain(self.around[main])) if main else set()

        def is_text(i: int) -> bool:
            kind = self.kind[i]
            if kind == NEVER:
                return False
            if self.article[i]:  # a part of an article
                return kind in (WEAK_NAME, WRAPPER) and self.prose[i] and held[i] > MOST_TEXT * inside.get(self.article[i], 0)
            if free:
                return False
            if kind == COMMENT_NAME:
                return i in holders and self.title[i] and held[i] > MORE_TEXT * whole
            if i in holders and held[i] > MORE_TEXT * text:
                return True
            return held[i] > MOST_TEXT * text and (kind != WRAPPER or self.prose[i])

        found = [False] * n
        for i in range(1, n):
            found[i] = found[self.parent[i]] or not is_text(i)
        return found


def lines_of(page: str) -> list[tuple[str, int, int, int, bool]]:
    """The lines of a page: text, length - 0 for links and noise -, number of the outermost article that holds it or 0,
    level as a heading or 0, and whether it has text of links that is not noise.

    Inline noise within a line of other text is left out of it.
    """
    lines: list[_Line] = []
    line = _Line()
    stack: list[tuple[str, int]] = []  # open elements: tag; 1 marked as noise, 2 hidden, 4 article, 8 link, 16 heading
    opened: dict[str, int] = {}
    headings: list[int] = []
    marked, noisy = _Marked(), [0]  # noisy: open elements that are marked as noise
    hidden = article = link = articles = 0

    def emit() -> None:
        nonlocal line
        if line.pieces:
            lines.append(line)
        line = _Line()

    def put(piece: str) -> None:
        if hidden or not piece:
            return
        line.pieces.append((piece, link > 0 and not article, noisy[-1]))
        if not piece.isspace():
            if article > 0:
                line.article = articles
            line.level = line.level or (headings[-1] if headings else 0)
            line.linked |= link > 0

    def leave(to: int) -> None:
        nonlocal hidden, article, link
        while len(stack) > to:
            tag, kind = stack.pop()
            opened[tag] -= 1
            hidden -= kind >> 1 & 1
            article -= kind >> 2 & 1
            link -= kind >> 3 & 1
            if kind & 16:
                headings.pop()
            if kind & 1:
                noisy.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m[1]:
            if tag in BLOCKS:
                emit()
            end = re.compile(rf"</{tag}(?:[\s/>]|$)", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = n if close < 0 else close + 1
            continue
        if tag in BLOCKS:
            emit()
        elif tag == "br":
            put(" ")
        if tag in VOID:
            continue
        if m[1]:
            if opened.get(tag):
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in CLOSES_P or tag in ("li", "dd", "dt", "tr", "td", "th"):
            if opened.get("p") or opened.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] == tag and tag in ("li", "tr", "td", "th"):
                        leave(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
        if not m[3].endswith("/") or tag in BLOCKS or tag == "a":
            mark, hide = _marks(tag, m[3], article > 0)
            kind = (mark > 0) | hide << 1 | (tag in ("article", "main")) << 2 | (tag == "a") << 3 | (tag in HEADINGS) << 4
            stack.append((tag, kind))
            opened[tag] = opened.get(tag, 0) + 1
            hidden += hide
            if kind & 1:
                noisy.append(marked.add(mark, noisy[-1], articles if article else 0))
            if kind & 4:
                if not article:
                    articles += 1
                    marked.around[articles] = noisy[-1]
                article += 1
            link += kind >> 3 & 1
            if kind & 4 or tag == "p":
                marked.prose[noisy[-1]] = True
            if kind & 16:
                headings.append(int(tag[1]))
                marked.title[noisy[-1]] |= tag == "h1"
    emit()

    noise = marked.noise(lines)
    out = []
    for x in lines:
        clean = [p for p in x.pieces if not noise[p[2]]]
        some = any(not p[0].isspace() for p in clean)
        said = _SPACE.sub(" ", entities.unescape("".join(p[0] for p in (clean if some else x.pieces)))).strip()
        if said:
            length = sum(len(p[0].strip()) for p in clean if not p[1])
            out.append((said, length, x.article, x.level, x.linked and some))
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks in order, joined by newlines; empty if there is none."""
    if not page:
        return ""
    lines = lines_of(page)
    weights = [x[1] for x in lines]
    n = len(lines)
    sums = [sum(weights[k] for k in range(max(0, i - REACH), min(n, i + REACH + 1)) if lines[k][2] == lines[i][2]) for i in range(n)]
    surge = min(SURE, SURGE * sum(w * x for w, x in zip(weights, sums, strict=True)) / (sum(weights) or 1))
    kept = [False] * n
    start = 0
    while start < n:
        stop = start
        while stop < n and sums[stop] > 0 and lines[stop][2] == lines[start][2]:  # up to the dive
            stop += 1
        if stop > start and (lines[start][2] or max(sums[start:stop]) >= surge):
            full = [i for i in range(start, stop) if weights[i]]
            for i in range(full[0], full[-1] + 1):
                kept[i] = weights[i] > 0 or lines[i][4]
        start = max(stop, start + 1)
    # a heading stays with the text that it leads
    follows = n + LEAD + 1
    for i in range(n - 1, -1, -1):
        if weights[i]:
            if not kept[i] and (lines[i][3] == 1 and follows < n or lines[i][3] and follows - i <= LEAD + 1):
                kept[i] = True
            follows = i if kept[i] else 2 * n + LEAD + 1
    return "\n".join(line[0] for line, keep in zip(lines, kept, strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        lengths = pd.array([len(t) for t in texts], dtype="int64")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(lengths, pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    pages: page_id, url, html and any other columns.  Null, empty and text-free pages give an empty text;
    repeated rows give equal texts; broken markup is read as far as it goes; a very long page is read whole, in time
    that grows with its length.
    """
    rows = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
