"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. Each line's weight is its text's length, without link text; a line in
an article or main element weighs its whole length more. Lines of page furniture (menus, headers, footers, side bars, notices,
adverts, forms, comments; told by element, class, id or role) are left out, with the articles in them; furniture that is never
closed ends where an article begins.

A region is the lines that share their innermost article or main element, or have none. In each region sums over WINDOW lines
are taken; a surge is where the sum rises over the threshold, a dive where it falls to nothing. The region of the heaviest
text is the page's, whether it is an element or not; of its spans those count whose highest sum is PART of the highest, as do such spans of
the elements around it, and regions of half its weight. What lies between a region's spans is kept, and the heading and text lines before.

Null or empty html gives an empty text. Unclosed and cut-off tags are tolerated. Repeated rows each get a row; an empty table gets
none. Very long pages are read whole. Of regions of equal weight the last one is the page's. Columns besides page_id, url and html are
ignored."""

from __future__ import annotations

import html as htmllib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_batches

WINDOW = 3
#: The least sum of a surge, in characters; in a region of less, half of its highest sum.
SURGE = 60
#: Of the highest sum, the share that a span of the article reaches.
PART = 0.25
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|object|canvas|math)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(textarea|select|title)\b[^>]*>.*?(?:</\2\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?][^>]*(?:>|$)",
    re.S | re.I,
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody"
    " td tfoot th thead tr ul".split()
)
#: Elements that are furniture wherever they stand.
FURNITURE = frozenset("nav footer aside form button dialog menu fieldset label input datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that hold others, of which role words tell what they are within an article.
BOXES = frozenset("div section ul ol dl table details header figure center fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|pop-up|modal|overlay|"
    r"newsletter|subscri\w+|sign-?up|paywall|side-?bar|widget\w*|related\w*|recommend\w*|share|sharing|social\w*|comments?|commentlist|disqus|respond|"
    r"repl(?:y|ies)|reader-?comments|nav|navbar|navigation|menus?|breadcrumbs?|pag(?:er|ination)|toolbar|masthead|footer|site-?header|page-?header|topbar|"
    r"header|search\w*|login|complementary|contentinfo|tags?|skip-?link)(?:$|[\s_-])",
    re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _is_furniture(tag: str, attrs: str, in_main: bool) -> bool:
    """By element, or by role words of its attributes. Headings are never furniture by such words, and within an article or main
    element only boxes are: a paragraph of the class "notice" or a heading of the class "article-header" is text."""
    if tag in FURNITURE or tag == "header" and not in_main:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    roles = tag not in HEADINGS and not (in_main and tag not in BOXES)
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if roles and name in ("class", "id", "role") and _ROLE.search(value):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _never_closed(tokens: list, tag: str) -> list:
    """For each token, whether an element of that tag that opens there is never closed."""
    level, levels = 0, []
    for m in tokens:
        if (m[4] or "").lower() == tag:
            level += -1 if m[3] else 1
        levels.append(level)
    out, least = [True] * len(tokens), level + 1
    for i in range(len(tokens) - 1, -1, -1):
        out[i] = least >= levels[i]
        least = min(least, levels[i])
    return out


def lines_of(page: str, open_furniture: bool = False) -> tuple:
    """(text, weight, region, in a heading) of each line of a page, and the region around each region (0: no element).

    open_furniture: furniture ends at an article within it, closed later or not."""
    lines, text, link_chars = [], [], 0
    skip, depth, began, link, heading = "", 0, 0, False, False
    around, inside = {0: 0}, [(0, "")]  # open article and main elements
    tokens, unclosed = list(_TOKEN.finditer(page)), {}

    def flush():
        nonlocal text, link_chars
        line = " ".join(htmllib.unescape("".join(text)).split())
        if line:
            region = inside[-1][0]
            lines.append((line, max(0, len(line) - link_chars) + (len(line) if region else 0), region, heading))
        text, link_chars = [], 0

    at = 0
    for i, m in enumerate(tokens):
        if not skip and m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if link:
                link_chars += len(piece.strip())
        at = m.end()
        tag = (m[4] or "").lower()
        if not tag:
            continue
        closes = bool(m[3])
        if skip:
            if tag in ("article", "main") and not closes and tag != skip:
                if skip not in unclosed:
                    unclosed[skip] = _never_closed(tokens, skip)
                if not (open_furniture or skip == "p" or unclosed[skip][began]):
                    continue
                skip = ""  # furniture that was never closed ends where the article begins
            elif tag == skip:
                depth += -1 if closes else 1
                if skip in ("p", "li") and not closes:
                    depth -= 1
                if depth <= 0:
                    skip = ""
                continue
            elif skip == "p" and tag in BLOCKS:
                skip = ""
            else:
                continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if tag in ("h1", "h2"):
            heading = not closes
        elif tag in BLOCKS:
            heading = False
        if closes:
            if tag in ("article", "main"):
                for k in range(len(inside) - 1, 0, -1):
                    if inside[k][1] == tag:
                        del inside[k:]
                        break
            elif tag == "a":
                link = False
            continue
        if tag in ("article", "main"):
            around[len(around)] = inside[-1][0]
            inside.append((len(around) - 1, tag))
        if tag not in VOID and not m[5].endswith("/") and _is_furniture(tag, m[5], len(inside) > 1):
            if tag not in BLOCKS:
                text.append(" ")
            skip, depth, began = tag, 1, i
        elif tag == "a":
            link = True
    if not skip and at < len(page):
        text.append(page[at:])
    flush()
    return lines, around


def _spans(weights: list) -> list:
    """(highest sum, start, stop) between each surge and its dive."""
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    threshold = min(SURGE, max(sums, default=0) // 2)
    spans, i = [], 0
    while i < n:
        if sums[i] > threshold and weights[i]:
            j = i
            while j < n and sums[j]:
                j += 1
            spans.append((max(sums[i:j]), i, j))
            i = j
        else:
            i += 1
    return spans


def _chosen(lines: list, around: dict) -> list:
    """Places of the lines of the text."""
    regions: dict = {}
    for k, line in enumerate(lines):
        regions.setdefault(line[2], []).append(k)
    spans = {r: _spans([lines[k][1] for k in places]) for r, places in regions.items()}
    weight = {r: sum(lines[k][1] for _, a, b in spans[r] for k in regions[r][a:b]) for r in regions}
    best = max(weight, key=lambda r: (weight[r], r), default=None)
    if best is None or not weight[best]:
        return []
    highest = max(s[0] for s in spans[best])
    outer, r = set(), best
    while r:
        r = around[r]
        outer.add(r)
    keep: set = set()
    for r, places in regions.items():
        if r == best or r in outer:
            own = [s for s in spans[r] if s[0] >= PART * highest]
        else:
            own = spans[r] if 2 * weight[r] >= weight[best] else []
        if not own:
            continue
        first, stop = own[0][1], own[-1][2]
        head = next((i for i in range(first, -1, -1) if lines[places[i]][3]), first)
        while head and lines[places[head - 1]][1] and 2 * lines[places[head - 1]][1] >= len(lines[places[head - 1]][0]):
            head -= 1
        keep.update(k for k in places[head:first] if 2 * lines[k][1] >= len(lines[k][0]))
        keep.update(places[first:stop])
    start = min(keep)
    if not any(lines[k][3] for k in keep):  # the heading may stand before the article, in the element around it
        above = [k for k in range(start) if lines[k][3] and lines[k][2] in outer - {0}]
        keep.update(above[-1:])
    return sorted(keep)


def main_text(page: str) -> str:
    """The text between the surge and dive points."""
    lines, around = lines_of(page)
    keep = _chosen(lines, around)
    if not keep:
        lines, around = lines_of(page, True)
        keep = _chosen(lines, around)
    return "\n".join(lines[k][0] for k in keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py() or "") for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").transform(in_batches, run, "page_id long, url string, text string, n_chars long")
