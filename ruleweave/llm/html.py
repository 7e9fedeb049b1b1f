"""Operator 10: main text of web pages by the line-block distribution.

Markup is stripped into lines, one for each block. Lines of menus, headers, footers, sidebars, notices,
adverts, forms and comments, told by element, class, id or role, count as empty, and so do lines made
of links. Lengths are summed over sliding windows of lines; text starts at a surge, a window that holds SURGE characters
or half as many as the fullest one, and ends where the windows dive to nothing, so that a run of WINDOW link lines ends it, in an article too.
Short lines in the container of a surge belong to it. Where a page marks its article or main element, the lines outside are
empty too; an article in boilerplate, or one that is itself a comment, an advert or a list of related ones, marks nothing.

A class or id is boilerplate if all its parts between hyphens and underscores are known words and one is a word of boilerplate: `sidebar-left` is, `form-factor` isn't.
Scripts and styles without an end run to the end of the page, as in browsers; other elements of which the content is left out don't.

Null, empty or text-free html gives empty text. Repeated pages are extracted each for themselves. An empty table gives no rows. A very long page is a slice of its own, read once from left to right.
Other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import slices

#: Lines in a window, and the least sum of a window at a surge.
WINDOW, SURGE = 3, 80
#: A line counts as one of links if more than this share of it is.
LINKED = 0.6
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "svg", "math", "object"}
_OUT = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "fieldset", "figure-share"} | _RAW
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
_NOISE = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promotion banner sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager"
    " comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login social share sharing related recommended"
    " footer masthead topbar toolbar skip widget widgets search form hidden".split()
)
#: Words that may stand beside one of boilerplate in a class or id.
_BESIDE = set("left right top bottom side main site page post article global primary secondary header box boxes bar area wrapper wrap container inner outer section block list item items link links icons button buttons group row col slot unit text content posts articles stories reply author meta body policy mobile desktop sticky fixed small large".split())
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_SECTIONS = {"article", "main"}
#: An article is boilerplate if a whole class or id is a word of _NOISE, or a part of one is "comment".
_REMARK = re.compile(r"(?:^|[\s_-])comment(?:$|[\s_-])", re.I)
#: Blocks of lines; any other element is a container of them.
_BLOCKS = set("p h1 h2 h3 h4 h5 h6 hgroup header address ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th".split()) | _INLINE


def lines_of(page: str) -> tuple[list[tuple[str, bool, bool, int, int]], bool]:
    """Each line as (text, whether it lies inside the marked article, whether it is boilerplate, its container, characters of links), and whether any article is marked."""
    lines: list[tuple[str, bool, bool, int, int]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, int]] = []  # element, inside article, boilerplate, container
    marked = False
    at, n = 0, len(page)
    inside = noise = False
    box = boxes = 0
    in_link = 0
    unclosed: set[str] = set()  # elements that have no end from here on

    def flush() -> None:
        nonlocal linked
        if text:
            own = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if own:
                lines.append((own, inside, noise, box, linked))
        linked = 0

    def say(part: str) -> None:
        nonlocal linked
        if part:
            text.append(part)
            if in_link:
                linked += len(part)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            if m.group().startswith("<![CDATA["):
                say(m.group()[9:].removesuffix("]]>"))
            continue
        closing = m.group(1) or m.group(4)
        attributes = m.group(3) or m.group(6) or ""
        if name in _RAW and not closing:
            if not attributes.rstrip().endswith("/") and name not in unclosed:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if not end and name not in ("script", "style"):
                    unclosed.add(name)
                at = end.end() if end else at if name in unclosed else n
            if name not in ("svg", "math"):
                flush()
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name in _INLINE and not (attributes and not closing and _is_noise(name, attributes)):
            if closing and any(e[0] == name for e in stack):  # an inline element that is boilerplate
                flush()
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
                inside, noise, box = stack[-1][1:] if stack else (False, False, 0)
            continue
        flush()
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        if closing:
            if any(e[0] == name for e in stack):
                while stack.pop()[0] != name:
                    pass
                inside, noise, box = stack[-1][1:] if stack else (False, False, 0)
            continue
        if name == "p" or name in ("li", "td", "tr", "dd", "dt", "option"):  # closed by the next of its kind
            if stack and stack[-1][0] == name:
                stack.pop()
                inside, noise, box = stack[-1][1:] if stack else (False, False, 0)
        noise = noise or name in _OUT or (name == "header" and not inside) or _is_noise(name, attributes)
        inside = inside or not noise and (name in _SECTIONS or bool(re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody", attributes, re.I)))
        marked |= inside
        if name not in _BLOCKS:
            box = boxes = boxes + 1
        stack.append((name, inside, noise, box))
    flush()
    return lines, marked


def _boilerplate(name: str) -> bool:
    """Whether a class or id is made of words of boilerplate, and words that may stand beside them."""
    parts = [x.lower() for x in _PART.split(name) if x]
    return any(x in _NOISE for x in parts) and all(x in _NOISE or x in _BESIDE or x.isdigit() for x in parts)


def _is_noise(name: str, attributes: str) -> bool:
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attributes):
        kind, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "role" and value.lower() in _ROLES:
            return True
        if kind in ("class", "id") and (any(x.lower() in _NOISE for x in value.split()) or _REMARK.search(value) if name == "article" else any(map(_boilerplate, value.split()))):
            return True
    return False


def text_lines(lengths: list[int], boxes: list[int]) -> list[bool]:
    """Which lines are text, by the lengths of what counts in them and their containers."""
    n = len(lengths)
    sums = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    least = max(1, min(SURGE, max(sums, default=0) // 2))
    surge, open_ = [False] * n, False
    dense = set()  # containers of the longest lines of surges
    for i in range(n):
        if lengths[i] and sums[i] >= least:
            open_ = True
            dense.add(boxes[max(range(i, min(n, i + WINDOW)), key=lengths.__getitem__)])
        if not sums[i]:
            open_ = False
        surge[i] = open_
    return [s or bool(m) and b in dense for s, m, b in zip(surge, lengths, boxes)]


def main_text(page: str | None) -> str:
    """The lines between surges and dives of a page, joined by spaces."""
    lines, marked = lines_of(page or "")
    keep = [not noise and (inside or not marked) for _, inside, noise, _, _ in lines]
    lengths = [len(x[0]) if k and x[4] <= LINKED * len(x[0]) else 0 for x, k in zip(lines, keep)]
    return " ".join(x[0] for x, k, t in zip(lines, keep, text_lines(lengths, [x[3] for x in lines])) if k and t)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html_"):
            texts = [main_text(h) for h in batch.column("html_").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col(html).alias("html_")).mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")
