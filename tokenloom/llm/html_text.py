"""Main text by line-block distribution.

1. Markup is stripped in one pass over the page. Elements that are boilerplate by kind
   (menus, headers, footers, sidebars, forms, scripts, ...) or by the words of their
   class, id or role go with all they hold, as the text they hold can be as long as
   that of an article. Each block of text is a line, and each border of a container
   (div, section, list, ..., and of what was stripped) an empty line, so that parts of
   a page that are far apart in its structure are far apart in its lines.
2. The lengths of the lines, link texts apart, are summed over a window of BLOCK
   lines from each line on.
3. A surge point is a line where the sum is no longer zero, a dive point one where it is
   zero again. What lies between the two is kept, with every line, however short, if
   its sum reaches SURGE of the largest sum of the page somewhere in between.
4. An article or main element is a hint by mass: where such elements hold HINT of
   the lengths or more, nothing else is text, and every line of theirs is kept.

Defined results: a null or empty page, or one without text, gives an empty text; a
page of links alone counts the links' texts; unclosed tags end with their parents;
null ids and urls pass through; repeated rows are done one by one; an empty table
gives an empty table.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BLOCK = 3
SURGE = 0.25
HINT = 0.5

#: Elements whose content is raw text up to their end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
STRIPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "menu", "dialog", "audio", "video", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | STRIPPED
#: Blocks whose borders are empty lines.
CONTAINERS = {"address", "article", "body", "center", "details", "div", "dl", "fieldset", "figure", "header", "hgroup", "html", "main", "ol", "section", "table", "ul"} | STRIPPED
#: A start tag of the first kind closes an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = {"article", "main"}
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|notices?|alert|popup|modal"
    r"|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side|aside|widget|footer|foot|masthead|topbar|site-header|toolbar"
    r"|comments?|commentlist|disqus|replies|reply|related|recommended|share|sharing|social|newsletter|subscribe|pagination|pager|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
#: Names of what surrounds the text as well, such as content-with-sidebar.
WRAPPER = re.compile(r"(?:^|[\s_-])(?:content|main|wrapper|container|layout|page|article|post|with|has|no)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TOKEN = re.compile(r"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


def unwanted(tag: str, attributes: str, inside_main: bool) -> bool:
    """Whether an element is boilerplate by its kind or by what its attributes call it."""
    if tag in STRIPPED or tag == "header" and not inside_main:
        return True
    if tag in MAIN or tag in ("body", "html") or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role") and UNWANTED.search(value) and not WRAPPER.search(value) or name == "style" and HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", attributes)))


def strip_markup(page: str) -> list[tuple[str, int, bool]]:
    """The page's lines: text, its length without link texts, and whether it lies in an article or main element."""
    lines: list[tuple[str, int, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each began a stripped part
    opened: Counter[str] = Counter()
    off = main = linked = 0
    at, raw = 0, None

    def end_line(tag: str | None = None) -> None:
        nonlocal linked
        if text:
            whole = "".join(text)
            line = " ".join(whole.split())
            if line:
                lines.append((line, max(0, len(line) - linked), main > 0))
        text.clear()
        linked = 0
        if tag in CONTAINERS and not off:
            lines.append(("", 0, main > 0))

    def pop() -> None:
        nonlocal off, main
        tag, stripped = stack.pop()
        opened[tag] -= 1
        off -= stripped
        main -= tag in MAIN

    while at <= len(page):
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, at)
            at, raw = (m.end() if m else len(page)), None
            pop()
            continue
        m = TOKEN.search(page, at)
        if not off and (end := m.start() if m else len(page)) > at:
            text.append(html_lib.unescape(page[at:end]))
            if opened["a"] > 0:
                linked += len(" ".join(text[-1].split()))
        if m is None:
            break
        at = max(m.end(), at + 1)
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                if tag in BLOCKS:
                    end_line(tag)
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in BLOCKS:
                end_line()
            continue
        if tag == "br":
            if not off:
                text.append("\n")
            continue
        if tag in BLOCKS:
            end_line(tag)
            while stack and stack[-1][0] in CLOSES.get(tag, ()):
                pop()
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        gone = not off and unwanted(tag, m[3], main > 0)
        if gone:
            end_line(tag)
        if tag == "p" and stack and not off:  # a paragraph ends the one before it, and what that has left open
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in BLOCKS:
                    break
        stack.append((tag, gone))
        opened[tag] += 1
        off += gone
        main += tag in MAIN
        if tag in RAW:
            raw = tag
    end_line()
    return lines


def stretches(sizes: np.ndarray, block: int = BLOCK, surge: float = SURGE) -> list[tuple[int, int]]:
    """From each surge point to the dive point after it, if the sums between reach surge of the largest one. The last line's window, and those near it, are cut short."""
    sums = np.convolve(sizes, np.ones(block, np.int64))[block - 1 :]
    high = sums > 0
    borders = np.flatnonzero(np.diff(np.concatenate(([False], high, [False]))))
    return [(int(a), int(z)) for a, z in borders.reshape(-1, 2) if sums[a:z].max() >= surge * sums.max()]


def main_text(page: str | None, block: int = BLOCK, surge: float = SURGE) -> str:
    lines = strip_markup(page or "")
    sizes = np.array([size for _, size, _ in lines], np.int64)
    if not sizes.any():  # links alone
        sizes = np.array([len(line) for line, _, _ in lines], np.int64)
    if not sizes.any():
        return ""
    inside = np.array([x for _, _, x in lines], bool)
    if sizes[inside].sum() >= HINT * sizes.sum():
        kept = [line for line, _, x in lines if x and line]
    else:
        kept = [line for a, z in stretches(sizes, block, surge) for line, _, _ in lines[a:z] if line]
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page: one narrow stage."""
    pages = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], *T._parse_datatype_string("text string, n_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return pages.mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
