"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of tags (and class names), blocks
of links apart. Per path, text length and punctuation are summed and set against the number of blocks.
Both ratios are carried back to the blocks, fused into one score, smoothed along the page and
thresholded: blocks above the threshold are content, and nothing else decides where the content lies.
Names of elements and classes weigh the score a little up or down; as a weight counts for all that an
element holds, a name on a wrapper changes nothing.

Gaps are filled then. Within the smallest section of the selected blocks, a block between them stays
(and a heading before them, and what follows them in their own section) unless its own part of the page
is named as boilerplate. Hidden elements, controls, scripts and styles are never text.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_column, slices, table

TAG_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
TAG_STEP = re.compile(r"""[^>"']*""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
PUNCTUATION = re.compile(r"[.,;:!?…](?=\s|\Z)|[。，、；：！？]")  # not those in addresses and numbers

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset("html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = frozenset("html body main article section div td center form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = frozenset("p ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("html body table ul ol dl div section article main td th blockquote".split())
# Not text, but only from a start tag to its own end tag: one without an end hides nothing.
UNSEEN = frozenset("head select datalist button svg object audio video canvas template noscript annotation annotation-xml".split())

# Names of parts that are seldom content. A word after or before one of STATES names a state, not a part.
SOFT = frozenset("social share sharing promo promoted promotion legal copyright widget search toolbar skip related recommended recommendations".split())
HARD = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead footer comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register pagination pager disclaimer".split()
)
HARD_TAGS = frozenset("nav footer aside menu dialog search form fieldset".split())
HARD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Hard names that can also be what an article's part is about: on one element of a page alone, and inside an article, they are soft.
TOPICS = frozenset("discussion comment reply respond banner alert menu navigation search".split())
STATES = frozenset("no not has have is with without free enabled disabled less open closed on off".split())

MAX_DEPTH = 512  # elements below this depth belong to the one that holds them, as in browsers
WEIGHT = {0: 1.0, 1: 0.5, 2: 0.03}  # of plain, softly and hard named elements
ARTICLE_WEIGHT = 1.8
HALF = 2000.0  # a path of blocks with 200 characters and nine marks has half the highest score


def named(names: str) -> tuple[int, bool]:
    """2 or 1 where class and id names mark a part that is hardly or seldom content, else 0; and whether words of TOPICS alone make it 2."""
    level, firm = 0, False
    for name in names.split():
        words = re.findall(r"[a-z]+", name)
        if STATES.isdisjoint(words):
            hard = HARD.intersection(words)
            level = max(level, 2 if hard else 0, 0 if SOFT.isdisjoint(words) else 1)
            firm = firm or not hard <= TOPICS
    return level, level == 2 and not firm


class Page:
    """Elements (numbered so that parents come first) and text nodes of one page, read in one pass over it."""

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.level, self.hidden, self.main, self.header = [""], [-1], [0], [0], [0], [False], [False]
        self.holder = [0]  # the element, or the block around it
        self.topics: dict[str, list[int]] = {}  # elements inside an article that are named by TOPICS alone
        self.inner = [False]  # whether the element lies in an article or is one
        self.link = [False]
        self.nodes: list[tuple[int, int, str]] = []  # (element, block number, text)
        self._paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        level, main, header, hidden, names, topic = 2 if tag in HARD_TAGS else 0, tag in ("main", "article"), tag == "header", False, "", False
        if attributes and not attributes.isspace():
            found = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(attributes)}
            names = _html.unescape(f"{found.get('class', '')} {found.get('id', '')}").lower()
            role = found.get("role", "").lower()
            own = 2 if role in HARD_ROLES else level
            level, topic = named(names)
            level, topic = max(level, own), topic and own < 2
            main = main or role == "main"
            header = header or "header" in re.findall(r"[a-z]+", names)
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(INVISIBLE.search(found.get("style", "")))
            names = "." + ".".join(sorted(set(re.findall(r"[a-z]+", names)))) if names.strip() else ""
        if tag in ("html", "body"):
            level, header = 0, False
        at = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self._paths.setdefault((self.path[parent], tag + names), len(self._paths) + 1))
        self.level.append(level)
        self.inner.append(main or self.inner[parent])
        if topic and self.inner[at]:
            self.topics.setdefault(names, []).append(at)
        self.hidden.append(1 if hidden else 0)
        self.main.append(main)
        self.header.append(header and not main)
        self.holder.append(at if tag in BLOCKS or "-" in tag else self.holder[parent])
        self.link.append(tag == "a" or self.link[parent])
        return at

    def _read(self, page: str) -> None:
        stack, opened, block, at, size = [0], {}, 0, 0, len(page)
        plain_until = 0  # before this place quotes are not paired: a quote there has no partner
        no_end: set[str] = set()  # raw elements without an end tag in the rest of the page

        def cut(i: int) -> None:
            for e in stack[i:]:
                opened[self.tag[e]] -= 1
            del stack[i:]

        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                self.nodes.append((stack[-1], block, page[at:]))
                break
            mark = page[lt + 1 : lt + 2]
            name = TAG_NAME.match(page, lt + 1)
            if not name and mark not in ("!", "?", "/"):
                lt = page.find("<", lt + 1)  # a bare sign is text
                lt = size if lt < 0 else lt
                self.nodes.append((stack[-1], block, page[at:lt]))
                at = lt
                continue
            if lt > at:
                self.nodes.append((stack[-1], block, page[at:lt]))
            if not name:
                if page.startswith("<!--", lt):
                    short = next((s for s in ("<!-->", "<!--->") if page.startswith(s, lt)), None)
                    end = lt + len(short) if short else page.find("-->", lt + 4) + 3
                    at = size if end < lt + 4 else end
                elif page.startswith("<![CDATA[", lt):
                    end = page.find("]]>", lt)
                    at = size if end < 0 else end + 3
                else:
                    end = page.find(">", lt)
                    at = size if end < 0 else end + 1
                continue
            # The end of the tag, outside quotes where these pair up.
            end = name.end()
            if lt < plain_until:
                end = page.find(">", end)
            else:
                while True:
                    end = TAG_STEP.match(page, end).end()
                    if end >= size:
                        end = -1
                        break
                    if page[end] == ">":
                        break
                    close = page.find(page[end], end + 1)
                    if close < 0:
                        plain_until = end
                        end = page.find(">", name.end())
                        break
                    end = close + 1
            if end < 0:
                break  # a tag without an end: nothing but markup follows
            attributes, at = page[name.end() : end], end + 1
            tag = name[0].lower()
            closing = tag[0] == "/"
            tag = tag.lstrip("/")
            if tag in BLOCKS or "-" in tag:
                block += 1
            elif tag == "br":
                self.nodes.append((stack[-1], block, " "))
            if closing:
                if opened.get(tag):
                    inline = tag not in BLOCKS
                    for i in range(len(stack) - 1, 0, -1):
                        found = self.tag[stack[i]]
                        if found == tag:
                            self.hidden[stack[i]] = 2 if tag in UNSEEN else self.hidden[stack[i]]
                            cut(i)
                            break
                        if inline and found in SCOPE:
                            break
                continue
            bare = attributes.rstrip().endswith("/")
            if tag in RAW and not bare:
                finish = None if tag in no_end else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                if finish:
                    at = finish.end()
                elif tag in ("script", "style"):
                    break  # the rest of the page is code
                else:
                    no_end.add(tag)
                continue
            if tag in VOID:
                continue
            for closed in {*(("p",) if tag in P_ENDS else ()), *CLOSES.get(tag, ())}:
                if opened.get(closed):
                    for i in range(len(stack) - 1, 0, -1):
                        found = self.tag[stack[i]]
                        if found == closed:
                            cut(i)
                            break
                        if found in SCOPE and not (tag == "tr" and found in ("td", "th")):
                            break
            if not bare and len(stack) < MAX_DEPTH:
                stack.append(self._open(tag, attributes, stack[-1]))
                opened[tag] = opened.get(tag, 0) + 1
        for alone in self.topics.values():
            if len(alone) == 1:
                self.level[alone[0]] = 1


class Blocks:
    """Visible blocks of a page in its order: text, holding element, path and whether links fill it."""

    def __init__(self, page: Page):
        hidden = page.hidden
        for e in range(1, len(hidden)):
            hidden[e] = max(hidden[e], hidden[page.parent[e]])
        self.texts, self.holder, path = [], [], []
        at = 0
        least = min((hidden[e] for e, _, t in page.nodes if not t.isspace()), default=0)
        nodes = [n for n in page.nodes if hidden[n[0]] <= min(least, 1)]  # a page that hides all its text shows it all
        while at < len(nodes):
            end = at
            while end < len(nodes) and nodes[end][1] == nodes[at][1]:
                end += 1
            part, at = nodes[at:end], end
            text = " ".join(_html.unescape("".join(t for _, _, t in part)).split())
            if text:
                inside = next(n for n, _, t in part if not t.isspace())
                linked = sum(len(t.strip()) for n, _, t in part if page.link[n])
                links = 2 * linked > sum(len(t.strip()) for _, _, t in part)
                self.texts.append(text)
                self.holder.append(page.holder[inside])
                path.append((page.path[page.holder[inside]], links))
        self.links = np.array([x for _, x in path], bool)
        self.path = np.unique(np.array([2 * p + x for p, x in path], np.int64), return_inverse=True)[1]
        self.length = np.array([len(t) for t in self.texts], float)


def scores(blocks: Blocks, width: float = 1.0) -> np.ndarray:
    """Path ratios of text length and punctuation, fused, and smoothed along the page."""
    marks = np.array([len(PUNCTUATION.findall(t)) for t in blocks.texts], float)
    count = np.bincount(blocks.path)
    text_ratio, mark_ratio = (np.bincount(blocks.path, v) / count for v in (blocks.length, marks))
    fused = text_ratio * (1 + mark_ratio)
    fused = (fused / (fused + HALF))[blocks.path]  # twice the text of a long paragraph says no more than once
    kernel = np.exp(-(np.arange(-2, 3) ** 2) / (2 * width**2))
    around = np.convolve(fused, kernel, "full")[2:-2] / np.convolve(np.ones(len(fused)), kernel, "full")[2:-2]
    return fused**0.75 * around**0.25


def threshold(score: np.ndarray, length: np.ndarray) -> float:
    """Half the score of the average character."""
    return 0.5 * float(np.average(score, weights=length))


def content(page: Page, blocks: Blocks) -> np.ndarray:
    """Which blocks are content."""
    n = len(page.tag)
    weight = np.ones(n)
    for e in range(1, n):
        own = WEIGHT[page.level[e]] * (ARTICLE_WEIGHT if page.main[e] and not page.level[e] else 1)
        weight[e] = max(weight[page.parent[e]] * own, 1e-30)
    holder = np.array(blocks.holder)
    plain = scores(blocks)
    score = plain * weight[holder]
    chosen = score >= threshold(score, blocks.length * weight[holder])
    # Selected text below each element, and all text.
    held = np.zeros(n)
    np.add.at(held, holder, np.where(chosen, blocks.length, 0))
    count = np.bincount(holder[chosen], minlength=n)
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        held[up] += held[e]
        count[up] += count[e]
    section = 0  # the smallest section that holds all that is selected
    for e in range(1, n):
        if count[e] == count[0] and page.tag[e] in SECTIONS:
            section = e
    # An article around it is the better border.
    border = section
    while border > 0 and not page.main[border]:
        border = page.parent[border]
    section = border if border > 0 else section
    closed = page.tag[section] not in ("", "html", "body")
    # How strongly a part is named, where it does not hold most of the selected text. The header of an article is its own.
    part, article, nearest, inside = [0] * n, [False] * n, [0] * n, [section == 0] * n
    plainly = [True] * n  # whether only text elements lie between it and the nearest one with selected text
    for e in range(1, n):
        up = page.parent[e]
        plainly[e] = bool(count[e]) or plainly[up] and page.tag[e] in TEXTUAL
        inside[e] = inside[up] or e == section
        article[e] = article[up] or page.main[e]
        nearest[e] = e if count[e] else nearest[up]
        header = page.header[e] and not (article[e] or closed and inside[up])
        part[e] = max(part[up], max(page.level[e], header) if held[e] < 0.5 * held[0] else 0)
    first, last = np.flatnonzero(chosen)[[0, -1]]
    # The first and last selected block below each element.
    low, high = np.full(n, len(chosen)), np.full(n, -1)
    np.minimum.at(low, holder[chosen], np.flatnonzero(chosen))
    np.maximum.at(high, holder[chosen], np.flatnonzero(chosen))
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        low[up], high[up] = min(low[up], low[e]), max(high[up], high[e])
    raw = plain >= threshold(plain[chosen], blocks.length[chosen])
    keep = chosen.copy()
    for i in np.flatnonzero(~chosen):
        e = blocks.holder[i]
        if not inside[e] or part[e] == 2 or part[e] == 1 and not raw[i]:
            continue
        among = plainly[e] and low[nearest[e]] < i < high[nearest[e]]  # a list of links between paragraphs of one part
        links = blocks.links[i] and not (closed and (article[e] or among))
        if first < i < last:
            keep[i] = not links  # not a list of links beside the content
        elif i < first:
            keep[i] = page.tag[e] in HEADINGS or closed and not links
        else:
            keep[i] = not links and (closed or page.tag[nearest[e]] not in ("", "html", "body"))
    return keep


def main_text(page: str) -> str:
    """The article's blocks, joined by two line feeds. A page without any part that stands out is taken whole."""
    read = Page(page)
    blocks = Blocks(read)
    if not blocks.texts:
        return ""
    keep = content(read, blocks)
    return "\n\n".join(t for t, k in zip(blocks.texts, keep) if k)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """`pages` with a column `out` for the main text in place of `html`.

    A map without a shuffle; one row for each row. Null and empty pages give an empty text. Long
    pages are read whole. If `pages` has another column named `out`, it is replaced.
    """
    rows = pages.drop(out) if out != html else pages
    held = free_column(rows, "main")
    names = [c for c in rows.columns if c != html]
    rows = rows.select(*names, F.col(html).alias(held))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-1]), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, held):
            texts = pa.array([main_text(p) if p else "" for p in b.column(held).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*names, out])

    return rows.mapInArrow(run, schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable] = {"op10_html_text": op10_html_text}
