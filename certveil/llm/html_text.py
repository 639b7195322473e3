"""Main text of web pages by tree scoring.

The page becomes a tree of elements and a list of blocks (runs of text between block-level tags).
Subtrees that hold no article text are left out first: scripts, styles, menus, headers, footers,
asides, forms and elements whose class, id or role says advert, notice, sidebar, comment and the
like. Words that also name matters of an article (share, related, reply) only say so alone or beside
words for parts of a page; of paragraphs, headings, quotes and cells only plain words for adverts,
cookies and comments do. Every block of some length then passes points (one, one per comma, one per 100 characters up
to three), discounted by its share of link text, to its element's parent in full and to the
ancestors above by halves. The best container, or the article or main element around it, is kept
together with those siblings that score a fifth of it. Outside an article or main element, lists of
links before the first or after the last scored block are not.

Character references are decoded, white space within a block becomes one space, blocks are joined
in page order by one line feed. Nothing else is dropped or cut.

Defined cases: null and empty pages give the empty text; ties go to the container that opens first;
unclosed tags, comments and scripts end with the page; tags nested to any depth cost no more each; repeated rows and null ids are extracted
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements and the usual words in their class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object title annotation annotation-xml".split())
DROPPED = frozenset("head nav header footer aside form button select dialog menu canvas audio video".split()) | RAW
BLOCK = frozenset(
    "html body main article section div p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption h1 h2 h3 h4 h5 h6 hr address center details summary fieldset hgroup search".split()
) | (DROPPED - RAW)
KEPT = frozenset("html body main article".split())
UNWANTED = frozenset(
    "ad ads advert adverts advertisement adsbygoogle breadcrumb breadcrumbs cookie cookies footer header masthead menu nav navbar navigation newsletter pager pagination popup promoted sidebar signup sponsored subscribe subscription comments commentlist disqus".split()
)
UNSURE = frozenset("banner comment consent disclaimer login modal notice notices notification promo recommended related replies reply respond share sharing social sponsor toolbar widget".split())
PLAIN = frozenset("ad ads advert adverts advertisement adsbygoogle comment comments cookie cookies sponsored".split())
PARTS = frozenset(
    "area articles bar block bottom box button buttons col column container form global group icons inner item items left line link links list main message messages outer page panel posts primary right row secondary section site slot stories tab thread title top unit wrap wrapper".split()
)
PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figcaption caption dt dd td th".split())
WANTED = frozenset("article body content entry main page post story text".split())
ABSENT = frozenset("has no with without".split())
ROLES = frozenset("banner navigation contentinfo complementary search form alert dialog menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_tag = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_name = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_rest = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_attribute = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_parts = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_blank = re.compile(r"\s+")


def _says_unwanted(tag: str, word: str) -> bool:
    """Whether a class or id names a part of the page that is no article text."""
    parts = [p.lower() for p in _parts.findall(word)]
    if not parts or parts[0] in ABSENT:
        return False
    if tag in PROSE:
        return all(p in PLAIN or p in PARTS for p in parts) and any(p in PLAIN for p in parts)
    if parts[-1] in UNWANTED or "comments" in parts:
        return True
    around = lambda others, names: all(p in PARTS or p in UNWANTED or p in UNSURE or p in names for p in others)
    if parts[-1] in UNSURE and around(parts[:-1], WANTED):
        return True
    return (parts[0] in UNWANTED or parts[0] in UNSURE) and around(parts[1:], ABSENT)


def _unwanted(tag: str, attributes: str) -> bool:
    """Whether an element's tag or attributes say that it holds no article text."""
    if tag in DROPPED:
        return True
    if not attributes or tag in KEPT:
        return False
    for name, a, b, c in _attribute.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c)
        if name in ("class", "id"):
            if any(_says_unwanted(tag, word) for word in value.split()):
                return True
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Tree:
    def __init__(self) -> None:
        self.tag, self.parent, self.gone = ["#page"], [-1], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of link text
        self.open = [0]
        self.count: Counter[str] = Counter()  # open elements by tag
        self.buffer: list[str] = []
        self.linked = 0
        self.links = 0  # open a elements

    def flush(self) -> None:
        if self.buffer:
            text = _blank.sub(" ", html.unescape("".join(self.buffer))).strip()
            if text:
                self.blocks.append((self.open[-1], text, min(self.linked, len(text))))
            self.buffer, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            self.close_implied(tag)
        gone = self.gone[self.open[-1]] or _unwanted(tag, attributes)
        if tag in VOID:
            if tag in ("br", "img", "input", "hr", "wbr"):
                self.buffer.append(" " if tag != "wbr" else "")
            return
        if tag in BLOCK or gone:
            self.tag.append(tag)
            self.parent.append(self.open[-1])
            self.gone.append(gone)
            self.open.append(len(self.tag) - 1)
            self.count[tag] += 1
        elif tag == "a":
            self.links += 1

    def close_implied(self, tag: str) -> None:
        ends = CLOSES.get(tag, set())
        if not self.count["p"] and not any(self.count[e] for e in ends):
            return
        for k in range(len(self.open) - 1, 0, -1):
            here = self.tag[self.open[k]]
            if here == "p" or here in ends:
                self.cut(k)
                if here in ends and here != "td" and here != "th":
                    return
            elif here in BLOCK:
                return

    def cut(self, k: int) -> None:
        self.flush()
        self.close(k)
        self.links = 0

    def close(self, k: int) -> None:
        self.count.subtract(self.tag[e] for e in self.open[k:])
        del self.open[k:]

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
            return
        for k in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
            if self.tag[self.open[k]] == tag:
                if tag in BLOCK:
                    self.cut(k)
                else:  # a script or the like does not part the words around it
                    self.close(k)
                return
            if tag not in BLOCK and self.tag[self.open[k]] in BLOCK:
                return
        if tag in BLOCK:
            self.flush()

    def text(self, part: str) -> None:
        if self.gone[self.open[-1]]:
            return
        self.buffer.append(part)
        if self.links:
            self.linked += len(part.strip())


def _parsed(page: str) -> _Tree:
    tree, at, n = _Tree(), 0, len(page)
    lower = None
    while at < n:
        m = _tag.search(page, at)
        if not m:
            tree.text(page[at:])
            break
        i = m.start()
        if i > at:
            tree.text(page[at:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
            continue
        if page[i + 1] in "!?":
            end = page.find(">", i)
            at = n if end < 0 else end + 1
            continue
        name = _name.match(page, i + 1)
        tag = name[1].lower()
        rest = _rest.match(page, name.end())
        if rest:
            at = rest.end()
        else:
            end = page.find(">", name.end())
            at = n if end < 0 else end + 1
        if page[i + 1] == "/":
            tree.end(tag)
            continue
        tree.start(tag, page[name.end() : at - 1])
        if tag in RAW:  # its content is no markup
            lower = page.lower() if lower is None and len(page.lower()) == n else (lower or page)
            end = lower.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = n if close < 0 else close + 1
            tree.end(tag)
    tree.flush()
    return tree


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = _parsed(page)
    if not tree.blocks:
        return ""
    parent, count = tree.parent, len(tree.tag)
    score, chars, linked, lists = [0.0] * count, [0] * count, [0] * count, [0] * count
    scored = []  # the blocks that pass points
    for k, (element, text, links) in enumerate(tree.blocks):
        chars[element] += len(text)
        linked[element] += links
        lists[element] += links > 0
        if len(text) >= 25:
            points = (1 + text.count(",") + min(3, len(text) / 100)) * (1 - links / len(text))
            if points > 0.5:
                scored.append(k)
            e = parent[element] if tree.tag[element] not in ("div", "section", "article", "main", "body", "#page") else element
            while e >= 0 and points > 0.01:
                score[e] += points
                points /= 2
                e = parent[e]
    for e in range(count - 1, 0, -1):  # children come after their parents
        for sums in (chars, linked, lists):
            sums[parent[e]] += sums[e]
    best = max(range(count), key=lambda e: (score[e] * (1 - linked[e] / chars[e]) if chars[e] else 0.0, -e))
    around = best
    while around > 0 and tree.tag[around] not in ("article", "main"):
        around = parent[around]
    top = around if around > 0 else best
    kept = {top}
    if score[best] > 0 and top == best and top > 0:
        kept |= {e for e in range(count) if parent[e] == parent[top] and not tree.gone[e] and score[e] >= 0.2 * score[best]}
    if score[best] <= 0 and around <= 0:
        kept = {0}
    inside, menu = [False] * count, [False] * count
    for e in range(count):  # parents come before their children
        up = parent[e]
        inside[e] = e in kept or up >= 0 and inside[up]
        menu[e] = up >= 0 and menu[up] or tree.tag[e] in ("ul", "ol", "dl", "table") and lists[e] >= 3 and linked[e] > 0.66 * chars[e]
    mine = [k for k in scored if inside[tree.blocks[k][0]]]
    first, last = (mine[0], mine[-1]) if mine and around <= 0 else (0, len(tree.blocks))
    return "\n".join(text for k, (e, text, _) in enumerate(tree.blocks) if inside[e] and not (menu[e] and (k < first or k > last)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
