"""HTML extraction: flat text blocks with word count and link density of their neighbours, judged by a decision tree.

A page is read once, tag by tag. Text between two block tags is a block, whatever inline tags it has; scripts, styles, head and other
parts that show no text are skipped. A block's features are its words and link density (share of words inside links), those
of the block before and after, and what its open elements say: names, classes and ids that speak of page furniture or of
content, headings, list items. A decision tree (Gini, grown here in numpy) is fitted on LABELLED, a small table of pages written
for it, and decides on each block. Good blocks in page order are the text.

Odd rows: null and empty html give an empty text; pages of any length are read whole, in time that grows with their length; tags and
entities that the end cuts off are closed there; unknown tags are inline; rows that repeat, page_id included, are pages each; an
empty table gives no row. Columns other than page_id, url and html are left behind.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session

# Fixed values of the format: tags that divide blocks, that hold no text of the page, and that have no end tag.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("applet audio button canvas datalist embed head iframe map math meter noembed noframes noscript object progress script select style svg template textarea title video".split())
RAW_TAGS = frozenset("iframe noembed noframes noscript script style textarea title".split())
VOID_TAGS = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements that a new one of these closes: it can't lie in an open one of the same kind.
CLOSES_OWN = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "optgroup": "optgroup option"}
CLOSES_P = BLOCK_TAGS - {"html", "body", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}

#: What names of tags, classes, ids and roles say, by whole words of them.
FURNITURE = frozenset("ad ads adv advert advertisement adverts advertising aside author-box banner bar bio breadcrumb breadcrumbs byline comment commentlist comments consent contentinfo cookie cookies copyright dialog discussion disqus feedback footer form gdpr header inpage login masthead menu meta modal nav navbar navigation newsletter notice notices pager pagination popup popular promo promoted recommended related replies reply respond rail search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar trending widget widgets".split())
CONTENT = frozenset("article articlebody body-text content entry main maincontent post postcontent story text".split())

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_NAMES = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_]\S+", re.I)  # says what lies beside, as in has-sidebar

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "content", "heading", "item")


@lru_cache(4096)
def _said(tag: str, names: str) -> tuple[int, int]:
    """Whether an element speaks of furniture, and of content."""
    names = _LAYOUT.sub(" ", names)
    words = set(names.lower().split()) | {w.lower() for w in _WORDS.findall(names)}
    return int(tag in ("nav", "footer", "header", "aside", "form", "menu", "dialog", "search") or not FURNITURE.isdisjoint(words)), int(tag in ("article", "main") or not CONTENT.isdisjoint(words))


def blocks(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """Text, words, words in links, furniture, content, heading and item (1 or 0 each) of every block of text."""
    found: list = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int, int]] = []  # open elements: tag, furniture, content
    open_count: dict[str, int] = {}
    furniture = content = 0
    quoted = True  # until a quote is found open at the end

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                heading = any(open_count.get(h) for h in ("h1", "h2", "h3", "h4", "h5", "h6"))
                item = any(open_count.get(x) for x in ("li", "td", "th", "dt", "dd"))
                n = text.count(" ") + 1
                found.append((text, n, min(linked, n), int(furniture > 0), int(content > 0), int(heading), int(item)))
        linked = 0

    def say(text: str):
        nonlocal linked
        text = entities.unescape(text)
        parts.append(text)
        if open_count.get("a"):
            linked += len(text.split())

    def pop():
        nonlocal furniture, content
        tag, f, c = stack.pop()
        open_count[tag] -= 1
        furniture -= f
        content -= c

    def close(tags, until=()):
        """Close the innermost open element of these tags, unless one of `until` is opened within it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in until:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end() - 2)
            at = size if end < 0 else end + 3
            continue
        rest = _REST.match(page, m.end()) if quoted and m[2] else None
        quoted = quoted and not (m[2] and rest is None)
        end = rest.end() if rest else page.find(">", m.end()) + 1
        if not end:
            break
        at, tag = end, (m[2] or "").lower()
        if not tag:
            continue
        if tag in HIDDEN_TAGS and not m[1]:
            if page[end - 2] != "/" or tag not in ("svg", "math"):
                at = _after(page, end, tag)
            continue
        divides = tag in BLOCK_TAGS
        if divides:
            flush()
        elif tag == "br" or tag == "img":
            parts.append(" ")
        if m[1]:
            if open_count.get(tag):
                close((tag,), () if divides else BLOCK_TAGS)
        elif tag not in VOID_TAGS:
            if tag in CLOSES_P and open_count.get("p"):
                close(("p",), ("td", "th", "li", "table", "button"))
            if tag in CLOSES_OWN and any(open_count.get(t) for t in CLOSES_OWN[tag].split()):
                close(tuple(CLOSES_OWN[tag].split()), ("ul", "ol", "table", "dl", "select"))
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(page[m.end() : end - 1])) if end - m.end() > 1 else ""
            f, c = (0, 0) if tag in ("body", "html") else _said("div" if tag == "header" and open_count.get("article") else tag, names)
            stack.append((tag, f, c))
            open_count[tag] = open_count.get(tag, 0) + 1
            furniture += f
            content += c
    flush()
    return found


@lru_cache(64)
def _ending(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>?", re.I)


def _after(page: str, at: int, tag: str) -> int:
    """Where the hidden element that began before `at` ends; those of other than raw text may lie in each other."""
    depth, size = 1, len(page)
    while True:
        m = _ending(tag).search(page, at)
        if m is None:
            return size if tag in RAW_TAGS or tag == "head" else at
        at = m.end()
        depth += -1 if m[1] else int(tag not in RAW_TAGS)
        if not depth:
            return at


def features(found: list) -> np.ndarray:
    """A row of FEATURES per block; beyond the page's ends there are no words and no links."""
    own = np.array([b[1:] for b in found], np.float64).reshape(-1, 6)
    density = own[:, 1] / np.maximum(own[:, 0], 1)
    out = np.zeros((len(found), len(FEATURES)))
    out[:, 0], out[:, 1] = own[:, 0], density
    out[1:, 2], out[1:, 3] = own[:-1, 0], density[:-1]
    out[:-1, 4], out[:-1, 5] = own[1:, 0], density[1:]
    out[:, 6:] = own[:, 2:]
    return out


def _gini(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    share = ones / np.maximum(n, 1)
    return 2 * n * share * (1 - share)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """A decision tree: (feature, limit, tree for values up to the limit, tree for others), or the label of a leaf."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = (_gini(np.array([y.sum()]), np.array([len(y)]))[0] - 1e-9, None, None)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])[:-1]
        n = np.arange(1, len(y))
        cost = _gini(ones, n) + _gini(y.sum() - ones, len(y) - n)
        cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        i = int(np.argmin(cost))
        if cost[i] < best[0] - 1e-9:
            best = (cost[i], j, (v[i] + v[i + 1]) / 2)
    if best[1] is None:
        return int(2 * y.sum() >= len(y))
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


def judge(tree, x: np.ndarray) -> np.ndarray:
    """The tree's label of every row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    out, left = np.empty(len(x), np.int64), x[:, tree[0]] <= tree[1]
    out[left], out[~left] = judge(tree[2], x[left]), judge(tree[3], x[~left])
    return out


def _w(n: int) -> str:
    """A text of n words."""
    return " ".join(["word"] * n)


def _menu(n: int, words: int = 1) -> str:
    return "<ul>" + f"<li><a>{_w(words)}</a></li>" * n + "</ul>"


#: Labelled pages: parts in page order, each with 1 if its blocks are main text. Words stand for any words: only counts and links matter.
LABELLED = (
    ((0, f"<nav>{_menu(6)}</nav>"), (0, f"<div class='ad'>{_w(9)}</div>"), (1, f"<article><h1>{_w(10)}</h1><p>{_w(60)}<p>{_w(3)}<p>{_w(90)}<p>{_w(1)}<p>{_w(25)}</article>"), (0, f"<footer>{_w(9)}</footer>")),
    ((0, f"<div class='menu'>{_menu(4, 2)}</div>"), (1, f"<main><h1>{_w(5)}</h1><p>{_w(40)} <a>{_w(2)}</a></p><ul><li>{_w(12)}</li><li>{_w(4)}</li></ul><blockquote>{_w(20)}</blockquote></main>"), (0, f"<aside><h3>{_w(2)}</h3>{_menu(5, 6)}<p>{_w(15)}</p></aside>"), (0, f"<div id='footer'><p>{_w(12)}</p></div>")),
    ((0, f"<header><p>{_w(3)}</p><a>{_w(1)}</a></header>"), (0, f"<div class='cookie-notice'><p>{_w(30)}</p></div>"), (1, f"<div class='content'><h2>{_w(8)}</h2><p>{_w(120)}</p><p>{_w(2)}</p><table><tr><td>{_w(2)}</td><td>{_w(1)}</td></tr></table></div>"), (0, f"<div id='comments'><h3>{_w(1)}</h3><p>{_w(50)}</p><p>{_w(8)}</p></div>")),
    ((0, f"<p><a>{_w(2)}</a> <a>{_w(2)}</a> <a>{_w(1)}</a></p>"), (1, f"<h1>{_w(7)}</h1><p>{_w(70)}</p><p>{_w(45)} <a>{_w(4)}</a></p><p>{_w(30)}</p>"), (0, f"<p><a>{_w(6)}</a></p><p><a>{_w(8)}</a></p>"), (0, f"<form><p>{_w(11)}</p><label>{_w(2)}</label></form>")),
    ((0, f"<div>{_menu(8)}</div>"), (1, f"<div><h2>{_w(6)}</h2><p>{_w(35)}</p><p>{_w(16)}</p><p>{_w(80)}</p></div>"), (0, f"<div class='related'><h4>{_w(2)}</h4>{_menu(3, 9)}</div>"), (0, f"<div>{_w(6)}</div>")),
    ((0, f"<div class='sponsored'>{_w(40)}</div>"), (1, f"<article><p>{_w(1)}</p></article>"), (0, f"<section class='comments'><ul><li>{_w(22)}</li><li>{_w(70)}</li></ul></section>"), (0, f"<footer><p><a>{_w(1)}</a></p><p>{_w(25)}</p></footer>")),
    ((0, f"<header><h1>{_w(4)}</h1><nav>{_menu(3)}</nav></header>"), (1, f"<article><h1>{_w(9)}</h1><p>{_w(55)}</p></article>"), (0, f"<article><div class='share'>{_w(5)}</div></article>"), (1, f"<article><p>{_w(33)}</p><h2>{_w(3)}</h2><ol><li>{_w(6)}</li><li>{_w(18)} <a>{_w(1)}</a></li></ol></article>"), (0, f"<article><div class='ad'>{_w(28)}</div></article>"), (1, f"<article><p>{_w(64)}</p></article>"), (0, f"<div class='newsletter'><h3>{_w(4)}</h3><p>{_w(26)}</p></div>")),
    ((0, f"<div>{_w(2)}</div><div>{_w(3)}</div>"), (1, f"<p>{_w(50)}</p><p>{_w(12)}</p><p>{_w(41)}</p>"), (0, f"<div>{_w(4)}</div>"), (0, f"<div><a>{_w(3)}</a></div>")),
    ((0, f"<div class='breadcrumbs'><a>{_w(1)}</a> <a>{_w(2)}</a></div>"), (1, f"<div class='post'><p>{_w(2)}</p><p>{_w(4)}</p><p>{_w(3)}</p></div>"), (0, f"<div class='reply'><p>{_w(14)}</p></div>")),
    ((1, f"<article><p>{_w(15)}<a>{_w(15)}</a></p><p><a>{_w(1)}</a></p><p>{_w(20)}</p></article>"), (0, f"<aside>{_w(18)}</aside>")),
)


def training() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of every block of the labelled pages."""
    xs, ys = [], []
    for page in LABELLED:
        found = blocks("".join(part for _, part in page))
        xs.append(features(found))
        ys += [label for label, part in page for _ in blocks(part)]
    return np.concatenate(xs), np.array(ys)


@lru_cache(1)
def fitted():
    return grow(*training())


def main_text(page: str, tree) -> str:
    """The good blocks of a page."""
    found = blocks(page)
    if not found:
        return ""
    good = judge(tree, features(found))
    return "\n\n".join(b[0] for b, g in zip(found, good.tolist()) if g)


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """page_id, url, text (main text, empty if none) and n_chars (its code points) of every page."""
    session(pages)
    tree = fitted() if tree is None else tree

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "", tree) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The given pages say where their article is; blocks there are what lies between tags of blocks.
OP12_SQL = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
  b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1|h2|h3|div|ul|li|ol|blockquote|section)(?:\s[^>]*)?>'), lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(x, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g'))) AS bs FROM a),
  c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(bs, lambda x: regexp_replace(x, '&amp;?', '&', 'g')), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
  SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c"""
