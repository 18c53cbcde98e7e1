"""Lexical search, HTML extraction and the prefix trie against plain versions, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import html_extraction, lexical_search, prefix_trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    """(item, rank, doc_id, score) by scoring every document for every item."""
    held = [(i, Counter(plain_terms(t))) for i, t in docs if plain_terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(plain_terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc_id, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["The", "ÉTÉ", "été", "x1y", "ß"]
    text = lambda n: " ".join(r.choices(words, weights=[1 + 200 // (i + 1) for i in range(len(words))], k=n))
    same = text(30)
    docs = [(i * 5, text(r.randint(1, 60))) for i in range(300)] + [(7, same), (3, same), (-4, same), (3, same), (None, same), (None, text(20))]
    docs += [(10_001, None), (10_002, ""), (10_003, " ...\n"), (10_004, text(40_000)), (10_005, "w39" * 3)] + [(20_000 + i, "w1 w1 w2") for i in range(200)]
    items = [(i, text(12)) for i in range(15)] + [(50, None), (51, ""), (52, "absent"), (53, "w1 w1 w1 w2"), (53, "w3"), (None, "été W5"), (54, same)]
    return docs, items


def test_search_equals_scoring_all(spark, texts):
    docs, items = texts
    frame = spark.createDataFrame([(i, t, 1, "b", 2, 3) for i, t in docs], "doc_id long, text string, n long, body string, terms int, window int").repartition(5)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id int, text string, score int")
    want = plain_search(docs, items)
    for window, size in ((4096, 1 << 24), (64, 1 << 24), (7, 100)):  # the last reads the queries in several blocks
        assert rows(lexical_search.search(frame, asked, window=window, query_bytes=size)) == want


def test_search_of_nothing(spark, texts):
    docs, items = texts
    no_docs = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert lexical_search.search(no_docs, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert lexical_search.search(frame, no_items).collect() == []


PAGES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple words of a page that has no tag at all but enough of them to be a paragraph of its own, so they are kept whole here", None),
    ("<title>t</title><script>var a = '<p>no</p>';</script><nav><a href='/'>Home</a></nav><article><h1>A &lt;b&gt;</h1><p>one\n two&nbsp;three<p>four <b>five</b><br>six</article><footer>f</footer>", "A <b>\n\none two three\n\nfour five six"),
    ("<article><p>before<!-- <p>hidden</p> --> after<style>p{}</style></p><div class='comments'><p>reader</p></div><p>last", "before after\n\nlast"),
    ("<div class=\"cookie-notice\">We use cookies</div><main><p title='a > b'>text &eacute;&#233;&#xe9; &am</p><form><input value='x'>Name <button>Go</button></form></main>", "text ééé &am"),
    ("<article><p>unclosed comment<!-- all of the rest", "unclosed comment"),
    ("<article><p>cut tag <a href='x", "cut tag"),
    ("<article><p>if a < b then</p><svg><text>no</text></svg><aside><p>side</p></aside></article>", "if a < b then"),
    ("<body class='has-sidebar'><article><header><h1>Title</h1></header><ul><li>item one<li>item two</ul></article>", "Title\n\nitem one\n\nitem two"),
]


def test_html_pages(spark):
    frame = spark.createDataFrame([(i, f"u{i}", h, "t", 5) for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[3][0], None, None)] * 2, "page_id long, url string, html string, text string, n_chars int")
    got = html_extraction.extract(frame.repartition(3)).collect()
    assert len(got) == len(PAGES) + 2 and all(r.n_chars == len(r.text) for r in got)
    for r in got:
        page, want = PAGES[3 if r.page_id is None else r.page_id]
        assert r.text == (" ".join(page.replace("&amp;", "&").split()) if want is None else want), page
    assert html_extraction.extract(frame.limit(0)).collect() == []


def test_html_time_grows_with_length():
    """Pages of a million characters made to be reread: open comments, quotes, tags and scripts."""
    for part in ("<!-- ", "<a '", "<p><b>", "<div>", "<script>", "<li>", "&amp", "< ", "</p>", "<svg>"):
        html_extraction.main_text("<article><p>kept</p>" + part * (1_000_000 // len(part)), html_extraction.fitted())
    long = "<article><p>" + "word " * 500_000 + "</article>"
    assert len(html_extraction.main_text(long, html_extraction.fitted())) == 2_499_999


def test_tree():
    x, y = html_extraction.training()
    assert 80 <= len(y) <= 200 and (html_extraction.judge(html_extraction.fitted(), x) == y).mean() > 0.97
    r = np.random.default_rng(1)
    z = r.normal(size=(500, 3))
    truth = ((z[:, 0] > 0.3) & (z[:, 2] < 0.1)).astype(int)
    assert (html_extraction.judge(html_extraction.grow(z, truth), z) == truth).mean() > 0.99
    assert html_extraction.grow(z, np.zeros(500, int)) == 0


def plain_trie(turns):
    """Every node of the trie, by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()
    return sorted(((v[0], len(k), members[k[:-1]][0] if k else None, len(v), kids[k], leaves[k], saved[k], sha(k)) for k, v in members.items()), key=repr)


def conversations(kind):
    r = random.Random(kind)
    said = ["", "a", "b", "long " * 300, "é" * 5]
    if kind == 0:  # shallow and dense: most nodes are shared
        return [(c, t, r.choice(["user", None]), r.choice(said)) for c in range(250) for t in range(r.randint(1, 5))]
    if kind == 1:  # deep copies, ties, repeats, nulls, and turns out of order
        base = [(t, "user", r.choice(said)) for t in range(30)]
        out = [(100 + c, *x) for c in range(60) for x in base[: r.choice([30, 30, 12, 7])]]
        out += [(5, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "user", "a"), (None, 0, "user", "lost"), (-150, 0, "user", "n"), (-101, 2, "user", "m"), (300, 1, None, "a")]
        r.shuffle(out)
        return out
    return [(c, 0, "user", "same") for c in range(1, 90)]  # one turn of all, none where the first is taken over


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_trie_equals_dictionaries(spark, kind):
    turns = conversations(kind)
    frame = spark.createDataFrame([(*x, "c", 3) for x in turns], "conv_id long, turn int, role string, text string, block string, depth int").repartition(4)
    want = plain_trie(turns)
    for size in (3, 40, 100_000):
        assert rows(prefix_trie.prefix_trie(frame, rows=size)) == want, size


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect() == []


def test_nearest_smaller():
    r = random.Random(2)
    v = [r.randint(0, 9) for _ in range(300)]
    assert prefix_trie.nearest_smaller(v) == [next((j for j in range(i + 1, 300) if v[j] < v[i]), 300) for i in range(300)]
    assert prefix_trie._left_smaller(v) == [next((j for j in range(i - 1, -1, -1) if v[j] < v[i]), -1) for i in range(300)]
