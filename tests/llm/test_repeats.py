"""Substring and suffix-array dedup against brute force, on small windows and whole fixtures."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm.substring_dedup import op3_substring_dedup, substring_dedup
from tidemark.llm.suffix_dedup import op4_suffix_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, rid string, h long"


def brute_words(rows, window):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, b in texts:
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]] = seen.get(b[i : i + window], 0) + 1
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, alphabet, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(alphabet) for _ in range(r.randint(1, 3)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [r.choice(shared) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 4))]
        rows.append((r.randint(0, 40) if r.random() < 0.3 else 100 + i, r.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(None, rows[0][1]), (7, None), (8, ""), (9, "ab" * 300), (10, "ab" * 300 + "c"), (11, "a " * 200), (12, " \x00\x00 " * 30), (13, "\x00" * 70), (rows[3][0], rows[3][1])]
    return rows


@pytest.mark.parametrize("seed,alphabet", [(1, "ab"), (2, "abcdéß中"), (3, "a\x00b")])
def test_small_windows(spark, seed, alphabet):
    rows = corpus(seed, alphabet)
    df = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA)
    got = [tuple(x) for x in substring_dedup(df, 12, 4, 300).selectExpr("doc_id", "n_units", "n_removed", "coalesce(sha2(kept, 256), sha)").collect()]
    assert sorted(got, key=str) == brute_words(rows, 12)
    got = [tuple(x) for x in suffix_dedup(df, 40, 16, 2000).selectExpr("doc_id", "n_units", "n_removed", "n_spans", "coalesce(sha2(kept, 256), sha)").collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 40)


@pytest.mark.parametrize("most", [2, 10])
def test_hot_anchors(spark, most):
    # one passage, a little longer or shorter than a window, with other surroundings in every row; near copies of one text
    r = random.Random(most)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    line, short, base = text(15), text(11), text(60)
    rows = []
    for i in range(60):
        edited = list(base)
        edited[r.randrange(60)] = word() + "x"
        rows.append((i, " ".join([*text(r.randint(0, 9)), *r.choice([line, short, edited, edited[20:], line + line]), *text(r.randint(0, 9))])))
    rows += [(99, rows[5][1]), (99, rows[6][1]), (None, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in substring_dedup(df, 12, 4, 300, most).selectExpr("doc_id", "n_units", "n_removed", "coalesce(sha2(kept, 256), sha)").collect()]
    assert sorted(got, key=str) == brute_words(rows, 12)
    got = [tuple(x) for x in suffix_dedup(df, 40, 16, 2000, most).selectExpr("doc_id", "n_units", "n_removed", "n_spans", "coalesce(sha2(kept, 256), sha)").collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 40)


def test_a_key_is_bounded(spark, monkeypatch):
    """With one passage in all rows, no shard gets more texts of a key than allowed."""
    from tidemark.llm import repeats, suffix_dedup

    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    common = noise(38)
    rows = [(i, noise(30) + common + noise(30)) for i in range(300)] + [(i, noise(30) + common + "tail" + noise(30)) for i in range(300, 330)]
    seen = spark.sparkContext.accumulator(0)

    def build(chunks):
        per = {}
        for x in chunks:
            per[x.h] = per.get(x.h, 0) + 1
        if max(per.values()) > 20:
            seen.add(1)
        return suffix_dedup.judge(chunks, 40)

    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.removed(df, repeats.Units(False, 40, 16), build, suffix_dedup.goes, True, 4000, "bounded", 20)
    got = [tuple(x) for x in out.selectExpr("doc_id", "n_units", "n_removed", "n_spans", "coalesce(sha2(kept, 256), sha)").collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 40) and seen.value == 0 and sum(x[2] for x in got) > 0


def test_index_alone_decides(spark):
    """Nothing goes if the index says nothing, exact copies included."""
    from tidemark.llm import repeats, substring_dedup, suffix_dedup

    df = spark.createDataFrame([(x[0], x[1]) for x in corpus(1, "ab")], "doc_id long, text string")
    for units, goes, same in ((repeats.Units(True, 12, 4), substring_dedup.goes, False), (repeats.Units(False, 40, 16), suffix_dedup.goes, True)):
        out = repeats.removed(df, units, lambda chunks: [None] * len(chunks), goes, same, 2000, "muted")
        assert out.agg({"n_removed": "sum"}).first()[0] == 0


def test_columns_against_sorted_suffixes(tmp_path):
    """Order and common prefixes of every round against sorting, with the files in a folder and in memory."""
    from tidemark.llm import suffix_dedup

    r = random.Random(8)
    texts = [bytes(r.choice(b"ab") for _ in range(30)) for _ in range(40)]
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for folder in (str(tmp_path), None):
        with suffix_dedup.Columns(folder) as columns:
            columns.write(np.arange(40), np.zeros(40))
            for place in range(29, -1, -1):
                order, common = columns.read()
                order, common = suffix_dedup.insert(order, common, np.array([texts[i][place] for i in order], np.uint8), 25)
                columns.write(order, common)
                got = [texts[i][place:] for i in order]
                assert got == sorted(got)
                assert common.tolist() == [0, *(min(25, share(a, b)) for a, b in zip(got, got[1:]))]
                stays = np.array([r.random() < 0.5 for _ in order])
                some, shared = suffix_dedup.without(order, common, stays)
                assert shared[1:].tolist() == [min(25, share(texts[a][place:], texts[b][place:])) for a, b in zip(some, some[1:])]
        assert not list(tmp_path.iterdir())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(df).count() == 0 and suffix_dedup(df).count() == 0


def test_long_texts_in_blocks(spark, monkeypatch):
    import tidemark.llm.repeats as r

    text = " ".join(str(i) for i in range(4000))
    rows = [(1, text), (2, "x " + text[5000:9000] + " y")]
    whole = r.anchors(text.encode(), r.Units(True, 50, 20))
    monkeypatch.setattr(r, "BLOCK", 3000)
    parts = r._scan_one(text.encode(), r.Units(True, 50, 20))
    assert set(whole[0].tolist()) == set(parts[0].tolist())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in substring_dedup(df).selectExpr("doc_id", "n_units", "n_removed", "coalesce(sha2(kept, 256), sha)").collect()]
    assert sorted(got, key=str) == brute_words(rows, 50)


def test_queries_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted([tuple(x) for x in op3_substring_dedup(spark, sf).collect()], key=str) == brute_words(rows, 50)
    assert sorted([tuple(x) for x in op4_suffix_dedup(spark, sf).collect()], key=str) == brute_bytes(rows, 400)
