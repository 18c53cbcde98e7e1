"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

A window is 50 consecutive words. Each word that lies in a window whose word sequence also starts in a document with a
smaller doc_id goes; windows are judged on the input. Candidate chunks (see repeats.py) meet in shards of bounded size. In
a shard, texts come in order of the first document that has them: each is streamed through the automaton of those before
it, and then joins the references. Its matching statistics (longest suffix that the references contain, cut to the window's
length) tell the covered windows, and the automaton's state the earliest document of each. A document that has the text
loses the windows whose earliest document is before it, so exact copies too go only by what the automaton says. The
automaton goes to the tasks of its own shard only: sent to every task, automata of all shards would grow with the corpus.

Defined results: null text has no words; empty text, a text under 50 words or an unrepeated one loses nothing; a row
with null doc_id neither loses words nor is a reference; rows that share a doc_id don't count against each other, so of
exact copies with one doc_id all stay; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import MOST_CHUNKS, Chunk, Units, removed

WINDOW, GRAM = 50, 20
#: Words of distinct candidate text in a shard, about.
SHARD_WORDS = 60_000
#: A window that no reference has.
NOBODY = (1 << 63) - 1


class SuffixAutomaton:
    """Online suffix automaton over words; a state knows the document that brought its strings first."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.doc = [None]
        self.last = 0

    def _state(self, length: int, after: dict, doc) -> int:
        self.next.append(after)
        self.link.append(0)
        self.length.append(length)
        self.doc.append(doc)
        return len(self.next) - 1

    def extend(self, words, doc) -> None:
        """Append words; doc: their document, never smaller than those before."""
        after, link, length = self.next, self.link, self.length
        for w in words:
            p, cur = self.last, self._state(length[self.last] + 1, {}, doc)
            while p >= 0 and w not in after[p]:
                after[p][w] = cur
                p = link[p]
            if p >= 0:
                q = after[p][w]
                if length[p] + 1 != length[q]:
                    clone = self._state(length[p] + 1, dict(after[q]), self.doc[q])
                    link[clone] = link[q]
                    link[q] = clone
                    while p >= 0 and after[p].get(w) == q:
                        after[p][w] = clone
                        p = link[p]
                    q = clone
                link[cur] = q
            self.last = cur

    def windows(self, words, size: int) -> list:
        """For each window of `size` words, the first document that has it, or False."""
        after, link, length, doc = self.next, self.link, self.length, self.doc
        state, matched, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in after[state]:
                state = link[state]
                matched = length[state]
            if w in after[state]:
                state = after[state][w]
                matched += 1
            if matched >= size:
                while length[link[state]] >= size:
                    state = link[state]
                matched = size
            if i + 1 >= size:
                out.append(doc[state] if matched >= size else False)
        return out


def judge(chunks: list[Chunk], window: int = WINDOW) -> list[bytes | None]:
    """For each chunk, the first document of every window, as runs; None where no copy of it loses a word.

    A text that the references do not wholly contain joins them and is streamed again, so that every window's document,
    its own included, is what the automaton says.
    """
    references, out = SuffixAutomaton(), []
    for number, chunk in enumerate(chunks):
        words = chunk.body.split(b" ")
        first = references.windows(words, window)
        if not all(d is not False for d in first):
            references.extend(words, chunk.d0)
            references.extend([number], chunk.d0)  # a word that no text has: no match passes from one text to the next
            if chunk.copies > 1 or any(d is not False for d in first):
                first = references.windows(words, window)
            else:
                first = []
        out.append(runs(first) if chunk.copies > 1 or any(d < chunk.d0 for d in first) else None)
    return out


def runs(first: list[int]) -> bytes:
    """Ends of the runs of equal documents, then these documents, as 64-bit numbers."""
    d = np.array([NOBODY if x is False else x for x in first], "<i8")
    ends = np.flatnonzero(np.concatenate([d[1:] != d[:-1], [True]])) + 1
    return np.concatenate([ends, d[ends - 1]]).astype("<i8").tobytes()


def goes(verdict: bytes, n: int, doc_id: int) -> np.ndarray:
    """Which windows start in a document before this one."""
    ends, first = np.frombuffer(verdict, "<i8").reshape(2, -1)
    return np.repeat(first, np.diff(ends, prepend=0)) < doc_id


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, most: int = MOST_CHUNKS) -> DataFrame:
    """doc_id, n_units (words), n_removed, n_spans, kept (bytes; null where nothing goes), sha (of the whole word sequence)."""
    return removed(docs, Units(True, window, gram), lambda chunks: judge(chunks, window), goes, False, shard_words, "substring", most)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    r = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return r.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.coalesce(F.sha2("kept", 256), "sha").alias("kept_sha256"))
