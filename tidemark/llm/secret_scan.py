"""Secret scans with multipart credential linking.

Base kinds (assign, access, hex) are reported wherever they match. Weak candidates - a short assigned secret, a named
account, an endpoint - mean little alone; an interval join links them within scopes: a candidate's interval is its whole
paragraph (a scope ends at a blank line), and it is reported only where parts that complement it lie in that interval. find()
and linked_spans() also take a reach in code points to both sides, REACH by default; the columns are scanned without one.
What complements what: a weak secret needs an identifier, an account needs a secret, an endpoint needs both.
Base spans count as parts: an access id as an identifier, assigned and hex values as secrets.

Defined results: null and empty texts have no spans; texts of any length are scanned whole, a paragraph of any length is one
scope; spans that begin together are ordered by kind, then end; equal rows give equal spans; nested spans of several kinds are all
reported; an empty table gives an empty result; further columns are ignored by the scan and kept by redacted().
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, session

REACH = 300
KINDS = ("assign", "access", "hex", "account", "weak", "endpoint")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Fixed values of the base kinds: keywords, value alphabet and least lengths.
_ASSIGN = re.compile("(?:%s)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))))
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

_ACCOUNT = re.compile("(?<![A-Za-z0-9])(?:%s)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@+-]{2,64})" % "|".join(map(_either, ("username", "user", "login", "account", "client_?id", "access_?key_?id"))))
_WEAK = re.compile("(?<![A-Za-z0-9])(?:%s)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]{4,})" % "|".join(map(_either, ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_?key", "auth", "credential"))))
_ENDPOINT = re.compile("[a-z][a-z0-9+.-]{1,15}://[^\\s\"'<>]+")
_SCOPE = re.compile("\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping within a kind."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


def _meets(sorted_starts: list[int], ends: list[int], low: int, high: int) -> bool:
    """Whether any of the spans (sorted, of one kind of part) overlaps low..high; their ends rise with their starts."""
    i = bisect_left(ends, low + 1)
    return i < len(sorted_starts) and sorted_starts[i] < high


def linked_spans(text: str, base: list[tuple[int, str, int]], reach: int | None = REACH) -> list[tuple[int, str, int]]:
    """The weak candidates with their complements in reach (None: anywhere) within the scope."""
    covered = sorted((s, e) for s, _, e in base)
    starts, ends = [s for s, _ in covered], [e for _, e in covered]
    high = 0
    for i, e in enumerate(ends):
        ends[i] = high = max(high, e)
    free = lambda s, e: not _meets(starts, ends, s, e)
    accounts = [(m.start(), m.end()) for m in _ACCOUNT.finditer(text) if free(m.start(), m.end())]
    points = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    weak = [(m.start(), m.end()) for m in _WEAK.finditer(text) if free(m.start(), m.end())]
    if not (accounts or points or weak):
        return []
    ids = sorted(accounts + [(s, e) for s, k, e in base if k == "access"])
    secrets = sorted(weak + [(s, e) for s, k, e in base if k != "access"])
    if not secrets or not (ids or points):
        return []

    def parts(spans):
        a, b, top = [s for s, _ in spans], [], 0
        for _, e in spans:
            top = max(top, e)
            b.append(top)
        return a, b

    ids_at, secrets_at = parts(ids), parts(secrets)
    walls = [0, *(m.end() for m in _SCOPE.finditer(text)), len(text) + 1]

    def near(s, e, other):
        k = bisect_left(walls, s + 1)
        return _meets(*other, max(s - reach, walls[k - 1]), min(e + reach, walls[k]))

    reach = len(text) if reach is None else reach
    out = [(s, "account", e) for s, e in accounts if near(s, e, secrets_at)]
    out += [(s, "weak", e) for s, e in weak if near(s, e, ids_at)]
    return out + [(s, "endpoint", e) for s, e in points if near(s, e, ids_at) and near(s, e, secrets_at)]


def find(text: str | None, reach: int | None = REACH) -> list[tuple[int, str, int]]:
    """All spans of a text by start, then kind as in KINDS."""
    base = base_spans(text or "")
    return sorted(base + linked_spans(text or "", base, reach), key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points by start."""
    session(docs)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, k, e in find(t, reach)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, mark: str = "[SECRET]", reach: int | None = None) -> DataFrame:
    """The documents with every span replaced by `mark`, overlapping spans by one; null texts stay null, n_chars follows."""
    session(docs)
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text):
        spans = find(text, reach)
        if not spans:
            return text
        out, done = [], 0
        for s, _, e in spans:
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if length is not None:
                n = [b if t is None or t == u else len(t) for t, u, b in zip(new, old, batch.column(length).to_pylist())]
                batch = batch.set_column(length, batch.schema.field(length), pa.array(n, batch.schema.field(length).type))
            yield batch

    return map_rows(docs, run)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    r = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return r.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
