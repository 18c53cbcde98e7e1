"""Conversation prefix trie: Cartesian trees over the common prefixes of sorted conversations, built in blocks.

Conversations are sequences of turn digests, sorted as byte strings, ties by conv_id, and cut into blocks of adjacent rows (a
range-partitioned sort, so copies in any number are dealt over blocks). With lcp, the number of turns that a row shares with the row
before it, a node of depth d is an interval of rows: it begins at a row with lcp < d <= its length and ends at the next row
with lcp < d, the nearest smaller value. Inside a block a stack finds the nearest smaller values, and with them the nodes of the
Cartesian tree; rows of equal lcp are one node, and the depths between a node and its parent are expanded. What a block cannot
close is closed by block minima: each block gives its share (first rows, all rows or last rows) of the intervals that cross its
border, and the owner of a share is the last block before it that opens that depth, which is the nearest block with a smaller minimum.
Sums, minima and counts over intervals come from prefix sums, a sparse table and the shares' totals.

A turn's digest is the first 16 bytes of SHA-256 of its role's length, role and text. A conversation lies in one row, as a document
does: with its texts until it is digested, then at some 20 bytes a turn.

Odd rows: null roles and texts are empty; turns go by number, nulls first, then by role and text, so repeated rows are turns each.
Rows without a conv_id belong to no conversation. Conversation numbers below zero go to the next hundred towards zero. Texts
of any length are digested whole. An empty table gives no node. Columns other than conv_id, turn, role and text are left behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session, written

DIGEST = 16
#: Rows and bytes of turn digests that a block holds about.
BLOCK_ROWS = 50_000
BLOCK_BYTES = 8 << 20

_SHARE = "block int, kind string, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, parent_kind string, ids string"
_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.string()), *((c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("parent_conv_id", pa.int64()), ("parent_kind", pa.string()), ("ids", pa.string())])
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _digest(turn: Column) -> Column:
    """The digest of a turn (role, text)."""
    return F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(turn["role"]), turn["role"], turn["text"]).cast("binary"), 256)), 1, DIGEST)


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, digests and chars (code points of the texts): a row per conversation, in the order of its turns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    df = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    df = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return df.select("conv_id", F.transform("t", _digest).alias("digests"), F.transform("t", lambda x: F.length(x["text"])).alias("chars"))


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with the first h turns of its group's first one before its own after h; h is crc32(conv_id) mod `most`."""
    base = conversations.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), *(F.slice(c, 1, most - 1).alias(f"_{c}") for c in ("digests", "chars")))
    own = conversations.withColumns({"_of": F.col("conv_id") - F.col("conv_id") % group, "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})
    df = own.join(base, F.col("_of") == F.col("_base"), "left")

    def both(c):
        after = F.when(F.size(c) > F.col("_h"), F.slice(c, F.col("_h") + 1, F.size(c))).otherwise(F.slice(c, 1, 0))
        before = F.when(F.col("_base").isNotNull(), F.slice(f"_{c}", F.lit(1), F.col("_h"))).otherwise(F.slice(c, 1, 0))
        return F.concat(before, after).alias(c)

    return df.select("conv_id", both("digests"), both("chars"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the start on."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


def nearest_smaller(values: list[int]) -> list[int]:
    """For every place the next place with a smaller value, or the length of the list."""
    out, stack = [len(values)] * len(values), []
    for j, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = j
        stack.append(j)
    return out


class _Least:
    """Minima over intervals, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 1 << len(self.rows) <= len(values):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.rows[k][a[of]], self.rows[k][b[of] - (1 << int(k))])
        return out


def block_nodes(block: int, conv: np.ndarray, seqs: list[bytes], chars: list, before: int, after: int) -> dict[str, list]:
    """The nodes that lie in a block of sorted rows, and its shares of those that cross its borders.

    before: lcp of the first row with the row before the block (-1: there is none); after: lcp of the next block's first row.
    Kinds: node; head (opens here, goes on), through (all rows) and tail (first rows) of intervals from blocks before.
    """
    n = len(seqs)
    size = np.array([len(s) // DIGEST for s in seqs], np.int64)
    lcp = [before, *(_common(a, b) for a, b in zip(seqs, seqs[1:]))]
    smaller = nearest_smaller(lcp)
    at = np.array(lcp, np.int64)
    # code points up to each depth, row after row; a row's part begins at base[row]
    base = np.concatenate([[0], np.cumsum(size + 1)])
    upto = np.zeros(base[-1], np.int64)
    for k, c in enumerate(chars):
        np.cumsum(c, out=upto[base[k] + 1 : base[k + 1]])
    shared = np.where(at > 0, upto[base[:-1] + np.maximum(at, 0)], 0)
    sums = np.concatenate([[0], np.cumsum(shared)])
    leaves = np.concatenate([[0], np.cumsum(np.append(at[1:], after) < size)])
    least = _Least(conv)
    # rows that go beyond their lcp, by lcp: a node's children that do not begin with it
    branch = np.flatnonzero(size > at)
    keys = np.sort((at[branch] + 1) * (n + 1) + branch)

    def children(k, d, r):  # rows j in (k, r) with lcp d that go on
        return np.searchsorted(keys, (d + 1) * (n + 1) + r) - np.searchsorted(keys, (d + 1) * (n + 1) + k + 1)

    runs = []  # row, depths (above, up to], end
    for k in range(n):
        j, low, length = k + 1, lcp[k], int(size[k])
        top = lcp[j] if j < n else after
        if length > max(low, top):
            runs.append((k, max(low, top), length, j))
        while j < n and lcp[j] > low:
            r = smaller[j]
            under = lcp[r] if r < n else after
            length = lcp[j]
            if length > max(low, under):
                runs.append((k, max(low, under), length, r))
            j = r
        if j == n and after > low:  # open at the end of the block
            runs.append((k, low, min(after, length), n + 1))
    found = np.array(runs, np.int64).reshape(-1, 4)
    many = found[:, 2] - found[:, 1]
    k, r = np.repeat(found[:, 0], many), np.repeat(found[:, 3], many)
    d = np.repeat(found[:, 1], many) + 1 + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    is_open = r > n
    r = np.minimum(r, n)
    # shares of intervals that began before: depths up to before, ended by the first smaller lcp
    deep = np.arange(0, before + 1)
    low_run = np.minimum.accumulate(at)
    end = np.searchsorted(-low_run, -deep, side="right")  # first row with lcp < depth
    kind = np.concatenate([np.where(is_open, "head", "node"), np.where(end < n, "tail", "through")])
    row, depth, stop = np.concatenate([k, np.zeros(len(deep), np.int64)]), np.concatenate([d, deep]), np.concatenate([r, end])
    came = np.arange(len(row)) >= len(k)
    prefix = np.where(depth > 0, upto[base[row] + np.maximum(depth - 1, 0)], 0)
    own = np.where(came, 0, 1)
    saved = sums[stop] - sums[np.where(came, 0, row + 1)] - (stop - row - own) * prefix
    below = np.where(came, children(np.full(len(row), -1), depth, stop), (size[row] > depth) + children(row, depth, stop))
    # conversations that end at a node are its first rows
    copies = np.append(np.flatnonzero(~((at[1:] == size[1:]) & (size[1:] == size[:-1]))) + 1, n)
    after_copies = copies[np.searchsorted(copies, np.arange(n), side="right")]
    ends = np.where((size[row] == depth) & (~came | (depth == before)), np.minimum(after_copies[row], stop), row)
    ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(row.tolist(), ends.tolist())]
    # the parent: the same row's node above, or the node of depth lcp around the row
    name: dict[tuple[int, int], int] = {}
    smallest = least.over(row, stop)
    closed = kind == "node"
    for a, b, c, ok in zip(row.tolist(), depth.tolist(), smallest.tolist(), closed.tolist()):
        if ok:
            name[(a, b)] = c
    heads = {b: a for a, b, x in zip(row.tolist(), depth.tolist(), kind.tolist()) if x == "head"}
    left = _left_smaller(lcp)
    parent, where = [], []
    for a, b, inherited in zip(row.tolist(), depth.tolist(), came.tolist()):
        if inherited or b == 0:
            parent.append(None)
            where.append(None)
            continue
        start = a
        while start >= 0 and lcp[start] >= b - 1:
            start = left[start]
        known = name.get((start, b - 1)) if start >= 0 else None
        parent.append(known)
        where.append(None if known is not None else "head" if start >= 0 and heads.get(b - 1) == start else "came")
    sha = [hashlib.sha256(x.encode()).hexdigest() if ok else None for x, ok in zip(ids, closed.tolist())]
    return {
        "block": [block] * len(row), "kind": kind.tolist(), "depth": depth, "conv_id": smallest, "n_convs": stop - row, "n_children": below, "n_leaves": leaves[stop] - leaves[row],
        "saved_tokens": saved, "ends_sha256": sha, "parent_conv_id": parent, "parent_kind": where, "ids": [None if ok else x for x, ok in zip(ids, closed.tolist())],
    }


def _left_smaller(values: list[int]) -> list[int]:
    """For every place the last place before it with a smaller value, or -1."""
    out, stack = [], []
    for j, v in enumerate(values):
        while stack and values[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(j)
    return out


def _sorted_blocks(seqs: DataFrame, rows: int, size: int) -> DataFrame:
    """conv_id, seq and chars in blocks of adjacent sequences: block, place, and the first row's and the next block's lcp."""
    flat = written(seqs.select("conv_id", F.unhex(F.array_join(F.transform("digests", F.hex), "")).alias("seq"), "chars"), "trie-sequences")
    total = flat.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("bytes")).first()
    parts = max(1, -(-total["n"] // rows), -(-(total["bytes"] or 0) // size))
    df = flat.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    df = written(df.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("place")), "trie-sorted")
    # a row per block: its borders, each with the last row of the block before
    edge = df.groupBy("block").agg(F.min_by("seq", "place").alias("first"), F.max_by("seq", "place").alias("last")).withColumn("last", F.lag("last").over(Window.orderBy("block")))

    @F.udf("long")
    def shared(a, b):
        return -1 if a is None else _common(bytes(a), bytes(b))

    edge = written(edge.select("block", shared("last", "first").alias("before")), "trie-borders")
    edge = edge.withColumn("after", F.coalesce(F.lead("before").over(Window.orderBy("block")), F.lit(-1)))
    return df.join(edge, "block")


def prefix_trie(turns: DataFrame, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    session(turns)
    return trie(rebuilt(sequences(turns)), rows, size)


def trie(seqs: DataFrame, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> DataFrame:
    """The same for conversations as they are (conv_id, digests, chars)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        block, before, after = (table.column(c)[0].as_py() for c in ("block", "before", "after"))
        conv = table.column("conv_id").to_numpy()
        return pa.table(block_nodes(block, conv, table.column("seq").to_pylist(), table.column("chars").to_pylist(), before, after), schema=_ARROW)

    found = written(_sorted_blocks(seqs, rows, size).groupBy("block").applyInArrow(run, _SHARE), "trie-shares")
    nodes, shares = found.where("kind = 'node'"), found.where("kind <> 'node'")
    # a share that came belongs to the last block before that opened its depth: rows here are blocks and depths, not conversations
    order = Window.partitionBy("depth").orderBy("block", F.col("kind") == "head")
    shares = written(shares.withColumn("owner", F.last(F.when(F.col("kind") == "head", F.col("block")), ignorenulls=True).over(order)), "trie-crossing")
    total = lambda c: F.sum(c).alias(c)
    head = lambda c: F.max(F.when(F.col("kind") == "head", F.col(c))).alias(c)
    crossing = shares.groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), *map(total, ("n_convs", "n_children", "n_leaves", "saved_tokens")), head("parent_kind"))
    crossing = crossing.join(_hashed(shares), ["owner", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    crossing = written(crossing, "trie-crossed")
    # who is alive in a block at a depth, by how it got there
    alive = shares.join(crossing.select("owner", "depth", F.col("conv_id").alias("_parent")), ["owner", "depth"])
    alive = alive.select("block", (F.col("depth") + 1).alias("depth"), F.when(F.col("kind") == "head", "head").otherwise("came").alias("parent_kind"), "_parent")
    crossing = crossing.select(F.col("owner").alias("block"), *(c for c in NODE if c != "parent_conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), "parent_kind")
    open_nodes = nodes.select(crossing.columns).unionByName(crossing)
    done = open_nodes.where(F.col("parent_kind").isNull())
    rest = open_nodes.where(F.col("parent_kind").isNotNull()).join(alive, ["block", "depth", "parent_kind"]).withColumn("parent_conv_id", F.col("_parent"))
    return done.select(*NODE).unionByName(rest.select(*NODE))


def _hashed(shares: DataFrame) -> DataFrame:
    """owner, depth and the digest of all ids that end there: pieces of a block's ids, streamed in order through one SHA-256."""

    def run(batches):
        last, sha, first, out = None, None, True, []
        for batch in batches:
            for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
                if (owner, depth) != last:
                    if last is not None:
                        out.append((*last, sha.hexdigest()))
                    last, sha, first = (owner, depth), hashlib.sha256(), True
                sha.update(("" if first else ",").encode() + ids.encode())
                first = False
            yield pa.RecordBatch.from_pydict({"owner": [x[0] for x in out], "depth": [x[1] for x in out], "ends_sha256": [x[2] for x in out]}, schema=kinds)
            out = []
        if last is not None:
            yield pa.RecordBatch.from_pydict({"owner": [last[0]], "depth": [last[1]], "ends_sha256": [sha.hexdigest()]}, schema=kinds)

    kinds = pa.schema([("owner", pa.int32()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    pieces = shares.where("ids <> ''").select("owner", "depth", "block", "ids").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block")
    return pieces.mapInArrow(run, "owner int, depth long, ends_sha256 string")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_STEP = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384))"
OP13_SQL = f"""WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  h AS (SELECT conv_id, ts, xor({_STEP}, 4294967295) % 6 AS h FROM o),
  s AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
  m AS (SELECT conv_id, ts, d, ts[1:d] AS k FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM s)),
  n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ts) = d), '') AS ids FROM m GROUP BY k, d),
  c AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
  e AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (k)),
  u AS (SELECT k[1:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(k[d].t) END) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM e) GROUP BY 1)
  SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(e.ids) AS ends_sha256
  FROM e JOIN u USING (k) LEFT JOIN e p ON e.d > 0 AND p.k = e.k[1:e.d - 1]"""
