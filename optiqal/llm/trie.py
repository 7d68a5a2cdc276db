"""Conversation prefix tries: double arrays over pieces of prefix shards, their nodes merged globally.

Conversations are cut into segments of SEGMENT turns. A segment belongs to the shard of the turns before it, its prefix, and
segments of one shard with the same turns are counted once. A task sorts its segments by prefix and turns and packs them,
some at a time, into a double array: turns become dense numbers, node s leads by turn t to slot BASE[s] + t, which is its child
if CHECK of that slot is s. Following the segments through the array gives the nodes with their counts. A node that several
arrays hold (an upper node, or one of a popular shard) has one row in each, and these are merged by the hash of its path.

What a node sums over its subtree needs no walk through the tree, however deep. In each node the smallest conversation is the
owner; from its first own node on a conversation owns all its nodes. So a node counts as often beyond once in a subtree as
there are conversations below that pass it without owning it: each member of a node adds the tokens from there up to its
first own node, and each owner of a childless node adds a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiqal.functions.graph import written
from optiqal.llm._prefix import numbered
from optiqal.llm._shared import small_batches

c = F.col
#: Turns of a segment.
SEGMENT = 64
#: Segments of a long conversation whose running totals one task makes, and conversation numbers in one piece of a list of ends.
RUN, ENDS = 64, 4096
#: A conversation takes over the first turns of the one whose number is the next lower multiple of FAMILY, HEAD - 1 at most.
FAMILY, HEAD = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), x and y (a hash of 128 bits of role and text), tokens (code points of the text).

    Ordered by turn (null first), then role and text, null ones being empty; rows that are alike in all of these all count.
    Rows without a conv_id take no part. A conversation of any length is numbered in parts; only its rows of one turn and
    role whose texts begin alike stay in one.
    """
    empty = lambda name: F.coalesce(conversations[name].cast("string"), F.lit("")).alias(name)
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), empty("role"), empty("text"))
    turn = F.asc_nulls_first("turn")
    rows = numbered(rows, "conv_id", [turn, F.left("role", F.lit(32)), F.left("text", F.lit(32))], [turn, F.left("role", F.lit(32)), F.left("text", F.lit(32)), "role", "text"])
    return rows.select("conv_id", c("before").cast("long").alias("pos"), F.xxhash64("role", "text").alias("x"), F.xxhash64("text", F.lit(1), "role").alias("y"), F.char_length("text").cast("long").alias("tokens"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): conv_id, depth (from 1), x, y, tokens; and conv_id, n_turns of every conversation, also those left without turns.

    Conversation c takes its first h = crc32(decimal c) % HEAD turns from conversation c - c % FAMILY (all if that has fewer,
    none if there is none) and then its own after its first h.
    """
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(c("conv_id").cast("string").cast("binary")) % HEAD).alias("h")
    base = (c("conv_id") - c("conv_id") % FAMILY).alias("base")
    head = size.where(c("conv_id") % FAMILY == 0).select(c("conv_id").alias("base"), c("n").alias("head"))
    of = size.select("conv_id", "n", h, base).join(head, "base", "left")
    of = written(of.select("conv_id", "base", "n", "h", F.least(F.coalesce("head", F.lit(0)), "h").alias("taken")), "conversations")
    own = turns.join(of.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (c("pos") - c("h") + c("taken") + 1).alias("depth"), "x", "y", "tokens")
    first = turns.where((c("conv_id") % FAMILY == 0) & (c("pos") < HEAD - 1)).withColumnRenamed("conv_id", "base")
    taken = of.select("conv_id", "base", "h").join(first, "base").where("pos < h").select("conv_id", (c("pos") + 1).alias("depth"), "x", "y", "tokens")
    return own.unionByName(taken), of.select("conv_id", (c("taken") + F.greatest(c("n") - c("h"), F.lit(0))).alias("n_turns"))


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, seg, turns (array of gx, gy, tokens), px, py, before, total, last: of each segment of each conversation.

    gx, gy: a hash of turn and depth. px, py: the hash of the path so far, the exclusive or of those of all turns before.
    before: tokens before the segment. total: tokens of the conversation. last: whether it is the last segment.
    """
    seg = F.floor((c("depth") - 1) / SEGMENT).cast("long")
    rows = rows.select("conv_id", "depth", seg.alias("seg"), F.xxhash64("x", "depth", "y").alias("gx"), F.xxhash64("y", "x", "depth").alias("gy"), "tokens")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("depth", "gx", "gy", "tokens"))), lambda t: F.struct(t["gx"].alias("gx"), t["gy"].alias("gy"), t["tokens"].alias("tokens")))
    sums = [F.bit_xor("gx").alias("gx"), F.bit_xor("gy").alias("gy"), F.sum("tokens").alias("tokens")]
    segs = written(rows.groupBy("conv_id", "seg").agg(turns.alias("turns"), *sums).withColumn("run", F.floor(c("seg") / RUN).cast("long")), "segments")  # SEGMENT turns at most
    run = segs.groupBy("conv_id", "run").agg(*sums, F.max("seg").alias("most"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda w, *names: [F.coalesce(f(n).over(earlier(w)), F.lit(0)).alias(m) for f, n, m in zip((F.bit_xor, F.bit_xor, F.sum), ("gx", "gy", "tokens"), names, strict=True)]
    by_run, whole = W.partitionBy("conv_id").orderBy("run"), W.partitionBy("conv_id")
    run = run.select("conv_id", "run", *so_far(by_run, "rx", "ry", "rt"), F.sum("tokens").over(whole).alias("total"), F.max("most").over(whole).alias("most"))
    within = W.partitionBy("conv_id", "run").orderBy("seg")
    out = segs.join(run, ["conv_id", "run"]).select("conv_id", "seg", "turns", "rx", "ry", "rt", "total", (c("seg") == c("most")).alias("last"), *so_far(within, "ix", "iy", "it"))
    return out.select("conv_id", "seg", "turns", c("rx").bitwiseXOR(c("ix")).alias("px"), c("ry").bitwiseXOR(c("iy")).alias("py"), (c("rt") + c("it")).alias("before"), "total", "last")


class DoubleArray:
    """A trie in two arrays: the child of node s by code t is slot base[s] + t, and is there if check of it is s. Slot 0 is the top.

    codes: for each sequence its codes by level, -1 from its end on. They are dense numbers of the symbols of a level,
    siblings mostly in a row.
    """

    def __init__(self, symbols: np.ndarray):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.end = 1  # no slot from here on is taken
        self.codes = np.full(symbols.shape, -1, np.int64)
        at = np.zeros(len(symbols), np.int64)
        for k in range(symbols.shape[1]):
            live = np.flatnonzero(symbols[:, k] >= 0)
            if not len(live):
                break
            s, g = at[live], symbols[live, k]
            known, seen = np.unique(g[np.lexsort((g, s))], return_index=True)
            code = np.empty(len(known), np.int64)
            code[np.argsort(seen)] = np.arange(len(known))
            self.codes[live, k] = code[np.searchsorted(known, g)]
            pair, which = np.unique(s * (len(known) + 1) + self.codes[live, k], return_inverse=True)
            at[live] = self._place(*np.divmod(pair, len(known) + 1))[which]

    def _grow(self, slots: int) -> None:
        if slots > len(self.check):
            more = max(slots, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def _place(self, parent: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Slots for the children of some nodes, given by parent and code in order."""
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        count = np.diff(np.append(first, len(parent)))
        for i, n in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            t = code[i : i + n]
            b = self._room(t)
            self._grow(b + int(t[-1]) + 1)
            self.base[parent[i]] = b
            self.check[b + t] = parent[i]
            self.end = max(self.end, b + int(t[-1]) + 1)
        one = first[count == 1]
        free = np.flatnonzero(self.check[1 : self.end] < 0)[: len(one)] + 1  # an only child fits into any gap
        free = np.append(free, np.arange(self.end, self.end + len(one) - len(free)))
        self.end = max(self.end, int(free[-1]) + 1) if len(one) else self.end
        self._grow(self.end)
        self.base[parent[one]] = free - code[one]
        self.check[free] = parent[one]
        return self.base[parent] + code

    def _room(self, t: np.ndarray, tries: int = 64) -> int:
        """A base that puts all codes on free slots: one of the first gaps if they fit there, else the end."""
        gaps = np.flatnonzero(self.check[1 : self.end] < 0)[:tries] + 1
        for b in (gaps - t[0]).tolist():
            slots = b + t
            if (self.check[slots[slots < self.end]] < 0).all():
                return b
        return self.end - int(t[0])

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, sequences, their nodes at it), from the top down."""
        at = np.zeros(len(self.codes), np.int64)
        for k in range(self.codes.shape[1]):
            live = np.flatnonzero(self.codes[:, k] >= 0)
            slot = self.base[at[live]] + self.codes[live, k]
            if (self.check[slot] != at[live]).any():
                raise AssertionError("a sequence leaves its trie")
            at[live] = slot
            if len(live):
                yield k, live, slot


def _packed(batch: pa.RecordBatch) -> tuple[DoubleArray, dict[str, np.ndarray]]:
    """The double array of a batch of segments, whose first level is the prefix, and per segment and level: kx, ky, qx, qy (paths of node and parent), tokens, before."""
    lists = batch.column("turns")
    off = lists.offsets.to_numpy().astype(np.int64)
    items = lists.values
    n = np.diff(off)
    rows, width = len(n), int(n.max())
    row = np.repeat(np.arange(rows), n)
    level = np.arange(off[0], off[-1]) - np.repeat(off[:-1], n)
    own = slice(int(off[0]), int(off[-1]))

    def table(values: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, width), np.int64)
        out[row, level] = values
        return out

    gx, gy, tokens = (table(items.field(x).to_numpy()[own]) for x in ("gx", "gy", "tokens"))
    px, py, before = (batch.column(x).to_numpy() for x in ("px", "py", "before"))
    paths = {}
    for name, g, p in (("x", gx, px), ("y", gy, py)):
        along = np.bitwise_xor.accumulate(np.concatenate([p[:, None], g], 1), axis=1)
        paths["q" + name], paths["k" + name] = along[:, :-1], along[:, 1:]
    turns = np.unique(np.stack([gx[row, level], gy[row, level]], 1), axis=0, return_inverse=True)[1].ravel()
    prefix = np.unique(np.stack([px, py], 1), axis=0, return_inverse=True)[1].ravel()
    symbols = np.full((rows, width + 1), -1, np.int64)
    symbols[:, 0], symbols[row, level + 1] = prefix, turns
    paths |= {"tokens": tokens, "before": before[:, None] + np.cumsum(tokens, 1) - tokens}
    return DoubleArray(symbols), paths


NODES = "kx long, ky long, qx long, qy long, depth long, tokens long, before long, n long, conv_id long, n_ends long"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each batch of distinct segments, with its conversations, the smallest of them, and how many end there."""
    for batch in batches:
        if not batch.num_rows:
            continue
        trie, of = _packed(batch)
        size = len(trie.check)
        n, ends, least, where, depth = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
        many, end, conv, seg = (batch.column(x).to_numpy() for x in ("n", "n_ends", "conv_id", "seg"))
        length = (trie.codes >= 0).sum(1) - 1
        for k, live, slot in trie.walk():
            if k:
                np.add.at(n, slot, many[live])
                np.add.at(ends, slot, np.where(length[live] == k, end[live], 0))
                np.minimum.at(least, slot, conv[live])
                where[slot], depth[slot] = live, seg[live] * SEGMENT + k
        found = np.flatnonzero(n)
        level = (depth[found] - 1) % SEGMENT
        cols = [of[x][where[found], level] for x in ("kx", "ky", "qx", "qy")] + [depth[found]] + [of[x][where[found], level] for x in ("tokens", "before")] + [n[found], least[found], ends[found]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[x.split()[0] for x in NODES.split(", ")])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kx, ky, saved, leaves: what each batch of segments adds to the sums of its nodes; nodes to which it adds nothing have no row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        trie, of = _packed(batch)
        size = len(trie.check)
        saved, leaves, where, level = (np.zeros(size, np.int64) for _ in range(4))
        until, leaf = batch.column("until").to_numpy(), batch.column("leaf").to_numpy()
        for k, live, slot in trie.walk():
            if k:
                np.add.at(saved, slot, np.maximum(0, until[live] - of["before"][live, k - 1]))
                np.add.at(leaves, slot, leaf[live])
                where[slot], level[slot] = live, k - 1
        found = np.flatnonzero((saved > 0) | (leaves > 0))
        cols = [of["kx"][where[found], level[found]], of["ky"][where[found], level[found]], saved[found], leaves[found]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kx", "ky", "saved", "leaves"])


def nodes(segs: DataFrame) -> DataFrame:
    """The distinct nodes but the top: NODES, with n, the smallest conv_id and n_ends over all conversations."""
    end = [c("px").bitwiseXOR(F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t["gx"]))).alias("ex"), c("py").bitwiseXOR(F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t["gy"]))).alias("ey")]
    same = segs.select("*", *end).groupBy("seg", "ex", "ey").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.count_if("last").alias("n_ends"), *[F.first(x).alias(x) for x in ("turns", "px", "py", "before")])
    same = written(same.withColumn("gx", c("turns")[0]["gx"]), "distinct-segments")
    shards = same.repartitionByRange("px", "py", "gx", "ex").sortWithinPartitions("px", "py", "gx", "ex").select("seg", "turns", "px", "py", "before", "n", "conv_id", "n_ends")
    found = shards.mapInArrow(_nodes, NODES)
    agg = [F.min(x).alias(x) for x in ("qx", "qy", "depth", "tokens", "before")]
    return found.groupBy("kx", "ky").agg(*agg, F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n_ends"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kx, ky, ends_sha256 from pieces (kx, ky, ids) in order: a list's pieces are hashed one after another."""
    key, sha = None, None
    for batch in batches:
        done: list[tuple] = []
        for x, y, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (x, y) != key:
                if sha:
                    done.append((*key, sha.hexdigest()))
                key, sha = (x, y), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _rows_of(done)
    if sha:
        yield _rows_of([(*key, sha.hexdigest())])


def _rows_of(rows: list[tuple]) -> pa.RecordBatch:
    x, y, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(sha, pa.string())], names=["kx", "ky", "ends_sha256"])


def ends(segs: DataFrame, conversations: DataFrame) -> DataFrame:
    """kx, ky, ends_sha256: of the numbers of the conversations that end in each node, ascending, joined by commas; nodes in which none ends have no row."""
    last = segs.where("last").select(F.aggregate("turns", c("px"), lambda a, t: a.bitwiseXOR(t["gx"])).alias("kx"), F.aggregate("turns", c("py"), lambda a, t: a.bitwiseXOR(t["gy"])).alias("ky"), "conv_id")
    none = conversations.where("n_turns = 0").select(F.lit(0).cast("long").alias("kx"), F.lit(0).cast("long").alias("ky"), "conv_id")
    piece = last.unionByName(none).groupBy("kx", "ky", F.shiftright("conv_id", ENDS.bit_length() - 1).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))  # ENDS numbers at most
    return piece.repartition("kx", "ky").sortWithinPartitions("kx", "ky", "piece").select("kx", "ky", "ids").mapInArrow(_digests, "kx long, ky long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    See turns_of for order, nulls, ties and repeated rows, and rebuilt for what is joined. A node is known by its smallest
    member and its depth. A conversation left without turns is a member of the top alone. No conversations: no rows. Paths
    are told apart by hashes of 128 bits.
    """
    small_batches(conversations.sparkSession)
    turns = written(turns_of(conversations), "turns")
    rows, convs = rebuilt(turns)
    segs = written(segments(rows), "segments-with-paths")
    found = written(nodes(segs), "nodes")
    owners = found.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("top"), F.max((c("n_ends") == c("n")).cast("long")).alias("leaf"))
    owned = segs.join(owners.select("conv_id", c("top.before").alias("shared"), "leaf"), "conv_id", "left")
    owned = owned.select("turns", "px", "py", "before", F.coalesce("shared", "total").alias("until"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"))
    sums = owned.mapInArrow(_sums, "kx long, ky long, saved long, leaves long").groupBy("kx", "ky").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    children = found.groupBy(c("qx").alias("kx"), c("qy").alias("ky")).agg(F.count("*").alias("n_children"))
    ended = written(ends(segs, convs), "ends")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).where("n > 0")  # one row
    zero = F.lit(0).cast("long")
    whole = found.agg(F.count_if(c("depth") == 1).alias("n_children"), F.greatest(F.count_if(c("n_ends") == c("n")), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum((c("n") - 1) * c("tokens")), zero).alias("saved_tokens"))  # one row
    key = ["kx", "ky"]
    root = top.join(F.broadcast(whole)).select(zero.alias("kx"), zero.alias("ky"), zero.alias("qx"), zero.alias("qy"), "conv_id", zero.alias("depth"), c("n").alias("n_convs"), "n_children", c("n_leaves").cast("long").alias("n_leaves"), "saved_tokens")
    below = found.join(sums, key, "left").join(children, key, "left").select(*key, "qx", "qy", "conv_id", "depth", c("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), F.coalesce("leaves", zero).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"))
    every = written(root.unionByName(below).join(ended, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "trie")
    parents = every.select(c("kx").alias("qx"), c("ky").alias("qy"), c("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    first = every.where("depth <= 1").crossJoin(F.broadcast(top.select(c("conv_id").alias("parent_conv_id")))).withColumn("parent_conv_id", F.when(c("depth") == 1, c("parent_conv_id")))  # the top's one row
    return first.select(*columns).unionByName(every.where("depth > 1").join(parents, ["qx", "qy"]).select(*columns))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base,
         xor(list_reduce([4294967295::BIGINT] || flatten([[ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(conv_id::VARCHAR, '')]),
                         lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
k AS (SELECT c.conv_id, c.base, c.h, least(coalesce(b.n, 0), c.h) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT t.conv_id, pos - h + taken + 1 AS depth, role, text FROM t JOIN k ON t.conv_id = k.conv_id WHERE pos >= h
  UNION ALL SELECT k.conv_id, pos + 1, role, text FROM k JOIN t ON t.conv_id = k.base WHERE pos < h),
p AS (
  SELECT conv_id, depth, length(text) AS tokens, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, lag(path) OVER w AS parent, lead(path) OVER w AS further FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (
  SELECT path, any_value(depth) AS depth, any_value(tokens) AS tokens, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE further IS NULL), '')) AS ends_sha256
  FROM q GROUP BY path),
kids AS (SELECT parent AS path, count(*) AS n FROM n WHERE parent IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT x.path AS up, y.path AS path FROM q x JOIN q y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
s AS (
  SELECT up, sum((n_convs - 1) * tokens) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM a JOIN n USING (path) LEFT JOIN kids USING (path) GROUP BY up)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.up = n.path LEFT JOIN n m ON m.path = n.parent LEFT JOIN kids ON kids.path = n.path
"""
