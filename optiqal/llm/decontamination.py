"""Benchmark decontamination by suffix arrays of the training text.

Each task turns its documents into one word sequence and sorts the suffixes that can begin a match into a suffix array
(a Bloom gate on the first words of the benchmark's windows leaves out suffixes that cannot). Every suffix of the
benchmark is binary-searched in that array. The words that hits cover are marked, and hits are followed along both texts to
the longest verbatim matches that cover them; pairs of repeated places are never listed. Documents are read once and never shuffled.

The benchmark reaches the tasks as broadcasts of about BLOCK_BYTES of text each, which wait on the executors' disks: a task's
Python holds one block (two while it reads the next), and goes through all of them for each batch of documents. An item is never split over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiqal.llm._shared import BATCH_BYTES, annotate
from optiqal.llm._words import LETTERS, grams, hashes, room, split

#: Bytes of benchmark text in a block, on average; items are dealt to blocks by hash. A task holds some 120 bytes a word of it, a broadcast 40.
BLOCK_BYTES = 8 << 20
_GATE = 3
_BLOOM_BITS = 22

MATCH = T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("item_start", "doc_start", "n_words"))])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH))])


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`row` (a row of docs) and `found`: its words, the words hit, the items with occurring windows, and its longest verbatim matches.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is `window` consecutive words of
    an item, or the whole of a shorter one that isn't empty. Matches cover the words hit from left to right: each is the longest
    that begins at the first hit of which the ones before leave a word uncovered (of equal ones that in the item that comes
    first), and starts in words from 0. Identifiers of items may be of any type and are given as text.
    Null or empty text: no words, no match. Null item text: nothing. Rows that repeat are each judged; several items with
    the same text all match. No items: no matches. Items with a null id match but give a null item_id.
    """
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES) or 1
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    blocks = []
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        blocks.append(docs.sparkSession.sparkContext.broadcast(_windows(part.toArrow(), window)))
    return annotate(docs, text_col, FOUND, _Search(blocks), BATCH_BYTES if n_blocks > 1 else None)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with the columns of docs."""
    found = find_matches(docs, benchmark, window)
    return found.where(F.col("found.n_hit") == 0).select("row.*")


def _windows(items: pa.Table, window: int) -> list[dict]:
    """The benchmark's suffixes, by the number of words that they must share: distinct windows, where each one begins, and in which items."""
    text = items.column("text").combine_chunks() if items.num_rows else pa.array([], pa.string())
    ids = items.column("id").to_pylist()
    w = split(text if isinstance(text, pa.Array) else text.chunk(0), LETTERS)
    h, left, doc = hashes(w), room(w), w.doc
    count = np.diff(w.first)
    need = np.minimum(count, window)[doc] if len(doc) else np.zeros(0, np.int64)
    at = np.flatnonzero(left >= need)
    out = []
    for n in np.unique(need[at]):
        own = at[need[at] == n]
        rows = np.stack([h[own + j] for j in range(n)], 1)
        which = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(which.ravel(), kind="stable")
        gate = grams(h, min(n, _GATE))[own]
        bloom = np.zeros(1 << _BLOOM_BITS, bool)
        bloom[gate >> np.uint64(64 - _BLOOM_BITS)] = True
        at_pos = np.full(len(h) + 1, -1, np.int32)
        at_pos[own] = which
        begin = np.searchsorted(which[order], np.arange(which.max() + 2))
        pairs = np.unique(np.stack([which, doc[own]]), axis=1)  # the items of each window
        small = lambda x: x.astype(np.int32)  # noqa: E731 - places and items of a block
        out.append({"n": int(n), "hashes": h, "begin": small(begin), "pos": small(own[order]), "at_pos": at_pos, "item": small(doc), "at": small(np.arange(len(h)) - w.first[doc]), "items": small(pairs[1]), "items_begin": small(np.searchsorted(pairs[0], np.arange(len(begin)))), "bloom": np.packbits(bloom), "ids": ids})
    return out


def _keys(t: dict) -> np.ndarray:
    """The distinct windows in order, a row of word hashes each."""
    return t["hashes"][t["pos"][t["begin"][:-1]][:, None] + np.arange(t["n"])]


def _compare(train: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for each pair of a training suffix and a benchmark suffix, by their first words."""
    out = np.zeros(len(keys), np.int8)
    for j in range(keys.shape[1]):
        x = train[rows, j]
        out = np.where(out == 0, (x > keys[:, j]).astype(np.int8) - (x < keys[:, j]), out)
    return out


def _bounds(train: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the range of the suffix array that begins with it, by binary search for all keys at once."""
    ends = []
    for right in (False, True):
        lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(train), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            c = _compare(train, np.minimum(mid, len(train) - 1), keys)
            up = (c <= 0 if right else c < 0) & open_
            lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        ends.append(lo)
    return ends[0], ends[1]


def _longest(key: np.ndarray, p: int, t: dict) -> tuple[int, int, int]:
    """(item, its first word, windows) of the longest match that begins at the hit at p; key: the window at each place, -1 for none."""
    pos = t["pos"][t["begin"][key[p]] : t["begin"][key[p] + 1]]
    n, last = 1, len(t["at_pos"]) - 1
    while p + n < len(key) and key[p + n] >= 0:
        on = pos[(t["at_pos"][np.minimum(pos + n, last)] == key[p + n]) & (pos + n <= last)]
        if not len(on):
            break
        pos, n = on, n + 1
    first = int(pos.min())
    return int(t["item"][first]), int(t["at"][first]), n


class _Search:
    """Called in the tasks with the texts of some documents."""

    def __init__(self, blocks: list[Broadcast]):
        self.blocks = blocks

    def _tests(self) -> Iterator[dict]:
        """The windows of all blocks; of several blocks none is kept when it has been gone through."""
        for block in self.blocks:
            for t in block.value:
                if "keys" not in t:
                    t["keys"] = _keys(t)
                yield t
            if len(self.blocks) > 1:
                t = None
                vars(block).pop("_value", None)  # read again for the next batch

    def __call__(self, text: pa.Array) -> list:
        w = split(text, LETTERS)
        h, left = hashes(w), room(w)
        n_docs, n = len(w.first) - 1, len(h)
        edge = np.zeros(n + 1, np.int64)
        items: list[set] = [set() for _ in range(n_docs)]
        found: list[tuple] = []
        ids: list[str] = []  # of the items with windows here, over all blocks
        for t in self._tests():
            gate = grams(h, min(t["n"], _GATE))
            bloom = np.unpackbits(t["bloom"]).view(bool)
            may = np.flatnonzero(bloom[gate >> np.uint64(64 - _BLOOM_BITS)])
            may = may[left[may] >= t["n"]]
            if not len(may):
                continue
            words = np.stack([h[may + j] for j in range(t["n"])], 1)
            array = np.lexsort(words.T[::-1])  # the suffix array: suffixes by their first words
            lo, hi = _bounds(words[array], t["keys"])
            size = hi - lo
            at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            p, own = may[array[at]], np.repeat(np.arange(len(size)), size)  # each place has one window
            order = np.argsort(p)
            p, own = p[order], own[order]
            np.add.at(edge, p, 1)
            np.add.at(edge, p + t["n"], -1)
            doc = np.searchsorted(w.first, p, side="right") - 1
            both = np.unique(np.stack([doc, own]), axis=1)
            number: dict[int, int] = {}  # of the block's items that occur
            for d, k in both.T.tolist():
                of = t["items"][t["items_begin"][k] : t["items_begin"][k + 1]].tolist()
                items[d].update(number.setdefault(x, len(ids) + len(number)) for x in of)
            # hits in a row, of one document: each such run is covered by itself
            cut = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (doc[1:] != doc[:-1])])) if len(p) else np.zeros(0, np.int64)
            for a, b in zip(cut, np.append(cut[1:], len(p))[: len(cut)], strict=True):
                i, end = 0, -1
                while i < b - a:
                    item, start, size = _longest(own[a:b], i, t)
                    found.append((int(doc[a]), int(p[a]) + i, size + t["n"] - 1, number[item], start))
                    i += size  # the next hit has a word that this match does not reach
            ids += [t["ids"][x] for x in number]
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        found.sort()
        doc, p, size, item, start = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
        matches = pa.StructArray.from_arrays([pa.array([ids[i] for i in item], pa.string()), pa.array(start, pa.int64()), pa.array(p - w.first[doc], pa.int64()), pa.array(size, pa.int64())], names=MATCH.names)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), matches)
        return [np.diff(w.first), hit[w.first[1:]] - hit[w.first[:-1]], [list({ids[i]: None for i in sorted(x)}) for x in items], lists]


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ids = F.filter(F.array_sort(F.array_distinct("found.items")), lambda x: x.isNotNull())
    return found.select(F.col(f"row.{id_col}").alias("doc_id"), F.col("found.n_words").alias("n_words"), F.col("found.n_hit").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
place AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
met AS (SELECT r, i, place.n AS n, item_id FROM place JOIN win ON place.k = win.k AND place.n = win.n),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM met)) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""
