"""Spelling variants: words one edit apart, by dynamic programming along a sorted word list.

Two words one edit apart agree in their first half or in their second, so each word goes into groups of words that share
one of the two (the second half read backwards). Each group is a sorted list. Its words are walked prefix by prefix: the row of the edit matrix
of a prefix is made once and serves the whole range of words that the common prefixes of neighbours (LCPs) show to start
with it; only the three cells of a row around the diagonal can be one edit away; and a range whose prefix is more than one
edit from the word asked for is skipped. All words of many groups are asked for at once, as arrays.

A group of more than ROOM words is dealt into finer groups: of the part that is not yet known to agree, again either the
first half or the second must. At the finest, words differ in one place only, so no group stays large.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiqal.functions.graph import written
from optiqal.llm._shared import small_batches

c = F.col
#: Letters of a run, and the fewest code points of a word and its fewest occurrences.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form must be so many times as frequent as the word.
TIMES = 10
#: Words of a group at most, rows that a task gets, and words that are asked for at once.
ROOM, TASK, WIDTH = 50_000, 20_000, 1 << 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", salt: int = 31) -> DataFrame:
    """word, n: the words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences in whole texts.

    A word is a maximal run of LETTERS with A-Z lower-cased; where `salt` divides h, the unsigned crc32 of `<key>:<run>`, it
    has lost its code point h % length. Null keys count as empty; null and empty texts have no words.
    """
    run = F.explode(F.regexp_extract_all(docs[text_col].cast("string"), F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0)))
    rows = docs.select(F.concat(F.coalesce(docs[key_col].cast("string"), F.lit("")), F.lit(":")).alias("key"), run.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    rows = rows.withColumn("h", F.crc32(F.concat("key", "run").cast("binary")))
    at = (c("h") % F.char_length("run")).cast("int")
    word = F.when(c("h") % salt == 0, F.overlay("run", F.lit(""), at + 1, F.lit(1))).otherwise(c("run"))
    return rows.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(c("n") >= LEAST_COUNT)


def _keyed(words: DataFrame) -> DataFrame:
    """The first groups of each word: word, n, size, a, b, back, bar, key.

    size: code points of the longer word of the pairs sought; words of m code points meet those of m in size m, and those of
    m + 1 in size m + 1. Such pairs agree in size - 1 code points at least, some in front and some behind. A group's words
    have the first a and the last b code points in common (key); pairs that agree in the first `bar` are another group's.
    """
    m = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(m, m + 1)).alias("size"))
    return _halves(rows.withColumns({"a": F.lit(0), "b": F.lit(0), "bar": c("size") + 1}))


def _halves(rows: DataFrame) -> DataFrame:
    """The two groups of each row in which half of what may differ agrees: a grows to its middle, or b does."""
    half = F.floor((c("size") - 1 - c("a") - c("b")) / 2).cast("int")
    middle = c("a") + half
    front = F.struct(middle.alias("a"), c("b").alias("b"), c("bar").alias("bar"), F.lit(False).alias("back"))
    behind = F.struct(c("a").alias("a"), (c("size") - 1 - middle).alias("b"), middle.alias("bar"), F.lit(True).alias("back"))
    parts = rows.select("word", "n", "size", F.explode(F.array(front, behind)).alias("cut")).select("word", "n", "size", "cut.*")
    return parts.withColumn("key", F.xxhash64("size", "a", "b", "bar", "back", F.substr("word", F.lit(1), c("a")), F.right("word", c("b"))))


def _groups(words: DataFrame, room: int) -> DataFrame:
    """The rows of groups of at most `room` words: larger ones are halved until they fit, or differ in two code points at most."""
    waiting, done = written(_keyed(words), "groups"), []
    while True:
        large = waiting.where(c("size") - 1 - c("a") - c("b") > 1).groupBy("key").agg(F.count("*").alias("words")).where(c("words") > room).select("key")
        large = written(large, "large-groups")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, waiting])
        done.append(waiting.join(large, "key", "left_anti"))
        waiting = written(_halves(waiting.join(large, "key", "left_semi")), "groups")


def _lcp(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each word but the first: how many code points it shares with the one before."""
    size = np.diff(off)
    most = np.minimum(size[:-1], size[1:])
    out = np.zeros(len(most), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        same = flat[off[live] + out[live]] == flat[off[live + 1] + out[live]]
        live = live[same]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


def _one_edit(flat: np.ndarray, off: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asked, found): all ordered pairs of words of one group with exactly one edit between them.

    flat and off: the words' code points, sorted within each group, and the groups one after another. A row of the frontier
    is a range of the list whose words share their first `depth` code points, a word asked for, and the cells depth - 1,
    depth and depth + 1 of the matrix row that this prefix has against that word (2 stands for 2 and more).
    """
    size = np.diff(off)
    lcp = np.zeros(len(size), np.int64)
    lcp[1:] = np.where(group[1:] == group[:-1], _lcp(flat, off), -1)
    lcp[0] = -1
    order = np.argsort(lcp, kind="stable")  # places where a list parts, by the depth at which it does
    level = lcp[order]
    first = np.flatnonzero(lcp < 0)
    last = np.append(first[1:], len(size))
    for at in range(0, len(size), WIDTH):
        asked = np.arange(at, min(at + WIDTH, len(size)))
        g = np.searchsorted(first, asked, side="right") - 1
        yield from _walk(flat, off, size, order, level, first[g], last[g], asked)


def _walk(flat: np.ndarray, off: np.ndarray, size: np.ndarray, order: np.ndarray, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    left, mid, right = np.full(len(q), 2, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
    depth = 0
    while len(q):
        ends = size[lo] == depth  # the shortest word of a range is its prefix itself
        over = size[q] - depth
        value = np.where(over == 0, mid, np.where(over == 1, right, np.where(over == -1, left, 2)))
        hit = ends & (value == 1)
        yield q[hit], lo[hit]
        lo = lo + ends
        keep = lo < hi
        lo, hi, q, left, mid, right = lo[keep], hi[keep], q[keep], left[keep], mid[keep], right[keep]
        # the ranges of one more code point: a range parts where neighbours share `depth` code points only
        a, b = np.searchsorted(level, [depth, depth + 1])
        cuts = order[a:b]
        from_, to = np.searchsorted(cuts, lo, side="right"), np.searchsorted(cuts, hi, side="left")
        n = to - from_ + 1
        parent = np.repeat(np.arange(len(lo)), n)
        nth = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n)
        start = np.where(nth == 0, lo[parent], cuts[np.minimum(from_[parent] + nth - 1, max(len(cuts) - 1, 0))] if len(cuts) else lo[parent])
        stop = np.where(nth == n[parent] - 1, hi[parent], cuts[np.minimum(from_[parent] + nth, max(len(cuts) - 1, 0))] if len(cuts) else hi[parent])
        q, left, mid, right = q[parent], left[parent], mid[parent], right[parent]
        sign = flat[off[start] + depth]
        length, base = size[q], off[q]

        def differs(j: int, length: np.ndarray = length, base: np.ndarray = base, sign: np.ndarray = sign) -> np.ndarray:
            return (flat[np.minimum(base + j, len(flat) - 1)] != sign) | (length <= j)

        new_left = np.minimum(mid + 1, left + differs(depth - 1)) if depth else np.minimum(mid + 1, 2)
        new_mid = np.minimum(np.minimum(right + 1, new_left + 1), mid + differs(depth))
        new_right = np.minimum(new_mid + 1, right + differs(depth + 1))
        new_left = np.where(length < depth, 2, new_left)
        new_mid = np.where(length < depth + 1, 2, new_mid)
        new_right = np.where(length < depth + 2, 2, new_right)
        left, mid, right = (np.minimum(x, 2).astype(np.int8) for x in (new_left, new_mid, new_right))
        keep = np.minimum(np.minimum(left, mid), right) <= 1
        lo, hi, q, left, mid, right = start[keep], stop[keep], q[keep], left[keep], mid[keep], right[keep]
        depth += 1


def _near(table: pa.Table) -> pa.Table:
    """word, near, best_n, best: of the rows of some groups, how many words are near each word there, and the most frequent."""
    words = np.array(table.column("word").to_pylist(), object)
    n, size, bar, key = (table.column(x).to_numpy() for x in ("n", "size", "bar", "key"))
    back = table.column("back").to_numpy()
    turned = [w[::-1] if r else w for w, r in zip(words, back, strict=True)]
    order = np.array(sorted(range(len(words)), key=lambda i: (key[i], turned[i])), np.int64)
    group = np.unique(key[order], return_inverse=True)[1]
    length = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join([turned[i] for i in order]).encode("utf-32-le"), "<u4")
    off = np.concatenate([[0], np.cumsum(length[order])])
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    for asked, found in _one_edit(flat, off, group):
        asked, found = order[asked], order[found]
        own = np.maximum(length[asked], length[found]) == size[asked]
        for i, j in zip(asked[own].tolist(), found[own].tolist(), strict=True):
            if words[i][: bar[i]] != words[j][: bar[i]] or bar[i] > size[i]:
                count[i] += 1
                k = best[i]
                if k < 0 or n[j] > n[k] or n[j] == n[k] and words[j] < words[k]:
                    best[i] = j
    some = np.flatnonzero(count)
    return pa.table({"word": pa.array(words[some].tolist(), pa.string()), "near": pa.array(count[some]), "best_n": pa.array(n[best[some]]), "best": pa.array(words[best[some]].tolist(), pa.string())})


def near_words(words: DataFrame, room: int = ROOM) -> DataFrame:
    """word, n_near, best_n, best: for each word (word, n; distinct) that has any, how many words are one edit away, and the most frequent of them.

    Ties go to the smallest word in code-point order. Words without near words have no row; null and empty words take no part.
    """
    small_batches(words.sparkSession)
    rows = _groups(words.where("word <> ''").select("word", c("n").cast("long").alias("n")), room)
    buckets = max(1, -(-rows.count() // TASK))
    found = rows.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(_near, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-c("best_n")).alias("n"), c("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-c("best.n")).alias("best_n"), c("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (word, form; no cycles). The reach doubles from round to round."""
    at = written(forms.select("word", c("form").alias("root")), "roots")
    while True:
        further = at.select(c("word").alias("root"), c("root").alias("next"))
        step = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), c("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(words: DataFrame, times: int = TIMES, room: int = ROOM) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word (word, n; distinct).

    form: the most frequent word one edit away (ties: the smallest in code-point order), if that is at least `times` as
    frequent as the word, else null. root: the last word along the forms, the word itself without a form.
    """
    near = near_words(words, room)
    form = c("best_n") >= times * c("n")
    rows = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, c("best")).alias("form"), F.when(form, c("best_n")).alias("form_n")), "variants")
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants of the words of whole texts; see vocabulary for what counts as a word. No rows, no texts: no words."""
    return variants(written(vocabulary(docs, key_col, text_col), "words"))


ORACLE_SQL = r"""
WITH RECURSIVE
r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents) GROUP BY ALL),
t AS (SELECT [list_reduce([i, -1, -1, -1, -1, -1, -1, -1, -1], lambda a, v: xor(a >> 1, (a & 1) * 3988292384)) FOR i IN range(256)] AS step),
b AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM r),
h AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(code, i, 2))::BIGINT FOR i IN range(1, length(code), 2)],
                                 lambda a, v: xor(a >> 8, step[(xor(a, v) & 255) + 1])), 4294967295) AS h FROM b, t),
w AS (
  SELECT word, sum(n) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM w, (SELECT unnest(range(1, 10000)) AS i) WHERE i <= length(word)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.less
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.less),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, f.form, ends.at AS root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM f JOIN ends USING (word)
"""
