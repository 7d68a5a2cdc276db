"""Exact substring dedup with suffix arrays built by two-stage sorting.

Every string of LENGTH bytes holds an anchor: its smallest K-byte hash. Equal strings have equal anchors at equal places, so
only text around anchors that occur twice can repeat, and it is dealt to the tasks by anchor. There a suffix array is built:
suffixes that begin with a byte below or equal to the next one are sorted directly, all others are induced from them by one
scan of the buckets; strings of LENGTH bytes repeat where adjacent suffixes share that many. The earliest one stays.

Places with one anchor and one content (64-bit hashes of both; anchor and content together make 128 bits) are one class: its
earliest place goes to the suffix arrays for the class, if its anchor has other contents that could share a string with it; the
class's other places repeat it as a whole. Each task settles what it can of a class before anything is shuffled, so an anchor
that every document has brings a few rows from each batch. An anchor of more than HOT contents is dealt on by the strings
themselves, so no anchor must fit in a task.

Rows that share a doc_id are parts of one document, in the order of their texts' hashes; `base` is where a part begins in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiqal.functions.graph import written
from optiqal.llm._prefix import running
from optiqal.llm._shared import pieces, small_batches, text_bytes
from optiqal.llm._words import mix

LENGTH, K = 100, 20
_SPAN = LENGTH - K + 1
#: Places of one anchor that are kept together.
HOT = 65_536
#: Bytes of one suffix array; anchors are never split over two.
ARRAY = 128 << 10
_U = np.uint64


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over x[i : i + n] for each i that has n values."""
    width = 1
    while 2 * width <= n:
        x = op(x[: len(x) - width], x[width:])
        width *= 2
    return op(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _eight(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each byte on as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), kind, padded.data, strides=(1,))


def _gram_hashes(e: np.ndarray, n: int) -> np.ndarray:
    """Hashes, never 0, of K bytes from each of the first n places on; e: eight bytes from each place on."""
    return mix(e[:n] * _U(0x9E3779B97F4A7C15) ^ mix(e[8 : n + 8] + _U(1)) ^ e[12 : n + 12] * _U(0xC2B2AE3D27D4EB4F)) | _U(1)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, least, at): hashes of K bytes, the least in each string of LENGTH bytes (0 where it leaves its text), anchors."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return np.zeros(0, _U), np.zeros(0, _U), none
    h = _gram_hashes(_eight(data, "<u8"), len(data) - K + 1)
    least = _slide(h, _SPAN, np.minimum)
    inside = np.zeros(len(least), bool)
    edge = np.zeros(len(data) + 1, np.int64)
    long = off[1:] - off[:-1] >= LENGTH
    np.add.at(edge, off[:-1][long], 1)
    np.add.at(edge, off[1:][long] - LENGTH + 1, -1)
    inside = np.cumsum(edge)[: len(least)] > 0
    least = np.where(inside, least, _U(0))
    around = np.concatenate([np.zeros(_SPAN - 1, _U), least, np.zeros(_SPAN - 1, _U)])
    most = _slide(around, _SPAN, np.maximum)  # for each K bytes, over the strings that hold them
    return h, least, np.flatnonzero(most[: len(h)] == h)


def _owned(h: np.ndarray, least: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings that each anchor is the least of; they are a run that ends at or before it."""
    around = np.concatenate([np.zeros(_SPAN - 1, _U), least, np.zeros(_SPAN, _U)])
    begin, last, own_h = np.full(len(at), -1), np.full(len(at), -1), h[at]
    for back in range(_SPAN):
        own = around[at - back + _SPAN - 1] == own_h
        begin[own] = at[own] - back
        fresh = own & (last < 0)
        last[fresh] = at[fresh] - back
    return begin, last


def _content_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges, which are LENGTH to LENGTH + SPAN - 1 long."""
    e = _eight(data, "<u8")
    out = mix((end - begin).astype(_U))
    for d in range(0, LENGTH + _SPAN, 8):
        at = begin + d
        inside = at + 8 <= end
        out = np.where(inside, mix(out ^ e[np.minimum(at, len(data) - 1)]), out)
    return mix(out ^ e[end - 8])


_ANCHORED = ["anchor", "doc_id", "base", "start", "n", "content", "settled"]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, base, text -> anchor, doc_id, base, start, n, content, settled: the n strings from start on that an anchor is the
    least of, and a hash of their text. Settled: an earlier place of the batch has the same text.
    """
    for batch in batches:
        made: list[list[np.ndarray]] = []
        rows = 0
        for part in pieces(batch, 2):
            data, off = text_bytes(part.column(2))
            h, least, at = anchors(data, off)
            if not len(at):
                continue
            begin, last = _owned(h, least, at)
            new = np.ones(len(at), bool)  # equal hashes side by side may be the least of the same strings
            new[1:] = (h[at[1:]] != h[at[:-1]]) | (begin[1:] != begin[:-1]) | (last[1:] != last[:-1])
            at, begin, last = at[new], begin[new], last[new]
            doc = np.searchsorted(off, at, side="right") - 1
            ids, base = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
            made.append([h[at].view(np.int64), ids, base, begin - off[doc] + base, last - begin + 1, _content_hashes(data, begin, last + LENGTH).view(np.int64), doc + rows])
            rows += part.num_rows
        if not made:
            continue
        anchor, ids, base, start, n, content, row = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.lexsort((start, ids, content, anchor))
        settled = np.zeros(len(order), bool)
        settled[order[1:]] = (anchor[order[1:]] == anchor[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
        i = np.flatnonzero(settled)  # in the order of rows and places: what overlaps becomes one
        end = (start + n)[i] + LENGTH - 1
        head = np.ones(len(i), bool)
        head[1:] = (row[i[1:]] != row[i[:-1]]) | (start[i[1:]] > end[:-1]) if len(i) else False
        first = i[head]
        n[first] = end[np.append(np.flatnonzero(head)[1:], len(i)) - 1] - start[first] - LENGTH + 1 if len(i) else n[first]
        keep = np.sort(np.concatenate([np.flatnonzero(~settled), first]))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, ids, base, start, n.astype(np.int32), content, settled)], names=_ANCHORED)


#: What _compared makes of a row: all its strings are earlier elsewhere; some may be; some may be, and the anchor is hot.
AGAIN, PERHAPS, HOT_PERHAPS = 0, 1, 2


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, document and start: those that may lose bytes, or are needed to tell.

    A row whose text an earlier row of its anchor has too is settled. If an anchor has several texts, the first row of each
    goes on. Of the last anchor only these first rows are held, and if there are more than HOT, only their hashes' bound.
    """
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 6
    hot = False

    def out(cols: list[np.ndarray], i: np.ndarray, kind) -> pa.RecordBatch:
        anchor, doc, base, start, n, _ = (x[i] for x in cols)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(base), pa.array(start), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(np.broadcast_to(np.int32(kind), len(i)) if np.isscalar(kind) else kind.astype(np.int32))], names=["doc_id", "base", "start", "n", "anchor", "kind"])

    def settle(cols: list[np.ndarray], old: int, last: bool) -> Iterator[pa.RecordBatch]:
        """The first `old` rows were held; unless this is the last call, the last anchor stays open."""
        nonlocal held, hot
        anchor, content = cols[0], cols[5]
        order = np.lexsort((content, anchor))  # stable: the earliest of equal texts first
        a, c = anchor[order], content[order]
        again = np.concatenate([[False], (a[1:] == a[:-1]) & (c[1:] == c[:-1])])
        if again.any():
            yield out(cols, order[again], AGAIN)
        first = np.sort(order[~again])
        a = anchor[first]
        open_ = np.zeros(len(first), bool) if last else a == anchor[-1]
        head = np.concatenate([[True], a[1:] != a[:-1]])
        count = np.diff(np.append(np.flatnonzero(head), len(a)))[np.cumsum(head) - 1]
        was_hot = hot & (a == anchor[0]) if old else np.zeros(len(first), bool)
        done = ~open_ & ((count > 1) | was_hot)
        if done.any():
            yield out(cols, first[done], np.where(was_hot[done], HOT_PERHAPS, PERHAPS))
        rest = first[open_]
        hot = bool(hot and old and len(rest) and anchor[rest[0]] == anchor[0])
        if len(rest) > HOT or hot:  # too many texts to hold: their strings are told apart one by one
            yield out(cols, rest, HOT_PERHAPS)
            hot, rest = True, rest[:1]
            held = [x[rest] for x in cols]
            held[5] = np.zeros(1, np.int64)
            return
        held = [x[rest] for x in cols]

    for batch in batches:
        settled = batch.column("settled").to_numpy(zero_copy_only=False)
        whole = [batch.column(i).to_numpy() for i in range(6)]
        if settled.any():
            yield out(whole, np.flatnonzero(settled), AGAIN)
        if not settled.all():
            cols = [np.concatenate([x, y[~settled]]) for x, y in zip(held, whole, strict=True)]
            yield from settle(cols, len(held[0]), False)
    if len(held[0]) and not hot:
        yield from settle(held, len(held[0]), True)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, base, text, wanted -> anchor, doc_id, base, start, content: the text of the strings, or each one's own if the anchor is hot."""
    names = ["anchor", "doc_id", "base", "start", "content"]
    for batch in batches:
        for part in pieces(batch, 2):
            data, off = text_bytes(part.column(2))
            text, lists = data.tobytes(), part.column(3)
            own, begin = lists.flatten(), np.asarray(lists.offsets, np.int64)
            doc = np.repeat(np.arange(part.num_rows), np.diff(begin))
            start, n, anchor, kind = (own.field(i).to_numpy() for i in range(4))
            ids, base = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
            calm = np.flatnonzero(kind == PERHAPS)
            a = (off[doc] + start - base)[calm]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[calm]), pa.array(ids[calm]), pa.array(base[calm]), pa.array(start[calm]), pa.array([text[i:j] for i, j in zip(a, a + n[calm] - 1 + LENGTH, strict=True)], pa.binary())], names=names)
            for i in np.flatnonzero(kind == HOT_PERHAPS):
                s = off[doc[i]] + start[i] - base[i] + np.arange(n[i])
                key = _content_hashes(data, s, s + LENGTH).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(s), ids[i])), pa.array(np.full(len(s), base[i])), pa.array(start[i] + np.arange(n[i])), pa.array([text[j : j + LENGTH] for j in s], pa.binary())], names=names)


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of a byte text in order of their first `depth` bytes, by two-stage sorting.

    A suffix whose first byte is not above the next one is sorted directly, eight bytes at a time and only among those that
    still tie. Each of the others begins with a byte above the next, so it follows from a bucket before its own: as
    the buckets are passed in order, each suffix found puts the one before it at the end of that one's bucket.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    after = np.append(text[1:], np.uint8(0)).astype(np.int16)
    after[-1] = -1
    direct = np.flatnonzero(text <= after)
    keys = _eight(text, ">u8")
    order = direct[np.argsort(keys[direct].astype(_U), kind="stable")]
    first = keys[order].astype(_U)
    fresh = np.ones(len(order), bool)
    fresh[1:] = first[1:] != first[:-1]
    for d in range(8, depth, 8):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(fresh)[at]
        to = order[at] + d
        more = np.where(to < n, keys[np.minimum(to, n - 1)].astype(_U), _U(0))
        by = np.lexsort((more, group))
        order[at] = order[at][by]
        group, more = group[by], more[by]
        fresh[at[1:]] = (group[1:] != group[:-1]) | (more[1:] != more[:-1])
    bucket = np.searchsorted(text[order], np.arange(257))
    before = np.concatenate([[-1], text[:-1].astype(np.int16)])
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))  # the end of the text is below every byte
    out = []
    for c in np.unique(text).tolist():
        now = np.concatenate([*induced[c], order[bucket[c] : bucket[c + 1]]])  # those followed by a lower byte come first
        out.append(now)
        prev = before[now]
        up = np.flatnonzero(prev > c)
        if len(up):
            by = up[np.argsort(prev[up], kind="stable")]
            p = prev[by]
            cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            for i, a in enumerate(cut):
                b = cut[i + 1] if i + 1 < len(cut) else len(by)
                induced[p[a]].append(now[by[a:b]] - 1)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, array: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Whether each suffix of the array shares its first `depth` bytes with the one before it; False for the first."""
    n = len(text)
    keys = _eight(text, ">u8")
    a, b = array[1:], array[:-1]
    same = (a + depth <= n) & (b + depth <= n)
    for d in [*range(0, depth - 7, 8), depth - 8]:
        at = np.flatnonzero(same)
        same[at] = keys[a[at] + d] == keys[b[at] + d]
    return np.concatenate([[False], same])


def _hopeful(anchors_: np.ndarray, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which records can share a string of LENGTH bytes with another one of their anchor.

    A shared string has its anchor at the same place in both, and at least half of the other bytes on one side of it.
    """
    half = (LENGTH - K + 1) // 2
    e = _eight(text, "<u8")
    h = _gram_hashes(e, len(text) - K + 1)
    record = np.repeat(np.arange(len(begin)), size)
    at = np.flatnonzero(h == anchors_.view(_U)[record[: len(h)]])  # a record may hold its anchor twice: each place counts
    own, end = record[at], begin + size
    keep = np.ones(len(begin), bool)
    keep[own] = False  # the others, of hot anchors, are keyed by their strings
    for side, room in ((at - half, at - half >= begin[own]), (at + K, at + K + half <= end[own])):
        i = np.flatnonzero(room)
        key = mix(anchors_[own[i]].view(_U) ^ _U(1))
        for d in range(0, half, 8):
            key = mix(key ^ e[side[i] + d])
        _, which, n = np.unique(key, return_inverse=True, return_counts=True)
        keep[own[i[n[which] > 1]]] = True
    return keep


def _later(anchors_: np.ndarray, docs: np.ndarray, bases: np.ndarray, starts: np.ndarray, contents: list[bytes]) -> list[np.ndarray]:
    """doc_id, base, from, to of the bytes in strings that some earlier record, or an earlier place of the same one, holds too."""
    size = np.array([len(c) for c in contents])
    text = np.frombuffer(b"".join(contents), np.uint8)
    begin = np.cumsum(size) - size
    keep = _hopeful(anchors_, text, begin, size)
    text = text[np.repeat(keep, size)]
    docs, bases, starts, size = docs[keep], bases[keep], starts[keep], size[keep]
    begin = np.cumsum(size) - size
    if len(size) < 2:
        return [np.zeros(0, np.int64)] * 4
    array = suffix_array(text)
    record = np.searchsorted(begin, array, side="right") - 1
    whole = array + LENGTH <= (begin + size)[record]
    same = common_prefixes(text, array)
    group = np.cumsum(~same)[whole]
    array, record = array[whole], record[whole]
    place = starts[record] + array - begin[record]
    order = np.lexsort((place, docs[record], group))
    group, record, array, place = group[order], record[order], array[order], place[order]
    again = np.concatenate([[False], group[1:] == group[:-1]])
    # the same place may be held by two records: it isn't earlier than itself
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(group))))
    again &= (docs[record] != docs[record[head]]) | (place != place[head])
    at = np.sort(array[again])
    rec = np.searchsorted(begin, at, side="right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (rec[1:] != rec[:-1])])) if len(at) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(at))[: len(cut)] - 1
    move = starts[rec[cut]] - begin[rec[cut]]
    return [docs[rec[cut]], bases[rec[cut]], at[cut] + move, at[ends] + move + LENGTH]


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From records sorted by anchor, document and start: the bytes to remove. Equal contents of one anchor (strings of hot ones) need no sorting."""
    spans: list[tuple[int, int, int, int]] = []
    anchor, seen, group = None, {}, []
    block: list[tuple[int, int, int, int, bytes]] = []
    held = 0

    def out(cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["doc_id", "base", "from", "to"])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal block, held
        if block:
            *numbers, contents = zip(*block, strict=True)
            yield out(_later(*(np.array(x, np.int64) for x in numbers), list(contents)))
        block, held = [], 0

    for batch in batches:
        for key, doc, base, start, content in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if key != anchor:
                if len(group) > 1:
                    block.extend(group)
                    held += sum(len(r[4]) for r in group)
                anchor, seen, group = key, {}, []
                if held >= ARRAY:
                    yield from flush()
            earlier = seen.get(content)
            if earlier is None:
                seen[content] = (doc, start)
                group.append((key, doc, base, start, content))
            elif earlier != (doc, start):
                spans.append((doc, base, start, start + len(content)))
        if len(spans) >= 4096:
            yield out(zip(*spans, strict=True))
            spans = []
    if len(group) > 1:
        block.extend(group)
    yield from flush()
    if spans:
        yield out(zip(*spans, strict=True))


#: So many document ids are sent to all tasks at most, 8 bytes each; more are joined by a shuffle.
FEW = 1 << 20


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs with an id in ids (doc_id, distinct)."""
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_semi")


def parts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with base: 0, but where rows share a doc_id, the bytes before theirs; equal texts share it. often: whether rows do."""
    often = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "often")
    if often.isEmpty():
        return docs.withColumn("base", F.lit(0).cast("long")).withColumn("often", F.lit(False))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    texts = docs.join(often, "doc_id", "left_semi").select("doc_id", sha.alias("sha"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).distinct()
    texts = running(texts.withColumn("bucket", F.substring("sha", 1, 3)), "doc_id", "bucket", ["sha"], F.col("size") + LENGTH)  # so that runs of two parts never touch
    placed = docs.withColumn("sha", sha).join(texts.select("doc_id", "sha", F.col("before").cast("long").alias("base")), ["doc_id", "sha"], "left")
    return placed.select(*docs.columns, F.coalesce("base", F.lit(0)).alias("base"), F.col("base").isNotNull().alias("often"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, from, to: byte ranges, which may overlap, that repeat earlier text. docs: doc_id (not null), base, text, each part once."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", "base", "text").mapInArrow(_anchored, "anchor long, doc_id long, base long, start long, n int, content long, settled boolean")
    # what is settled needs no neighbours, so it stays out of the way of its anchor
    key = F.when(F.col("settled"), F.xxhash64("doc_id", "start")).otherwise(F.col("anchor"))
    found = found.withColumn("key", key).repartition("key").drop("key").sortWithinPartitions("settled", "anchor", "doc_id", "start")
    rows = written(found.mapInArrow(_compared, "doc_id long, base long, start long, n int, anchor long, kind int"), "repeats")
    again = rows.where(F.col("kind") == AGAIN).select("doc_id", "base", F.col("start").alias("from"), (F.col("start") + F.col("n") + (LENGTH - 1)).cast("long").alias("to"))
    perhaps = rows.where(F.col("kind") != AGAIN)
    wanted = perhaps.groupBy("doc_id", "base").agg(F.collect_list(F.struct("start", "n", "anchor", "kind")).alias("wanted"))
    some = only(docs, perhaps.select("doc_id").distinct()).join(wanted, ["doc_id", "base"]).select("doc_id", "base", "text", "wanted")
    records = some.mapInArrow(_records, "anchor long, doc_id long, base long, start long, content binary")
    sorted_out = records.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(_sorted_out, "doc_id long, base long, from long, to long")
    return again.unionByName(sorted_out)


def union_of(ranges) -> "F.Column":
    """Maximal runs, in order, of an array of (from, to)."""
    kind = "struct<from:bigint,to:bigint>"
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("last"))

    def step(s, r):
        last = s["last"]
        wider = F.struct(s["done"].alias("done"), F.struct(last["from"].alias("from"), F.greatest(last["to"], r["to"]).alias("to")).alias("last"))
        return F.when(last.isNull(), F.struct(s["done"].alias("done"), r.alias("last"))).when(r["from"] <= last["to"], wider).otherwise(F.struct(F.concat(s["done"], F.array(last)).alias("done"), r.alias("last")))

    return F.aggregate(F.array_sort(ranges), zero, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw, at, out = (text or "").encode(), 0, []
            for r in runs:
                out.append(raw[at : r["from"]])
                at = r["to"]
            kept.append(b"".join([*out, raw[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(kept, pa.binary())], names=["doc_id", "base", "runs", "kept"])


def _named(docs: DataFrame, text_col: str, key_col: str) -> DataFrame:
    return parts(docs.select(docs[key_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")))


def remove_repeats(named: DataFrame) -> DataFrame:
    """(doc_id, base, runs, kept) of the parts of documents that lose bytes: the maximal runs removed, from the part's own
    beginning, and the bytes that stay. named: what parts() makes of documents.
    """
    whole = named.where("doc_id is not null")
    once = whole.where("not often").unionByName(whole.where("often").dropDuplicates(["doc_id", "base"]))
    own = F.transform("runs", lambda r: F.struct((r["from"] - F.col("base")).alias("from"), (r["to"] - F.col("base")).alias("to")))
    runs = spans(once).groupBy("doc_id", "base").agg(union_of(F.collect_set(F.struct("from", "to"))).alias("runs"))
    runs = written(runs.select("doc_id", "base", own.alias("runs")), "runs")
    return only(once, runs.select("doc_id").distinct()).join(runs, ["doc_id", "base"]).select("doc_id", "base", "text", "runs").mapInArrow(_cut, "doc_id long, base long, runs array<struct<from:long,to:long>>, kept binary")


def digest(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty text: no bytes, nothing removed. Documents with a null doc_id keep everything and remove nothing from
    others. Rows that share a doc_id are parts of one document, in the order of the hashes of their texts; matches never cross
    parts, rows of equal text are one part, and each row has its part's result. doc_id must be a whole number.
    """
    own = _named(docs, text_col, key_col)
    whole = own.select("doc_id", "base", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    less = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["to"] - r["from"])
    cut = remove_repeats(own).select("doc_id", "base", less.alias("removed"), F.size("runs").cast("long").alias("spans"), F.sha2("kept", 256).alias("cut_sha"))
    out = whole.join(cut, ["doc_id", "base"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("spans", F.lit(0)).alias("n_spans"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))
