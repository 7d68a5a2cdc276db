"""MinHash near-duplicates with an LSH forest over sorted signature orders.

A document's set is its distinct five-word shingles. Documents with equal sets are one node. Each of TREES orders of the
signature begins with other components; nodes that agree in the first DEPTH of them form a region. A region with many
nodes goes deeper, by its size, and is walked in signature order, so that a node meets those with which it shares the
longest prefixes. Candidates are linked only if their full sets, compared shingle by shingle, are similar enough. What this
walk passes over is looked at again: the full sets of each region at DEPTH that links have not yet brought together meet in
blocks, all against all, and only links that join classes leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiqal.functions.graph import components, written
from optiqal.llm._shared import pieces, small_batches
from optiqal.llm._words import VISIBLE, grams, hashes, mix, room, split

SHINGLE = 5
DEPTH, TREES = 4, 24
K = DEPTH * TREES
#: A region of more nodes than this goes deeper: by two components for each doubling.
ROOMY = 1024
#: Nodes of a region that are compared at a time; the next window keeps the last half.
WINDOW = 512
#: In a window of more nodes than this, a node keeps its nearest ones and the two that are nearest to all.
NEAREST = 6
#: Elements of the sets of a block, in all, when whole regions are compared.
_BLOCK_SET = 1 << 17
#: Share of agreeing components from which a candidate is compared in full; 0.75 is 4.5 standard deviations above it.
HOPEFUL = 0.55

_U = np.uint64
_A = mix(np.arange(1, K + 1, dtype=_U)) | _U(1)
_B = mix(np.arange(K + 1, 2 * K + 1, dtype=_U))


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sets, first): hashes of the distinct shingles of each text, sorted, one set after another; set i begins at first[i]."""
    w = split(text, VISIBLE)
    h, left = hashes(w), room(w)
    count = np.diff(w.first)
    g = grams(h, SHINGLE)
    x = np.concatenate([g[left[: len(g)] >= SHINGLE], np.zeros(0, _U)])
    size = np.maximum(count - SHINGLE + 1, 0)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):  # their one shingle is the whole sequence
        whole = np.array([int(mix(grams(h[w.first[i] : w.first[i + 1]], int(count[i])) + _U(count[i]))[0]) for i in short], _U)
        x = np.insert(x, (np.cumsum(size) - size)[short], whole)
        size[short] = 1
    first = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(first[:-1], first[1:], strict=True):
        x[a:b].sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[first[:-1][size > 0]] = True
    return x[new], np.concatenate([[0], np.cumsum(new)])[first]


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per set K minima of 32 bits; empty sets have none and keep zeros."""
    out = np.zeros((len(first) - 1, K), np.uint32)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        h = mix(sets)
        for k in range(K):
            out[full, k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> _U(32)).astype(np.uint32), first[:-1][full])
    return out


def nodes_of(sets: np.ndarray, first: np.ndarray) -> list:
    """16 bytes that equal sets share; None for an empty set."""
    full = np.flatnonzero(first[1:] > first[:-1])
    out: list = [None] * (len(first) - 1)
    if len(full):
        size = (first[1:] - first[:-1])[full].astype(_U)
        one = mix(np.add.reduceat(mix(sets), first[:-1][full]) + size)
        two = mix(np.add.reduceat(mix(sets ^ _B[0]), first[:-1][full]) ^ size)
        both = np.stack([one, two], 1)
        for i, x in zip(full, both, strict=True):
            out[i] = x.tobytes()
    return out


def _keys(sig: np.ndarray) -> np.ndarray:
    """The region of each node in each order, at DEPTH: a hash of the order's first components and of the order itself."""
    parts = sig.reshape(len(sig), TREES, DEPTH).astype(_U)
    h = np.arange(TREES, dtype=_U)[None, :] + _U(1)
    for j in range(DEPTH):
        h = mix(h ^ parts[:, :, j])
    return h.view(np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1):
            sets, first = shingles(part.column(1))
            sig = signatures(sets, first)
            keys = _keys(sig)
            full = first[1:] > first[:-1]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(first), pa.int64()), pa.array(nodes_of(sets, first), pa.binary()), pa.array([s.tobytes() if f else None for s, f in zip(sig, full, strict=True)], pa.binary()), pa.array([k if f else [] for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "node", "sig", "keys"],
            )


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The region of each (node, order) at the depth that the region's size asks for, and the signature in that order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, K)
        tree, n = batch.column("tree").to_numpy(), batch.column("n").to_numpy()
        turn = np.take_along_axis(sig, (np.arange(K)[None, :] + tree[:, None] * DEPTH) % K, 1)
        extra = np.minimum(2 * np.ceil(np.log2(np.maximum(n / ROOMY, 1))).astype(np.int64), K - DEPTH)
        region = batch.column("key").to_numpy().astype(np.int64).view(_U).copy()
        for j in range(int(extra.max())):
            deep = extra > j
            region[deep] = mix(region[deep] ^ turn[deep, DEPTH + j].astype(_U) ^ _U(j + 1))
        yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), batch.column("node"), pa.array([x.tobytes() for x in turn.astype(">u4")], pa.binary())], names=["region", "node", "turn"])


def _pairs_in(nodes: list, sig: np.ndarray, old: int) -> tuple[list, list]:
    """Candidate pairs of a window of one region; its first `old` rows have met one another before."""
    m = len(nodes)
    like = np.zeros((m, m), np.int16)
    for k in range(K):
        like += sig[:, k][:, None] == sig[:, k][None, :]
    np.fill_diagonal(like, -1)
    hope = like >= HOPEFUL * K
    if m > NEAREST + 2:
        near = np.zeros_like(hope)
        top = np.argpartition(-like, NEAREST, axis=1)[:, :NEAREST]
        near[np.arange(m)[:, None], top] = True
        near[:, np.argsort(-like.sum(1), kind="stable")[:2]] = True
        hope &= near | near.T
    i, j = np.nonzero(np.triu(hope, 1))
    keep = j >= old
    return [nodes[x] for x in i[keep]], [nodes[x] for x in j[keep]]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates from rows sorted by region and signature: each region in windows, of which one is held at a time."""
    now, nodes, sigs, old = None, [], [], 0
    a: list = []
    b: list = []

    def met(keep: int) -> None:
        nonlocal nodes, sigs, old
        if len(nodes) > max(old, 1):
            x, y = _pairs_in(nodes, np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, K), old)
            a.extend(x), b.extend(y)
        nodes, sigs = nodes[len(nodes) - keep :], sigs[len(sigs) - keep :]
        old = keep

    for batch in batches:
        for region, node, turn in zip(*(batch.column(c).to_pylist() for c in ("region", "node", "turn")), strict=True):
            if region != now:
                met(0)
                now = region
            elif len(nodes) == WINDOW:
                met(WINDOW // 2)
            nodes.append(node), sigs.append(turn)
        if len(a) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            a, b = [], []
    met(0)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1):
            sets, first = shingles(part.column(1))
            same = [i for i, (x, y) in enumerate(zip(nodes_of(sets, first), part.column(0).to_pylist(), strict=True)) if x == y]
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0)[i].as_py() for i in same], pa.binary()), pa.array([sets[first[i] : first[i + 1]].tobytes() for i in same], pa.binary())], names=["node", "full"])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("full_a"), batch.column("full_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def describe(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, node, sig and keys of each document."""
    small_batches(docs.sparkSession)
    x = docs.select(docs[key_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return x.mapInArrow(_described, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, n_shingles long, node binary, sig binary, keys array<long>")


def nodes(described: DataFrame) -> DataFrame:
    """node, size, sig and keys of each set."""
    return written(described.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "nodes")


def candidates(node: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that the walk through the forest brings together, each once, a < b."""
    keys = node.select("node", F.posexplode("keys").alias("tree", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(shared, "key").join(node.select("node", "sig"), "node")
    regions = met.select("node", "key", "tree", "n", "sig").mapInArrow(_deeper, "region long, node binary, turn binary")
    walked = regions.repartition("region").sortWithinPartitions("region", "turn", "node").mapInArrow(_walk, "a binary, b binary")
    return walked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many elements each set of left has in common with each of right, by products of 0/1 matrices, some columns at a time."""
    rows = np.concatenate([left, right[~np.isin(right, left)]])
    place = {r: i for i, r in enumerate(rows.tolist())}
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, which, n = np.unique(np.concatenate([np.zeros(0, _U), *(sets[r] for r in rows)]), return_inverse=True, return_counts=True)
    often = n > 1  # what one set alone has is in no intersection
    number = np.cumsum(often) - 1
    keep = often[which]
    owner, which = owner[keep], number[which[keep]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    out = np.zeros((len(left), len(right)))
    i, j = [place[x] for x in left.tolist()], [place[x] for x in right.tolist()]
    for at in range(0, int(often.sum()), columns):
        a, b = np.searchsorted(which, [at, at + columns])
        m = np.zeros((len(rows), columns), np.float32)
        m[owner[a:b], which[a:b] - at] = 1
        out += m[i] @ m[j].T
    return out


def _joined(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Pairs of labels that links between two blocks (or within one) of a region join; no more than labels are."""
        sets = [np.frombuffer(x.as_buffer(), _U) for x in group.column("full")]
        names, label = np.unique(np.array(group.column("label").to_pylist(), object), return_inverse=True)
        block = group.column("block").to_numpy()
        left = np.flatnonzero(block == group.column("lo")[0].as_py())
        right = np.flatnonzero(block == group.column("hi")[0].as_py())
        size = np.array([len(x) for x in sets])
        common = shared_counts(sets, left, right) if len(left) and len(right) else np.zeros((len(left), len(right)))
        alike = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
        i, j = np.nonzero(alike & (label[left][:, None] != label[right][None, :]))
        least = list(range(len(names)))

        def root(x: int) -> int:
            while least[x] != x:
                least[x] = x = least[least[x]]
            return x

        found = []
        for x, y in np.unique(np.sort(np.stack([label[left[i]], label[right[j]]]), axis=0), axis=1).T.tolist():
            p, q = root(x), root(y)
            if p != q:
                least[max(p, q)] = min(p, q)
                found.append((names[x], names[y]))
        return pa.table({"x": pa.array([a for a, _ in found], pa.binary()), "y": pa.array([b for _, b in found], pa.binary())})

    return run


def passed_over(docs: DataFrame, described: DataFrame, node: DataFrame, labels: DataFrame, percent: int = 75, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(x, y): labels that links join, of nodes (node, label) that share a region at DEPTH.

    Regions that the walk takes as one small window are whole already, and those of one label have nothing to join.
    """
    known = node.select("node", "size", "keys").join(labels, "node")
    kinds = known.select(F.explode("keys").alias("key"), F.xxhash64("label").alias("kind"), "size").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("kind").alias("least"), F.max("kind").alias("most"))
    blocks = F.ceil(F.greatest(F.col("n") / WINDOW, F.col("total") / _BLOCK_SET))
    mixed = written(kinds.where((F.col("n") > NEAREST + 2) & (F.col("least") != F.col("most"))).select("key", blocks.alias("blocks")), "mixed")
    met = written(known.select("node", "label", F.explode("keys").alias("key")).join(mixed, "key"), "met")
    met_sets = full_sets(docs, described, met.select("node").distinct(), text_col, key_col)
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "label").join(met_sets, "node")
    return met.groupBy("key", "lo", "hi").applyInArrow(_joined(percent), "x binary, y binary").distinct()


def full_sets(docs: DataFrame, described: DataFrame, wanted: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(node, full) of the nodes wanted, each once, from the text of one document that has the set."""
    holder = described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node")
    text = docs.select(docs[key_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    full = text.join(holder, "doc_id").select("node", "text").mapInArrow(_full_sets, "node binary, full binary")
    return written(full.groupBy("node").agg(F.first("full").alias("full")), "sets")


def links(docs: DataFrame, described: DataFrame, pairs: DataFrame, percent: int = 75, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(a, b): those of the pairs whose full sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    full = full_sets(docs, described, wanted, text_col, key_col)
    x = pairs.join(full.select(F.col("node").alias("a"), F.col("full").alias("full_a")), "a").join(full.select(F.col("node").alias("b"), F.col("full").alias("full_b")), "b")
    return x.mapInArrow(_linked(percent), "a binary, b binary")


def classes(docs: DataFrame, percent: int = 75, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept.

    Null, empty or blank text: no shingles, linked with nothing, kept. Fewer than five words: the whole sequence is the
    one shingle. Equal sets are linked. Rows that share a doc_id are judged by their own texts and are all kept if it is
    the smallest. doc_ids may be of any type that has an order. Null doc_ids are linked but name no component: alone, theirs is null and they are kept.
    """
    described = written(describe(docs, text_col, key_col), "described")
    node = nodes(described)
    pairs = written(candidates(node), "pairs")
    found = components(links(docs, described, pairs, percent, text_col, key_col))
    labels = written(node.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("label")), "labels")
    wider = components(passed_over(docs, described, node, labels, percent, text_col, key_col), "x", "y").select(F.col("node").alias("label"), "component")
    own = described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = own.join(labels, "node").join(wider, "label", "left").withColumn("component", F.coalesce("component", "label"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    out = described.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicate(docs: DataFrame, percent: int = 75, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """The rows of docs of which the document is kept, with the columns of docs."""
    gone = classes(docs, percent, text_col, key_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[key_col].eqNullSafe(F.col("__gone")), "left_anti")
