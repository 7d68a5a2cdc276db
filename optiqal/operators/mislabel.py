"""Suspected mislabels: a shape's vector against the vectors of all labels.

Shapes are judged where they lie, some at a time, by matrix products with the label vectors; what is kept of a shape is its own
similarity, the best one, and two counts, however many labels there are. Label vectors of more than LABEL_BYTES go in blocks of
about that size, which meet the shapes in parts of as much.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiqal.functions.graph import written

c = F.col
#: Labels up to which the simpler rule holds.
FEW_LABELS = 10
#: Bytes of label vectors, or of shape vectors, that a task holds.
LABEL_BYTES = 64 << 20
#: Similarities that a task holds at once.
CELLS = 1 << 21
#: The similarity of vectors that have none: of another size, without a direction, or with what is not a number.
NONE = -2.0


class Labels:
    """Label vectors in order of their names; equal vectors are multiplied once, so that they tie exactly."""

    def __init__(self, names: list[str], vectors: list[np.ndarray]):
        order = sorted(range(len(names)), key=lambda i: names[i].encode())
        self.names = [names[i] for i in order]
        self.keys = [x.encode() for x in self.names]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {len(v) for v in vectors if v is not None} - {0}:
            at = np.array([k for k, i in enumerate(order) if vectors[i] is not None and len(vectors[i]) == size])
            units, ok = _units(np.stack([vectors[order[k]] for k in at]))
            distinct, which = np.unique(units[ok], axis=0, return_inverse=True)
            self.by_size[size] = at[ok], distinct, which.ravel()

    def similarities(self, size: int, vectors: np.ndarray) -> np.ndarray:
        out = np.full((len(vectors), len(self.names)), NONE)
        if size in self.by_size:
            at, distinct, which = self.by_size[size]
            units, ok = _units(vectors)
            products = np.einsum("id,jd->ij", units[ok], distinct)  # unlike a BLAS call, the same for a pair in any company
            out[np.ix_(np.flatnonzero(ok), at)] = products[:, which]
        return out


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((x * x).sum(1))
    ok = np.isfinite(length) & (length > 0)
    return np.divide(x, length[:, None], out=np.zeros_like(x), where=ok[:, None]), ok


def _labels_of(table: pa.Table | pa.RecordBatch) -> Labels:
    return Labels(table.column("name").to_pylist(), _arrays(table.column("e")))


def _arrays(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray | None]:
    return [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) if v.is_valid else None for v in column]


def _chunks(vectors: list[np.ndarray], labels: Labels) -> Iterator[tuple[list[int], np.ndarray]]:
    """(rows, similarities) of the vectors with all labels, a few rows at a time."""
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_size.setdefault(len(v), []).append(i)
    few = max(1, CELLS // max(1, len(labels.names)))
    for size, rows in by_size.items():
        for at in range(0, len(rows), few):
            some = rows[at : at + few]
            yield some, labels.similarities(size, np.stack([vectors[i] for i in some]))


def _best(vectors: list[np.ndarray], own_names: list, labels: Labels) -> dict[str, list]:
    """own: the similarity to the row's own label (null if it is not here); top, top_label: the best one, ties by name."""
    out: dict[str, list] = {k: [None] * len(vectors) for k in ("own", "top", "top_label")}
    for rows, s in _chunks(vectors, labels) if labels.names else ():
        best = s.argmax(1)
        for k, i in enumerate(rows):
            name = own_names[i]
            if name is not None:
                a = bisect_left(labels.keys, name.encode())
                same = 0
                while a + same < len(labels.keys) and labels.names[a + same] == name:
                    same += 1
                out["own"][i] = float(s[k, a : a + same].max()) if same else None
            out["top"][i], out["top_label"][i] = float(s[k, best[k]]), labels.names[best[k]]
    return out


def _counts(vectors: list[np.ndarray], own_names: list, own: list, top: list, threshold: float, labels: Labels) -> dict[str, list]:
    """ahead: labels more similar than the row's own, or as similar and before it by name; near: those less than threshold behind the best."""
    out: dict[str, list] = {k: [0] * len(vectors) for k in ("ahead", "near")}
    for rows, s in _chunks(vectors, labels) if labels.names else ():
        near = (np.array([top[i] for i in rows])[:, None] - s < threshold).sum(1)
        for k, i in enumerate(rows):
            if own[i] is not None:
                a = bisect_left(labels.keys, own_names[i].encode())
                out["ahead"][i] = int((s[k] > own[i]).sum() + (s[k, :a] == own[i]).sum())
            out["near"][i] = int(near[k])
    return out


def _measured(shapes: DataFrame, labels: DataFrame, threshold: float, vector: str, label_bytes: int) -> tuple[DataFrame, int]:
    """(rows, labels): shapes that have a vector, with own, top, top_label, ahead and near; and how many labels there are."""
    labels = labels.where("label is not null").select(c("label").cast("string").alias("name"), c("embedding").cast("array<double>").alias("e"))
    n, size = labels.agg(F.count("*"), F.coalesce(F.sum(8 * F.coalesce(F.size("e"), F.lit(0)) + F.octet_length("name")), F.lit(0))).first()
    has = shapes.where(c(vector).isNotNull() & (F.size(vector) > 0))
    x = has.select(F.struct(*[has[k] for k in has.columns]).alias("row"), c(vector).cast("array<double>").alias("v"), c("label").cast("string").alias("own_name"))
    types = "own double, top double, top_label string, ahead long, near long"
    if size <= label_bytes:
        sent = shapes.sparkSession.sparkContext.broadcast(labels.toArrow())  # of checked size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = _labels_of(sent.value)
            for batch in batches:
                vectors, names = _arrays(batch.column("v")), batch.column("own_name").to_pylist()
                best = _best(vectors, names, here)
                found = best | _counts(vectors, names, best["own"], best["top"], threshold, here)
                yield pa.RecordBatch.from_arrays([batch.column("row"), *_columns(found)], names=["row", *found])

        return x.mapInArrow(run, f"row {x.schema['row'].dataType.simpleString()}, {types}"), n
    x = written(x.withColumn("id", F.monotonically_increasing_id()), "shapes")
    shape_bytes = x.agg(F.coalesce(F.sum(8 * F.size("v")), F.lit(0))).first()[0]
    blocks, parts = -(-size // max(1, label_bytes)), max(1, -(-shape_bytes // max(1, label_bytes)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    deal = lambda what, k: F.pmod(F.xxhash64(what), F.lit(k)).cast("int")
    held = labels.withColumn("block", deal("name", blocks)).withColumn("part", every(parts)).groupBy("block", "part")
    sent = lambda df: df.withColumn("part", deal("id", parts)).withColumn("block", every(blocks)).groupBy("block", "part")

    def best_of(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _best(_arrays(left.column("v")), left.column("own_name").to_pylist(), _labels_of(right))
        return pa.table([left.column("id"), *_columns(found)], names=["id", *found])

    def count_of(left: pa.Table, right: pa.Table) -> pa.Table:
        own, top = left.column("own").to_pylist(), left.column("top").to_pylist()
        found = _counts(_arrays(left.column("v")), left.column("own_name").to_pylist(), own, top, threshold, _labels_of(right))
        return pa.table([left.column("id"), *_columns(found)], names=["id", *found])

    best = sent(x.select("id", "v", "own_name")).cogroup(held).applyInArrow(best_of, "id long, own double, top double, top_label string")
    first = F.min(F.struct((-c("top")).alias("minus"), c("top_label").alias("name")))
    best = written(best.where("top is not null").groupBy("id").agg(F.max("own").alias("own"), first.alias("b")).select("id", "own", (-c("b.minus")).alias("top"), c("b.name").alias("top_label")), "best")
    counts = sent(x.select("id", "v", "own_name").join(best, "id")).cogroup(held).applyInArrow(count_of, "id long, ahead long, near long")
    counts = counts.groupBy("id").agg(F.sum("ahead").alias("ahead"), F.sum("near").alias("near"))
    return x.join(best, "id").join(counts, "id").select("row", *[t.split()[0] for t in types.split(", ")]), n


def _columns(found: dict[str, list]) -> list[pa.Array]:
    kinds = {"own": pa.float64(), "top": pa.float64(), "top_label": pa.string(), "ahead": pa.int64(), "near": pa.int64()}
    return [pa.array(v, kinds[k]) for k, v in found.items()]


def label_similarities(shapes: DataFrame, labels: DataFrame, top: int | None = None, vector: str = "shape_embeddings", label_bytes: int = LABEL_BYTES) -> DataFrame:
    """shape_id, label, similarity, rank (from 0) of each shape's `top` most similar labels; of all where top is None. Ties go by name.

    Labels of more than label_bytes go block by block and need `top`: a row for each shape and label is meant for few labels.
    """
    names = labels.where("label is not null").select(c("label").cast("string").alias("name"), c("embedding").cast("array<double>").alias("e"))
    size = names.agg(F.coalesce(F.sum(8 * F.coalesce(F.size("e"), F.lit(0)) + F.octet_length("name")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // max(1, label_bytes)))
    if blocks > 1 and top is None:
        raise ValueError(f"{size} bytes of label vectors: ask for the top labels only")
    has = shapes.where(c(vector).isNotNull() & (F.size(vector) > 0)).select("shape_id", c(vector).cast("array<double>").alias("v"))
    kind = f"shape_id {has.schema['shape_id'].dataType.simpleString()}, label string, similarity double, rank int"

    def ranked(here: Labels) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("shape_id")
                for rows, s in _chunks(_arrays(batch.column("v")), here) if here.names else ():
                    order = np.argsort(-s, axis=1, kind="stable")[:, :top]
                    n = order.shape[1]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(rows, n))), pa.array([here.names[i] for i in order.ravel()], pa.string()), pa.array(np.take_along_axis(s, order, 1).ravel()), pa.array(np.tile(np.arange(n, dtype=np.int32), len(rows)))], names=["shape_id", "label", "similarity", "rank"])

        return run

    if blocks == 1:
        sent = shapes.sparkSession.sparkContext.broadcast(names.toArrow())  # of checked size
        return has.mapInArrow(lambda batches: ranked(_labels_of(sent.value))(batches), kind)
    has = written(has, "shapes")
    out = None
    for k in range(blocks):  # each block's best are joined with those of the blocks before
        sent = shapes.sparkSession.sparkContext.broadcast(names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).toArrow())  # label_bytes or so
        found = has.mapInArrow(lambda batches, sent=sent: ranked(_labels_of(sent.value))(batches), kind)
        out = written(found if out is None else _first(out.unionByName(found), top), "top-labels")
        sent.destroy()
    return out


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The `top` best rows of each shape, ranked anew; of two blocks, so 2 * top rows a shape."""
    items = F.array_sort(F.collect_list(F.struct((-c("similarity")).alias("minus"), "label")))
    rows = rows.groupBy("shape_id").agg(F.slice(items, 1, top).alias("items")).select("shape_id", F.posexplode("items").alias("rank", "i"))
    return rows.select("shape_id", "i.label", (-c("i.minus")).alias("similarity"), "rank")


def mislabels(shapes: DataFrame, labels: DataFrame, threshold: float = 0.01, min_confidence: float = 0.5, rank_tolerance: int = 1, vector: str = "shape_embeddings", label_bytes: int = LABEL_BYTES) -> DataFrame:
    """shape_id, label, suggested_label, rank (from 0), similarity, top_similarity, status (correct, wrong or ambiguous) and issue.

    Fewer than FEW_LABELS labels: wrong beyond the tolerated rank, below min_confidence, or behind the best by more than half
    the threshold. Else, among the max(2, 5 %) best labels: ambiguous where these are closer together than the threshold;
    beyond them: wrong if the best is confident and ahead by more than the threshold, ambiguous otherwise. An unknown
    label is wrong, the best one is correct. Shapes without a vector, and labels without a name, take no part.
    """
    x, n = _measured(shapes, labels, threshold, vector, label_bytes)
    if not n:
        x = x.limit(0)
    best = min(max(2, int(n * 0.05)), max(n, 1))
    rank, gap = F.when(c("own").isNotNull(), c("ahead").cast("int")), c("top") - c("own")
    x = x.withColumn("rank", rank)
    few = F.when((c("rank") > rank_tolerance) | (c("own") < min_confidence) | (gap > threshold / 2), "wrong").otherwise("correct")
    close: Column = c("near") >= best  # the best ones are closer together than the threshold if as many are near the first
    many = F.when(c("rank") >= max(2, int(n * 0.05)), F.when((c("top") >= min_confidence) & (gap > threshold), "wrong").otherwise("ambiguous")).when(close, "ambiguous").otherwise("correct")
    x = x.withColumn("status", F.when(c("rank").isNull(), "wrong").when(c("rank") == 0, "correct").otherwise(few if n < FEW_LABELS else many))
    issue = F.when(c("status") == "wrong", "WRONG_CLASS").when(c("status") == "ambiguous", "AMBIGUOUS_CLASS")
    keep = [c(f"row.{k}") for k in ("asset_id", "shape_id", "x", "y", "w", "h") if k in shapes.columns]
    return x.select(*keep, "row.label", c("top_label").alias("suggested_label"), "rank", c("own").alias("similarity"), c("top").alias("top_similarity"), "status", issue.alias("issue"))


def mislabel_report(found: DataFrame) -> DataFrame:
    """Rows with an issue, as actual and expected boxes, with the action UPDATE."""
    box = lambda label: F.struct("x", "y", "w", "h", label.alias("label"))
    return found.where("issue is not null").select("asset_id", "shape_id", "issue", F.struct(box(c("label")).alias("actual"), box(c("suggested_label")).alias("expected")).alias("comparison"), F.array(F.lit("UPDATE")).alias("actions"))
