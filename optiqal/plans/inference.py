"""Embeddings and captions by a model that the caller supplies, in batches inside the tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a batch, and bytes of text or binary data after which a batch is full before.
BATCH, BATCH_BYTES = 64, 32 << 20
#: make_model() gives a function from a list of items (bytes, text, numbers or lists, never null) to as many results.
MakeModel = Callable[[], Callable[[list], Any]]
_MODELS: dict[str, Callable[[list], Any]] = {}


def _model(name: str, make_model: MakeModel) -> Callable[[list], Any]:
    """The worker's one model of that name: workers live on from task to task, and so does what they have loaded."""
    if name not in _MODELS:
        _MODELS[name] = make_model()
    return _MODELS[name]


def _ask(model: Callable[[list], Any], items: list) -> list[tuple[Any, str | None]]:
    """(result, error) for each item. A batch that fails is asked again item by item, so only what fails by itself has an error."""
    try:
        found = list(model(items))
        if len(found) != len(items):
            raise ValueError(f"{len(found)} results for {len(items)} items")
        return [(x, None) for x in found]
    except Exception as e:  # whatever a model raises is the item's own error
        if len(items) == 1:
            return [(None, f"{type(e).__name__}: {str(e)[:500]}")]
        return [_ask(model, [x])[0] for x in items]


def infer(df: DataFrame, make_model: MakeModel, item: Column, result: str, kind: str, error: str | None = None, batch: int = BATCH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """df with column `result` of that kind (a SQL type), what the model makes of `item`; columns of the same names are replaced.

    Items may be texts, binary data, numbers or arrays of any size. Batches have `batch` items, or fewer once they hold
    batch_bytes, and run on over the borders of Arrow's batches. Null items have a null result. An item that the model fails
    on has a null result and its message in column `error`, if one is named; else the failure ends the job. A model is made
    once in each worker.
    """
    df = df.drop(result, *([error] if error else []))
    names = df.columns
    rows = df.select(F.struct(*[df[n] for n in names]).alias("row"), item.alias("item"))
    code = cloudpickle.dumps(make_model)
    name = hashlib.sha256(code).hexdigest()
    out = df.sparkSession.createDataFrame([], f"row {rows.schema['row'].dataType.simpleString()}, result {kind}, error string").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in out.fields[1:]]
        model = _model(name, cloudpickle.loads(code))
        held: list[pa.Array] = []  # rows that wait for the batch to fill
        waiting: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            known = [x for x in waiting if x is not None]
            answers = iter(_ask(model, known) if known else [])
            found = [(None, None) if x is None else next(answers) for x in waiting]
            if error is None and (bad := next((e for _, e in found if e), None)):
                raise RuntimeError(f"the model failed: {bad}")
            plain = [x.tolist() if hasattr(x, "tolist") else x for x, _ in found]
            whole = pa.concat_arrays(held)
            held.clear(), waiting.clear()
            return pa.RecordBatch.from_arrays([whole, pa.array(plain, types[0]), pa.array([e for _, e in found], types[1])], names=["row", "result", "error"])

        for arrow in batches:
            row, items = arrow.column(0), arrow.column(1)
            from_ = 0
            for i in range(arrow.num_rows):
                x = items[i].as_py()
                waiting.append(x)
                size += len(x) if isinstance(x, (bytes, str)) else 8 * len(x) if isinstance(x, list) else 8
                if len(waiting) >= batch or size >= batch_bytes:
                    held.append(row.slice(from_, i + 1 - from_))
                    from_, size = i + 1, 0
                    yield flush()
            if from_ < arrow.num_rows:
                held.append(row.slice(from_))
        if waiting:
            yield flush()

    made = rows.mapInArrow(run, out)
    return made.select(*[F.col(f"row.`{n}`") for n in names], F.col("result").alias(result), *([F.col("error").alias(error)] if error else []))


def embed_images(images: DataFrame, make_model: MakeModel, column: str = "data", batch: int = BATCH, error: str | None = None) -> DataFrame:
    """Images with clip_embeddings; the model gets batches of the column's values. See infer."""
    return infer(images, make_model, F.col(column), "clip_embeddings", "array<float>", error, batch)


def label_prompt(label: Column) -> Column:
    return F.concat(F.lit("a "), label)


def embed_labels(labels: DataFrame, make_model: MakeModel, batch: int = BATCH, error: str | None = None) -> DataFrame:
    """Labels with the embedding of their prompt."""
    return infer(labels, make_model, label_prompt(F.col("label")), "embedding", "array<float>", error, batch)


def caption_images(images: DataFrame, make_model: MakeModel, column: str = "data", batch: int = BATCH, error: str | None = None) -> DataFrame:
    """Images with one caption each."""
    return infer(images, make_model, F.col(column), "caption", "string", error, batch)
