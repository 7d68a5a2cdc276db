"""Row-carrying helpers of the training-data operators: bounded batches and pieces of text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def annotate(docs: DataFrame, text_col: str, result: T.StructType, work: Callable[[pa.Array], list], piece: int | None = None) -> DataFrame:
    """Two columns: `row`, the untouched input row, and `found`, what work makes of the text column.

    The input's columns stay inside `row`, so none of them can clash with a result.
    work gets one Arrow array of texts, of about `piece` bytes (PIECE if not given), and returns the fields of `found`.
    """
    types = [f.dataType for f in result.fields]
    names = [f.name for f in result.fields]

    plain = isinstance(docs.schema[text_col].dataType, T.StringType)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t) for t in types]
        for batch in batches:
            texts = batch.column(0).field(at) if plain else batch.column(1)
            for a, n in cuts(texts, piece or PIECE):
                row, text = batch.column(0).slice(a, n), texts.slice(a, n)
                made = work(text)
                found = pa.StructArray.from_arrays([x.cast(k) if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)], names=names)
                yield pa.RecordBatch.from_arrays([row, found], names=["row", "found"])

    small_batches(docs.sparkSession)
    inputs = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *([] if plain else [docs[text_col].cast("string").alias("text")]))
    return inputs.mapInArrow(run, T.StructType([T.StructField("row", inputs.schema["row"].dataType), T.StructField("found", result)]))


#: Bytes of a batch that Spark hands to a task's Python; a larger row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not only by rows: rows may hold long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Bytes of text that a task works on at once; NumPy temporaries are a small multiple of it.
PIECE = 1 << 20


def cuts(text: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices with about `limit` bytes of text each; a longer text is a slice of its own."""
    import numpy as np

    off = text_offsets(text)
    ends, at, n = off[1:] - off[0], 0, len(text)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to - at
        at = to


def pieces(batch: pa.RecordBatch, text: int, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows by the bytes of the text column of that number."""
    for a, n in cuts(batch.column(text), limit):
        yield batch.slice(a, n)


def text_offsets(text: pa.Array):
    """Byte offsets (rows + 1) into the data buffer of a string array."""
    import numpy as np

    wide = pa.types.is_large_string(text.type)
    kind = np.int64 if wide else np.int32
    raw = text.buffers()[1]
    if raw is None or len(text) == 0:
        return np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(raw, kind, len(text) + 1, text.offset * np.dtype(kind).itemsize).astype(np.int64)


def text_bytes(text: pa.Array):
    """(bytes, offsets): the UTF-8 bytes of all rows, one after another, and where each row begins and ends in them."""
    import numpy as np

    off = text_offsets(text)
    data = text.buffers()[2]
    if data is None or len(off) < 2 or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])), off - off[0]
