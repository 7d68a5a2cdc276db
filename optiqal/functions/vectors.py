"""Vectors as array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def parse_vector(v: Column) -> Column:
    """A vector from its text form, a list `[1, 2.5, None]` or a tuple `(1, 2)` of numbers; what cannot be read becomes an empty array.

    None and null are null places, which stay. Numbers may lack digits before or after the point, and a last comma may stand.
    A number in parentheses is no vector.
    """
    text = F.trim(F.regexp_replace(v, r"\s+", " "))
    inner = F.regexp_extract(text, r"^[\[(] ?(.*?) ?,? ?[\])]$", 1)
    for form, plain in ((r"\bNone\b", "null"), (r"(?<![0-9])\.(?=[0-9])", "0."), (r"(?<=[0-9])\.(?![0-9])", ".0"), (r"(?<![0-9eE])\+", "")):
        inner = F.regexp_replace(inner, form, plain)
    read = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<double>", {"mode": "PERMISSIVE"})
    whole = F.regexp_like(text, F.lit(r"^(?:\[.*\]|\(.*,.*\))$"))
    return F.coalesce(F.when(whole, read), F.array().cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


#: Groups whose sums a task holds at once; beyond that it hands them on and begins anew.
GROUPS = 4096


def _sums(keys: int, raw: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys..., vector) or, not raw, (keys..., high, low, n) in order of the keys -> (keys..., high, low, n): sums per group and place in
    extended precision, given as two doubles each, and how many values each has. Nulls in a vector are left out."""

    def rows(names: list[str], held: dict) -> pa.RecordBatch:
        high = [s.astype(np.float64) for s, _ in held.values()]
        low = [np.where(np.isfinite(h), s - h, 0).astype(np.float64) for h, (s, _) in zip(high, held.values(), strict=True)]
        kinds = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*kinds, pa.array(high, pa.list_(pa.float64())), pa.array(low, pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.list_(pa.int64()))], names=[*names, "high", "low", "n"])

    types: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        names: list[str] = []
        for batch in batches:
            names, types[:] = batch.schema.names[:keys], batch.schema.types[:keys]
            for key, *vector in zip(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True) if keys else [()] * batch.num_rows, *batch.columns[keys:], strict=True):
                if raw:
                    v = np.array(vector[0].values.to_numpy(zero_copy_only=False), np.longdouble)
                    n = np.asarray(vector[0].values.is_valid(), np.int64)
                    v[n == 0] = 0
                else:
                    v, n = (np.asarray(vector[0].values, np.longdouble) + np.asarray(vector[1].values)), np.asarray(vector[2].values)
                if key not in held and (len(held) >= GROUPS if raw else held):
                    yield rows(names, held)
                    held = {}
                total, count = held.get(key, (np.zeros(0, np.longdouble), np.zeros(0, np.int64)))
                if len(v) > len(total):
                    total, count = np.append(total, np.zeros(len(v) - len(total), np.longdouble)), np.append(count, np.zeros(len(v) - len(count), np.int64))
                total[: len(v)] += v
                count[: len(v)] += n
                held[key] = total, count
        if held:
            yield rows(names, held)

    return run


def mean_vectors(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """The mean vector of each group, as column `centroid`; by may be empty, and null is a group of its own.

    Each task adds up whole vectors, so what is shuffled is a row per group and task. Sums are kept in extended precision:
    they hardly depend on the order of the rows. A place of a vector is averaged over the vectors that have a number there,
    null if none has. No group without a vector has a row.
    """
    x = df.where(c(vector).isNotNull()).select(*by, c(vector).cast("array<double>").alias("v"))
    kind = "".join(f"`{n}` {x.schema[n].dataType.simpleString()}, " for n in by) + "high array<double>, low array<double>, n array<long>"
    part = x.mapInArrow(_sums(len(by), True), kind)
    part = part.repartition(*by).sortWithinPartitions(*by) if by else part.coalesce(1)  # a row a task
    total = part.mapInArrow(_sums(len(by), False), kind)
    return total.select(*by, F.zip_with(F.zip_with("high", "low", lambda h, e: h + e), "n", lambda s, n: F.when(n > 0, s / n)).alias("centroid"))
