"""Near unit vectors, exactly and at every size: cells around pivots, bounded by the triangle inequality, whose blocks meet inside tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiqal.functions.blocks import blocks_of, in_one_row, meetings
from optiqal.functions.density import Found, Joined, Met
from optiqal.functions.graph import written

c = F.col
#: At most so many vectors serve as pivots, and of fewer rows one for half a block. Any choice gives the same result.
PIVOTS = 1024
#: Vectors of a block, all of one cell, and vectors of a block that are compared with another block at a time.
BLOCK, PART = 2048, 512
#: Bytes of all vectors of a block, but for single ones.
BLOCK_BYTES = 16 << 20
#: Allowance for rounding: of distances between a vector and a pivot, and of cosines.
SLACK, TIE = 1e-6, 1e-12


def units_of(df: DataFrame, vector: str) -> DataFrame:
    """id (from asset_id) and unit, the vector at length 1; null, empty and zero vectors and those with null or non-finite components have no row."""
    v = F.transform(vector, lambda x: x.cast("double"))
    x = df.select(c("asset_id").alias("id"), v.alias("v")).withColumn("most", F.array_max(F.transform("v", F.abs))).where("most > 0 and most < double('Infinity')")
    x = x.select("id", F.transform("v", lambda e: e / c("most")).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    return x.withColumn("length", F.sqrt(squares)).where("length > 0").select("id", F.transform("v", lambda e: e / c("length")).alias("unit"))


def _distance(units: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * units @ at.T))


def _nearest(pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The rows with `cell`, that of the nearest pivot of their dimension, and `own`, the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, rows in pdf.groupby(pdf["unit"].map(len)):
                cell, own = np.full(len(rows), -size), np.zeros(len(rows))  # a dimension without a pivot is one cell
                if size in pivots:
                    names, at = pivots[size]
                    far = _distance(np.stack(rows["unit"].to_list()), at)
                    cell, own = names[far.argmin(axis=1)], far.min(axis=1)
                yield rows.assign(cell=cell, own=own)

    return run


def _packed(room: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows cell, part, id, copies, core, unit in the order of cell and part: blocks of the rows of a part, of about `room` bytes at most."""

    def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(rows)
        units = pa.array([batch.column("unit").flatten().to_numpy().tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("cell").slice(0, 1), *in_one_row(batch, ["id", "copies", "core"]), units], names=["cell", "ids", "copies", "core", "units"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(k).to_numpy() for k in ("cell", "part")])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            for a, b in zip(starts, np.append(starts[1:], len(batch)), strict=True):
                now, bytes_ = tuple(key[:, a].tolist()), 8 * len(batch.column("unit").slice(a, b - a).flatten())
                if held and (now != last or size + bytes_ > room):
                    yield made(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, last = size + bytes_, now
        if held:
            yield made(held)

    return run


class _Block:
    def __init__(self, columns: dict[str, pa.Scalar]) -> None:
        self.cell, self.ids = columns["cell"].as_py(), columns["ids"].values
        self.copies, self.core = columns["copies"].values.to_numpy(), columns["core"].values.to_numpy(zero_copy_only=False)
        self.units = np.frombuffer(columns["units"].as_buffer()).reshape(len(self.ids), -1)


def distinct_units(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, copies): id, unit, copies of each unit vector, under the smallest id that has it; and a, id of all other rows with it."""
    x = written(units, "units")
    points = written(x.groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "unit", "copies"), "distinct-units")
    return points, x.join(points.select("unit", c("id").alias("a")), "unit").where("a <> id").select("a", "id")


def near(points: DataFrame, min_cosine: float, found: Found) -> DataFrame:
    """What `found` asks for of the pairs of points (id, unit, copies, core) with at least min_cosine, exactly at every size.

    Every vector belongs to the cell of its nearest pivot, and cells are cut into blocks. Each block meets in a task each other
    one that the triangle inequality cannot exclude, and there only the vectors that may have a near one are compared. Tasks
    read both blocks from their table, and only what is asked for leaves them, so disk grows with the vectors alone.
    """
    kind = points.schema["id"].dataType.simpleString()
    n = points.count()
    sample = points.select("id", "unit").orderBy(F.xxhash64(c("id").cast("string")), "id").limit(min(PIVOTS, math.isqrt(n) + 1, 2 * n // BLOCK + 1)).collect()  # PIVOTS rows at most
    pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["unit"]) for r in sample}:
        at = [i for i, r in enumerate(sample) if len(r["unit"]) == size]
        pivots[size] = (np.array(at), np.array([sample[i]["unit"] for i in at]))
    reach, part = math.sqrt(max(0.0, 2 - 2 * min_cosine)), PART

    placed = points.select("id", "unit", "copies", "core").mapInPandas(_nearest(pivots), f"id {kind}, unit array<double>, copies long, core boolean, cell long, own double")
    cells = {r["cell"]: (r["n"], r["own"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("own")).collect()}  # a row a pivot
    meets = {k: [k] for k in cells}
    for names, at in pivots.values():
        most = np.array([cells[int(k)][1] if int(k) in cells else -math.inf for k in names])
        meet = _distance(at, at) <= most[:, None] + most[None, :] + reach + SLACK
        meets |= {int(k): names[m].tolist() for k, m in zip(names, meet, strict=True) if int(k) in cells}
    plan = points.sparkSession.createDataFrame([(k, -(-size // BLOCK)) for k, (size, _) in cells.items()], "cell long, parts long")  # a row a pivot
    dealt = placed.join(F.broadcast(plan), "cell").select("cell", F.pmod(F.xxhash64(c("id").cast("string")), c("parts")).alias("part"), "id", "copies", "core", "unit")
    dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part")
    blocks = blocks_of(dealt, _packed(BLOCK_BYTES), f"cell long, ids array<{kind}>, copies array<bigint>, core array<boolean>, units binary", "blocks")
    near_cells = points.sparkSession.createDataFrame(list(meets.items()), "cell long, meets array<long>")  # a row a pivot
    blocks = blocks.join(F.broadcast(near_cells), "cell")
    where = {int(k): at[i] for names, at in pivots.values() for i, k in enumerate(names)}

    def near_cell(x: _Block, y: _Block) -> np.ndarray:
        """The rows of x that may have a near one in the cell of y."""
        if x.cell == y.cell:
            return np.arange(len(x.ids))
        far, own = (_distance(x.units, where[k][None, :])[:, 0] for k in (y.cell, x.cell))
        return np.flatnonzero(far <= np.minimum(own + 2 * reach, cells[y.cell][1] + reach) + SLACK)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, joined = ["cell", "ids", "copies", "core", "units"], Joined()
        for batch in batches:
            for k in range(len(batch)):
                x, y = (_Block({n: batch.column(f"{n}{end}")[k] for n in names}) for end in ("", "_2"))
                met = Met(found, x, y, (batch.column("block")[k].as_py(), batch.column("block_2")[k].as_py()), joined)
                rows, others = near_cell(x, y), near_cell(y, x)
                for a in range(0, len(rows), part):
                    some = rows[a : a + part]
                    cosines = (x.units[some] @ y.units[others].T).ravel()
                    at = np.flatnonzero(cosines >= min_cosine - TIE)
                    i, j = some[at // len(others)] if len(at) else at, others[at % len(others)] if len(at) else at
                    wanted = met.open(i, j)
                    met.add(i[wanted], j[wanted], cosines[at[wanted]])
                yield met.out()

    return meetings(blocks, lambda a, b: ~F.array_contains(a("meets"), b("cell"))).mapInArrow(compared, found.schema(kind))
