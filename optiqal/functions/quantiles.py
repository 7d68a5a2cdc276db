"""Quantiles with linear interpolation: exact by aggregate, exact by selection for groups of any size, or approximate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiqal.functions.graph import written

c = F.col
#: Accuracy of approximate quantiles: errors in rank are at most 1 / ACCURACY.
ACCURACY = 100_000
#: Values of a group that an aggregate may keep in memory; larger groups are searched by counts.
ROOM = 250_000
#: Cells of one pass of the search, and values of a cell that are gathered instead of counted again.
CELLS, FEW = 1024, 4096


def quantiles(col: Column, qs: Sequence[float], exact: bool = True) -> Column:
    """An array of quantiles as an aggregate. Exact ones keep each distinct value of a group in memory: see quantile_stats."""
    if exact:
        return F.percentile(col, F.array(*[F.lit(q) for q in qs]))
    return F.transform(F.percentile_approx(col, F.array(*[F.lit(q) for q in qs]), F.lit(ACCURACY)), lambda x: x.cast("double"))


def quantile_stats(df: DataFrame, by: Sequence[str], col: str, qs: Sequence[float], *aggs: Column, keep: Sequence[str] = (), exact: bool = True, room: int = ROOM) -> DataFrame:
    """by, the other aggregates, and q: for each group the array of its quantiles, as percentile gives them; null without values.

    No task keeps more than about `room` values of a group: those of larger groups are found by counting (see select_ranks).
    aggs may use by, col and keep, which are written once and then read. Values are taken as doubles; nulls take no part, NaN
    is the largest value, and null is a group of its own. by may be empty: then there is one row.
    """
    by, qs = list(by), list(qs)
    if not exact:
        return df.groupBy(*by).agg(*aggs, quantiles(c(col), qs, False).alias("q"))
    x = written(df.select(*dict.fromkeys([*by, col, *keep])), "values")
    large = written(x.groupBy(*by).agg(F.count(col).alias("n")).where(c("n") > room), "large-groups")
    if large.isEmpty():
        return x.groupBy(*by).agg(*aggs, quantiles(c(col), qs).alias("q"))
    names = {n: f"group {i}" for i, n in enumerate(by)}  # whatever the caller calls them
    groups, own = list(names.values()), {v: k for k, v in names.items()}
    at = [(F.lit(float(q)) * (c("n") - 1)).alias(f"at{i}") for i, q in enumerate(qs)]
    wanted = large.withColumnsRenamed(names).select(*groups, *at)
    both = [f(f"at{i}").cast("long") for i in range(len(qs)) for f in (F.floor, F.ceil)]
    values = x.select(*[c(n).alias(g) for n, g in names.items()], c(col).alias("v"))
    found = select_ranks(values, groups, "v", wanted.select(*groups, F.explode(F.array_distinct(F.array(*both))).alias("k")))
    found = found.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("at"))  # two values a quantile

    def between(i: int) -> Column:
        low, high = F.floor(f"at{i}").cast("long"), F.ceil(f"at{i}").cast("long")
        a, b = c("at")[low], c("at")[high]
        return F.when(a.eqNullSafe(b), a).otherwise((high - c(f"at{i}")) * a + (c(f"at{i}") - low) * b)

    big = _alike(wanted, found, groups).select(*groups, F.array(*[between(i) for i in range(len(qs))]).alias("q")).withColumnsRenamed(own)
    if not by:
        return x.agg(*aggs).crossJoin(F.broadcast(big)) if aggs else big  # one row
    small = _alike(x, large.select(*by), by, "left_anti").groupBy(*by).agg(*aggs, quantiles(c(col), qs).alias("q"))
    if aggs:
        big = _alike(_alike(x, large.select(*by), by, "left_semi").groupBy(*by).agg(*aggs), big, by)
    return small.unionByName(big)


def _alike(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """a joined with b where all of `by` agree, nulls too; a's columns `by` stay. Without `by`, b has a few rows."""
    if not by:
        return a.crossJoin(F.broadcast(b))
    names = {x: f"__{i}" for i, x in enumerate(by)}
    return a.join(b.withColumnsRenamed(names), [c(x).eqNullSafe(c(n)) for x, n in names.items()], how).drop(*names.values())


def _scale(v: Column) -> Column:
    """A monotone scale on which neighbouring powers of two are equally far apart, on both sides of 0."""
    size = F.ln(F.abs(v)) + 800.0
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0.0)


def select_ranks(df: DataFrame, by: Sequence[str], col: str, ranks: DataFrame, few: int = FEW) -> DataFrame:
    """by, k, v: the k-th smallest value (from 0) of each group, for ranks (by, k); by has none of the names used here.

    A pass counts the values that may still be meant in CELLS cells, equally wide on a logarithmic scale while they span
    more than a factor of four and on their own after that, and keeps of each rank the cell it lies in; cells of one value
    or of at most `few` values end the search. Memory is a cell's count, least and largest value. Passes are few: each
    divides the range by CELLS.
    """
    by = list(by)
    inf = float("inf")
    x = df.select(*by, c(col).cast("double").alias("v")).where("v is not null")
    open_ = ranks.select(*by, "k", F.lit(-inf).alias("lo"), F.lit(float("nan")).alias("hi"), F.lit(0).cast("long").alias("below"))
    done: list[DataFrame] = []
    edge = [*by, "lo", "hi", "below"]
    while True:
        span = open_.select(*edge).distinct()
        inside = _alike(x, span, by).where("v >= lo and v <= hi")  # NaN is larger than any other value
        finite = F.when(F.abs(c("v")) < inf, c("v"))
        ends = inside.groupBy(*edge).agg(F.min(finite).alias("a"), F.max(finite).alias("b"))
        wide = (c("a") <= 0) & (c("b") >= 0) | (F.greatest(F.abs("a"), F.abs("b")) > 4 * F.least(F.abs("a"), F.abs("b")))
        on = lambda v: F.when(wide, _scale(v)).otherwise(v)
        share = (on(c("v")) - on(c("a"))) / (on(c("b")) - on(c("a")))
        cell = F.when(F.isnan("v"), CELLS + 1).when(c("v") == inf, CELLS).when(c("v") == -inf, -1).when(c("a") == c("b"), 0).otherwise(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
        cells = _alike(inside, written(ends, "ends"), edge).select(*edge, "v", cell.cast("int").alias("cell")).groupBy(*edge, "cell").agg(F.count("*").alias("m"), F.min("v").alias("first"), F.max("v").alias("last"))
        so_far = W.partitionBy(*edge).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # CELLS + 3 rows
        cells = cells.withColumn("before", F.coalesce(F.sum("m").over(so_far), F.lit(0)) + c("below"))
        hit = _alike(open_, cells, edge).where((c("k") >= c("before")) & (c("k") < c("before") + c("m")))
        hit = written(hit.select(*by, "k", c("first").alias("lo"), c("last").alias("hi"), c("before").cast("long").alias("below"), "m"), "ranks")
        done.append(hit.where("lo = hi").select(*by, "k", c("lo").alias("v")))
        short = hit.where((c("lo") != c("hi")) & (c("m") <= few))
        gathered = _alike(x, short.select(*edge).distinct(), by).where("v >= lo and v <= hi").groupBy(*edge).agg(F.array_sort(F.collect_list("v")).alias("all"))  # `few` values at most
        done.append(_alike(short, gathered, edge).select(*by, "k", c("all")[(c("k") - c("below")).cast("int")].alias("v")))
        open_ = hit.where((c("lo") != c("hi")) & (c("m") > few)).drop("m")
        if open_.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
