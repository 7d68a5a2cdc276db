"""The numbers behind charts: small aggregates, one schema for each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiqal.functions.quantiles import quantile_stats

c = F.col


def bar(df: DataFrame, category, value) -> DataFrame:
    return df.select(category.alias("category"), value.cast("double").alias("value"))


def pair_bar(pairs: DataFrame, value: str) -> DataFrame:
    """Pairs of labels as `a + b`."""
    return bar(pairs, F.concat_ws(" + ", "label_1", "label_2"), c(value))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """bin (from 0), lo, hi, n: equal widths from the least to the largest value, the last bin closed.

    A constant column gets a range of half a unit to either side; no value gives no row. Nulls and NaN are left out.
    """
    x = df.select(c(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    t = x.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")
    same = c("a") == c("b")
    t = t.select(F.when(same, c("a") - 0.5).otherwise(c("a")).alias("a"), F.when(same, c("b") + 0.5).otherwise(c("b")).alias("b"))
    n = x.crossJoin(F.broadcast(t)).select(F.least(F.floor((c("v") - c("a")) / (c("b") - c("a")) * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    frame = t.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (c("b") - c("a")) / bins
    return frame.join(n, "bin", "left").select("bin", (c("a") + step * c("bin")).alias("lo"), (c("a") + step * (c("bin") + 1)).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def boxplot(df: DataFrame, category: str, col: str, exact: bool = True) -> DataFrame:
    """category, low, q1, median, q3, high, n: the whiskers are the fences at 1.5 ranges, clamped to the values."""
    x = df.select(c(category).alias("category"), c(col).alias("value"))
    s = quantile_stats(x, ["category"], "value", [0.25, 0.5, 0.75], F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"), exact=exact)
    nan = lambda x: F.when(c("n") == 0, F.lit(float("nan"))).otherwise(x)
    q1, q2, q3 = (c("q")[i] for i in range(3))
    return s.select("category", nan(F.greatest(c("lo"), q1 - 1.5 * (q3 - q1))).alias("low"), nan(q1).alias("q1"), nan(q2).alias("median"), nan(q3).alias("q3"), nan(F.least(c("hi"), q3 + 1.5 * (q3 - q1))).alias("high"), "n")


def boxplot_outliers(df: DataFrame, category: str, col: str, exact: bool = True) -> DataFrame:
    """category, value of the values strictly beyond the whiskers."""
    box = boxplot(df, category, col, exact).select("category", "low", "high")
    x = df.select(c(category).alias("category"), c(col).cast("double").alias("value"))
    return x.join(box, "category").where((c("value") < c("low")) | (c("value") > c("high"))).select("category", "value")


def heatmap(matrix: DataFrame, value: str, labels: list[str] | None = None) -> DataFrame:
    """label_1, label_2, value of a matrix's cells; with labels, a row for each label_1 and a column for each of those instead, 0 where there is no cell."""
    if labels is None:
        return matrix.select("label_1", "label_2", c(value).alias("value"))
    return matrix.groupBy("label_1").pivot("label_2", labels).agg(F.first(value)).na.fill(0)


def scatter(features: DataFrame, cells: int | None = None) -> DataFrame:
    """center_x, center_y, label; with cells, the number of centres in each cell of a square grid instead."""
    if cells is None:
        return features.select("center_x", "center_y", "label")
    at = lambda k: F.least(F.floor(c(k) * cells), F.lit(cells - 1))
    return features.groupBy(at("center_x").alias("cell_x"), at("center_y").alias("cell_y"), "label").agg(F.count("*").alias("n"))


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(c(x).alias("x"), c(y).alias("y")).orderBy("x", "y")


def table_card(row: DataFrame) -> DataFrame:
    """key, value (text) of a row."""
    pairs = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("key"), c(k).cast("string").alias("value")) for i, k in enumerate(row.columns)])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def markdown_table(row: DataFrame) -> DataFrame:
    """A row as a table in Markdown, in column `text`."""
    head = "| " + " | ".join(row.columns) + " |"
    rule = "| " + " | ".join("---" for _ in row.columns) + " |"
    values = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c(k).cast("string"), F.lit("None")) for k in row.columns]), F.lit(" |"))
    return row.select(F.concat_ws("\n", F.lit(head), F.lit(rule), values).alias("text"))


def is_empty(chart: DataFrame, value: str) -> DataFrame:
    """One row, empty: whether a chart has no row, or no value other than 0, null and NaN."""
    some = F.bool_or(c(value).isNotNull() & ~F.isnan(c(value).cast("double")) & (c(value) != 0))
    return chart.agg((~F.coalesce(some, F.lit(False))).alias("empty"))
