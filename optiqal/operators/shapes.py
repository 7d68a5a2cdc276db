"""Shape statistics and outliers. Thresholds are one aggregate per label, joined back; no window spans a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiqal.functions.graph import written
from optiqal.functions.quantiles import quantile_stats

c = F.col


def shape_global_stats(f: DataFrame, small: float = 20, large: float = 0.5) -> DataFrame:
    """One row over shape_features: counts, shares of small and large shapes in percent, mean aspect ratio, and the thresholds."""
    percent = lambda cond: F.avg(F.when(cond, 100.0).otherwise(0.0))
    return f.agg(
        F.count("*").alias("num_shapes"),
        F.countDistinct("label").alias("num_classes"),
        percent(c("area") < small).alias("percent_small"),
        percent(c("relative_area") > large).alias("percent_large"),
        F.avg("aspect_ratio").alias("mean_aspect_ratio"),
        F.lit(float(small)).alias("small_threshold"),
        F.lit(float(large)).alias("large_threshold"),
    )


def per_class_area_stats(f: DataFrame, exact: bool = True) -> DataFrame:
    """label, count_area, mean_area, median_area, std_area."""
    x = quantile_stats(f, ["label"], "area", [0.5], F.count("area").alias("count_area"), F.avg("area").alias("mean_area"), F.stddev_samp("area").alias("std_area"), exact=exact)
    return x.select("label", "count_area", "mean_area", c("q")[0].alias("median_area"), "std_area")


def aspect_ratio_stats(f: DataFrame) -> DataFrame:
    return f.agg(F.min("aspect_ratio").alias("min_ratio"), F.max("aspect_ratio").alias("max_ratio"), F.stddev_samp("aspect_ratio").alias("std_ratio"))


def counts_per_asset(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("asset_id").agg(F.count("shape_id").alias("n"))


def shape_density_stats(shapes: DataFrame, images: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Shapes per asset: mean, std, min, max, median and assets without any (0 unless the images are given)."""
    n = counts_per_asset(shapes)
    if images is not None:
        n = images.select("asset_id").distinct().join(n, "asset_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    x = quantile_stats(n, [], "n", [0.5], F.avg("n").alias("mean_n"), F.stddev_samp("n").alias("std_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.count_if(c("n") == 0).alias("num_empty_images"), exact=exact)
    return x.select("mean_n", "std_n", "min_n", "max_n", c("q")[0].alias("median_n"), "num_empty_images")


def class_distribution(shapes: DataFrame) -> DataFrame:
    """Shapes per label, most first."""
    return shapes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def _class_stats(f: DataFrame, col: str, exact: bool) -> DataFrame:
    x = quantile_stats(f, ["label"], col, [0.25, 0.75], F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count("*").alias("size"), exact=exact)
    iqr = c("q")[1] - c("q")[0]
    return x.select("label", "mean", "std", "size", (c("q")[0] - 1.5 * iqr).alias("low"), (c("q")[1] + 1.5 * iqr).alias("high"))


def _sides(f: DataFrame, col: str, z: float, least: int, exact: bool) -> DataFrame:
    """f with below and above: beyond z standard deviations, or beyond the fences in a class of 5 or more; the class needs `least` rows."""
    x = f.join(_class_stats(f, col, exact), "label")
    score = (c(col) - c("mean")) / c("std")
    enough, spread, fenced = c("size") >= least, c("std") > 0, c("size") >= 5
    side = lambda by_z, by_iqr: F.coalesce(enough & ((spread & by_z) | (fenced & by_iqr)), F.lit(False))
    return x.withColumn("below", side(F.when(spread, score < -z), c(col) < c("low"))).withColumn("above", side(F.when(spread, score > z), c(col) > c("high")))


def _rows(df: DataFrame, group: str, item: Column, description: Column, score: str) -> DataFrame:
    return df.select(F.lit(group).alias("group"), item.alias("item"), description.alias("description"), c("label"), F.lit(None).cast("string").alias("label_2"), c("asset_id").cast("string").alias("asset_id"), c("shape_id").cast("string").alias("shape_id"), c(score).cast("double").alias("score"))


def _typical(x: DataFrame, col: str, exact: bool) -> DataFrame:
    """Of each label that has an outlier, the inlier nearest to the median of the inliers; ties to the smaller shape_id."""
    inlier = ~c("below") & ~c("above")
    inner = x.select("label", F.when(inlier, c(col)).alias("inner"), (~inlier).alias("out"))
    t = quantile_stats(inner, ["label"], "inner", [0.5], F.bool_or("out").alias("some"), keep=["out"], exact=exact).where("some").select("label", c("q")[0].alias("median"))
    near = x.where(inlier).join(t, "label")
    best = near.groupBy("label").agg(F.min(F.struct(F.abs(c(col) - c("median")).alias("away"), c("shape_id"), c("asset_id"), c(col))).alias("b"))
    return best.select("label", "b.shape_id", "b.asset_id", F.col(f"b.{col}").alias(col))


def area_outliers(f: DataFrame, z: float = 2.5, exact: bool = True, typical: bool = True) -> DataFrame:
    """Outlier rows of group `area`: shapes unusually small or large for their label, and a typical one of each such label."""
    x = _sides(f, "area", z, 1, exact)
    out = x.where(c("below") | c("above"))
    item = F.when(c("below"), "small_shapes").otherwise("large_shapes")
    text = F.when(c("below"), "Shapes that are unusually small for their label").otherwise("Shapes that are unusually large for their label")
    rows = _rows(out, "area", item, text, "area")
    return rows.unionByName(_rows(_typical(x, "area", exact), "area", F.lit("typical_shapes"), F.lit("Shapes with typical area across labels"), "area")) if typical else rows


def aspect_ratio_outliers(f: DataFrame, z: float = 2.5, exact: bool = True, typical: bool = True) -> DataFrame:
    """Outlier rows of group `aspect_ratio`; labels of one shape have none."""
    x = _sides(f, "aspect_ratio", z, 2, exact)
    rows = _rows(x.where(c("below") | c("above")), "aspect_ratio", F.lit("extreme_ratios"), F.lit("Shapes with extreme aspect ratios (too flat or too tall)"), "aspect_ratio")
    return rows.unionByName(_rows(_typical(x, "aspect_ratio", exact), "aspect_ratio", F.lit("typical_ratios"), F.lit("Shapes with typical aspect ratios across labels"), "aspect_ratio")) if typical else rows


def density_outliers(shapes: DataFrame, sample_n: int = 5, use_quantiles: bool = True, z: float = 2.5, exact: bool = True) -> DataFrame:
    """Outlier rows of group `density`: assets of few and many shapes (quantile bounds count as outside), and typical ones."""
    n = written(counts_per_asset(shapes), "counts")
    if use_quantiles:
        t = quantile_stats(n, [], "n", [0.05, 0.5, 0.95], exact=exact).select(c("q")[0].alias("lo"), c("q")[2].alias("hi"), c("q")[1].alias("median"))
        low, high = c("n") <= c("lo"), c("n") >= c("hi")
    else:
        t = quantile_stats(n, [], "n", [0.5], F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), exact=exact).where("std > 0").withColumn("median", c("q")[0])
        low, high = (c("n") - c("mean")) / c("std") < -z, (c("n") - c("mean")) / c("std") > z
    x = n.crossJoin(F.broadcast(t)).withColumn("low", low).withColumn("high", high)  # t is a single row
    as_row = lambda df, item, text: df.select(F.lit("density").alias("group"), F.lit(item).alias("item"), F.lit(text).alias("description"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("label_2"), c("asset_id").cast("string").alias("asset_id"), F.lit(None).cast("string").alias("shape_id"), c("n").cast("double").alias("score"))
    inlier = x.where(~c("low") & ~c("high")).orderBy(F.abs(c("n") - c("median")), "asset_id").limit(sample_n)
    return as_row(x.where("low"), "few_objects", "Images with very few objects (underpopulated)").unionByName(as_row(x.where("high"), "many_objects", "Images with too many objects (overcrowded)")).unionByName(as_row(inlier, "typical_density", "Images with typical object count"))
