"""Image quality: outliers of luminance, contrast and blur, and issues per asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiqal.functions.quantiles import quantile_stats

c = F.col


def _row(df: DataFrame, group: str, item: str, text: str, score: str) -> DataFrame:
    return df.select(F.lit(group).alias("group"), F.lit(item).alias("item"), F.lit(text).alias("description"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("label_2"), c("asset_id").cast("string").alias("asset_id"), F.lit(None).cast("string").alias("shape_id"), c(score).cast("double").alias("score"))


def iqr_outliers(images: DataFrame, col: str, low: float = 0.05, high: float = 0.95, reach: float = 2, sample_n: int = 5, exact: bool = True) -> DataFrame:
    """Outlier rows of group `col`: beyond the low and high quantile by more than `reach` times their distance.

    Where a side has none, its single extreme row counts instead. inliers_sample: the sample_n others nearest to the median
    of all. Ties go to the smaller asset_id; nulls take no part.
    """
    x = images.where(c(col).isNotNull()).select("asset_id", col)
    ends = [F.min(F.struct(col, "asset_id"))["asset_id"].alias("least"), F.min(F.struct((-c(col)).alias("v"), "asset_id"))["asset_id"].alias("most"), F.min(col).alias("lo"), F.max(col).alias("hi")]
    t = quantile_stats(x, [], col, [low, 0.5, high], *ends, keep=["asset_id"], exact=exact)
    iqr = c("q")[2] - c("q")[0]
    t = t.select((c("q")[0] - reach * iqr).alias("lower"), (c("q")[2] + reach * iqr).alias("upper"), c("q")[1].alias("median"), "least", "most", "lo", "hi")
    y = x.crossJoin(F.broadcast(t))  # a single row
    below = (c(col) < c("lower")) | ((c("lo") >= c("lower")) & (c("asset_id") == c("least")))
    above = (c(col) > c("upper")) | ((c("hi") <= c("upper")) & (c("asset_id") == c("most")))
    inlier = y.where(~below & ~above).orderBy(F.abs(c(col) - c("median")), "asset_id").limit(sample_n)
    return (
        _row(y.where(below), col, "low_outliers", f"Images with very low {col}", col)
        .unionByName(_row(y.where(above), col, "high_outliers", f"Images with very high {col}", col))
        .unionByName(_row(inlier, col, "inliers_sample", f"Representative images with typical {col}", col))
    )


def blur_outliers(images: DataFrame, q: float = 0.99, sample_n: int = 5, exact: bool = True) -> DataFrame:
    """Outlier rows of group `blur`: scores at or above the quantile (the sharpest), at or below 1 - q (the blurriest), and a typical sample below it."""
    x = images.where("blur_score is not null").select("asset_id", "blur_score")
    t = quantile_stats(x, [], "blur_score", [1 - q, 0.5, q], exact=exact)
    y = x.crossJoin(F.broadcast(t))  # a single row
    sample = y.where(c("blur_score") < c("q")[2]).orderBy(F.abs(c("blur_score") - c("q")[1]), "asset_id").limit(sample_n)
    return (
        _row(y.where(c("blur_score") >= c("q")[2]), "blur", "high_outliers", "Images with high blur score", "blur_score")
        .unionByName(_row(y.where(c("blur_score") <= c("q")[0]), "blur", "blurriest", "Images with the lowest blur score", "blur_score"))
        .unionByName(_row(sample, "blur", "inliers_sample", "Representative images with typical blur", "blur_score"))
    )


#: item of an outlier row -> issue, by group.
ISSUES = {("luminance", "low_outliers"): "LOW-LUMINANCE", ("luminance", "high_outliers"): "HIGH-LUMINANCE", ("contrast", "low_outliers"): "LOW-CONTRAST", ("contrast", "high_outliers"): "HIGH-CONTRAST", ("clip", "outliers"): "OUTLIER", ("clip", "duplicates"): "NEAR_DUPLICATE"}
#: issue -> what may be done about it.
REMEDIES = {"BLURRY": ["TAG", "DELETE"], "CORRUPTED": ["DELETE"], "NEAR_DUPLICATE": ["CLEAN", "DELETE"]}


def image_issues(images: DataFrame, outliers: DataFrame) -> DataFrame:
    """asset_id, issues, potential_actions from the flags of images and outlier rows; assets without an issue have no row."""
    flag = F.explode(F.array_compact(F.array(F.when(c("is_blurry"), "BLURRY"), F.when(c("is_corrupted"), "CORRUPTED")))).alias("issue")
    own = images.select(c("asset_id").cast("string").alias("asset_id"), flag)
    named = F.coalesce(*[F.when((c("group") == g) & (c("item") == i), name) for (g, i), name in ISSUES.items()])
    both = own.unionByName(outliers.select("asset_id", named.alias("issue")).where("issue is not null"))
    remedy = F.coalesce(*[F.when(c("issue") == k, F.array(*[F.lit(a) for a in v])) for k, v in REMEDIES.items()], F.array(F.lit("TAG"), F.lit("DELETE")))
    return both.groupBy("asset_id").agg(F.array_sort(F.collect_set("issue")).alias("issues"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(remedy)))).alias("potential_actions"))
