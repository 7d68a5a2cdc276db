"""Box tightness: annotated boxes against suggested ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiqal.functions.geometry import iou
from optiqal.functions.quantiles import quantile_stats

c = F.col
DELTAS = ("x1", "y1", "x2", "y2", "area")


def match_suggestions(shapes: DataFrame, suggested: DataFrame) -> DataFrame:
    """Shapes that have a suggested box, with it (sx, sy, sw, sh), both in shares of the image, and their iou."""
    s = suggested.select("shape_id", *[c(k).alias(f"s{k}") for k in "xywh"])
    x = shapes.join(s, "shape_id")
    size = {"x": "image_width", "y": "image_height", "w": "image_width", "h": "image_height"}
    both = {f"n{k}": F.try_divide(c(k), c(v)) for k, v in size.items()} | {f"sn{k}": F.try_divide(c(f"s{k}"), c(v)) for k, v in size.items()}
    return x.withColumns(both).withColumn("iou", iou(*[c(k) for k in "xywh"], *[c(f"s{k}") for k in "xywh"]))


def tightness_deltas(matched: DataFrame, exact: bool = True) -> DataFrame:
    """The matches of at least the median iou, with the differences of corners and area, annotated less suggested."""
    median = quantile_stats(matched, [], "iou", [0.5], exact=exact).select(c("q")[0].alias("median_iou"))
    x = matched.crossJoin(F.broadcast(median)).where("iou >= median_iou").drop("median_iou")  # one row
    return x.withColumns({"delta_x1": c("nx") - c("snx"), "delta_y1": c("ny") - c("sny"), "delta_x2": c("nx") + c("nw") - c("snx") - c("snw"), "delta_y2": c("ny") + c("nh") - c("sny") - c("snh"), "delta_area": c("nw") * c("nh") - c("snw") * c("snh")})


def _means() -> list:
    return [(1 - F.avg("delta_area")).alias("tightness_score"), *[F.avg(f"delta_{k}").alias(f"delta_{k}") for k in DELTAS[:4]]]


def tightness_global(deltas: DataFrame) -> DataFrame:
    return deltas.agg(*_means())


def tightness_per_class(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("label").agg(*_means())


def tightness_issues(matched: DataFrame, least: float = 0.5, most: float = 0.9) -> DataFrame:
    """Matches with an iou strictly between the bounds, as actual and expected boxes, with the actions TAG and DELETE."""
    box = lambda p: F.struct(*[c(f"{p}{k}").alias(k) for k in "xywh"])
    return matched.where((c("iou") > least) & (c("iou") < most)).select("asset_id", "shape_id", "label", "iou", box("").alias("actual"), box("s").alias("expected"), F.array(F.lit("TAG"), F.lit("DELETE")).alias("actions"))


def first_assets(shapes: DataFrame, n: int | None = None) -> DataFrame:
    """The shapes of the first n assets; of all where n is None."""
    return shapes if n is None else shapes.join(shapes.select("asset_id").distinct().orderBy("asset_id").limit(n), "asset_id", "left_semi")


def long_deltas(deltas: DataFrame) -> DataFrame:
    """label, side, value: for one box plot per label and side."""
    return deltas.select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), c(f"delta_{k}").alias("value")) for k in DELTAS[:4]])).alias("d")).select("label", "d.side", "d.value")
