"""Boxes as column arithmetic: everything here stays in generated code and is safe on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def polygon_to_bbox(coords: Column) -> Column:
    """struct(x, y, w, h) around a polygon's points; null for null or no points."""
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))
    return F.when(F.size(coords) > 0, box)


def intersection(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """The area that two boxes share; 0 where they are apart."""
    width = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    height = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union in double precision; 0 for boxes apart or of no area."""
    inter = intersection(ax, ay, aw, ah, bx, by, bw, bh)
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def normalize_coords(shapes: DataFrame) -> DataFrame:
    """x, w over the image's width and y, h over its height; null where that is 0 or missing."""
    size = {"x": "image_width", "y": "image_height", "w": "image_width", "h": "image_height"}
    return shapes.withColumns({f"{k}_norm": F.try_divide(c(k), c(v)) for k, v in size.items()})


def shape_features(shapes: DataFrame) -> DataFrame:
    """Area, aspect ratio, relative and normalised sizes and the centre of each shape."""
    return shapes.withColumns(
        {
            "area": c("w") * c("h"),
            "image_area": c("image_width") * c("image_height"),
            "relative_area": F.try_divide(c("w") * c("h"), c("image_width") * c("image_height")),
            "aspect_ratio": F.try_divide(c("w"), c("h")),
            "w_norm": F.try_divide(c("w"), c("image_width")),
            "h_norm": F.try_divide(c("h"), c("image_height")),
            "area_norm": F.try_divide(c("w"), c("image_width")) * F.try_divide(c("h"), c("image_height")),
            "center_x": F.try_divide(c("x") + c("w") / 2, c("image_width")),
            "center_y": F.try_divide(c("y") + c("h") / 2, c("image_height")),
        }
    )


def prompt_boxes(shapes: DataFrame, size: int = 1024, grow: float = 0.1) -> DataFrame:
    """px1, py1, px2, py2: the box in an image resized to `size`, grown on each side and kept inside the image, in whole pixels."""
    scale = F.lit(float(size)) / F.greatest("image_width", "image_height")
    whole = lambda x: x.cast("int")
    width, height = whole(c("image_width") * scale), whole(c("image_height") * scale)
    return shapes.withColumns(
        {
            "px1": whole(F.greatest(whole(c("x") * scale) * (1 - grow), F.lit(1.0))),
            "py1": whole(F.greatest(whole(c("y") * scale) * (1 - grow), F.lit(1.0))),
            "px2": whole(F.least(whole((c("x") + c("w")) * scale) * (1 + grow), width - 1)),
            "py2": whole(F.least(whole((c("y") + c("h")) * scale) * (1 + grow), height - 1)),
        }
    )


def denormalize_boxes(boxes: DataFrame) -> DataFrame:
    """x, y, w, h in whole pixels from a centre box (cx, cy, nw, nh) in shares of the image."""
    return boxes.withColumns(
        {
            "x": ((c("cx") - c("nw") / 2) * c("image_width")).cast("int"),
            "y": ((c("cy") - c("nh") / 2) * c("image_height")).cast("int"),
            "w": (c("nw") * c("image_width")).cast("int"),
            "h": (c("nh") * c("image_height")).cast("int"),
        }
    )
