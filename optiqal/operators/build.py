"""Building the image and shape tables, projections and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The columns of the strict views, by the tables' schema.
IMAGE_VIEW = ["filename", "width", "height", "tags", "caption", "is_blurry", "is_corrupted", "blur_score", "file_size_bytes", "color", "luminance", "contrast"]
ANNOTATION_VIEW = ["filename", "image_width", "image_height", "label", "x", "y", "w", "h", "x_norm", "y_norm"]


def first_annotation(annotations: DataFrame) -> DataFrame:
    """The first annotation of each asset, by creation and then identifier."""
    order = W.partitionBy("asset_id").orderBy("created_at", "annotation_id")
    return annotations.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def drop_tiny_shapes(shapes: DataFrame, least: float = 100) -> DataFrame:
    """Shapes of more than `least` pixels, and those without coordinates."""
    return shapes.where(F.col("x").isNull() | (F.col("w") * F.col("h") > least))


def join_image_meta(shapes: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shapes with image_width, image_height, filename and asset_url; asset ids without an image). Of several images the least counts."""
    meta = images.groupBy("asset_id").agg(F.min(F.struct("filename", "asset_url", "width", "height")).alias("m"))
    meta = meta.select("asset_id", "m.filename", "m.asset_url", F.col("m.width").alias("image_width"), F.col("m.height").alias("image_height"))
    return shapes.join(meta, "asset_id"), shapes.join(meta, "asset_id", "left_anti").select("asset_id").distinct()


def attach_shape_vectors(shapes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Shapes with shape_embeddings from (id, vector); null where there is none."""
    return shapes.join(vectors.select(F.col("id").alias("shape_id"), F.col("vector").alias("shape_embeddings")), "shape_id", "left")


def embedding_coverage(shapes: DataFrame, column: str = "shape_embeddings") -> DataFrame:
    """total, with_vector, and ready: more than half (rounded down) have a vector."""
    x = shapes.agg(F.count("*").alias("total"), F.count(column).alias("with_vector"))
    return x.withColumn("ready", F.col("with_vector") > F.floor(F.col("total") / 2))


def project(df: DataFrame, columns: list[str], always: tuple[str, ...] = ("asset_id", "filename", "asset_url")) -> DataFrame:
    """The wanted columns that exist, each once, after those that are always there."""
    return df.select([c for c in dict.fromkeys([*always, *columns]) if c in df.columns])


#: What a projection of shapes always has.
SHAPE_KEYS = ("asset_id", "annotation_id")


def image_view(images: DataFrame) -> DataFrame:
    return images.select(*IMAGE_VIEW)


def annotation_view(shapes: DataFrame) -> DataFrame:
    return shapes.select(*ANNOTATION_VIEW)


def guarded(df: DataFrame, shapes: DataFrame) -> DataFrame:
    """df, or no row where the shapes are of one class or none, or have no coordinates."""
    ok = shapes.agg((F.countDistinct("label") > 1).alias("classes"), (F.count("x") > 0).alias("boxes")).where("classes and boxes").select(F.lit(True).alias("__ok"))
    return df.crossJoin(F.broadcast(ok)).drop("__ok")  # a single row


def small_area(least: float = 20) -> Column:
    return F.col("w") * F.col("h") < least


def outside_of_image() -> Column:
    """Whether a box leaves its image."""
    c = F.col
    return (c("x") < 0) | (c("y") < 0) | (c("x") + c("w") > c("image_width")) | (c("y") + c("h") > c("image_height"))


def shape_issues(shapes: DataFrame, least: float = 20) -> DataFrame:
    """asset_id, shape_id, issue: SMALL_AREA and OUTSIDE_OF_IMAGE."""
    found = F.array_compact(F.array(F.when(small_area(least), "SMALL_AREA"), F.when(outside_of_image(), "OUTSIDE_OF_IMAGE")))
    return shapes.select("asset_id", "shape_id", F.explode(found).alias("issue"))
