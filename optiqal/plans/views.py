"""The given tables seen as images, shapes, vectors, captions and suggested boxes; in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHAPE_COLUMNS = (
    "l_orderkey AS asset_id",
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS bigint)) AS shape_id",
    "CASE WHEN p_size = 1 THEN 'rare_a' WHEN p_size = 2 THEN 'rare_b' ELSE p_type END AS label",
    "CAST((l_suppkey * 7) % 100 AS double) AS x",
    "CAST((l_partkey * 13) % 80 AS double) AS y",
    "CAST(10 + l_quantity AS double) AS w",
    "CAST(10 + (l_partkey % 50) AS double) AS h",
    "CAST(200 AS double) AS image_width",
    "CAST(150 AS double) AS image_height",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
)
SHAPES = f"shapes AS (SELECT {', '.join(_SHAPE_COLUMNS)} FROM lineitem JOIN part ON l_partkey = p_partkey)"
FEATURES = (
    SHAPES + ", features AS (SELECT *, w * h AS area, image_width * image_height AS image_area, (w * h) / (image_width * image_height) AS relative_area, w / h AS aspect_ratio, "
    "w / image_width AS w_norm, h / image_height AS h_norm, (w / image_width) * (h / image_height) AS area_norm, (x + w / 2) / image_width AS center_x, (y + h / 2) / image_height AS center_y FROM shapes)"
)
_SUGGESTED = ("shape_id", "x + (l_linenumber % 3) AS x", "y + (l_linenumber % 2) AS y", "w - (l_partkey % 5) AS w", "h - (l_suppkey % 4) AS h")
SUGGESTED = SHAPES + f", suggested AS (SELECT {', '.join(_SUGGESTED)} FROM shapes)"
IMAGES = "images AS (SELECT event_id AS asset_id, value AS luminance, value AS contrast, value AS blur_score, value < 5 AS is_blurry, false AS is_corrupted, event_type FROM events)"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*_SHAPE_COLUMNS)


def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).selectExpr(*_SUGGESTED)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS asset_id", "value AS luminance", "value AS contrast", "value AS blur_score", "value < 5 AS is_blurry", "false AS is_corrupted", "event_type")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS asset_id", "vec_id AS shape_id", "CAST(label AS string) AS label", "embedding AS shape_embeddings", "embedding AS clip_embeddings")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS asset_id", "text AS caption")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotations for each order, of its odd and even lines; every third order is a segmentation, every third a classification."""
    s = shapes(spark, sf_dir)
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    coords = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(F.col("w"), F.lit(0.0)), corner(F.col("w"), F.col("h")), corner(F.lit(0.0), F.col("h")))
    one = F.struct(F.col("shape_id").alias("id"), "label", F.concat(F.lit("id-"), F.col("label")).alias("label_id"), "x", "y", "w", "h", coords.alias("coords"))
    kind = F.element_at(F.array(F.lit("OBJECT_DETECTION"), F.lit("SEGMENTATION"), F.lit("CLASSIFICATION")), (F.pmod("asset_id", F.lit(3)) + 1).cast("int"))
    half = F.pmod("l_linenumber", F.lit(2))
    return s.groupBy("asset_id", half.alias("half")).agg(F.min("l_shipdate").alias("created_at"), F.collect_list(one).alias("shapes")).select("asset_id", F.concat_ws("/", "asset_id", "half").alias("annotation_id"), "created_at", kind.alias("task_type"), "shapes")
