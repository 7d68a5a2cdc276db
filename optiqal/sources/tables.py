"""Metadata tables, asset and annotation exports, vectors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from optiqal.functions.geometry import polygon_to_bbox
from optiqal.functions.vectors import parse_vector
from optiqal.schemas import ANNOTATIONS, REPORT


def read_metadata_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An image or shape table from CSV with a header. Array columns are read from their JSON text; other suffixes are refused."""
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError(f"not a .csv path: {path}")
    wanted = T.StructType.fromDDL(schema)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in wanted])
    df = spark.read.csv(path, schema=flat, header=True, multiLine=True, escape='"')
    arrays = {f.name: F.coalesce(F.from_json(f.name, f.dataType), F.array().cast(f.dataType)) for f in wanted if isinstance(f.dataType, T.ArrayType)}
    return df.withColumns(arrays) if arrays else df


def write_metadata_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays become JSON text."""
    arrays = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    (df.withColumns(arrays) if arrays else df).write.mode("overwrite").csv(path, header=True, escape='"')


def parsed_vectors(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not empty, with the vector as an array (text is parsed)."""
    v = parse_vector(F.col(column)) if isinstance(df.schema[column].dataType, T.StringType) else F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType))
    return df.withColumn(column, v).where(F.size(column) > 0)


def load_assets(spark: SparkSession, path: str) -> DataFrame:
    """Assets from a JSON export; tags become their names, and none where they are missing."""
    schema = "asset_id string, filename string, asset_url string, width int, height int, annotation_id string, tags array<struct<id: string, name: string>>"
    return project_tags(spark.read.schema(schema).json(path))


def project_tags(assets: DataFrame) -> DataFrame:
    """tags as an array of names."""
    return assets.withColumn("tags", F.coalesce(F.transform("tags", lambda t: t["name"]), F.array().cast("array<string>")))


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATIONS).json(path)


def load_shapes(annotations: DataFrame) -> DataFrame:
    """One row per shape of nested annotations: boxes as they are, polygons by their box, classes by label alone."""
    s = annotations.select("asset_id", "annotation_id", "task_type", F.explode("shapes").alias("s"))
    box = polygon_to_bbox(F.col("s.coords"))
    part = lambda k: F.when(F.col("task_type") == "OBJECT_DETECTION", F.col(f"s.{k}")).when(F.col("task_type") == "SEGMENTATION", box[k])
    return s.select("asset_id", "annotation_id", F.col("s.id").alias("shape_id"), "task_type", F.col("s.label").alias("label"), F.col("s.label_id").alias("label_id"), *[part(k).alias(k) for k in "xywh"])


def vectors_of(points: DataFrame, model: str) -> DataFrame:
    """id and vector of one model; points without it fall away."""
    return points.select("id", F.try_element_at("vector", F.lit(model)).alias("vector")).where("vector is not null")


def load_image_vectors(assets: DataFrame, points: DataFrame, model: str) -> DataFrame:
    """Assets with clip_embeddings, null where the vector is missing."""
    return assets.join(vectors_of(points, model).select(F.col("id").alias("asset_id"), F.col("vector").alias("clip_embeddings")), "asset_id", "left")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def append_content(content: DataFrame, path: str, batch: str | int) -> None:
    """Rows (type content, error or event, and the columns of a report) of one batch, in a table that is split by batch and type.

    A batch has a folder of its own and replaces what an earlier attempt has left there: appending it again changes nothing.
    """
    content.write.mode("overwrite").partitionBy("type").json(f"{path.rstrip('/')}/batch={batch}")


def append_stream(content: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """append_content for each micro-batch of a stream, keyed by its number: a batch that is replayed after a failure counts once."""
    return content.writeStream.foreachBatch(lambda rows, batch: append_content(rows, path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_content(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches; schema names the content's own columns, without type and batch."""
    return spark.read.schema(f"{schema}, type string, batch string").json(path)


def is_computing(spark: SparkSession, path: str) -> bool:
    """Whether no event row of any batch has ended the report yet; a table without a batch is still computing."""
    return read_content(spark, path, "name string").where("type = 'event'").isEmpty()
