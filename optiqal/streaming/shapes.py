"""Shape checks on a stream of shapes: whatever looks at one row at a time needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from optiqal.functions.geometry import normalize_coords, shape_features
from optiqal.operators.build import drop_tiny_shapes, shape_issues


def read_shapes(spark: SparkSession, path: str, schema) -> DataFrame:
    """Shapes from files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def prepared(shapes: DataFrame) -> DataFrame:
    """Shapes with normalised coordinates and features, without tiny ones; the same on batches and streams."""
    return shape_features(normalize_coords(drop_tiny_shapes(shapes)))


def issues(shapes: DataFrame) -> DataFrame:
    return shape_issues(shapes)


def class_counts(shapes: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window, label, n: shapes per label and time window; rows later than `late` are left out.

    Times may be dates, timestamps, or timestamps without a zone, which are taken to be in the session's: watermarks need a zone.
    """
    shapes = shapes.withColumn(time, F.col(time).cast("timestamp_ltz"))
    return shapes.withWatermark(time, late).groupBy(F.window(time, width), "label").agg(F.count("*").alias("n"))


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now, once, and stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
