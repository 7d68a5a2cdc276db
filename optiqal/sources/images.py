"""Image files and their quality metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "path string, width int, height int, is_corrupted boolean, is_blurry boolean, blur_score double, color array<double>, luminance double, contrast double"


def read_images(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path, file_size_bytes and the decoded image of each file below path, in one scan; files that cannot be decoded stay, with an empty image.

    options are those of Spark's file sources, as recursiveFileLookup or pathGlobFilter.
    """
    files = spark.read.format("image").option("dropInvalid", False).options(**options).load(path)
    return files.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path"), F.col("_metadata.file_size").alias("file_size_bytes"), *[F.col(f"image.{k}") for k in ("height", "width", "nChannels", "mode", "data")])


def write_images(images: DataFrame, path: str, name: str = "name", data: str = "data") -> None:
    """Each row's binary `data` as a file of its own, in the folder `name=<name>` below path, through Spark's own file systems.

    A line break follows the data, which image formats ignore. Names are distinct; rows of one name would share a file.
    """
    out = images.select(F.col(name).alias("name"), F.col(data).cast("string").alias("value"))
    out.repartition("name").write.partitionBy("name").text(path)


def measure(pixels: np.ndarray, blur_threshold: float = 90.0) -> dict:
    """Metrics of one image (height, width, channels in blue, green, red order, or one grey channel).

    blur_score is the population variance of the Laplacian (4-neighbour kernel, borders reflected without the edge) of the
    grey image .299R + .587G + .114B, rounded; higher is sharper. luminance is the mean of .2126R + .7152G + .0722B.
    """
    x = pixels.astype(np.float64)
    r, g, b = (x[:, :, 2], x[:, :, 1], x[:, :, 0]) if x.shape[2] >= 3 else (x[:, :, 0],) * 3
    grey = np.rint(0.299 * r + 0.587 * g + 0.114 * b)
    edge = np.pad(grey, 1, mode="reflect") if min(grey.shape) > 1 else np.pad(grey, 1, mode="edge")
    lap = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * grey
    light = 0.2126 * r + 0.7152 * g + 0.0722 * b
    score = float(lap.var())
    return {"is_corrupted": False, "is_blurry": score < blur_threshold, "blur_score": score, "color": [float(r.mean()), float(g.mean()), float(b.mean())], "luminance": float(light.mean()), "contrast": float(light.std())}


def image_quality(images: DataFrame, blur_threshold: float = 90.0) -> DataFrame:
    """Metrics of each image; one that cannot be read is corrupted, with blur_score 0 and nulls."""
    broken = {"is_corrupted": True, "is_blurry": None, "blur_score": 0.0, "color": None, "luminance": None, "contrast": None}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, w, h, n, data in zip(pdf.path, pdf.width, pdf.height, pdf.nChannels, pdf.data, strict=True):
                ok = h > 0 and w > 0 and n > 0 and data is not None and len(data) == h * w * n
                got = measure(np.frombuffer(data, np.uint8).reshape(h, w, n), blur_threshold) if ok else broken
                rows.append({"path": path, "width": w if ok else None, "height": h if ok else None, **got})
            out = pd.DataFrame(rows, columns=["path", "width", "height", "is_corrupted", "is_blurry", "blur_score", "color", "luminance", "contrast"])
            yield out.astype({"width": "Int32", "height": "Int32", "is_blurry": "boolean"})

    return images.select("path", "width", "height", "nChannels", "data").mapInPandas(run, METRICS)


def assemble_images(catalogue: DataFrame, metrics: DataFrame) -> DataFrame:
    """Catalogue rows (asset_id, filename, target_path, asset_url, tags, width, height) with metrics by target_path.

    The decoded size replaces the catalogue's; the caption is empty until captions are made.
    """
    m = metrics.select(F.col("path").alias("target_path"), F.col("width").alias("w"), F.col("height").alias("h"), "is_corrupted", "is_blurry", "blur_score", "color", "luminance", "contrast", *(["file_size_bytes"] if "file_size_bytes" in metrics.columns else []))
    out = catalogue.join(m, "target_path", "left")
    return out.withColumns({"width": F.coalesce("w", "width"), "height": F.coalesce("h", "height"), "caption": F.lit("")}).drop("w", "h")
