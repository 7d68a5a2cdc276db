"""Looking into and curating a dataset version: tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def dataset_info(images: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row: images, annotated images, instances, labels and the shapes of each label, most first."""
    per = shapes.groupBy("label").agg(F.count("*").alias("n"))
    labels = per.agg(F.count("*").alias("labels"), F.sum("n").alias("instances"), F.transform(F.array_sort(F.collect_list(F.struct((-c("n")).alias("minus"), c("label")))), lambda s: F.concat(s["label"], F.lit(": "), (-s["minus"]).cast("string"))).alias("repartition"))
    counts = images.agg(F.countDistinct("asset_id").alias("images")).crossJoin(shapes.agg(F.countDistinct("asset_id").alias("annotated_images")))  # single rows
    return counts.crossJoin(labels)


def written_at(ts) -> "F.Column":
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def tag_assets(images: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """Images with the tag added to those in ids (asset_id); adding it again changes nothing."""
    if not tag:
        raise ValueError("a tag is needed")
    marked = ids.select("asset_id").distinct().withColumn("__marked", F.lit(True))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return images.join(marked, "asset_id", "left").withColumn("tags", F.when(c("__marked"), F.array_union(tags, F.array(F.lit(tag)))).otherwise(tags)).drop("__marked")


def delete_assets(images: DataFrame, shapes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and shapes without those of ids."""
    gone = ids.select("asset_id").distinct()
    return images.join(gone, "asset_id", "left_anti"), shapes.join(gone, "asset_id", "left_anti")


def fork(images: DataFrame, shapes: DataFrame, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, labels, shapes) of a copy. deep-copy: everything; soft-copy: labels and tags, no shapes; image(s): tags alone."""
    labels = shapes.select("label").distinct()
    if mode == "deep-copy":
        return images, labels, shapes
    if mode == "soft-copy":
        return images, labels, shapes.limit(0)
    if mode in ("image", "images"):
        return images, labels.limit(0), shapes.limit(0)
    raise ValueError(f"no such mode: {mode}")


def write_fork(parts: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    for name, df in zip(("images", "labels", "shapes"), parts, strict=True):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
