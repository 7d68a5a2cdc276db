"""Embedding space: class and global centroids, outliers, and clusters of near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiqal.functions.density import Found, density_clusters
from optiqal.functions.graph import written
from optiqal.functions.near import distinct_units, near, units_of
from optiqal.functions.quantiles import quantile_stats
from optiqal.functions.vectors import distance, mean_vectors

c = F.col


def class_centroids(df: DataFrame, vector: str = "shape_embeddings") -> DataFrame:
    """label, centroid."""
    return mean_vectors(df.where(c(vector).isNotNull() & (F.size(vector) > 0)), vector, ["label"])


def distance_to_centroid(df: DataFrame, vector: str = "shape_embeddings") -> DataFrame:
    """The rows that have a vector, with their distance to the mean of their label."""
    x = df.where(c(vector).isNotNull() & (F.size(vector) > 0))
    return x.join(class_centroids(df, vector), "label").withColumn("distance", distance(c(vector), c("centroid"))).drop("centroid")


def centroid_outliers(df: DataFrame, percent: float = 95, min_samples: int = 6, vector: str = "shape_embeddings", exact: bool = True) -> DataFrame:
    """label, shape_id, distance of the rows beyond their label's percentile; labels of fewer than min_samples have none."""
    d = written(distance_to_centroid(df, vector).select("label", "shape_id", "distance"), "distances")
    bound = quantile_stats(d, ["label"], "distance", [percent / 100], F.count("*").alias("n"), exact=exact).where(c("n") >= min_samples).select("label", c("q")[0].alias("bound"))
    return d.join(bound, "label").where("distance > bound").select("label", "shape_id", "distance")


def global_centroid_distance(df: DataFrame, vector: str = "clip_embeddings") -> DataFrame:
    """asset_id, distance to the mean of all vectors."""
    x = df.where(c(vector).isNotNull() & (F.size(vector) > 0))
    centre = mean_vectors(x, vector, [])
    return x.crossJoin(F.broadcast(centre)).select("asset_id", distance(c(vector), c("centroid")).alias("distance"))  # one centre


def embedding_outliers(df: DataFrame, top_percent: float = 3, vector: str = "clip_embeddings") -> DataFrame:
    """The n - int(n * (1 - top_percent / 100)) rows farthest from the centre.

    They are found by counts: in which of 1,000 distance classes the last one falls, and then by rank among that class's rows.
    """
    d = written(global_centroid_distance(df, vector), "distances")
    n, least, most = d.agg(F.count("*"), F.min("distance"), F.max("distance")).first()
    wanted = (n or 0) - int((n or 0) * (1 - top_percent / 100))
    step = ((most or 0) - (least or 0)) / 1000 or 1.0
    d = d.withColumn("cell", F.floor((c("distance") - F.lit(float(least or 0))) / F.lit(float(step))))
    sizes = sorted(d.groupBy("cell").count().collect(), key=lambda r: (r["cell"] is None, -(r["cell"] or 0)))  # 1,002 rows at most
    cell, above = None, 0
    for r in sizes:
        cell = r["cell"]
        if above + r["count"] >= wanted:
            break
        above += r["count"]
    if not wanted or cell is None:
        return d.limit(0).drop("cell")
    edge = d.where(c("cell") == cell).orderBy(F.desc("distance"), "asset_id").limit(wanted - above)
    return d.where(c("cell") > cell).unionByName(edge).drop("cell")


def similar_pairs(df: DataFrame, min_cosine: float = 0.95, vector: str = "clip_embeddings") -> DataFrame:
    """(a, b, cosine), a < b: pairs of assets with at least min_cosine (less 1e-12), exact at every size.

    Of assets with one and the same direction only the smallest is compared; each of the others has a pair with it alone.
    """
    points, copies = distinct_units(units_of(df, vector))
    pairs = near(points.withColumn("core", F.lit(True)), min_cosine, Found("pairs"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").unionByName(copies.select("a", c("id").alias("b"), F.lit(1.0).alias("cosine")))


def duplicate_clusters(df: DataFrame, min_cosine: float = 0.95, vector: str = "clip_embeddings", min_samples: int = 2) -> DataFrame:
    """asset_id, cluster: what DBSCAN makes of cosine distance in the original space (see density_clusters); noise has no row.

    A cluster is named by its smallest core point, with two samples its smallest asset. The space is the vectors' own, with no
    projection to two dimensions before: a deliberate difference. Assets of one direction are points of the same place.
    """
    points, copies = distinct_units(units_of(df, vector))
    found = density_clusters(points, lambda p, what: near(p, min_cosine, what), min_samples)
    return found.select(c("id").alias("asset_id"), "cluster").unionByName(copies.join(found.withColumnRenamed("id", "a"), "a").select(c("id").alias("asset_id"), "cluster"))


def cluster_members(clusters: DataFrame) -> DataFrame:
    """cluster, n, asset_id: a row a member of the clusters of two and more. No cluster is gathered in one row."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    return clusters.join(sizes, "cluster").select("cluster", "n", "asset_id")
