"""Every operator as a query over the given tables, with its SQL for DuckDB."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optiqal.functions import geometry
from optiqal.functions.graph import shared_dir
from optiqal.functions.vectors import mean_vectors
from optiqal.operators import build, captions, charts, curate, embedding, interclass, mislabel, quality, report, tightness
from optiqal.operators import shapes as shp
from optiqal.plans import inference
from optiqal.plans import views as v
from optiqal.plans.registry import Checks
from optiqal.sources import images as img
from optiqal.sources import tables as src

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select([F.round(k, digits).alias(k) if t in ("double", "float") else c(k) for k, t in df.dtypes])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def features(spark, d):
    return geometry.shape_features(v.shapes(spark, d))


# Shapes: features, statistics, outliers


@query(f"WITH {v.FEATURES} SELECT shape_id, area, image_area, round(relative_area, 9) AS relative_area, round(aspect_ratio, 9) AS aspect_ratio, round(w_norm, 9) AS w_norm, round(h_norm, 9) AS h_norm, round(area_norm, 9) AS area_norm, round(center_x, 9) AS center_x, round(center_y, 9) AS center_y FROM features")
def shape_features(spark, d):
    return rounded(features(spark, d).select("shape_id", "area", "image_area", "relative_area", "aspect_ratio", "w_norm", "h_norm", "area_norm", "center_x", "center_y"))


@query(f"WITH {v.SHAPES} SELECT shape_id, round(x / image_width, 9) AS x_norm, round(y / image_height, 9) AS y_norm, round(w / image_width, 9) AS w_norm, round(h / image_height, 9) AS h_norm FROM shapes")
def normalized_coords(spark, d):
    return rounded(geometry.normalize_coords(v.shapes(spark, d)).select("shape_id", "x_norm", "y_norm", "w_norm", "h_norm"))


@query(f"WITH {v.FEATURES} SELECT count(*) AS num_shapes, count(DISTINCT label) AS num_classes, round(avg(CASE WHEN area < 20 THEN 100.0 ELSE 0.0 END), 9) AS percent_small, round(avg(CASE WHEN relative_area > 0.05 THEN 100.0::DOUBLE ELSE 0.0 END), 9) AS percent_large, round(avg(aspect_ratio), 9) AS mean_aspect_ratio, 20.0::DOUBLE AS small_threshold, 0.05::DOUBLE AS large_threshold FROM features")
def shape_global_stats(spark, d):
    return rounded(shp.shape_global_stats(features(spark, d), large=0.05))


@query(f"WITH {v.FEATURES} SELECT label, count(area) AS count_area, round(avg(area), 9) AS mean_area, round(quantile_cont(area, 0.5), 9) AS median_area, round(stddev_samp(area), 9) AS std_area FROM features GROUP BY label")
def per_class_area_stats(spark, d):
    return rounded(shp.per_class_area_stats(features(spark, d)))


@query(f"WITH {v.FEATURES} SELECT round(min(aspect_ratio), 9) AS min_ratio, round(max(aspect_ratio), 9) AS max_ratio, round(stddev_samp(aspect_ratio), 9) AS std_ratio FROM features")
def aspect_ratio_stats(spark, d):
    return rounded(shp.aspect_ratio_stats(features(spark, d)))


@query(f"WITH {v.SHAPES}, n AS (SELECT count(s.shape_id) AS n FROM orders LEFT JOIN shapes s ON o_orderkey = s.asset_id GROUP BY o_orderkey) SELECT round(avg(n), 9) AS mean_n, round(stddev_samp(n), 9) AS std_n, min(n) AS min_n, max(n) AS max_n, round(quantile_cont(n, 0.5), 9) AS median_n, count(*) FILTER (n = 0) AS num_empty_images FROM n")
def shape_density_stats(spark, d):
    orders = v.table(spark, d, "orders").select(c("o_orderkey").alias("asset_id"))
    return rounded(shp.shape_density_stats(v.shapes(spark, d), orders))


@query(f"WITH {v.SHAPES} SELECT label, count(*) AS n FROM shapes GROUP BY label")
def class_distribution(spark, d):
    return shp.class_distribution(v.shapes(spark, d))


def _outlier_sql(col: str, least: int) -> str:
    """below and above for each shape, as CTE x."""
    return (
        f"WITH {v.FEATURES}, t AS (SELECT label, avg({col}) AS m, stddev_samp({col}) AS s, count(*) AS k, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM features GROUP BY label), "
        f"x AS (SELECT f.*, k >= {least} AND coalesce((s > 0 AND ({col} - m) / s < -2.5) OR (k >= 5 AND {col} < q1 - 1.5 * (q3 - q1)), false) AS below, "
        f"k >= {least} AND coalesce((s > 0 AND ({col} - m) / s > 2.5) OR (k >= 5 AND {col} > q3 + 1.5 * (q3 - q1)), false) AS above FROM features f JOIN t USING (label)), "
        f"md AS (SELECT label, quantile_cont({col}, 0.5) AS md FROM x WHERE NOT below AND NOT above GROUP BY label), "
        f"ty AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY label ORDER BY abs({col} - md), shape_id) AS nth FROM x JOIN md USING (label) WHERE NOT below AND NOT above AND label IN (SELECT label FROM x WHERE below OR above)) WHERE nth = 1) "
    )


@query(_outlier_sql("area", 1) + "SELECT CASE WHEN below THEN 'small_shapes' ELSE 'large_shapes' END AS item, label, asset_id::VARCHAR AS asset_id, shape_id, round(area, 9) AS score FROM x WHERE below OR above UNION ALL SELECT 'typical_shapes', label, asset_id::VARCHAR, shape_id, round(area, 9) FROM ty")
def shape_area_outliers(spark, d):
    return rounded(shp.area_outliers(features(spark, d)).select("item", "label", "asset_id", "shape_id", "score"))


@query(_outlier_sql("aspect_ratio", 2) + "SELECT 'extreme_ratios' AS item, label, asset_id::VARCHAR AS asset_id, shape_id, round(aspect_ratio, 9) AS score FROM x WHERE below OR above UNION ALL SELECT 'typical_ratios', label, asset_id::VARCHAR, shape_id, round(aspect_ratio, 9) FROM ty")
def shape_aspect_ratio_outliers(spark, d):
    return rounded(shp.aspect_ratio_outliers(features(spark, d)).select("item", "label", "asset_id", "shape_id", "score"))


_COUNTS = f"WITH {v.SHAPES}, n AS (SELECT asset_id, count(shape_id) AS n FROM shapes GROUP BY asset_id), "
_DENSITY = "SELECT 'few_objects' AS item, asset_id::VARCHAR AS asset_id, n::DOUBLE AS score FROM x WHERE low UNION ALL SELECT 'many_objects', asset_id::VARCHAR, n::DOUBLE FROM x WHERE high UNION ALL SELECT 'typical_density', asset_id::VARCHAR, n::DOUBLE FROM (SELECT * FROM x WHERE NOT low AND NOT high ORDER BY abs(n - md), asset_id LIMIT 5)"


@query(_COUNTS + "t AS (SELECT quantile_cont(n, 0.05) AS lo, quantile_cont(n, 0.95) AS hi, quantile_cont(n, 0.5) AS md FROM n), x AS (SELECT *, n <= lo AS low, n >= hi AS high FROM n, t) " + _DENSITY)
def shape_density_outliers(spark, d):
    return shp.density_outliers(v.shapes(spark, d)).select("item", "asset_id", "score")


@query(_COUNTS + "t AS (SELECT avg(n) AS m, stddev_samp(n) AS s, quantile_cont(n, 0.5) AS md FROM n), x AS (SELECT *, (n - m) / s < -2.5 AS low, (n - m) / s > 2.5 AS high FROM n, t WHERE s > 0) " + _DENSITY)
def shape_density_outliers_by_z(spark, d):
    return shp.density_outliers(v.shapes(spark, d), use_quantiles=False).select("item", "asset_id", "score")


@query(f"WITH {v.SHAPES} SELECT asset_id, shape_id, issue FROM (SELECT asset_id, shape_id, unnest([CASE WHEN w * h < 400 THEN 'SMALL_AREA' END, CASE WHEN x < 0 OR y < 0 OR x + w > image_width OR y + h > image_height THEN 'OUTSIDE_OF_IMAGE' END]) AS issue FROM shapes) WHERE issue IS NOT NULL")
def shape_issues(spark, d):
    return build.shape_issues(v.shapes(spark, d), 400)


# Relations between classes

_PRESENCE = f"WITH {v.SHAPES}, p AS (SELECT DISTINCT asset_id, label FROM shapes), co AS (SELECT a.label AS label_1, b.label AS label_2, count(*) AS n FROM p a JOIN p b USING (asset_id) GROUP BY 1, 2)"
_IOU = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_PAIRS = f"{_PRESENCE}, pr AS (SELECT a.asset_id, a.shape_id AS shape_1, b.shape_id AS shape_2, least(a.label, b.label) AS label_1, greatest(a.label, b.label) AS label_2, {_IOU} / (a.w * a.h + b.w * b.h - {_IOU}) AS iou FROM shapes a JOIN shapes b ON a.asset_id = b.asset_id AND a.shape_id < b.shape_id)"
_BOTH_WAYS = "SELECT label_1, label_2, {0} FROM m UNION ALL SELECT label_2, label_1, {0} FROM m WHERE label_1 <> label_2"


@query(f"{_PRESENCE} SELECT * FROM co")
def cooccurrence(spark, d):
    return interclass.cooccurrence(v.shapes(spark, d))


@query(f"{_PAIRS} SELECT asset_id, shape_1, shape_2, label_1, label_2, round(iou, 9) AS iou FROM pr")
def shape_pairs(spark, d):
    return rounded(interclass.shape_pairs(v.shapes(spark, d)))


@query(f"{_PAIRS} SELECT asset_id, shape_1, shape_2, label_1, label_2, round(iou, 9) AS iou FROM pr WHERE iou > 0")
def overlapping_pairs(spark, d):
    return rounded(interclass.overlapping_pairs(v.shapes(spark, d)))


@query(f"{_PAIRS} SELECT asset_id, shape_1, shape_2, label_1, label_2, round(iou, 9) AS iou FROM pr WHERE iou > 0")
def overlapping_pairs_tiled(spark, d):
    """With every image compared tile by tile."""
    return rounded(interclass.overlapping_pairs(v.shapes(spark, d), crowded=0))


@query(f"{_PAIRS}, m AS (SELECT label_1, label_2, round(avg(iou), 9) AS mean_iou FROM pr GROUP BY 1, 2) {_BOTH_WAYS.format('mean_iou')}")
def mean_iou_per_pair(spark, d):
    return rounded(interclass.mean_iou_per_pair(v.shapes(spark, d)))


@query(f"{_PAIRS}, m AS (SELECT label_1, label_2, count(*) AS n FROM pr WHERE iou >= 0.2 GROUP BY 1, 2), s AS ({_BOTH_WAYS.format('n')}), l AS (SELECT DISTINCT label FROM shapes) SELECT a.label AS label_1, b.label AS label_2, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN s ON s.label_1 = a.label AND s.label_2 = b.label")
def overlap_counts(spark, d):
    return interclass.overlap_counts(v.shapes(spark, d), dense=True)


@query(f"{_PRESENCE} SELECT label_1 || ' + ' || label_2 AS category, n::DOUBLE AS value FROM co WHERE label_1 <= label_2 ORDER BY n DESC, label_1, label_2 LIMIT 10")
def top_cooccurrences(spark, d):
    return charts.pair_bar(interclass.top_pairs(interclass.cooccurrence(v.shapes(spark, d)), "n"), "n")


@query(f"{_PRESENCE} SELECT label_1 AS label FROM co GROUP BY 1 HAVING sum(n) = 0")
def isolated_classes(spark, d):
    return interclass.isolated_classes(interclass.cooccurrence(v.shapes(spark, d)))


@query(f"{_PRESENCE} SELECT label_1 AS label, 0 AS value FROM co GROUP BY 1 HAVING sum(CASE WHEN label_1 <> label_2 THEN n ELSE 0 END) = 0")
def isolated_classes_off_diagonal(spark, d):
    return interclass.isolated_with_zero(interclass.cooccurrence(v.shapes(spark, d)))


@query(f"{_PRESENCE}, r AS (SELECT label_1 AS label, sum(n)::BIGINT AS total FROM co GROUP BY 1) SELECT label, total FROM r WHERE total > (SELECT avg(total) + stddev_samp(total) FROM r)")
def hub_classes(spark, d):
    return interclass.hub_classes(interclass.cooccurrence(v.shapes(spark, d)))


_N = "(SELECT count(DISTINCT asset_id) FROM shapes)"


@query(f"{_PRESENCE}, rare AS (SELECT label_1, label_2 FROM co WHERE label_1 < label_2 AND n <= greatest(2, {_N} * 0.01)), b AS (SELECT r.label_1, r.label_2, p.asset_id FROM rare r JOIN p ON p.label = r.label_1 JOIN p q ON q.label = r.label_2 AND q.asset_id = p.asset_id), k AS (SELECT label_1, label_2 FROM b GROUP BY 1, 2 HAVING count(*) >= 3) SELECT label_1, label_2, asset_id, count(*) AS n_boxes, string_agg(shape_id, ',' ORDER BY shape_id) AS shapes FROM b JOIN k USING (label_1, label_2) JOIN shapes s USING (asset_id) WHERE s.label IN (label_1, label_2) GROUP BY 1, 2, 3")
def unexpected_cooccurrence(spark, d):
    x = interclass.unexpected_cooccurrence(v.shapes(spark, d))
    return x.select("label_1", "label_2", "asset_id", F.size("boxes").cast("long").alias("n_boxes"), F.array_join(F.transform("boxes", lambda b: b["shape_id"]), ",").alias("shapes"))


@query(f"{_PRESENCE}, u AS (SELECT label_1, label_2 FROM co WHERE label_1 < label_2 AND n >= greatest(3, {_N} * 0.06)), m AS (SELECT label_1, label_2, asset_id, min(label) AS label FROM u JOIN p ON p.label IN (label_1, label_2) GROUP BY 1, 2, 3 HAVING count(*) = 1) SELECT * FROM m WHERE (label_1, label_2) IN (SELECT (label_1, label_2) FROM m GROUP BY label_1, label_2 HAVING count(*) >= 3)")
def missing_expected_cooccurrence(spark, d):
    return interclass.missing_expected_cooccurrence(v.shapes(spark, d))


@query(f"{_PAIRS}, o AS (SELECT label_1, label_2, count(*) AS n FROM pr WHERE iou >= 0.2 GROUP BY 1, 2), f AS (SELECT pr.* FROM pr LEFT JOIN o USING (label_1, label_2) WHERE label_1 < label_2 AND iou > 0.1 AND coalesce(n, 0) <= greatest(3, {_N} * 0.06)) SELECT label_1, label_2, asset_id, shape_1, shape_2, round(iou, 9) AS iou FROM f WHERE (label_1, label_2) IN (SELECT (label_1, label_2) FROM f GROUP BY label_1, label_2 HAVING count(*) >= 3)")
def unexpected_overlap(spark, d):
    return rounded(interclass.unexpected_overlap(v.shapes(spark, d)))


# Embeddings

_VEC = "e AS (SELECT vec_id AS id, label::VARCHAR AS label, embedding::DOUBLE[] AS e FROM embeddings)"
_POS = f"WITH {_VEC}, l AS (SELECT id, label, unnest(range(1, len(e) + 1)) AS pos, unnest(e) AS val FROM e)"
_CENT = f"{_POS}, cm AS (SELECT label, pos, avg(val) AS m FROM l GROUP BY 1, 2), dist AS (SELECT l.id, l.label, sqrt(sum((val - m) * (val - m))) AS distance FROM l JOIN cm USING (label, pos) GROUP BY 1, 2)"


@query(f"{_POS}, cm AS (SELECT label, pos, avg(val) AS m FROM l GROUP BY 1, 2) SELECT label, list(round(m, 9) ORDER BY pos) AS centroid FROM cm GROUP BY label")
def class_centroids(spark, d):
    return embedding.class_centroids(v.vectors(spark, d)).select("label", F.transform("centroid", lambda x: F.round(x, 9)).alias("centroid"))


@query(f"{_CENT} SELECT id AS shape_id, label, round(distance, 9) AS distance FROM dist")
def distance_to_centroid(spark, d):
    return rounded(embedding.distance_to_centroid(v.vectors(spark, d)).select("shape_id", "label", "distance"))


@query(f"{_CENT} SELECT label, id AS shape_id, round(distance, 9) AS distance FROM dist JOIN (SELECT label, quantile_cont(distance, 0.95) AS b, count(*) AS k FROM dist GROUP BY label) USING (label) WHERE k >= 6 AND distance > b")
def intra_class_outliers(spark, d):
    return rounded(embedding.centroid_outliers(v.vectors(spark, d)))


_GLOBAL = f"{_POS}, cm AS (SELECT pos, avg(val) AS m FROM l GROUP BY 1), dist AS (SELECT l.id, sqrt(sum((val - m) * (val - m))) AS distance FROM l JOIN cm USING (pos) GROUP BY 1)"


@query(f"{_GLOBAL} SELECT id AS asset_id, round(distance, 9) AS distance FROM dist")
def global_centroid_distance(spark, d):
    return rounded(embedding.global_centroid_distance(v.vectors(spark, d)))


@query(f"{_GLOBAL}, k AS (SELECT count(*) - floor(count(*) * (1 - 3 / 100.0::DOUBLE))::BIGINT AS k FROM dist) SELECT asset_id, round(distance, 9) AS distance FROM (SELECT id AS asset_id, distance, row_number() OVER (ORDER BY distance DESC, id) AS nth FROM dist), k WHERE nth <= k")
def embedding_outliers(spark, d):
    return rounded(embedding.embedding_outliers(v.vectors(spark, d)))


_NEAR = "near AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.4)"
_REACH = "RECURSIVE {0}, ed AS (SELECT a, b FROM {1} UNION SELECT b, a FROM {1}), reach AS (SELECT a AS id, a AS r FROM ed UNION SELECT reach.id, ed.b FROM reach JOIN ed ON ed.a = reach.r), cl AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id)"


@query(f"WITH {_REACH.format(_VEC + ', ' + _NEAR, 'near')} SELECT id AS asset_id, cluster FROM cl")
def duplicate_clusters(spark, d):
    return embedding.duplicate_clusters(v.vectors(spark, d), min_cosine=0.4)


@query(f"WITH {_REACH.format(_VEC + ', ' + _NEAR, 'near')} SELECT cluster, count(*) OVER (PARTITION BY cluster) AS n, id AS asset_id FROM cl")
def duplicate_cluster_members(spark, d):
    return embedding.cluster_members(embedding.duplicate_clusters(v.vectors(spark, d), min_cosine=0.4))


# Image quality

def _quality_sql(col: str) -> str:
    return (
        f"WITH {v.IMAGES}, t AS (SELECT quantile_cont({col}, 0.05) AS q1, quantile_cont({col}, 0.95) AS q3, quantile_cont({col}, 0.5) AS md, min({col}) AS lo, max({col}) AS hi FROM images WHERE {col} IS NOT NULL), "
        f"x AS (SELECT asset_id, {col} AS val, md, {col} < q1 - 2 * (q3 - q1) OR (lo >= q1 - 2 * (q3 - q1) AND asset_id = (SELECT asset_id FROM images WHERE {col} IS NOT NULL ORDER BY {col}, asset_id LIMIT 1)) AS low, "
        f"{col} > q3 + 2 * (q3 - q1) OR (hi <= q3 + 2 * (q3 - q1) AND asset_id = (SELECT asset_id FROM images WHERE {col} IS NOT NULL ORDER BY {col} DESC, asset_id LIMIT 1)) AS high FROM images, t WHERE {col} IS NOT NULL) "
        "SELECT 'low_outliers' AS item, asset_id::VARCHAR AS asset_id, val AS score FROM x WHERE low UNION ALL SELECT 'high_outliers', asset_id::VARCHAR, val FROM x WHERE high UNION ALL "
        "SELECT 'inliers_sample', asset_id::VARCHAR, val FROM (SELECT * FROM x WHERE NOT low AND NOT high ORDER BY abs(val - md), asset_id LIMIT 5)"
    )


@query(_quality_sql("luminance"))
def luminance_outliers(spark, d):
    return quality.iqr_outliers(v.images(spark, d), "luminance").select("item", "asset_id", "score")


@query(_quality_sql("contrast"))
def contrast_outliers(spark, d):
    return quality.iqr_outliers(v.images(spark, d), "contrast").select("item", "asset_id", "score")


@query(f"WITH {v.IMAGES}, t AS (SELECT quantile_cont(blur_score, 0.99) AS hi, quantile_cont(blur_score, 0.01) AS lo, quantile_cont(blur_score, 0.5) AS md FROM images) SELECT 'high_outliers' AS item, asset_id::VARCHAR AS asset_id, blur_score AS score FROM images, t WHERE blur_score >= hi UNION ALL SELECT 'blurriest', asset_id::VARCHAR, blur_score FROM images, t WHERE blur_score <= lo UNION ALL SELECT 'inliers_sample', asset_id::VARCHAR, blur_score FROM (SELECT * FROM images, t WHERE blur_score < hi ORDER BY abs(blur_score - md), asset_id LIMIT 5)")
def blur_outliers(spark, d):
    return quality.blur_outliers(v.images(spark, d)).select("item", "asset_id", "score")


@query(
    "WITH q AS (" + _quality_sql("luminance") + f"), {v.IMAGES}, i AS (SELECT asset_id, CASE item WHEN 'low_outliers' THEN 'LOW-LUMINANCE' WHEN 'high_outliers' THEN 'HIGH-LUMINANCE' END AS issue FROM q UNION ALL SELECT asset_id::VARCHAR, 'BLURRY' FROM images WHERE is_blurry) "
    "SELECT asset_id, string_agg(DISTINCT issue, ',' ORDER BY issue) AS issues, 'DELETE,TAG' AS potential_actions FROM i WHERE issue IS NOT NULL GROUP BY asset_id"
)
def image_issues(spark, d):
    x = quality.image_issues(v.images(spark, d), quality.iqr_outliers(v.images(spark, d), "luminance"))
    return x.select("asset_id", F.array_join("issues", ",").alias("issues"), F.array_join("potential_actions", ",").alias("potential_actions"))


# Mislabels

_LABELS = f"{_POS}, cm AS (SELECT label, pos, avg(val) AS m FROM l GROUP BY 1, 2), lv AS (SELECT label, list(m ORDER BY pos) AS v FROM cm {{0}} GROUP BY label), sim AS (SELECT e.id, e.label AS own, lv.label, list_dot_product(e.e, v) / (sqrt(list_dot_product(e.e, e.e)) * sqrt(list_dot_product(v, v))) AS s FROM e, lv), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, label) - 1 AS r FROM sim), k AS (SELECT count(*) AS k FROM lv), g AS (SELECT id, own, max(CASE WHEN r = 0 THEN label END) AS suggested_label, max(CASE WHEN label = own THEN r END) AS rank, max(CASE WHEN label = own THEN s END) AS similarity, max(s) AS top_similarity, max(s) - min(CASE WHEN r < greatest(2, floor(k * 0.05)) THEN s END) AS spread, any_value(k) AS k FROM rk, k GROUP BY 1, 2), "
_STATUS = "st AS (SELECT *, CASE WHEN rank IS NULL THEN 'wrong' WHEN rank = 0 THEN 'correct' WHEN k < 10 THEN CASE WHEN rank > 1 OR similarity < 0.5 OR top_similarity - similarity > 0.005 THEN 'wrong' ELSE 'correct' END WHEN rank >= greatest(2, floor(k * 0.05)) THEN CASE WHEN top_similarity >= 0.5 AND top_similarity - similarity > 0.01 THEN 'wrong' ELSE 'ambiguous' END WHEN spread < 0.01 THEN 'ambiguous' ELSE 'correct' END AS status FROM g) SELECT id AS shape_id, own AS label, suggested_label, rank::INT AS rank, round(similarity, 9) AS similarity, round(top_similarity, 9) AS top_similarity, status, CASE status WHEN 'wrong' THEN 'WRONG_CLASS' WHEN 'ambiguous' THEN 'AMBIGUOUS_CLASS' END AS issue FROM st"


def _label_vectors(spark, d):
    return mean_vectors(v.vectors(spark, d), "shape_embeddings", ["label"]).withColumnRenamed("centroid", "embedding")


@query(_LABELS.format("").replace(", k AS (SELECT count(*) AS k FROM lv), g AS", "###").partition("###")[0] + " SELECT id AS shape_id, label, round(s, 9) AS similarity, r::INT AS rank FROM rk")
def label_similarities(spark, d):
    """Every label by its similarity to each shape."""
    return rounded(mislabel.label_similarities(v.vectors(spark, d), _label_vectors(spark, d)))


@query(_LABELS.format("").replace(", k AS (SELECT count(*) AS k FROM lv), g AS", "###").partition("###")[0] + " SELECT id AS shape_id, label, round(s, 9) AS similarity, r::INT AS rank FROM rk WHERE r < 3")
def top_labels(spark, d):
    """The three most similar labels, with the label vectors in blocks of two or so."""
    return rounded(mislabel.label_similarities(v.vectors(spark, d), _label_vectors(spark, d), top=3, label_bytes=1200))


@query(_LABELS.format("") + _STATUS)
def mislabels(spark, d):
    """All ten labels: the rule for many."""
    x = v.vectors(spark, d).drop("asset_id")
    return rounded(mislabel.mislabels(x, _label_vectors(spark, d)))


@query(_LABELS.format("WHERE label < '8'") + _STATUS)
def mislabels_few_labels(spark, d):
    """Eight of ten labels: the rule for few, and unknown labels."""
    x = v.vectors(spark, d).drop("asset_id")
    return rounded(mislabel.mislabels(x, _label_vectors(spark, d).where("label < '8'")))


# Tightness

_MATCH = f"WITH {v.SUGGESTED}, a AS (SELECT * FROM shapes), mt AS (SELECT a.*, b.x AS sx, b.y AS sy, b.w AS sw, b.h AS sh, {_IOU} / (a.w * a.h + b.w * b.h - {_IOU}) AS iou FROM a JOIN suggested b USING (shape_id))"
_DELTA = f"{_MATCH}, dl AS (SELECT *, (x - sx) / image_width AS delta_x1, (y - sy) / image_height AS delta_y1, x / image_width + w / image_width - sx / image_width - sw / image_width AS delta_x2, y / image_height + h / image_height - sy / image_height - sh / image_height AS delta_y2, (w / image_width) * (h / image_height) - (sw / image_width) * (sh / image_height) AS delta_area FROM mt WHERE iou >= (SELECT quantile_cont(iou, 0.5) FROM mt))"
_MEANS = "round(1 - avg(delta_area), 9) AS tightness_score, round(avg(delta_x1), 9) AS delta_x1, round(avg(delta_y1), 9) AS delta_y1, round(avg(delta_x2), 9) AS delta_x2, round(avg(delta_y2), 9) AS delta_y2"


def _matched(spark, d):
    return tightness.match_suggestions(v.shapes(spark, d), v.suggested(spark, d))


@query(f"{_MATCH} SELECT shape_id, round(x / image_width, 9) AS nx, round(sx / image_width, 9) AS snx, round(iou, 9) AS iou FROM mt")
def matched_suggestions(spark, d):
    return rounded(_matched(spark, d).select("shape_id", "nx", "snx", "iou"))


@query(f"{_DELTA} SELECT shape_id, round(delta_x1, 9) AS delta_x1, round(delta_y1, 9) AS delta_y1, round(delta_x2, 9) AS delta_x2, round(delta_y2, 9) AS delta_y2, round(delta_area, 9) AS delta_area FROM dl")
def tightness_deltas(spark, d):
    return rounded(tightness.tightness_deltas(_matched(spark, d)).select("shape_id", *[f"delta_{k}" for k in tightness.DELTAS]))


@query(f"{_DELTA} SELECT {_MEANS} FROM dl")
def tightness_global(spark, d):
    return rounded(tightness.tightness_global(tightness.tightness_deltas(_matched(spark, d))))


@query(f"{_DELTA} SELECT label, {_MEANS} FROM dl GROUP BY label")
def tightness_per_class(spark, d):
    return rounded(tightness.tightness_per_class(tightness.tightness_deltas(_matched(spark, d))))


@query(f"{_MATCH} SELECT asset_id, shape_id, label, round(iou, 9) AS iou, w AS actual_w, sw AS expected_w, 'TAG,DELETE' AS actions FROM mt WHERE iou > 0.5 AND iou < 0.9")
def tightness_issues(spark, d):
    x = tightness.tightness_issues(_matched(spark, d))
    return rounded(x.select("asset_id", "shape_id", "label", "iou", c("actual.w").alias("actual_w"), c("expected.w").alias("expected_w"), F.array_join("actions", ",").alias("actions")))


@query(f"WITH {v.SHAPES} SELECT shape_id FROM shapes WHERE asset_id IN (SELECT DISTINCT asset_id FROM shapes ORDER BY 1 LIMIT 5)")
def tightness_asset_sample(spark, d):
    return tightness.first_assets(v.shapes(spark, d), 5).select("shape_id")


def _box_sql(rows: str, by: str, col: str) -> str:
    return f"bx AS (SELECT {by}, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median, quantile_cont({col}, 0.75) AS q3, min({col}) AS lo, max({col}) AS hi, count({col}) AS n FROM {rows} GROUP BY ALL) SELECT {by}, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 9) AS low, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, round(least(hi, q3 + 1.5 * (q3 - q1)), 9) AS high, n FROM bx"


@query(f"{_DELTA}, lg AS (SELECT label || '/x1' AS category, delta_x1 AS val FROM dl UNION ALL SELECT label || '/y1', delta_y1 FROM dl UNION ALL SELECT label || '/x2', delta_x2 FROM dl UNION ALL SELECT label || '/y2', delta_y2 FROM dl), " + _box_sql("lg", "category", "val"))
def tightness_boxplots(spark, d):
    x = tightness.long_deltas(tightness.tightness_deltas(_matched(spark, d)))
    return rounded(charts.boxplot(x.withColumn("name", F.concat_ws("/", "label", "side")), "name", "value"))


@query(f"WITH {v.SHAPES}, k AS (SELECT *, 1024 / greatest(image_width, image_height) AS sc FROM shapes) SELECT shape_id, trunc(greatest(trunc(x * sc) * (1 - 0.1::DOUBLE), 1.0))::INT AS px1, trunc(greatest(trunc(y * sc) * (1 - 0.1::DOUBLE), 1.0))::INT AS py1, trunc(least(trunc((x + w) * sc) * (1 + 0.1::DOUBLE), trunc(image_width * sc) - 1))::INT AS px2, trunc(least(trunc((y + h) * sc) * (1 + 0.1::DOUBLE), trunc(image_height * sc) - 1))::INT AS py2 FROM k")
def prompt_boxes(spark, d):
    return geometry.prompt_boxes(v.shapes(spark, d)).select("shape_id", "px1", "py1", "px2", "py2")


@query(f"WITH {v.FEATURES} SELECT shape_id, trunc((center_x - w_norm / 2) * image_width)::INT AS x, trunc((center_y - h_norm / 2) * image_height)::INT AS y, trunc(w_norm * image_width)::INT AS w, trunc(h_norm * image_height)::INT AS h FROM features")
def denormalized_boxes(spark, d):
    x = features(spark, d).select("shape_id", c("center_x").alias("cx"), c("center_y").alias("cy"), c("w_norm").alias("nw"), c("h_norm").alias("nh"), "image_width", "image_height")
    return geometry.denormalize_boxes(x).select("shape_id", "x", "y", "w", "h")


# Captions

_STOP = ", ".join(f"'{w}'" for w in captions.STOP_WORDS)
_TERMS = rf"tk AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents WHERE text IS NOT NULL), tf AS (SELECT id, term, count(*) AS tf FROM tk WHERE term NOT IN ({_STOP}) GROUP BY 1, 2)"
_TFIDF = f"{_TERMS}, dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), nn AS (SELECT count(text) AS n FROM documents), wu AS (SELECT id, term, df, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN dfs USING (term), nn), wt AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM wu)"
_CAPS = f"{_TFIDF}, first AS (SELECT min(doc_id) AS id, count(*) AS copies, text FROM documents WHERE text IS NOT NULL GROUP BY text), rep AS (SELECT id, term, w FROM wt SEMI JOIN first USING (id)), near AS (SELECT a.id AS a, b.id AS b FROM rep a JOIN rep b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.875 - 1e-12)"
_CLUSTER = "RECURSIVE " + _CAPS + ", ed AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach AS (SELECT a AS id, a AS r FROM ed UNION SELECT reach.id, ed.b FROM reach JOIN ed ON ed.a = reach.r), cl AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id), em AS (SELECT min(doc_id) AS e, count(*) AS k FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT id FROM tf)), cc AS (SELECT d.doc_id AS asset_id, coalesce(CASE WHEN d.doc_id NOT IN (SELECT id FROM tf) THEN CASE WHEN k > 1 THEN e END ELSE coalesce(cl.cluster, CASE WHEN copies > 1 THEN first.id END) END::VARCHAR, '-1') AS cluster FROM documents d JOIN first USING (text) LEFT JOIN cl ON cl.id = first.id, em)"


@query(f"WITH {_TFIDF} SELECT id AS asset_id, term, round(w, 9) AS weight FROM wt")
def caption_tfidf(spark, d):
    return rounded(captions.tfidf(v.captions(spark, d)).select("asset_id", "term", "weight"))


@query(f"WITH {_CLUSTER} SELECT asset_id, cluster FROM cc")
def caption_clusters(spark, d):
    return captions.caption_clusters(v.captions(spark, d))


#: The same with five samples: core points, their components, and border points with the smallest cluster that they reach.
_FIVE = (
    "RECURSIVE " + _CAPS.replace("0.875 - 1e-12", "0.68 - 1e-12").replace("near AS (", "near AS MATERIALIZED (") + ", ed AS MATERIALIZED (SELECT a, b FROM near UNION SELECT b, a FROM near), ot AS (SELECT ed.a AS id, sum(f.copies) AS n FROM ed JOIN first f ON f.id = ed.b GROUP BY 1), nc AS MATERIALIZED (SELECT first.id, first.copies + coalesce(ot.n, 0) AS n FROM first LEFT JOIN ot USING (id) SEMI JOIN rep USING (id)), "
    "core AS MATERIALIZED (SELECT id FROM nc WHERE n >= 5), reach AS (SELECT id, id AS r FROM core UNION SELECT reach.id, ed.b FROM reach JOIN ed ON ed.a = reach.r SEMI JOIN core ON core.id = ed.b), cl AS MATERIALIZED (SELECT id, min(r) AS cluster FROM reach GROUP BY id), "
    "bd AS (SELECT ed.a AS id, min(cluster) AS cluster FROM ed JOIN cl ON cl.id = ed.b WHERE ed.a NOT IN (SELECT id FROM core) GROUP BY 1), em AS (SELECT min(doc_id) AS e, count(*) AS k FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT id FROM tf)), "
    "cc AS (SELECT d.doc_id AS asset_id, coalesce(CASE WHEN d.doc_id NOT IN (SELECT id FROM tf) THEN CASE WHEN k >= 5 THEN e END ELSE coalesce(cl.cluster, bd.cluster) END::VARCHAR, '-1') AS cluster FROM documents d JOIN first USING (text) LEFT JOIN cl ON cl.id = first.id LEFT JOIN bd ON bd.id = first.id, em)"
)


@query(f"WITH {_FIVE} SELECT asset_id, cluster FROM cc")
def caption_clusters_of_five(spark, d):
    """Five samples at distance 0.8, a cosine of 0.68."""
    return captions.caption_clusters(v.captions(spark, d), eps=0.8, min_samples=5)


@query(f"WITH {_CLUSTER}, ct AS (SELECT cluster, id, term, tf FROM tf JOIN cc ON cc.asset_id = tf.id), cd AS (SELECT cluster, term, count(*) AS df FROM ct GROUP BY 1, 2), cn AS (SELECT cluster, count(*) AS n FROM cc GROUP BY 1), cw AS (SELECT cluster, id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM ct JOIN cd USING (cluster, term) JOIN cn USING (cluster)), cu AS (SELECT cluster, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster, id)) AS w FROM cw), cs AS (SELECT cluster, term, round(sum(w), 9) AS w FROM cu GROUP BY 1, 2), cr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, term) AS nth FROM cs) SELECT cluster, string_agg(term, ' ' ORDER BY nth) AS keywords FROM cr WHERE nth <= 10 GROUP BY cluster")
def caption_cluster_keywords(spark, d):
    x = v.captions(spark, d)
    return captions.cluster_keywords(x, captions.caption_clusters(x))


@query(f"WITH {_CLUSTER} SELECT cluster, asset_id, 'TAG' AS actions FROM cc")
def caption_cluster_members(spark, d):
    x = captions.cluster_assets(captions.caption_clusters(v.captions(spark, d)))
    return x.withColumn("actions", F.array_join("actions", ","))


# Charts


@query(f"WITH {v.SHAPES} SELECT label AS category, count(*)::DOUBLE AS value FROM shapes GROUP BY label")
def class_distribution_bar(spark, d):
    return charts.bar(shp.class_distribution(v.shapes(spark, d)), c("label"), c("n"))


def _histogram_sql(rows: str, col: str, bins: int) -> str:
    return (
        f"hv AS (SELECT {col}::DOUBLE AS val FROM {rows} WHERE {col} IS NOT NULL), ht AS (SELECT CASE WHEN min(val) = max(val) THEN min(val) - 0.5 ELSE min(val) END AS a, CASE WHEN min(val) = max(val) THEN max(val) + 0.5 ELSE max(val) END AS b FROM hv), "
        f"hn AS (SELECT least(floor((val - a) / (b - a) * {bins}), {bins - 1})::INT AS bin, count(*) AS n FROM hv, ht GROUP BY 1) "
        f"SELECT i::INT AS bin, round(a + (b - a) / {bins} * i, 9) AS lo, round(a + (b - a) / {bins} * (i + 1), 9) AS hi, coalesce(n, 0)::BIGINT AS n FROM ht, range({bins}) r(i) LEFT JOIN hn ON hn.bin = i"
    )


@query(f"WITH {v.IMAGES}, " + _histogram_sql("images", "luminance", 50))
def luminance_histogram(spark, d):
    return rounded(charts.histogram(v.images(spark, d), "luminance"))


@query(f"WITH {v.FEATURES}, " + _histogram_sql("features", "aspect_ratio", 50))
def aspect_ratio_histogram(spark, d):
    return rounded(charts.histogram(features(spark, d), "aspect_ratio"))


@query(f"WITH {v.SHAPES}, n AS (SELECT count(shape_id) AS n FROM shapes GROUP BY asset_id), " + _histogram_sql("n", "n", 30))
def density_histogram(spark, d):
    return rounded(charts.histogram(shp.counts_per_asset(v.shapes(spark, d)), "n", 30))


@query(f"WITH {v.FEATURES}, ft AS (SELECT label AS category, area FROM features), " + _box_sql("ft", "category", "area"))
def area_boxplot(spark, d):
    return rounded(charts.boxplot(features(spark, d), "label", "area"))


@query(f"WITH {v.FEATURES}, bx AS (SELECT label, quantile_cont(area, 0.25) AS q1, quantile_cont(area, 0.75) AS q3, min(area) AS lo, max(area) AS hi FROM features GROUP BY label) SELECT label AS category, round(area, 9) AS value FROM features JOIN bx USING (label) WHERE area < greatest(lo, q1 - 1.5 * (q3 - q1)) OR area > least(hi, q3 + 1.5 * (q3 - q1))")
def area_boxplot_outliers(spark, d):
    return rounded(charts.boxplot_outliers(features(spark, d), "label", "area"))


@query(f"{_PRESENCE} SELECT label_1, coalesce(sum(n) FILTER (label_2 = 'rare_a'), 0)::BIGINT AS rare_a, coalesce(sum(n) FILTER (label_2 = 'rare_b'), 0)::BIGINT AS rare_b FROM co GROUP BY label_1")
def cooccurrence_heatmap(spark, d):
    return charts.heatmap(interclass.cooccurrence(v.shapes(spark, d)), "n", ["rare_a", "rare_b"])


@query(f"WITH {v.FEATURES} SELECT round(center_x, 9) AS center_x, round(center_y, 9) AS center_y, label FROM features")
def center_scatter(spark, d):
    return rounded(charts.scatter(features(spark, d)))


@query(f"WITH {v.FEATURES} SELECT least(floor(center_x * 20), 19)::BIGINT AS cell_x, least(floor(center_y * 20), 19)::BIGINT AS cell_y, label, count(*) AS n FROM features GROUP BY 1, 2, 3")
def center_grid(spark, d):
    return charts.scatter(features(spark, d), cells=20)


@query(f"WITH {v.SHAPES}, n AS (SELECT asset_id, count(shape_id) AS n FROM shapes GROUP BY asset_id) SELECT n AS x, count(*) AS y FROM n GROUP BY n")
def density_line(spark, d):
    n = shp.counts_per_asset(v.shapes(spark, d)).groupBy("n").agg(F.count("*").alias("assets"))
    return charts.line(n, "n", "assets")


@query(f"WITH {v.FEATURES} SELECT unnest([0, 1, 2]) AS ordinal, unnest(['num_shapes', 'num_classes', 'num_assets']) AS key, unnest([count(*)::VARCHAR, count(DISTINCT label)::VARCHAR, count(DISTINCT asset_id)::VARCHAR]) AS value FROM features")
def statistics_card(spark, d):
    row = features(spark, d).agg(F.count("*").alias("num_shapes"), F.countDistinct("label").alias("num_classes"), F.countDistinct("asset_id").alias("num_assets"))
    return charts.table_card(row)


@query(f"WITH {v.SHAPES} SELECT '| shapes | labels |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || count(*) || ' | ' || count(DISTINCT label) || ' |' AS text FROM shapes")
def statistics_markdown(spark, d):
    return charts.markdown_table(v.shapes(spark, d).agg(F.count("*").alias("shapes"), F.countDistinct("label").alias("labels")))


@query(f"WITH {v.SHAPES} SELECT count(*) = 0 AS empty FROM shapes")
def chart_is_empty(spark, d):
    return charts.is_empty(shp.class_distribution(v.shapes(spark, d)), "n")


# Building the tables

_ANN = f"{v.SHAPES}, an AS (SELECT asset_id, half, min(l_shipdate) AS created_at, asset_id || '/' || half AS annotation_id, CASE asset_id % 3 WHEN 0 THEN 'OBJECT_DETECTION' WHEN 1 THEN 'SEGMENTATION' ELSE 'CLASSIFICATION' END AS task_type FROM (SELECT *, l_linenumber % 2 AS half FROM shapes) GROUP BY asset_id, half)"
_FLAT = "SELECT s.asset_id, annotation_id, shape_id, task_type, label, 'id-' || label AS label_id, CASE WHEN task_type <> 'CLASSIFICATION' THEN x END AS x, CASE WHEN task_type <> 'CLASSIFICATION' THEN y END AS y, CASE WHEN task_type <> 'CLASSIFICATION' THEN w END AS w, CASE WHEN task_type <> 'CLASSIFICATION' THEN h END AS h FROM shapes s JOIN {0} a ON s.asset_id = a.asset_id AND s.l_linenumber % 2 = a.half"


@query(f"WITH {_ANN}, fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY created_at, annotation_id) AS nth FROM an) WHERE nth = 1) SELECT asset_id, annotation_id, task_type FROM fa")
def first_annotations(spark, d):
    return build.first_annotation(v.annotations(spark, d)).select("asset_id", "annotation_id", "task_type")


@query(f"WITH {_ANN} {_FLAT.format('an')}")
def loaded_shapes(spark, d):
    return src.load_shapes(v.annotations(spark, d))


@query(f"WITH {_ANN}, ls AS ({_FLAT.format('an')}) SELECT shape_id, label FROM ls WHERE x IS NULL OR w * h > 400")
def without_tiny_shapes(spark, d):
    return build.drop_tiny_shapes(src.load_shapes(v.annotations(spark, d)), 400).select("shape_id", "label")


@query(f"WITH {v.SHAPES} SELECT s.shape_id, o_orderpriority AS filename FROM shapes s JOIN orders ON asset_id = o_orderkey WHERE o_orderstatus <> 'F'")
def shapes_with_image_meta(spark, d):
    images = v.table(spark, d, "orders").where("o_orderstatus <> 'F'").selectExpr("o_orderkey AS asset_id", "o_orderpriority AS filename", "'' AS asset_url", "200 AS width", "150 AS height")
    return build.join_image_meta(v.shapes(spark, d).drop("image_width", "image_height"), images)[0].select("shape_id", "filename")


@query(f"WITH {v.SHAPES} SELECT DISTINCT asset_id FROM shapes WHERE asset_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def shapes_without_image(spark, d):
    images = v.table(spark, d, "orders").where("o_orderstatus <> 'F'").selectExpr("o_orderkey AS asset_id", "o_orderpriority AS filename", "'' AS asset_url", "200 AS width", "150 AS height")
    return build.join_image_meta(v.shapes(spark, d).drop("image_width", "image_height"), images)[1]


@query("SELECT doc_id AS asset_id, len(embedding) AS dimensions FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def image_vectors(spark, d):
    points = v.table(spark, d, "embeddings").select(c("vec_id").alias("id"), F.create_map(F.lit("clip"), c("embedding")).alias("vector"))
    assets = v.table(spark, d, "documents").select(c("doc_id").alias("asset_id"))
    return src.load_image_vectors(assets, points, "clip").select("asset_id", F.when(c("clip_embeddings").isNotNull(), F.size("clip_embeddings")).cast("long").alias("dimensions"))


@query("SELECT count(*) AS total, count(embedding) AS with_vector, count(embedding) > floor(count(*) / 2) AS ready FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def embedding_coverage(spark, d):
    shapes = v.table(spark, d, "documents").select(c("doc_id").alias("shape_id"))
    points = v.table(spark, d, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vector"))
    return build.embedding_coverage(build.attach_shape_vectors(shapes, points))


@query("SELECT vec_id AS id, len(embedding) AS dimensions FROM embeddings")
def parsed_vectors(spark, d):
    text = v.table(spark, d, "embeddings").select(c("vec_id").alias("id"), F.to_json("embedding").alias("vector"))
    return src.parsed_vectors(text, "vector").select("id", F.size("vector").cast("long").alias("dimensions"))


@query("SELECT conv_id AS asset_id, string_agg(DISTINCT role, ',' ORDER BY role) AS tags FROM conversations GROUP BY conv_id")
def projected_tags(spark, d):
    assets = v.table(spark, d, "conversations").groupBy(c("conv_id").alias("asset_id")).agg(F.array_sort(F.collect_set(F.struct(c("role").alias("name"), F.lit("t").alias("id")))).alias("tags"))
    return src.project_tags(assets).select("asset_id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query(f"WITH {v.IMAGES} SELECT asset_id, luminance FROM images")
def lenient_projection(spark, d):
    return build.project(v.images(spark, d), ["luminance", "no_such_column", "luminance"])


@query(f"WITH {v.SHAPES} SELECT asset_id, shape_id AS annotation_id, label, w, h FROM shapes")
def lenient_shape_projection(spark, d):
    shapes = v.shapes(spark, d).withColumnRenamed("shape_id", "annotation_id")
    return build.project(shapes, ["label", "w", "label", "no_such_column", "h"], build.SHAPE_KEYS)


@query(f"WITH {v.SHAPES} SELECT shape_id FROM shapes WHERE (SELECT count(DISTINCT label) > 1 AND count(x) > 0 FROM shapes)")
def guarded_shapes(spark, d):
    s = v.shapes(spark, d)
    return build.guarded(s, s).select("shape_id")


@query("SELECT doc_id AS asset_id FROM documents WHERE text IS NOT NULL")
def captioned(spark, d):
    return captions.without_null_captions(v.captions(spark, d)).select("asset_id")


# Report and curation


@query(_outlier_sql("area", 1) + ", o AS (SELECT CASE WHEN below THEN 'small_shapes' ELSE 'large_shapes' END AS item, label, asset_id::VARCHAR AS asset_id, shape_id FROM x WHERE below OR above UNION ALL SELECT 'typical_shapes', label, asset_id::VARCHAR, shape_id FROM ty) SELECT item, shape_id, ordinal::INT AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY label, asset_id, shape_id) AS ordinal FROM o) WHERE ordinal <= 100")
def outlier_preview(spark, d):
    return report.preview(shp.area_outliers(features(spark, d))).select("item", "shape_id", "ordinal")


@query(_COUNTS + "t AS (SELECT quantile_cont(n, 0.05) AS lo, quantile_cont(n, 0.95) AS hi, quantile_cont(n, 0.5) AS md FROM n), x AS (SELECT *, n <= lo AS low, n >= hi AS high FROM n, t), o AS (" + _DENSITY + "), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY asset_id) AS k FROM o) SELECT item, '🔹 ' || CASE item WHEN 'few_objects' THEN 'Images with very few objects (underpopulated)' WHEN 'many_objects' THEN 'Images with too many objects (overcrowded)' ELSE 'Images with typical object count' END || ':' AS text, string_agg(asset_id, ',' ORDER BY k) AS ids FROM r WHERE k <= 100 GROUP BY item")
def outlier_texts(spark, d):
    return report.item_texts(shp.density_outliers(v.shapes(spark, d))).select("item", "text", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {v.SHAPES}, n AS (SELECT label, count(*) AS n FROM shapes GROUP BY label) SELECT 'Annotation Quality' AS section, 'Class Analysis' AS sub_section, upper(label[1]) || lower(label[2:]) || ': ' || n AS text FROM n")
def located_contents(spark, d):
    n = shp.class_distribution(v.shapes(spark, d))
    rows = n.select(F.lit("Class Distribution").alias("name"), F.concat(report.capitalized(c("label")), F.lit(": "), c("n").cast("string")).alias("text"))
    return report.located(rows).select("section", "sub_section", "text")


@query(f"WITH {v.SHAPES}, n AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) AS k FROM shapes GROUP BY label) SELECT string_agg('Label ' || label || ': <Data id=\"chart-' || k || '\"/>', chr(10) || chr(10) ORDER BY k) AS text, string_agg('chart-' || k || '=' || n, ',' ORDER BY k) AS charts FROM n")
def merged_contents(spark, d):
    n = interclass.numbered(shp.class_distribution(v.shapes(spark, d)).withColumn("one", F.lit(1)), ["one"], ["label"])
    chart = F.struct(F.lit("chart-1").alias("id"), c("n").cast("string").alias("data"))
    x = report.merge_contents(n.select(c("nth").alias("ordinal"), F.concat(F.lit("Label "), c("label"), F.lit(': <Data id="chart-1"/>')).alias("text"), F.array(chart).alias("charts")))
    return x.select("text", F.array_join(F.transform("charts", lambda s: F.concat(s["id"], F.lit("="), s["data"])), ",").alias("charts"))


_MD = "chr(10) || '###' || name || chr(10) || text || chr(10)"


@query(f"WITH {v.SHAPES}, cd AS (SELECT string_agg(chr(10) || '###Class Distribution' || chr(10) || label || ': ' || n || chr(10), '' ORDER BY label) AS b FROM (SELECT label, count(*) AS n FROM shapes GROUP BY label)) SELECT '# Dataset Overview' || chr(10) || '# Overview' || chr(10) || chr(10) || '# Image Quality' || chr(10) || '# Image Statistics Analysis' || chr(10) || chr(10) || '# Image Quality Issues' || chr(10) || chr(10) || '# Annotation Quality' || chr(10) || '# Class Analysis' || chr(10) || b || chr(10) || '# Single Object Analysis' || chr(10) || chr(10) || '# Inter-Class Relation Analysis' || chr(10) || chr(10) || '# Annotation Outlier Detection' || chr(10) || chr(10) AS text FROM cd")
def report_markdown(spark, d):
    n = interclass.numbered(shp.class_distribution(v.shapes(spark, d)).withColumn("one", F.lit(1)), ["one"], ["label"])
    rows = n.select(F.lit("Class Distribution").alias("name"), c("nth").alias("ordinal"), F.concat(c("label"), F.lit(": "), c("n").cast("string")).alias("text"))
    return report.report_markdown(report.located(rows))


@query(f"WITH {v.IMAGES} SELECT 'somebody' AS creator, 'events' AS name, '1' AS version, 'values of events' AS description, count(*) AS size, 'CLASSIFICATION' AS task_type FROM images")
def data_card(spark, d):
    return report.data_card(v.images(spark, d), "somebody", "events", "1", "values of events", "CLASSIFICATION")


@query(f"WITH {v.SHAPES}, n AS (SELECT label, count(*) AS n FROM shapes GROUP BY label) SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS images, (SELECT count(DISTINCT asset_id) FROM shapes) AS annotated_images, (SELECT count(*) FROM n) AS labels, (SELECT sum(n)::BIGINT FROM n) AS instances, (SELECT string_agg(label || ': ' || n, ', ' ORDER BY n DESC, label) FROM n) AS repartition")
def dataset_info(spark, d):
    images = v.table(spark, d, "orders").select(c("o_orderkey").alias("asset_id"))
    return curate.dataset_info(images, v.shapes(spark, d)).withColumn("repartition", F.array_join("repartition", ", "))


@query("SELECT event_id AS asset_id, CASE WHEN value > 100 AND event_type <> 'bright' THEN event_type || ',bright' ELSE event_type END AS tags FROM events")
def tagged_assets(spark, d):
    images = v.images(spark, d).select("asset_id", "luminance", F.array("event_type").alias("tags"))
    once = curate.tag_assets(images, images.where("luminance > 100"), "bright")
    return curate.tag_assets(once, images.where("luminance > 100"), "bright").select("asset_id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {v.SHAPES}, g AS (SELECT asset_id FROM shapes GROUP BY asset_id HAVING count(*) > 4) SELECT shape_id FROM shapes WHERE asset_id NOT IN (SELECT asset_id FROM g)")
def without_deleted_assets(spark, d):
    s = v.shapes(spark, d)
    crowded = shp.counts_per_asset(s).where("n > 4")
    return curate.delete_assets(s.select("asset_id").distinct(), s, crowded)[1].select("shape_id")


@query(f"WITH {v.SHAPES} SELECT 'deep-copy' AS mode, (SELECT count(*) FROM events) AS images, count(DISTINCT label) AS labels, count(*) AS shapes FROM shapes UNION ALL SELECT 'soft-copy', (SELECT count(*) FROM events), count(DISTINCT label), 0 FROM shapes UNION ALL SELECT 'image', (SELECT count(*) FROM events), 0, 0")
def forked_versions(spark, d):
    out = None
    for mode in ("deep-copy", "soft-copy", "image"):
        parts = curate.fork(v.images(spark, d), v.shapes(spark, d), mode)
        n = [p.agg(F.count("*").alias(k)) for k, p in zip(("images", "labels", "shapes"), parts, strict=True)]
        row = n[0].crossJoin(n[1]).crossJoin(n[2]).select(F.lit(mode).alias("mode"), "images", "labels", "shapes")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT event_id AS asset_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events")
def written_timestamps(spark, d):
    return v.table(spark, d, "events").select(c("event_id").alias("asset_id"), curate.written_at(c("ts")).alias("created_at"))


@query("SELECT doc_id, replace(text, chr(10) || chr(10), chr(10)) AS text FROM documents")
def cleaned_newlines(spark, d):
    return v.table(spark, d, "documents").select("doc_id", report.clean_newlines(c("text")).alias("text"))


# Tables in and out, images, and the frame of checks


def _round_trip(df: DataFrame, what: str, write, read) -> DataFrame:
    """df written by `write(df, path)` to a new folder beside the other tables and read again by `read(spark, path)`."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    write(df, path + ".csv")
    return read(df.sparkSession, path + ".csv")


@query(f"WITH {v.FEATURES} SELECT shape_id, label, x, y, w, h, round(area, 9) AS area FROM features")
def metadata_csv(spark, d):
    """A shape table to CSV and back; one column is an array on the way."""
    x = features(spark, d).select("shape_id", "label", F.array("x", "y", "w", "h").alias("box"), "area")
    back = _round_trip(x, "shapes", src.write_metadata_csv, lambda s, p: src.read_metadata_csv(s, p, "shape_id string, label string, box array<double>, area double"))
    return rounded(back.select("shape_id", "label", *[c("box")[i].alias(k) for i, k in enumerate("xywh")], "area"))


@query("SELECT event_id::VARCHAR AS asset_id, event_type || '.jpg' AS filename, CASE WHEN value > 50 THEN event_type || ',' || user_id ELSE '' END AS tags FROM events")
def loaded_assets(spark, d):
    """Assets of a JSON export; some have no tags."""
    tag = lambda k: F.struct(F.concat(F.lit("id-"), c(k).cast("string")).alias("id"), c(k).cast("string").alias("name"))
    x = v.table(spark, d, "events").select(c("event_id").cast("string").alias("asset_id"), F.concat("event_type", F.lit(".jpg")).alias("filename"), F.when(c("value") > 50, F.array(tag("event_type"), tag("user_id"))).alias("tags"))
    back = _round_trip(x, "assets", lambda t, p: t.write.json(p), src.load_assets)
    return back.select("asset_id", "filename", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {v.SHAPES} SELECT 'Class Distribution' AS name, label || ': ' || count(*) AS text, 'TAG,DELETE' AS actions FROM shapes GROUP BY label")
def stored_report(spark, d):
    """A report written and read again."""
    n = shp.class_distribution(v.shapes(spark, d)).select(F.concat("label", F.lit(": "), c("n").cast("string")).alias("text"))
    x = n.select(F.lit("Annotation Quality").alias("section"), F.lit("Class Analysis").alias("sub_section"), F.lit("Class Distribution").alias("name"), F.lit(1).alias("ordinal"), "text", F.lit("{}").alias("data_json"), report.actions_of("clip_outliers").alias("actions"))
    return _round_trip(x, "report", src.write_report, src.read_report).select("name", "text", F.array_join("actions", ",").alias("actions"))


@query("SELECT event_type AS name, CASE WHEN value < 50 THEN 'content' ELSE 'error' END AS type, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT 'done', 'event', 1")
def appended_content(spark, d):
    """Contents, errors and the closing event appended one after the other."""
    x = v.table(spark, d, "events").select(c("event_type").alias("name"), F.when(c("value") < 50, "content").otherwise("error").alias("type"))

    def write(t, path):
        for batch in (0, 1, 1):  # the second one twice, as after a failure
            src.append_content(t.where(c("type") == ("content", "error")[batch]), path, batch)
        src.append_content(t.sparkSession.createDataFrame([("done", "event")], "name string, type string"), path, "end")

    return _round_trip(x, "content", write, lambda s, p: src.read_content(s, p, "name string")).groupBy("name", "type").agg(F.count("*").alias("n"))


#: Grey images of 8 x 8 from 64 components: round(128 + 40 * component), cut to 0..255.
_PIXELS = "px AS (SELECT vec_id AS id, unnest(range(64)) AS p, unnest(list_transform(embedding, lambda e: least(255, greatest(0, round(128 + 40 * e::DOUBLE)))::DOUBLE)) AS v FROM embeddings), cell AS (SELECT id, p // 8 AS i, p % 8 AS j, v FROM px)"
_NEIGHBOURS = "nb AS (SELECT id, i, j, v, CASE WHEN i = 0 THEN 1 ELSE i - 1 END AS up, CASE WHEN i = 7 THEN 6 ELSE i + 1 END AS dn, CASE WHEN j = 0 THEN 1 ELSE j - 1 END AS lf, CASE WHEN j = 7 THEN 6 ELSE j + 1 END AS rt FROM cell)"
_LAPLACE = (
    f"{_PIXELS}, {_NEIGHBOURS}, lap AS (SELECT n.id, n.v, u.v + w.v + l.v + r.v - 4 * n.v AS e FROM nb n JOIN cell u ON u.id = n.id AND u.i = n.up AND u.j = n.j JOIN cell w ON w.id = n.id AND w.i = n.dn AND w.j = n.j "
    "JOIN cell l ON l.id = n.id AND l.i = n.i AND l.j = n.lf JOIN cell r ON r.id = n.id AND r.i = n.i AND r.j = n.rt), "
    "q AS (SELECT id, var_pop(e) AS blur_score, avg(v) AS luminance, stddev_pop(v) AS contrast FROM lap GROUP BY id), "
    "met AS (SELECT id, round(blur_score, 6) AS blur_score, blur_score < 500 AS is_blurry, round(luminance, 6) AS luminance, round(contrast, 6) AS contrast, id % 10 = 3 AS broken FROM q)"
)


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as grey images, in the columns of decoded files; every tenth has lost its last byte."""
    byte = lambda e: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.round(128 + 40 * e.cast("double")))).cast("long")), 2, "0")
    x = v.table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", byte), "")).alias("data"))
    data = F.when(c("vec_id") % 10 == 3, F.substring("data", 1, 63)).otherwise(c("data"))
    return x.select(c("vec_id").cast("string").alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("nChannels"), data.alias("data"))


#: Per label, how many of its vectors are positive in each of the 64 places, modulo 256: a grey picture, and with the next two places a coloured one.
_FILES = (
    "cnt AS (SELECT label, p, count(*) FILTER (WHERE v > 0) % 256 AS v FROM (SELECT label, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2), "
    "pix AS (SELECT a.label, a.p, a.v::DOUBLE AS r, b.v::DOUBLE AS g, e.v::DOUBLE AS b FROM cnt a JOIN cnt b ON b.label = a.label AND b.p = (a.p + 1) % 64 JOIN cnt e ON e.label = a.label AND e.p = (a.p + 2) % 64), "
    "files AS (SELECT label || '-grey' AS name, p, r, r AS g, r AS b FROM pix UNION ALL SELECT label || '-colour', p, r, g, b FROM pix), "
    "light AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l, round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) AS grey, p // 8 AS i, p % 8 AS j FROM files), "
    "edge AS (SELECT n.*, u.grey + w.grey + x.grey + y.grey - 4 * n.grey AS e FROM light n JOIN light u ON u.name = n.name AND u.j = n.j AND u.i = CASE n.i WHEN 0 THEN 1 ELSE n.i - 1 END JOIN light w ON w.name = n.name AND w.j = n.j AND w.i = CASE n.i WHEN 7 THEN 6 ELSE n.i + 1 END "
    "JOIN light x ON x.name = n.name AND x.i = n.i AND x.j = CASE n.j WHEN 0 THEN 1 ELSE n.j - 1 END JOIN light y ON y.name = n.name AND y.i = n.i AND y.j = CASE n.j WHEN 7 THEN 6 ELSE n.j + 1 END)"
)


def _png(name: str, values: list[int]) -> bytes:
    """A PNG of 8 x 8 from 64 values: grey, coloured (a value and the next two for red, green and blue), or cut off, by the end of its name."""
    grey = not name.endswith("-colour")
    rows = [values[8 * i : 8 * i + 8] if grey else [values[(8 * i + j + k) % 64] for j in range(8) for k in range(3)] for i in range(8)]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    whole = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0 if grey else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")
    return whole[:40] if name.endswith("-broken") else whole


@query(
    f"WITH {_FILES} SELECT name, 8::INT AS width, 8::INT AS height, false AS is_corrupted, round(var_pop(e), 6) AS blur_score, var_pop(e) < 5000 AS is_blurry, round(avg(r), 6) AS red, round(avg(g), 6) AS green, round(avg(b), 6) AS blue, round(avg(l), 6) AS luminance, round(stddev_pop(l), 6) AS contrast, NULL::BIGINT AS small_file FROM edge GROUP BY name "
    "UNION ALL SELECT DISTINCT label || '-broken', NULL, NULL, true, 0, NULL, NULL, NULL, NULL, NULL, NULL, 41 FROM embeddings"
)
def image_files(spark, d):
    """Pictures written as files, grey, coloured and cut off, read in one scan and measured."""
    one = v.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "v")).groupBy("label", "p").agg((F.count_if(c("v") > 0) % 256).cast("int").alias("v"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"])  # 64 values
    named = one.groupBy("label").agg(values.alias("values")).select(F.explode(F.transform(F.array(*map(F.lit, ("grey", "colour", "broken"))), lambda k: F.concat_ws("-", "label", k))).alias("name"), "values")

    def encode(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "data": [_png(n, list(map(int, x))) for n, x in zip(pdf["name"], pdf["values"], strict=True)]})

    files = _round_trip(named.mapInPandas(encode, "name string, data binary"), "pictures", img.write_images, lambda s, p: img.read_images(s, p, recursiveFileLookup="true", pathGlobFilter="part-*"))
    got = img.image_quality(files, blur_threshold=5000).join(files.select("path", "file_size_bytes"), "path")
    name = F.regexp_extract("path", "name=([^/]+)/", 1)
    channel = lambda i: F.get("color", F.lit(i))
    got = got.select(name.alias("name"), "width", "height", "is_corrupted", "blur_score", "is_blurry", channel(0).alias("red"), channel(1).alias("green"), channel(2).alias("blue"), "luminance", "contrast", F.when(c("file_size_bytes") < 50, c("file_size_bytes")).alias("small_file"))
    return rounded(got, 6)


_METRICS = "CASE WHEN broken THEN 0 ELSE blur_score END AS blur_score, CASE WHEN NOT broken THEN is_blurry END AS is_blurry, CASE WHEN NOT broken THEN luminance END AS luminance, CASE WHEN NOT broken THEN contrast END AS contrast, broken AS is_corrupted"


@query(f"WITH {_LAPLACE} SELECT id::VARCHAR AS path, {_METRICS} FROM met")
def image_quality(spark, d):
    got = img.image_quality(_pictures(spark, d), blur_threshold=500).select("path", "blur_score", "is_blurry", "luminance", "contrast", "is_corrupted")
    return rounded(got, 6)


@query(f"WITH {_LAPLACE} SELECT doc_id AS asset_id, CASE WHEN NOT broken THEN 8 ELSE 100 END::INT AS width, CASE WHEN id IS NULL THEN NULL ELSE coalesce(broken, false) END AS is_corrupted, CASE WHEN NOT broken THEN luminance END AS luminance, '' AS caption FROM documents LEFT JOIN met ON id = doc_id")
def assembled_images(spark, d):
    """The catalogue is that of the documents; some of them have no picture."""
    x = v.table(spark, d, "documents").select(c("doc_id").alias("asset_id"), F.concat(c("doc_id").cast("string"), F.lit(".png")).alias("filename"), c("doc_id").cast("string").alias("target_path"), F.lit(None).cast("string").alias("asset_url"), F.array().cast("array<string>").alias("tags"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    got = img.assemble_images(x, img.image_quality(_pictures(spark, d), blur_threshold=500))
    return rounded(got.select("asset_id", "width", "is_corrupted", "luminance", "caption"), 6)


@query(f"WITH {v.IMAGES} SELECT asset_id, 200::INT AS width, is_blurry, blur_score, luminance, contrast FROM images")
def strict_image_view(spark, d):
    x = v.images(spark, d).select("*", *[F.lit(None).cast("string").alias(k) for k in ("filename", "tags", "caption", "file_size_bytes", "color")], F.lit(200).alias("width"), F.lit(150).alias("height"))
    x = x.withColumn("filename", c("asset_id").cast("string"))
    return build.image_view(x).select(c("filename").cast("long").alias("asset_id"), "width", "is_blurry", "blur_score", "luminance", "contrast")


@query(f"WITH {v.SHAPES} SELECT shape_id AS filename, image_width, image_height, label, x, y, w, h, round(x / image_width, 9) AS x_norm, round(y / image_height, 9) AS y_norm FROM shapes")
def strict_annotation_view(spark, d):
    return rounded(build.annotation_view(geometry.normalize_coords(v.shapes(spark, d)).withColumn("filename", c("shape_id"))))


@query(f"WITH {v.SHAPES}, n AS (SELECT label, count(*) AS n FROM shapes GROUP BY label) SELECT 'classes' AS name, count(*) AS rows, NULL AS message FROM n UNION ALL SELECT 'broken', NULL, 'ValueError: ' || (SELECT count(*) FROM shapes) || ' shapes'")
def checks_with_a_failure(spark, d):
    """Two checks: one writes its rows, the other raises and becomes an error row."""
    checks = Checks()

    def broken(tables):
        raise ValueError(f"{tables['shapes'].count()} shapes")

    checks.register("broken", broken)
    checks.register("classes", lambda tables: shp.class_distribution(tables["shapes"]))
    return checks.run(spark, {"shapes": v.shapes(spark, d)}, lambda name, df: df.write.format("noop").mode("overwrite").save())


@query(f"{_GLOBAL}, k AS (SELECT count(*) - floor(count(*) * (1 - 3 / 100.0::DOUBLE))::BIGINT AS k FROM dist) SELECT asset_id, 'TAG,DELETE' AS actions FROM (SELECT id AS asset_id, row_number() OVER (ORDER BY distance DESC, id) AS nth FROM dist), k WHERE nth <= k")
def outlier_actions(spark, d):
    return embedding.embedding_outliers(v.vectors(spark, d)).select("asset_id", F.array_join(report.actions_of("clip_outliers"), ",").alias("actions"))


@query(f"SELECT doc_id AS asset_id, CASE WHEN text <> '' THEN round(length(text) / 1000.0::DOUBLE, 3) END AS size, CASE WHEN text <> '' THEN round(list_sum(list_transform(string_split(text, ''), lambda x: unicode(x)))::DOUBLE / 1000, 3) END AS codes, text = '' AS failed FROM documents WHERE text IS NOT NULL")
def model_embeddings(spark, d):
    """Embeddings by a model that reads whole texts of very different sizes, and fails on empty ones."""

    def make_model():
        def one(t):
            if not t:
                raise ValueError("nothing to embed")
            return [float(len(t)), float(sum(map(ord, t)))]

        return lambda batch: [one(t) for t in batch]

    got = inference.embed_images(captions.without_null_captions(v.captions(spark, d)), make_model, "caption", error="error")
    part = lambda i: F.round(F.get("clip_embeddings", F.lit(i)).cast("double") / 1000, 3)
    return got.select("asset_id", part(0).alias("size"), part(1).alias("codes"), c("error").isNotNull().alias("failed"))


@query(f"WITH {v.SHAPES} SELECT label, 'a ' || label AS prompt, (length(label) + 2)::DOUBLE AS size, list_sum(list_transform(string_split('a ' || label, ''), lambda x: unicode(x)))::DOUBLE AS codes FROM (SELECT DISTINCT label FROM shapes)")
def model_label_embeddings(spark, d):
    """Labels by the vectors of their prompts."""
    labels = shp.class_distribution(v.shapes(spark, d)).select("label")
    got = inference.embed_labels(labels, lambda: lambda batch: [[len(t), sum(map(ord, t))] for t in batch])
    return got.select("label", inference.label_prompt(c("label")).alias("prompt"), c("embedding")[0].cast("double").alias("size"), c("embedding")[1].cast("double").alias("codes"))


@query("SELECT vec_id AS asset_id, CASE WHEN vec_id % 10 = 3 THEN 'broken' ELSE 'mean ' || (list_sum(p) // 64)::BIGINT || ' of 64' END AS caption FROM (SELECT vec_id, list_transform(embedding, lambda e: least(255, greatest(0, round(128 + 40 * e::DOUBLE)))::BIGINT) AS p FROM embeddings)")
def model_captions(spark, d):
    """Captions by a model of binary pictures; it fails on those that have lost a byte."""

    def make_model():
        def one(data):
            if len(data) != 64:
                raise ValueError("broken")
            return f"mean {sum(data) // 64} of {len(data)}"

        return lambda batch: [one(x) for x in batch]

    got = inference.caption_images(_pictures(spark, d), make_model, error="error")
    return got.select(c("path").cast("long").alias("asset_id"), F.when(c("error").isNotNull(), F.regexp_replace("error", "^ValueError: ", "")).otherwise(c("caption")).alias("caption"))


#: In each image one kind of part keeps its name and all others are common.
_KIND = "CASE WHEN split_part(label, ' ', 1) = CASE asset_id % 6 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LARGE' WHEN 4 THEN 'ECONOMY' ELSE 'PROMO' END THEN lower(split_part(label, ' ', 1)) ELSE 'common' END AS label"


@query(f"WITH {v.SHAPES}, s AS (SELECT {_KIND}, asset_id * 2 AS asset_id FROM shapes UNION ALL SELECT 'alone', o_orderkey * 2 + 1 FROM orders), p AS (SELECT DISTINCT asset_id, label FROM s), co AS (SELECT a.label AS l1, b.label AS l2, count(*) AS n FROM p a JOIN p b USING (asset_id) GROUP BY 1, 2), t AS (SELECT l1 AS label, sum(CASE WHEN l1 <> l2 THEN n ELSE 0 END)::BIGINT AS total FROM co GROUP BY 1) SELECT 'isolated' AS kind, label, 0::BIGINT AS total FROM t WHERE total = 0 UNION ALL SELECT 'hub', label, total FROM t WHERE total > (SELECT avg(total) + stddev_samp(total) FROM t)")
def isolated_and_hub_classes(spark, d):
    """A class that stands alone in its images, and one that meets all others."""
    own = v.table(spark, d, "orders").select(F.lit("alone").alias("label"), (c("o_orderkey") * 2 + 1).alias("asset_id"))
    m = interclass.cooccurrence(v.shapes(spark, d).selectExpr(_KIND, "asset_id * 2 AS asset_id").unionByName(own))
    alone = interclass.isolated_classes(m, include_diagonal=False).select(F.lit("isolated").alias("kind"), "label", F.lit(0).cast("long").alias("total"))
    return alone.unionByName(interclass.hub_classes(m, include_diagonal=False).select(F.lit("hub").alias("kind"), "label", "total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
