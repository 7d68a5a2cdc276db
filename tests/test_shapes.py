"""Thresholds and boundaries of the shape rules on small frames."""

import pytest
from pyspark.sql import functions as F

from optiqal.functions.geometry import denormalize_boxes, iou, polygon_to_bbox, prompt_boxes, shape_features
from optiqal.operators import interclass
from optiqal.operators import shapes as shp

COLS = "asset_id string, shape_id string, label string, x double, y double, w double, h double, image_width double, image_height double"


def frame(spark, areas, label="a"):
    rows = [(f"i{k}", f"s{k:02}", label, 0.0, 0.0, float(a), 1.0, 100.0, 100.0) for k, a in enumerate(areas)]
    return shape_features(spark.createDataFrame(rows, COLS))


def items(df):
    return {(r["item"], r["shape_id"]) for r in df.collect()}


def test_iqr_needs_five_rows(spark):
    four = items(shp.area_outliers(frame(spark, [10, 10, 10, 90]), typical=False))
    five = items(shp.area_outliers(frame(spark, [10, 10, 11, 10, 90]), typical=False))
    assert four == set()
    assert five == {("large_shapes", "s04")}


def test_typical_shape_is_nearest_inlier(spark):
    found = items(shp.area_outliers(frame(spark, [10, 12, 11, 10, 12, 11, 400])))
    assert ("large_shapes", "s06") in found and ("typical_shapes", "s02") in found


@pytest.mark.parametrize("areas", [[5], [5, 5], [7] * 6])
def test_no_spread_no_outliers(spark, areas):
    assert items(shp.area_outliers(frame(spark, areas))) == set()
    assert items(shp.aspect_ratio_outliers(frame(spark, areas))) == set()


def test_single_row_has_null_std(spark):
    row = shp.per_class_area_stats(frame(spark, [5])).first()
    assert row["std_area"] is None and row["median_area"] == 5


def test_density_bounds_are_inclusive(spark):
    rows = [(f"i{i}", f"s{i}-{k}", "a", 0.0, 0.0, 1.0, 1.0, 10.0, 10.0) for i in range(4) for k in range(i + 1)]
    got = {(r["item"], r["asset_id"]) for r in shp.density_outliers(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {("few_objects", "i0"), ("many_objects", "i3"), ("typical_density", "i1"), ("typical_density", "i2")}


def test_density_by_z_without_spread_is_empty(spark):
    assert shp.density_outliers(frame(spark, [1, 1, 1]), use_quantiles=False).count() == 0


def test_empty_images_are_counted(spark):
    images = spark.createDataFrame([("i0",), ("i9",)], "asset_id string")
    row = shp.shape_density_stats(frame(spark, [1]), images).first()
    assert row["num_empty_images"] == 1 and row["max_n"] == 1


def test_iou_of_boxes(spark):
    one = spark.range(1)
    val = lambda *v: one.select(iou(*[F.lit(float(x)) for x in v]).alias("v")).first()["v"]
    assert val(0, 0, 2, 2, 1, 1, 2, 2) == pytest.approx(1 / 7)
    assert val(0, 0, 1, 1, 2, 2, 1, 1) == 0 and val(0, 0, 0, 0, 0, 0, 0, 0) == 0 and val(0, 0, 3, 3, 0, 0, 3, 3) == 1


def test_polygon_box(spark):
    df = spark.createDataFrame([([(1.0, 5.0), (4.0, 2.0)],), ([],), (None,)], "p array<struct<x:double,y:double>>")
    got = [r["b"] for r in df.select(polygon_to_bbox(F.col("p")).alias("b")).collect()]
    assert tuple(got[0]) == (1, 2, 3, 3) and got[1] is None and got[2] is None


def test_prompt_and_centre_boxes(spark):
    df = spark.createDataFrame([("a", "s", "l", 10.0, 20.0, 30.0, 40.0, 512.0, 256.0)], COLS)
    r = prompt_boxes(df).first()
    assert (r["px1"], r["py1"], r["px2"], r["py2"]) == (18, 36, 88, 132)
    c = spark.createDataFrame([(0.5, 0.5, 0.25, 0.5, 100.0, 50.0)], "cx double, cy double, nw double, nh double, image_width double, image_height double")
    assert tuple(denormalize_boxes(c).select("x", "y", "w", "h").first()) == (37, 12, 25, 25)


def boxes(spark, n=30):
    rows = [("big", f"s{k:03}", "ab"[k % 2], float(k * 7 % 50), float(k * 11 % 40), 8.0 + k % 5, 6.0 + k % 7, 60.0, 50.0) for k in range(n)]
    return spark.createDataFrame(rows, COLS)


@pytest.mark.parametrize("crowded", [5, 64])
def test_tiles_find_the_same_pairs(spark, crowded):
    key = lambda df: sorted((r["shape_1"], r["shape_2"], round(r["iou"], 9)) for r in df.where("iou > 0").collect())
    assert key(interclass.overlapping_pairs(boxes(spark), crowded=crowded)) == key(interclass.shape_pairs(boxes(spark)))


def test_mean_iou_counts_boxes_apart(spark):
    plain = interclass.shape_pairs(boxes(spark)).groupBy("label_1", "label_2").agg(F.avg("iou").alias("m")).collect()
    got = {(r["label_1"], r["label_2"]): r["mean_iou"] for r in interclass.mean_iou_per_pair(boxes(spark)).collect()}
    for r in plain:
        assert got[r["label_1"], r["label_2"]] == pytest.approx(r["m"]) == got[r["label_2"], r["label_1"]]


def test_cooccurrence_is_symmetric_with_own_images_on_the_diagonal(spark):
    rows = [("i0", "1", "a"), ("i0", "2", "b"), ("i1", "3", "a"), ("i1", "4", "a")]
    s = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0, 9.0, 9.0) for r in rows], COLS)
    m = {(r["label_1"], r["label_2"]): r["n"] for r in interclass.cooccurrence(s).collect()}
    assert m == {("a", "a"): 2, ("b", "b"): 1, ("a", "b"): 1, ("b", "a"): 1}


def test_no_cartesian_product_and_no_single_partition_window(spark):
    for df in (interclass.shape_pairs(boxes(spark)), interclass.overlapping_pairs(boxes(spark)), interclass.cooccurrence(boxes(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_rare_and_usual_pairs_need_three_images(spark):
    rows = [(f"i{k}", f"a{k}", "a") for k in range(400)] + [(f"i{k}", f"b{k}", "b") for k in range(3)] + [(f"i{k}", f"c{k}", "c") for k in range(2)]
    s = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0, 9.0, 9.0) for r in rows], COLS)
    got = {(r["label_1"], r["label_2"], r["asset_id"], len(r["boxes"])) for r in interclass.unexpected_cooccurrence(s).collect()}
    assert got == {("a", "b", f"i{k}", 2) for k in range(3)}
