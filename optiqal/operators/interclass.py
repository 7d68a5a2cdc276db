"""Relations between classes: co-occurrence in images and overlap of boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiqal.functions.geometry import iou
from optiqal.functions.graph import written

c = F.col
#: Images, and tiles of an image, of more shapes than this are cut into tiles, 4 x 4 at a time, as often as LEVELS.
CROWDED, LEVELS = 64, 10


def presence(shapes: DataFrame) -> DataFrame:
    return shapes.where("label is not null").select("asset_id", "label").distinct()


def cooccurrence(shapes: DataFrame) -> DataFrame:
    """label_1, label_2, n: images that hold both; symmetric, with the images of a label itself on the diagonal."""
    p = presence(shapes)
    pairs = p.select("asset_id", c("label").alias("label_1")).join(p.select("asset_id", c("label").alias("label_2")), "asset_id")
    return pairs.groupBy("label_1", "label_2").agg(F.count("*").alias("n"))


def _sides(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    box = ["shape_id", "label", "x", "y", "w", "h"]
    s = shapes.where("x is not null and label is not null").select("asset_id", *box)
    return (s.select("asset_id", *[c(k).alias(f"{p}_{k}") for k in box]) for p in ("a", "b"))


def _paired(df: DataFrame) -> DataFrame:
    """shape_1, shape_2, label_1 <= label_2 and iou of joined sides."""
    overlap = iou(*[c(f"a_{k}") for k in "xywh"], *[c(f"b_{k}") for k in "xywh"])
    return df.select("asset_id", c("a_shape_id").alias("shape_1"), c("b_shape_id").alias("shape_2"), F.least("a_label", "b_label").alias("label_1"), F.greatest("a_label", "b_label").alias("label_2"), overlap.alias("iou"))


def shape_pairs(shapes: DataFrame) -> DataFrame:
    """Every pair of boxes of an image with their labels in order and their IoU."""
    a, b = _sides(shapes)
    return _paired(a.join(b, "asset_id").where("a_shape_id < b_shape_id"))


def overlapping_pairs(shapes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """The pairs of shape_pairs with iou > 0, without visiting the others in crowded images (see _tiles)."""
    s = written(shapes.where("x is not null and label is not null").select("asset_id", "shape_id", "label", *"xywh"), "boxes")
    large = s.groupBy("asset_id").agg(F.count("*").alias("n"), F.min("x").alias("from_x"), F.min("y").alias("from_y"), F.max(c("x") + c("w")).alias("to_x"), F.max(c("y") + c("h")).alias("to_y")).where(c("n") > crowded)
    large = written(large.drop("n"), "crowded-images")
    few = large.isEmpty()
    a, b = _sides(s if few else s.join(large, "asset_id", "left_anti"))
    pairs = _paired(a.join(b, "asset_id").where("a_shape_id < b_shape_id")).where("iou > 0")
    if few:
        return pairs
    tiles = _tiles(s.join(large, "asset_id"), crowded)
    tile = ["asset_id", "level", "tile_x", "tile_y"]
    box = ["shape_id", "label", *"xywh"]
    cut = lambda v: F.call_function("shiftright", v, 20 - 2 * c("level"))
    begun = (cut(c("x0")) == c("tile_x")) | (cut(c("y0")) == c("tile_y"))
    side = lambda p: tiles.select(*tile, *[c(k).alias(f"{p}_{k}") for k in (*box, "x0", "y0")], begun.alias(f"{p}_begun"))
    met = side("a").where("a_begun").join(side("b"), tile).where("a_shape_id <> b_shape_id and (not b_begun or a_shape_id < b_shape_id)")
    own = lambda k: cut(F.greatest(f"a_{k}0", f"b_{k}0")) == c(f"tile_{k}")
    found = _paired(met.where(own("x") & own("y"))).where("iou > 0")
    return pairs.unionByName(found.withColumns({"shape_1": F.least("shape_1", "shape_2"), "shape_2": F.greatest("shape_1", "shape_2")}))


def _tiles(s: DataFrame, crowded: int) -> DataFrame:
    """Boxes of crowded images dealt to the tiles that they touch: asset_id, level, tile_x, tile_y, the box, and x0, y0.

    Places are whole numbers of 20 bits on the image's extent, and a tile of level k is all places that share the first 2 k
    bits of both. A tile in whose columns or rows more than `crowded` boxes begin is cut if that halves the pairs to compare,
    so tiles are small where small boxes crowd, and boxes that overlap anyhow are not dealt out for nothing. Boxes that only pass through a tile have no pair of their own there: a pair belongs to the tile in which
    its intersection begins.
    """
    place = lambda k, v: F.when(c(f"to_{k}") > c(f"from_{k}"), F.least(F.floor((v - c(f"from_{k}")) / (c(f"to_{k}") - c(f"from_{k}")) * (1 << 20)), F.lit((1 << 20) - 1))).otherwise(0).cast("int")
    places = {f"{k}{i}": place(k, v) for k, size in (("x", "w"), ("y", "h")) for i, v in ((0, c(k)), (1, c(k) + c(size)))}
    now = s.withColumns(places).drop("from_x", "from_y", "to_x", "to_y").withColumns({"tile_x": F.lit(0), "tile_y": F.lit(0)})
    tile, done = ["asset_id", "tile_x", "tile_y"], []
    for level in range(LEVELS + 1):
        now, shift = written(now, "tiles"), 20 - 2 * level
        begins = lambda x, y, shift: F.count_if((F.shiftright("x0", shift) == c(x)) | (F.shiftright("y0", shift) == c(y)))
        within = lambda k: F.sequence(F.greatest(F.shiftright(f"{k}0", shift - 2), c(f"tile_{k}") * 4), F.least(F.shiftright(f"{k}1", shift - 2), c(f"tile_{k}") * 4 + 3))  # noqa: B023, E731
        smaller = lambda df: df.select("*", F.explode(within("x")).alias("next_x")).select("*", F.explode(within("y")).alias("next_y"))  # noqa: B023, E731
        cut = None
        if level < LEVELS:
            full = written(now.groupBy(*tile).agg(begins("tile_x", "tile_y", shift).alias("n"), F.count("*").alias("all")).where(c("n") > crowded).select(*tile, (c("n") * c("all")).alias("pairs")), "full-tiles")
            if not full.isEmpty():
                after = smaller(now.join(full.select(*tile), tile, "left_semi")).groupBy(*tile, "next_x", "next_y").agg((begins("next_x", "next_y", shift - 2) * F.count("*")).alias("pairs")).groupBy(*tile).agg(F.sum("pairs").alias("after"))
                cut = written(full.join(after, tile).where(c("after") * 2 <= c("pairs")).select(*tile), "cut-tiles")
        last = cut is None or cut.isEmpty()
        done.append((now if last else now.join(cut, tile, "left_anti")).withColumn("level", F.lit(level)))
        if last:
            break
        now = smaller(now.join(cut, tile, "left_semi")).drop("tile_x", "tile_y").withColumnsRenamed({"next_x": "tile_x", "next_y": "tile_y"})
    return reduce(DataFrame.unionByName, done)


def pair_totals(shapes: DataFrame) -> DataFrame:
    """label_1 <= label_2, pairs: how many pairs of boxes shape_pairs has, from counts alone."""
    n = shapes.where("x is not null and label is not null").groupBy("asset_id", "label").agg(F.count("*").alias("n"))
    a, b = n.select("asset_id", c("label").alias("label_1"), c("n").alias("n_1")), n.select("asset_id", c("label").alias("label_2"), c("n").alias("n_2"))
    both = a.join(b, "asset_id").where("label_1 <= label_2")
    pairs = F.when(c("label_1") == c("label_2"), c("n_1") * (c("n_1") - 1) / 2).otherwise(c("n_1") * c("n_2")).cast("long")
    return both.groupBy("label_1", "label_2").agg(F.sum(pairs).alias("pairs")).where("pairs > 0")


def symmetric(pairs: DataFrame) -> DataFrame:
    rest = [k for k in pairs.columns if k not in ("label_1", "label_2")]
    return pairs.unionByName(pairs.where("label_1 <> label_2").select(c("label_2").alias("label_1"), c("label_1").alias("label_2"), *rest))


def mean_iou_per_pair(shapes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """label_1, label_2, mean_iou over the pairs of boxes with iou >= threshold; symmetric. At 0 boxes apart count as zeros."""
    touching = overlapping_pairs(shapes)
    if threshold > 0:
        return symmetric(touching.where(c("iou") >= threshold).groupBy("label_1", "label_2").agg(F.avg("iou").alias("mean_iou")))
    sums = touching.groupBy("label_1", "label_2").agg(F.sum("iou").alias("total"))
    out = pair_totals(shapes).join(sums, ["label_1", "label_2"], "left")
    return symmetric(out.select("label_1", "label_2", (F.coalesce("total", F.lit(0.0)) / c("pairs")).alias("mean_iou")))


def overlap_counts(shapes: DataFrame, threshold: float = 0.2, dense: bool = False) -> DataFrame:
    """label_1, label_2, n: pairs of boxes with iou >= threshold; symmetric. With dense also 0 for all other pairs of labels, which are as many as the labels squared."""
    pairs = overlapping_pairs(shapes).where(c("iou") >= threshold)
    n = symmetric(pairs.groupBy("label_1", "label_2").agg(F.count("*").alias("n")))
    if not dense:
        return n
    labels = shapes.where("label is not null").select("label").distinct()
    every = labels.select(c("label").alias("label_1")).crossJoin(labels.select(c("label").alias("label_2")))  # what a matrix is
    return every.join(n, ["label_1", "label_2"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_pairs(matrix: DataFrame, value: str, n: int = 10) -> DataFrame:
    """The n largest entries with label_1 <= label_2."""
    return matrix.where("label_1 <= label_2").orderBy(F.desc(value), "label_1", "label_2").limit(n)


def _row_sums(matrix: DataFrame, value: str, include_diagonal: bool) -> DataFrame:
    m = matrix if include_diagonal else matrix.withColumn(value, F.when(c("label_1") != c("label_2"), c(value)).otherwise(0))
    return m.groupBy("label_1").agg(F.sum(value).alias("total"))


def isolated_classes(matrix: DataFrame, value: str = "n", include_diagonal: bool = True) -> DataFrame:
    """Labels of which the row sums to 0; with the diagonal that is none of a co-occurrence matrix."""
    return _row_sums(matrix, value, include_diagonal).where("total = 0").select(c("label_1").alias("label"))


def hub_classes(matrix: DataFrame, value: str = "n", include_diagonal: bool = True) -> DataFrame:
    """Labels of which the row sum is above the mean by more than a standard deviation, largest first."""
    sums = _row_sums(matrix, value, include_diagonal)
    bound = sums.agg((F.avg("total") + F.stddev_samp("total")).alias("bound"))
    return sums.crossJoin(F.broadcast(bound)).where("total > bound").select(c("label_1").alias("label"), "total").orderBy(F.desc("total"), "label")  # bound is one row


def _assets(shapes: DataFrame) -> DataFrame:
    return shapes.agg(F.countDistinct("asset_id").alias("assets"))


def _enough(rows: DataFrame, least: int) -> DataFrame:
    """The rows of label pairs that have at least `least` of them."""
    rows = written(rows, "rows-of-pairs")
    enough = rows.groupBy("label_1", "label_2").agg(F.count("*").alias("rows")).where(c("rows") >= least).drop("rows")
    return rows.join(enough, ["label_1", "label_2"], "left_semi")


def unexpected_cooccurrence(shapes: DataFrame, low: float = 0.01, least: int = 3) -> DataFrame:
    """label_1 < label_2 in at most max(2, low * images) images, and each such image with its boxes of either label; pairs with fewer than `least` images are left out."""
    rare = cooccurrence(shapes).where("label_1 < label_2").crossJoin(F.broadcast(_assets(shapes))).where(c("n") <= F.greatest(F.lit(2.0), c("assets") * low)).select("label_1", "label_2")
    p = presence(shapes)
    both = p.select("asset_id", c("label").alias("label_1")).join(rare, "label_1").join(p.select("asset_id", c("label").alias("label_2")), ["asset_id", "label_2"])
    both = _enough(both, least)
    long = both.select("asset_id", "label_1", "label_2", F.explode(F.array("label_1", "label_2")).alias("label"))
    box = F.struct("shape_id", "label", "x", "y", "w", "h")
    return long.join(shapes.select("asset_id", "label", box.alias("box")), ["asset_id", "label"]).groupBy("label_1", "label_2", "asset_id").agg(F.array_sort(F.collect_list("box")).alias("boxes"))


def missing_expected_cooccurrence(shapes: DataFrame, ratio: float = 0.06, least: int = 3) -> DataFrame:
    """label_1 < label_2 in at least max(3, ratio * images) images, and the images that hold exactly one of the two (`label`)."""
    usual = cooccurrence(shapes).where("label_1 < label_2").crossJoin(F.broadcast(_assets(shapes))).where(c("n") >= F.greatest(F.lit(3.0), c("assets") * ratio)).select("label_1", "label_2")
    either = usual.select("label_1", "label_2", F.explode(F.array("label_1", "label_2")).alias("label"))
    met = presence(shapes).join(either, "label").groupBy("label_1", "label_2", "asset_id").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    return _enough(met.where("n = 1").select("label_1", "label_2", "asset_id", "label"), least)


def unexpected_overlap(shapes: DataFrame, ratio: float = 0.06, count_iou: float = 0.2, least_iou: float = 0.1, least: int = 3) -> DataFrame:
    """label_1 < label_2 of which at most max(3, ratio * images) pairs overlap, and their pairs of boxes with iou > least_iou."""
    touching = written(overlapping_pairs(shapes).where("label_1 < label_2"), "touching")  # the join is made once
    often = touching.where(c("iou") >= count_iou).groupBy("label_1", "label_2").agg(F.count("*").alias("n"))
    found = touching.where(c("iou") > least_iou).join(often, ["label_1", "label_2"], "left").crossJoin(F.broadcast(_assets(shapes)))
    found = found.where(F.coalesce("n", F.lit(0)) <= F.greatest(F.lit(3.0), c("assets") * ratio))
    return _enough(found.select("label_1", "label_2", "asset_id", "shape_1", "shape_2", "iou"), least)


def isolated_with_zero(matrix: DataFrame) -> DataFrame:
    return isolated_classes(matrix, include_diagonal=False).select("label", F.lit(0).alias("value"))


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
