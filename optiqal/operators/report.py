"""The report: previews, texts, places and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col
PREVIEW = 100

# Sections and sub-sections of a report in their order, and the contents of each.
SECTIONS = (
    ("Dataset Overview", "Overview", ("Metadata Overview",)),
    ("Image Quality", "Image Statistics Analysis", ("Image Statistics Analysis",)),
    ("Image Quality", "Image Quality Issues", ("Luminance Issues", "Contrast Issues", "Blurry Images", "CLIP Outlier Analysis", "CLIP Duplicate Analysis")),
    ("Annotation Quality", "Class Analysis", ("Class Distribution",)),
    ("Annotation Quality", "Single Object Analysis", ("Single Object Analysis",)),
    ("Annotation Quality", "Inter-Class Relation Analysis", ("Top Class Co-occurrences", "Unexpected Co-occurrences", "Missing Expected Co-occurrences", "Top Class Overlaps", "Unexpected Overlaps")),
    ("Annotation Quality", "Annotation Outlier Detection", ("Shape Density Outliers", "Area-Based Shape Outliers", "Aspect Ratio Outliers", "Intra-Class Centroid Distance Outliers")),
)
#: What may be done about the rows of a group.
GROUP_ACTIONS = {"clip_outliers": ("TAG", "DELETE"), "clip_duplicates": ("CLEAN", "DELETE"), "mislabels": ("UPDATE",), "captions": ("TAG",)}


def locator(spark: SparkSession) -> DataFrame:
    """place, section, sub_section, name: where each content stands."""
    rows = [(s, sub, n) for s, sub, names in SECTIONS for n in names]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, section string, sub_section string, name string")


def located(content: DataFrame) -> DataFrame:
    """Content rows (name, text, ...) with their section and sub-section; unknown names have none."""
    return content.drop("section", "sub_section").join(F.broadcast(locator(content.sparkSession)), "name", "left")  # a fixed table


def preview(outliers: DataFrame, n: int = PREVIEW) -> DataFrame:
    """The first n rows of each item, over its labels in order."""
    order = W.partitionBy("group", "item").orderBy("label", "label_2", "asset_id", "shape_id")
    return outliers.withColumn("ordinal", F.row_number().over(order)).where(c("ordinal") <= n)


def capitalized(x: Column) -> Column:
    """The first letter upper, all others lower."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def clean_newlines(x: Column) -> Column:
    return F.replace(x, F.lit("\n\n"), F.lit("\n"))


def item_texts(outliers: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """group, item, text, ids: a line for each item with its previewed ids; a group asked for without rows says so."""
    p = preview(outliers)
    pair = F.when(c("label_2").isNotNull(), F.concat(F.lit("\n "), capitalized(c("label")), F.lit(" and "), capitalized(c("label_2")), F.lit(": \n")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("shape_id", "asset_id").alias("id")))), lambda s: s["id"])
    out = p.groupBy("group", "item").agg(F.concat(F.lit("🔹 "), F.min("description"), F.lit(":"), F.coalesce(F.min(pair), F.lit(""))).alias("text"), ids.alias("ids"))
    if groups is None:
        return out
    wanted = outliers.sparkSession.createDataFrame([(g,) for g in groups], "`group` string")
    none = wanted.join(outliers.select("group").distinct(), "group", "left_anti")
    return out.unionByName(none.select("group", F.lit(None).cast("string").alias("item"), F.concat(F.lit("No data found for group `"), c("group"), F.lit("`.")).alias("text"), F.array().cast("array<string>").alias("ids")))


def merge_contents(contents: DataFrame) -> DataFrame:
    """One content of many (ordinal, text, charts: array of (id, data)): charts numbered anew over all, and references in the texts with them."""
    n = contents.withColumn("size", F.size("charts")).withColumn("text", F.trim("text"))
    one = n.agg(F.array_sort(F.collect_list(F.struct("ordinal", "size", "text", "charts"))).alias("parts")).select("parts")  # the contents of one report
    kind = "struct<n:int,text:string,charts:array<struct<id:string,data:string>>>"
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("text"), F.array().cast("array<struct<id:string,data:string>>").alias("charts")).cast(kind)

    def step(s: Column, p: Column) -> Column:
        named = F.transform(p["charts"], lambda x, i: F.struct(F.concat(F.lit("chart-"), (s["n"] + i + 1).cast("string")).alias("id"), x["data"].alias("data")))
        refs = F.transform(p["charts"], lambda x, i: F.struct(F.concat(F.lit('<Data id="'), x["id"], F.lit('"/>')).alias("old"), F.concat(F.lit('<Data id="chart-'), (s["n"] + i + 1).cast("string"), F.lit('"/>')).alias("new"), i.alias("i")))
        # by way of marks that no text holds, so that a new reference is never taken for an old one
        marked = F.aggregate(refs, p["text"], lambda t, r: F.replace(t, r["old"], F.concat(F.lit("\u0001"), r["i"].cast("string"), F.lit("\u0002"))))
        text = F.aggregate(refs, marked, lambda t, r: F.replace(t, F.concat(F.lit("\u0001"), r["i"].cast("string"), F.lit("\u0002")), r["new"]))
        return F.struct((s["n"] + F.size(p["charts"])).alias("n"), F.concat(s["text"], F.lit("\n"), text, F.lit("\n")).alias("text"), F.concat(s["charts"], named).alias("charts")).cast(kind)

    return one.select(F.aggregate("parts", zero, step).alias("m")).select(F.trim(F.regexp_replace(c("m.text"), r"^\n+|\n+$", "")).alias("text"), c("m.charts").alias("charts"))


def report_markdown(report: DataFrame) -> DataFrame:
    """One row, text: headings in the order of the sections, each content under its own in the order of ordinal."""
    spark = report.sparkSession
    heads = spark.createDataFrame([(i, s, sub) for i, (s, sub, _) in enumerate(SECTIONS)], "place int, section string, sub_section string")
    one = F.concat(F.lit("\n"), F.coalesce(F.concat(F.lit("###"), c("name"), F.lit("\n")), F.lit("")), F.coalesce(F.concat(c("text"), F.lit("\n")), F.lit("")))
    bodies = report.groupBy("section", "sub_section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", one.alias("t")))), lambda s: s["t"]), "").alias("body"))
    x = heads.join(bodies, ["section", "sub_section"], "left")
    first = F.first("section").over(W.orderBy("place").rowsBetween(-1, -1))  # seven headings
    line = F.concat(F.when(first.eqNullSafe(c("section")), F.lit("")).otherwise(F.concat(F.lit("# "), c("section"), F.lit("\n"))), F.lit("# "), c("sub_section"), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    return x.select("place", line.alias("t")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda s: s["t"]), "").alias("text"))


def data_card(images: DataFrame, creator: str, name: str, version: str, description: str, task_type: str) -> DataFrame:
    """One row about a dataset version."""
    return images.agg(F.count("*").alias("size")).select(F.lit(creator).alias("creator"), F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(description).alias("description"), "size", F.lit(task_type).alias("task_type"))


def actions_of(group: str) -> Column:
    return F.array(*[F.lit(a) for a in GROUP_ACTIONS.get(group, ())]).cast("array<string>")
