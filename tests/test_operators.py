"""Quality, embeddings, mislabels, tightness, captions, charts, report, curation, sources, checks and models."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from optiqal.functions import near
from optiqal.functions.graph import components
from optiqal.operators import build, captions, charts, curate, embedding, mislabel, quality, report, tightness
from optiqal.plans.inference import embed_images, embed_labels
from optiqal.plans.registry import Checks
from optiqal.schemas import ANNOTATIONS, IMAGES
from optiqal.sources import images as img
from optiqal.sources import tables as src


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_metrics(spark, tmp_path):
    flat = np.full((8, 8, 3), (10, 20, 30), np.uint8)
    checks = np.indices((8, 8)).sum(0).astype(np.uint8) % 2 * 255
    (tmp_path / "flat.png").write_bytes(png(flat))
    (tmp_path / "checks.png").write_bytes(png(checks))
    (tmp_path / "broken.png").write_bytes(png(flat)[:40])
    raw = img.read_images(spark, str(tmp_path))
    assert {r["file_size_bytes"] for r in raw.collect()} == {p.stat().st_size for p in tmp_path.iterdir()}
    got = {r["path"].rpartition("/")[2]: r for r in img.image_quality(raw).collect()}
    f = got["flat.png"]
    assert f["color"] == [10, 20, 30] and f["blur_score"] == 0 and f["contrast"] == 0 and f["is_blurry"] and not f["is_corrupted"]
    assert f["luminance"] == pytest.approx(0.2126 * 10 + 0.7152 * 20 + 0.0722 * 30)
    k = got["checks.png"]  # every neighbour differs by 255: the Laplacian is +-1020
    assert k["blur_score"] == pytest.approx(1020**2) and not k["is_blurry"] and k["contrast"] == pytest.approx(127.5)
    b = got["broken.png"]
    assert b["is_corrupted"] and b["blur_score"] == 0 and b["luminance"] is None and b["width"] is None


def test_assembled_images_prefer_decoded_size(spark):
    catalogue = spark.createDataFrame([("a", "f", "p", "u", ["t"], 1, 2)], "asset_id string, filename string, target_path string, asset_url string, tags array<string>, width int, height int")
    metrics = spark.createDataFrame([("p", 8, 9, False, True, 1.0, [1.0], 2.0, 3.0)], img.METRICS.replace("is_corrupted boolean, is_blurry boolean", "is_corrupted boolean, is_blurry boolean"))
    r = img.assemble_images(catalogue, metrics).first()
    assert (r["width"], r["height"], r["caption"], r["contrast"]) == (8, 9, "", 3.0)


def test_quality_fallback_extremes(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([5, 6, 5, 6, 5, 6, 1000])] + [(99, None)], "asset_id long, luminance double")
    got = {(r["item"], r["asset_id"]) for r in quality.iqr_outliers(df, "luminance").collect()}
    assert ("low_outliers", "0") in got and ("high_outliers", "6") in got and not any(a == "99" for _, a in got)


def test_blur_all_equal_has_no_sample(spark):
    df = spark.createDataFrame([(k, 3.0) for k in range(4)], "asset_id long, blur_score double")
    assert {r["item"] for r in quality.blur_outliers(df).collect()} == {"high_outliers", "blurriest"}


def test_issues_per_asset(spark):
    images = spark.createDataFrame([("a", True, False), ("b", False, True)], "asset_id string, is_blurry boolean, is_corrupted boolean")
    out = spark.createDataFrame([("clip", "duplicates", "a")], "`group` string, item string, asset_id string")
    got = {r["asset_id"]: (r["issues"], r["potential_actions"]) for r in quality.image_issues(images, out).collect()}
    assert got == {"a": (["BLURRY", "NEAR_DUPLICATE"], ["CLEAN", "DELETE", "TAG"]), "b": (["CORRUPTED"], ["DELETE"])}


def test_centroid_outliers_need_six_rows_and_lie_beyond(spark):
    rows = [("a", f"s{k}", [float(k == 5) * 9, 0.0]) for k in range(6)] + [("b", f"t{k}", [float(k), 0.0]) for k in range(5)] + [("a", "none", None)]
    df = spark.createDataFrame(rows, "label string, shape_id string, shape_embeddings array<double>")
    assert [r["shape_id"] for r in embedding.centroid_outliers(df).collect()] == ["s5"]


def test_duplicate_clusters(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    rows = [(10 * i + j, [float(x) for x in b + 0.001 * j]) for i, b in enumerate(base) for j in range(3)] + [(999, [float(x) for x in rng.normal(size=16)]), (1000, None)]
    df = spark.createDataFrame(rows, "asset_id long, clip_embeddings array<double>")
    got = embedding.cluster_members(embedding.duplicate_clusters(df, 0.99)).collect()
    assert sorted((r["cluster"], r["asset_id"], r["n"]) for r in got) == [(10 * i, 10 * i + j, 3) for i in range(6) for j in range(3)]


@pytest.mark.parametrize("text", [False, True])
def test_near_vectors_equal_brute_force_over_many_cells_and_blocks(spark, monkeypatch, text):
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "PART", 24)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=8) + 0.35 * rng.normal(size=(150, 8))  # a third of the rows about one direction
    x = [[float(e) for e in v] for v in np.vstack([hot, rng.normal(size=(250, 8))])]
    x += [x[0], [2 * e for e in x[0]], x[200], [1e200] * 8, [1e-200] * 8, [1.0, 2.0], [2.0, 4.1], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] * 8, [], None]
    name = (lambda i: f"n{i:04d}") if text else (lambda i: i)
    df = spark.createDataFrame([(name(i), v) for i, v in enumerate(x)], f"asset_id {'string' if text else 'long'}, clip_embeddings array<double>").repartition(5)
    unit = {}
    for i, v in enumerate(x):
        if v and None not in v and np.isfinite(v).all() and any(v):
            w = np.array(v) / np.abs(v).max()
            unit[name(i)] = w / np.linalg.norm(w)
    least = 0.8
    pairs = {(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least}
    got = [(r["a"], r["b"]) for r in embedding.similar_pairs(df, least).collect()]
    assert len(got) == len(set(got)) and set(got) <= pairs
    alike = {b: min(a for a in unit if len(unit[a]) == len(unit[b]) and np.array_equal(unit[a], unit[b])) for b in unit}
    assert {(a, b) for a, b in pairs if alike[a] == a and alike[b] == b} <= set(got)
    group = {a: a for a in unit}

    def top(a):
        while group[a] != a:
            a = group[a]
        return a

    for a, b in sorted(pairs):
        p, q = sorted((top(a), top(b)))
        group[q] = p
    wanted = {a: top(a) for p in pairs for a in p}
    found = {r["asset_id"]: r["cluster"] for r in embedding.duplicate_clusters(df, least).collect()}
    assert found == wanted
    assert embedding.duplicate_clusters(df.where("asset_id is null"), least).count() == 0


def test_outlier_share_is_rounded_up_from_the_rest(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(10)], "asset_id long, clip_embeddings array<double>")
    assert [r["asset_id"] for r in embedding.embedding_outliers(df, 3).collect()] == [0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (2, 1)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 5: 5} | {100 + k: 100 for k in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matrices_in_long_form(spark):
    from optiqal.operators import interclass

    rows = [(1, "a", "x", 0.0, 0.0, 2.0, 2.0), (1, "b", "y", 0.0, 0.0, 2.0, 2.0), (2, "c", "z", 0.0, 0.0, 1.0, 1.0)]
    s = spark.createDataFrame(rows, "asset_id long, shape_id string, label string, x double, y double, w double, h double")
    assert {tuple(r) for r in interclass.overlap_counts(s).collect()} == {("x", "y", 1), ("y", "x", 1)}
    assert interclass.overlap_counts(s, dense=True).count() == 9
    assert {tuple(r) for r in charts.heatmap(interclass.cooccurrence(s), "n").collect()} == {("x", "x", 1), ("x", "y", 1), ("y", "x", 1), ("y", "y", 1), ("z", "z", 1)}


def test_mislabel_rules(spark):
    labels = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "label string, embedding array<double>")
    rows = [("1", "x", [1.0, 0.0]), ("2", "x", [0.0, 1.0]), ("3", "z", [1.0, 0.0]), ("4", "y", [1.0, 0.999]), ("5", "y", None), ("6", "y", [])]
    df = spark.createDataFrame(rows, "shape_id string, label string, shape_embeddings array<double>")
    got = {r["shape_id"]: (r["status"], r["suggested_label"], r["rank"]) for r in mislabel.mislabels(df, labels).collect()}
    assert got == {"1": ("correct", "x", 0), "2": ("wrong", "y", 1), "3": ("wrong", "x", None), "4": ("correct", "x", 1)}


def test_labels_in_blocks(spark):
    labels = spark.createDataFrame([(f"l{i}", [1.0, i / 7, (i * i) % 5 / 3]) for i in range(12)] + [("none", None), (None, [1.0, 2.0, 3.0]), ("l3", [5.0, 0.0, 0.1])], "label string, embedding array<double>")
    df = spark.createDataFrame([(i, f"l{i % 14}", [i % 4 - 1.5, i % 3 / 2, 1.0]) for i in range(40)] + [(50, None, [0.0, 0.0, 0.0]), (51, "l1", [1.0]), (99, "l1", None)], "shape_id long, label string, shape_embeddings array<double>")
    whole, blocks = ({r["shape_id"]: tuple(r) for r in mislabel.mislabels(df, labels, label_bytes=n).collect()} for n in (mislabel.LABEL_BYTES, 100))
    assert len(whole) == 42 and blocks == whole
    assert mislabel.mislabels(df.where("shape_id < 0"), labels, label_bytes=100).count() == 0
    assert mislabel.mislabels(df, labels.limit(0)).count() == 0
    every = {}
    for r in mislabel.label_similarities(df, labels).collect():
        every.setdefault(r["shape_id"], {})[r["rank"]] = (r["label"], r["similarity"])
    assert all(sorted(v) == list(range(14)) for v in every.values()) and len(every) == 42
    assert all([s for _, s in (v[k] for k in sorted(v))] == sorted((s for _, s in v.values()), reverse=True) for v in every.values())
    some = {(r["shape_id"], r["rank"]): (r["label"], r["similarity"]) for r in mislabel.label_similarities(df, labels, top=4, label_bytes=100).collect()}
    assert some == {(i, k): every[i][k] for i in every for k in range(4)}
    with pytest.raises(ValueError):
        mislabel.label_similarities(df, labels, label_bytes=100)


def test_mislabel_report(spark):
    labels = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "label string, embedding array<double>")
    df = spark.createDataFrame([("i", "2", "x", 1.0, 2.0, 3.0, 4.0, [0.0, 1.0])], "asset_id string, shape_id string, label string, x double, y double, w double, h double, shape_embeddings array<double>")
    r = mislabel.mislabel_report(mislabel.mislabels(df, labels)).first()
    assert r["comparison"]["actual"]["label"] == "x" and r["comparison"]["expected"]["label"] == "y" and r["actions"] == ["UPDATE"]


def test_tightness_bounds_are_strict(spark):
    cols = "asset_id string, shape_id string, label string, x double, y double, w double, h double, image_width double, image_height double"
    s = spark.createDataFrame([("i", k, "l", 0.0, 0.0, 10.0, 10.0, 100.0, 100.0) for k in "abc"], cols)
    t = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 5.0), ("b", 0.0, 0.0, 10.0, 7.0), ("c", 0.0, 0.0, 10.0, 9.0)], "shape_id string, x double, y double, w double, h double")
    m = tightness.match_suggestions(s, t)
    assert [r["shape_id"] for r in tightness.tightness_issues(m).collect()] == ["b"]
    assert tightness.tightness_issues(m, most=0.5).count() == 0
    assert tightness.tightness_global(tightness.tightness_deltas(m)).first()["tightness_score"] == pytest.approx(1 - (0.003 + 0.001) / 2)


def test_captions(spark):
    rows = [(1, "red dog runs"), (2, "red dog runs"), (3, "the and of"), (4, "of the"), (5, "blue whale"), (6, None), (7, "red dog runs fast fast fast")]
    df = spark.createDataFrame(rows, "asset_id long, caption string")
    got = {r["asset_id"]: r["cluster"] for r in captions.caption_clusters(df).collect()}
    assert got == {1: "1", 2: "1", 3: "3", 4: "3", 5: "-1", 7: "-1"}
    words = {r["cluster"]: r["keywords"] for r in captions.cluster_keywords(df, captions.caption_clusters(df)).collect()}
    assert words["1"] == "dog red runs" and words["-1"].startswith("fast")


def test_histogram_edges(spark):
    one = spark.createDataFrame([(2.0,), (2.0,), (None,), (float("nan"),)], "v double")
    h = charts.histogram(one, "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [0, 0, 2, 0] and h[0]["lo"] == 1.5 and h[-1]["hi"] == 2.5
    assert charts.histogram(one.limit(0), "v", 4).count() == 0
    two = charts.histogram(spark.createDataFrame([(float(v),) for v in range(11)], "v double"), "v", 10).orderBy("bin").collect()
    assert [r["n"] for r in two] == [1] * 9 + [2]


def test_boxplot_of_nothing_is_nan(spark):
    r = charts.boxplot(spark.createDataFrame([("a", None)], "k string, v double"), "k", "v").first()
    assert r["n"] == 0 and all(math.isnan(r[k]) for k in ("low", "q1", "median", "q3", "high"))


def test_empty_charts(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "v double")
    assert [charts.is_empty(x, "v").first()[0] for x in (df(), df(0.0, None), df(float("nan")), df(0.0, 2.0))] == [True, True, True, False]


def test_merging_renumbers_references(spark):
    ref = '<Data id="chart-{}"/>'
    rows = [(1, " one " + ref.format(1) + ref.format(2), [("chart-1", "a"), ("chart-2", "b")]), (2, "two " + ref.format(2) + ref.format(1), [("chart-1", "c"), ("chart-2", "d")])]
    df = spark.createDataFrame(rows, "ordinal int, text string, charts array<struct<id:string,data:string>>")
    r = report.merge_contents(df).first()
    assert r["text"] == "one " + ref.format(1) + ref.format(2) + "\n\ntwo " + ref.format(4) + ref.format(3)
    assert [(x["id"], x["data"]) for x in r["charts"]] == [("chart-1", "a"), ("chart-2", "b"), ("chart-3", "c"), ("chart-4", "d")]


def test_texts_of_missing_groups(spark):
    out = spark.createDataFrame([], "`group` string, item string, description string, label string, label_2 string, asset_id string, shape_id string, score double")
    assert report.item_texts(out, ["area"]).first()["text"] == "No data found for group `area`."


def test_capitals(spark):
    got = spark.createDataFrame([("aBC dEF",)], "v string").select(report.capitalized(F.col("v"))).first()[0]
    assert got == "Abc def" == "aBC dEF".capitalize()


def test_actions():
    assert report.GROUP_ACTIONS["clip_duplicates"] == ("CLEAN", "DELETE")


def test_tags_are_idempotent_and_needed(spark):
    images = spark.createDataFrame([("a", ["x"]), ("b", None)], "asset_id string, tags array<string>")
    ids = spark.createDataFrame([("a",), ("b",), ("b",)], "asset_id string")
    twice = curate.tag_assets(curate.tag_assets(images, ids, "x"), ids, "y")
    assert {r["asset_id"]: r["tags"] for r in twice.collect()} == {"a": ["x", "y"], "b": ["x", "y"]}
    with pytest.raises(ValueError):
        curate.tag_assets(images, ids, "")


def test_fork_modes(spark, tmp_path):
    images, shapes = spark.createDataFrame([("a", ["t"])], "asset_id string, tags array<string>"), spark.createDataFrame([("a", "l")], "asset_id string, label string")
    counts = {m: [p.count() for p in curate.fork(images, shapes, m)] for m in ("deep-copy", "soft-copy", "image", "images")}
    assert counts == {"deep-copy": [1, 1, 1], "soft-copy": [1, 1, 0], "image": [1, 0, 0], "images": [1, 0, 0]}
    curate.write_fork(curate.fork(images, shapes, "deep-copy"), str(tmp_path / "v2"))
    assert spark.read.parquet(str(tmp_path / "v2/shapes")).count() == 1
    with pytest.raises(ValueError):
        curate.fork(images, shapes, "other")


def test_nested_annotations(spark, tmp_path):
    box = lambda i, w: {"id": i, "label": "l", "label_id": "x", "x": 1.0, "y": 1.0, "w": w, "h": 10.0, "coords": [{"x": 0.0, "y": 0.0}, {"x": 20.0, "y": 10.0}]}
    rows = [
        {"asset_id": "i", "annotation_id": "2", "created_at": "2024-01-02T00:00:00", "task_type": "OBJECT_DETECTION", "shapes": [box("late", 50.0)]},
        {"asset_id": "i", "annotation_id": "1", "created_at": "2024-01-01T00:00:00", "task_type": "OBJECT_DETECTION", "shapes": [box("tiny", 10.0), box("kept", 10.1)]},
        {"asset_id": "p", "annotation_id": "3", "created_at": "2024-01-01T00:00:00", "task_type": "SEGMENTATION", "shapes": [box("poly", 1.0)]},
        {"asset_id": "c", "annotation_id": "4", "created_at": "2024-01-01T00:00:00", "task_type": "CLASSIFICATION", "shapes": [box("class", 1.0)]},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    got = build.drop_tiny_shapes(src.load_shapes(build.first_annotation(src.load_annotations(spark, str(tmp_path / "a.json")))))
    assert {r["shape_id"]: r["w"] for r in got.collect()} == {"kept": 10.1, "poly": 20.0, "class": None}
    assert spark.createDataFrame([], ANNOTATIONS).count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi"\nthere', ["x", "y"], [1.0, 2.5]), ("b", None, [], None)], "asset_id string, caption string, tags array<string>, color array<double>")
    path = str(tmp_path / "images.csv")
    src.write_metadata_csv(df, path)
    got = {r["asset_id"]: r for r in src.read_metadata_csv(spark, path, "asset_id string, caption string, tags array<string>, color array<double>").collect()}
    assert got["a"]["caption"] == 'say "hi"\nthere' and got["a"]["tags"] == ["x", "y"] and got["a"]["color"] == [1.0, 2.5] and got["b"]["color"] == []
    with pytest.raises(ValueError):
        src.read_metadata_csv(spark, str(tmp_path / "images.parquet"), IMAGES)


def test_vectors_from_text(spark):
    df = spark.createDataFrame([("a", "[1, 2.5]"), ("b", "junk"), ("c", "[]"), ("d", None)], "id string, v string")
    assert [(r["id"], r["v"]) for r in src.parsed_vectors(df, "v").collect()] == [("a", [1.0, 2.5])]


def test_vectors_of_a_model(spark):
    points = spark.createDataFrame([("a", {"clip": [1.0]}), ("b", {"other": [2.0]})], "id string, vector map<string,array<double>>")
    assert [r["id"] for r in src.vectors_of(points, "clip").collect()] == ["a"]


def test_assets_and_tags(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"asset_id":"a","tags":[{"id":"1","name":"red"}]}\n{"asset_id":"b"}')
    assert {r["asset_id"]: r["tags"] for r in src.load_assets(spark, str(tmp_path / "x.json")).collect()} == {"a": ["red"], "b": []}


def test_report_files_and_status(spark, tmp_path):
    row = ("Image Quality", "Image Quality Issues", "Blurry Images", 1, "t", "{}", ["TAG"])
    rep = spark.createDataFrame([row], "section string, sub_section string, name string, ordinal int, text string, data_json string, actions array<string>")
    src.write_report(rep, str(tmp_path / "r"))
    assert tuple(src.read_report(spark, str(tmp_path / "r")).first()) == row
    log = str(tmp_path / "log")
    src.append_content(spark.createDataFrame([("content", "x")], "type string, text string"), log, 1)
    assert src.is_computing(spark, log)
    src.append_content(spark.createDataFrame([("event", "done")], "type string, text string"), log, 2)
    assert not src.is_computing(spark, log)


def test_views_and_lenient_projection(spark):
    images = spark.createDataFrame([], IMAGES)
    assert build.image_view(images).columns == build.IMAGE_VIEW
    assert build.project(images, ["luminance", "nope", "asset_id"]).columns == ["asset_id", "filename", "asset_url", "luminance"]
    with pytest.raises(Exception):
        build.annotation_view(images)


def test_guard(spark):
    one = spark.createDataFrame([("a", 1.0)], "label string, x double")
    assert build.guarded(one, one).count() == 0
    two = spark.createDataFrame([("a", 1.0), ("b", None)], "label string, x double")
    assert build.guarded(two, two).count() == 2


def test_failing_check_leaves_the_others(spark):
    checks, written = Checks(), {}
    checks.register("bad", lambda t: t["nothing"])
    checks.register("good", lambda t: t["shapes"])
    found = checks.run(spark, {"shapes": spark.range(3)}, lambda name, df: written.update({name: df.count()}))
    assert written == {"good": 3} and [(r["name"], r["rows"], r["message"] is None) for r in found.collect()] == [("bad", None, False), ("good", 3, True)]


def test_models_get_batches(spark):
    def make():
        def predict(x):
            return np.stack([np.array([len(str(v)), len(x) <= 64], np.float32) for v in x])

        return predict

    labels = spark.createDataFrame([("cat",), ("horse",)], "label string")
    assert {r["label"]: r["embedding"] for r in embed_labels(labels, make).collect()} == {"cat": [5.0, 1.0], "horse": [7.0, 1.0]}
    assert len(embed_images(labels, make, "label").first()["clip_embeddings"]) == 2
