"""What must hold at any size: selection of ranks, sparse and dense neighbourhoods, label ranks, sums of vectors, tiles, models and checks."""

import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from optiqal.functions import density, near, quantiles, sparse
from optiqal.functions.vectors import mean_vectors, parse_vector
from optiqal.operators import captions, embedding, interclass, mislabel
from optiqal.plans import inference
from optiqal.plans.registry import Checks
from optiqal.sources import images as img
from optiqal.sources import tables as src

QS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]


def values(kind, n, rnd):
    if kind == "normal":
        return [rnd.gauss(0, 1) for _ in range(n)]
    if kind == "wide":
        return [math.exp(rnd.uniform(-600, 600)) * rnd.choice([1, -1]) for _ in range(n)]
    if kind == "ties":
        return [float(rnd.choice([1, 2, 2, 2, 7])) for _ in range(n)]
    if kind == "one":
        return [3.25] * n
    if kind == "close":
        return [1 + rnd.random() * 1e-13 for _ in range(n)]
    return [rnd.choice([math.inf, -math.inf, math.nan, 0.0, -0.0, rnd.random()]) for _ in range(n)]


def test_selected_quantiles_are_the_exact_ones(spark):
    rnd = random.Random(3)
    rows = [(k, v) for k in ("normal", "wide", "ties", "one", "close", "odd") for v in values(k, 700, rnd)] + [(None, float(i % 90)) for i in range(500)] + [("few", 1.0), ("few", 4.0), ("none", None)] + [("normal", None)] * 5
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(quantiles.quantiles(F.col("v"), QS).alias("q")).collect()}
    got = {r["k"]: r for r in quantiles.quantile_stats(df, ["k"], "v", QS, F.count("*").alias("n"), room=50).collect()}
    assert set(got) == set(want) and got["normal"]["n"] == 705 and got[None]["n"] == 500
    for k, q in want.items():
        assert repr(got[k]["q"]) == repr(q).replace("-0.0", "0.0") or all(a == b or a != a and b != b for a, b in zip(got[k]["q"], q, strict=True)), k
    whole = df.where("k = 'normal'").agg(quantiles.quantiles(F.col("v"), QS)).first()[0]
    assert quantiles.quantile_stats(df.where("k = 'normal'"), [], "v", QS, room=50).first()["q"] == whole
    assert quantiles.quantile_stats(df.where("k = 'normal'"), [], "v", QS, F.max("v").alias("m"), room=50).first()["q"] == whole
    assert quantiles.quantile_stats(df.limit(0), ["k"], "v", QS).count() == 0 and quantiles.quantile_stats(df.limit(0), [], "v", QS).first()["q"] is None


def test_a_group_of_millions_is_searched_by_counts(spark):
    df = spark.range(2_000_000).select(F.lit("x").alias("k"), F.exp(F.pmod(F.col("id") * 7_919, F.lit(2_000_003)) / 100_000.0).alias("v"))
    got = quantiles.quantile_stats(df, ["k"], "v", [0.5, 0.25]).first()["q"]
    want = np.exp(np.array([i * 7_919 % 2_000_003 for i in range(2_000_000)]) / 100_000.0)
    assert got == pytest.approx(np.quantile(want, [0.5, 0.25]), rel=1e-12)


def plain_clusters(near_of, copies, least):
    """DBSCAN over a table of neighbours, point by point."""
    core = {i for i in copies if copies[i] + sum(copies[j] for j in near_of[i]) >= least}
    name = {}
    for i in sorted(core):
        if i not in name:
            name[i], todo = i, [i]
            while todo:
                for j in near_of[todo.pop()] & core:
                    if j not in name:
                        name[j] = i
                        todo.append(j)
    border = {i: min(name[j] for j in near_of[i] & core) for i in copies if i not in core and near_of[i] & core}
    return name | border


def sparse_rows(rnd, n, words):
    docs = []
    for i in range(n):
        if i and rnd.random() < 0.5:
            other = dict(docs[rnd.randrange(i)])
            other[rnd.randrange(words)] = rnd.choice([1, 2])
        else:
            other = {0: 3, 1: 2} | {int(words * rnd.random() ** 3): rnd.choice([1, 2, 3]) for _ in range(rnd.choice([1, 4, 9]))}
        docs.append(other)
    df = {}
    for d in docs:
        for t in d:
            df[t] = df.get(t, 0) + 1
    unit = [{t: w / math.sqrt(sum(x * x for x in d.values())) for t, w in d.items()} for d in docs]
    return [(i, f"w{t}", df[t], w) for i, d in enumerate(unit) for t, w in d.items()], unit


@pytest.mark.parametrize("list_, block", [(64, 512), (4, 8)])
def test_sparse_neighbours(spark, monkeypatch, list_, block):
    monkeypatch.setattr(sparse, "LIST", list_)
    monkeypatch.setattr(sparse, "BLOCK", block)
    n = 60
    rows, unit = sparse_rows(random.Random(5), n, 30)
    for least in (0.7,):
        cos = np.array([[sum(w * b.get(t, 0.0) for t, w in a.items()) for b in unit] for a in unit])
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if cos[i, j] >= least - 1e-12}
        points = sparse.vectors_of(spark.createDataFrame(rows, "asset_id long, term string, df long, weight double")).withColumns({"copies": F.lit(1).cast("long") + F.col("id") % 3, "core": F.lit(True)})
        got = [tuple(sorted((r["a"], r["b"]))) for r in sparse.near_sparse(points, least, density.Found("pairs")).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        near_of = {i: {j for j in range(n) if j != i and (min(i, j), max(i, j)) in want} for i in range(n)}
        copies = {i: 1 + i % 3 for i in range(n)}
        counts = {r["id"]: r["n"] for r in sparse.near_sparse(points, least, density.Found("counts")).groupBy("id").agg(F.sum("n").alias("n")).collect()}
        assert counts == {i: sum(copies[j] for j in js) for i, js in near_of.items() if js}
        for samples in (4,):
            found = {r["id"]: r["cluster"] for r in density.density_clusters(points, lambda p, what, least=least: sparse.near_sparse(p, least, what), samples).collect()}
            assert found == plain_clusters(near_of, copies, samples)


def test_a_shared_wording_writes_no_pairs(spark):
    """A long list is compared inside tasks: what leaves is a forest, though all pairs of 700 captions are near."""
    rows = [(i, t, n, w) for i in range(700) for t, n, w in ((f"own{i}", 1, 0.1), ("shared", 700, math.sqrt(1 - 0.01)))]
    points = sparse.vectors_of(spark.createDataFrame(rows, "asset_id long, term string, df long, weight double")).withColumns({"copies": F.lit(1).cast("long"), "core": F.lit(True)})
    links = sparse.near_sparse(points, 0.9, density.Found("links"))
    assert 699 <= links.count() <= 3 * 700
    assert {r["cluster"] for r in density.density_clusters(points, lambda p, what: sparse.near_sparse(p, 0.9, what)).collect()} == {0}
    unlike = [(i, t, n, w) for i in range(700) for t, n, w in ((f"own{i}", 1, math.sqrt(0.5)), ("shared", 700, math.sqrt(0.5)))]
    points = sparse.vectors_of(spark.createDataFrame(unlike, "asset_id long, term string, df long, weight double")).withColumns({"copies": F.lit(1).cast("long"), "core": F.lit(True)})
    assert sparse.near_sparse(points, 0.875, density.Found("pairs")).count() == 0


@pytest.mark.parametrize("samples", [1, 2, 4])
def test_dense_clusters_of_any_number_of_samples(spark, monkeypatch, samples):
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "PART", 32)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5)).round(1)
    x[60:90] = x[:30]
    units = [tuple(v / np.linalg.norm(v)) for v in x]
    first: dict = {}
    for i, u in enumerate(units):
        first.setdefault(tuple(np.round(u, 12)), []).append(i)
    points = [v[0] for v in first.values()]
    cos = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    near_of = {i: {j for j in points if j != i and cos[i, j] >= 0.9} for i in points}
    plain = plain_clusters(near_of, {v[0]: len(v) for v in first.values()}, samples)
    want = {i: plain[v[0]] for v in first.values() if v[0] in plain for i in v}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "asset_id long, clip_embeddings array<double>")
    assert {r["asset_id"]: r["cluster"] for r in embedding.duplicate_clusters(df, 0.9, min_samples=samples).collect()} == want


def test_caption_clusters_and_odd_captions(spark):
    rows = [(1, "red car on road"), (2, "red car on road"), (3, "red car road"), (4, None), (5, ""), (6, "!!"), (7, "the"), (8, "blue boat")]
    df = spark.createDataFrame(rows, "asset_id long, caption string")
    assert {r["asset_id"]: r["cluster"] for r in captions.caption_clusters(df).collect()} == {1: "1", 2: "1", 3: "1", 5: "5", 6: "5", 7: "5", 8: "-1"}
    assert {r["asset_id"]: r["cluster"] for r in captions.caption_clusters(df, min_samples=4).collect()} == {i: "-1" for i in (1, 2, 3, 5, 6, 7, 8)}
    assert captions.without_null_captions(df).count() == 7 and captions.caption_clusters(df.limit(0)).count() == 0


def test_labels_by_the_ten_thousand(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=(30_000, 8)).round(3)
    names = [f"n{i}" for i in range(30_000)]
    labels = spark.createDataFrame(list(zip(names, e.tolist(), strict=True)), "label string, embedding array<double>")
    x = (e[:40] + rng.normal(size=(40, 8)) * 0.2).round(3)
    df = spark.createDataFrame([(i, names[i], v.tolist()) for i, v in enumerate(x)], "shape_id long, label string, shape_embeddings array<double>")
    order = np.argsort(np.array(names))
    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (e / np.linalg.norm(e, axis=1, keepdims=True)).T
    for size in (mislabel.LABEL_BYTES, 1 << 20):
        got = {r["shape_id"]: r for r in mislabel.mislabels(df, labels, label_bytes=size).collect()}
        for i in range(40):
            assert got[i]["rank"] == (s[i] > s[i, i]).sum() and got[i]["suggested_label"] == names[order[s[i][order].argmax()]]
            spread = s[i].max() - np.sort(s[i])[-1500]
            if 0 < got[i]["rank"] < 1500:
                assert got[i]["status"] == ("ambiguous" if spread < 0.01 else "correct")


def test_mean_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, None]), ("a", [5.0, 4.0, 7.0]), (None, [1e300, -1e300]), ("b", [None, 1.0]), ("c", None)] + [("sum", [x]) for x in (1e16, 1.0, -1e16)] * 50
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(7)
    got = {r["k"]: r["centroid"] for r in mean_vectors(df, "v", ["k"]).collect()}
    assert got == {"a": [3.0, 3.0, 7.0], None: [1e300, -1e300], "b": [None, 1.0], "sum": [pytest.approx(1 / 3)]}
    assert mean_vectors(df.where("k = 'a'"), "v", []).first()["centroid"] == [3.0, 3.0, 7.0]
    assert mean_vectors(df.limit(0), "v", ["k"]).count() == 0 and mean_vectors(df.limit(0), "v", []).count() == 0
    plan = mean_vectors(df, "v", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 2


def boxes(rnd, n, corner):
    out = []
    for i in range(n):
        near_corner = rnd.random() < corner
        side = 0.02 if near_corner else 40.0
        out.append((1, f"s{i:05d}", rnd.choice("abc"), rnd.random() * (1 if near_corner else 1000), rnd.random() * (1 if near_corner else 1000), rnd.random() * side, rnd.random() * side))
    return out + [(1, f"wide{i}", "w", 0.0, 0.0, 1000.0, 1000.0 - i) for i in range(3)] + [(2, "x", "a", 0.0, 0.0, 2.0, 2.0), (2, "y", "b", 1.0, 1.0, 2.0, 2.0), (2, "z", None, 1.0, 1.0, 2.0, 2.0), (3, "n", "a", None, None, None, None)]


def test_crowded_corners_equal_plain_pairs(spark):
    schema = "asset_id long, shape_id string, label string, x double, y double, w double, h double"
    df = spark.createDataFrame(boxes(random.Random(1), 1500, 0.9), schema)
    want = {(r["shape_1"], r["shape_2"], r["label_1"], r["label_2"], r["iou"]) for r in interclass.shape_pairs(df).where("iou > 0").collect()}
    got = [(r["shape_1"], r["shape_2"], r["label_1"], r["label_2"], r["iou"]) for r in interclass.overlapping_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1500 * 3
    same = spark.createDataFrame([(1, f"s{i}", "a", 1.0, 1.0, 0.0, 0.0) for i in range(100)], schema)
    assert interclass.overlapping_pairs(same).count() == 0


def test_models_see_every_item_once(spark):
    texts = ["", "x" * 200_000, None, *("ab" * (i % 7) for i in range(300)), "bad", "bad too"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)

    def make():
        made = os.getpid(), time.time()

        def model(batch):
            if any(t.startswith("bad") for t in batch):
                raise ValueError("no " + next(t for t in batch if t.startswith("bad")))
            assert len(batch) <= 16
            return [[float(len(t)), float(sum(map(ord, t))), made[1]] for t in batch]

        return model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = inference.infer(df, make, F.col("text"), "found", "array<double>", "why", batch=16, batch_bytes=50_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["id"]: r for r in rows}
    assert len(rows) == len(texts) and set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        bad = bool(t) and t.startswith("bad")
        assert got[i]["why"] == (f"ValueError: no {t}" if bad else None)
        assert (got[i]["found"] or [None, None])[:2] == ([None, None] if t is None or bad else [len(t), sum(map(ord, t))])
    with pytest.raises(Exception, match="the model failed"):
        inference.infer(df, make, F.col("text"), "found", "array<double>").collect()
    assert inference.infer(df.limit(0), make, F.col("text"), "found", "array<double>").count() == 0


def test_images_are_read_in_one_scan(spark, tmp_path):
    data = spark.createDataFrame([("a", bytearray(b"not a picture")), ("b", bytearray(b"\xff\xd8\xff"))], "name string, data binary")
    img.write_images(data, str(tmp_path / "files"))
    files = img.read_images(spark, str(tmp_path / "files"), recursiveFileLookup="true", pathGlobFilter="part-*")
    assert sorted(r["file_size_bytes"] for r in files.collect()) == [4, 14]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("FileScan") == 1
    assert {r["is_corrupted"] for r in img.image_quality(files).collect()} == {True}


def test_a_batch_counts_once(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = lambda *x: spark.createDataFrame(list(x), "type string, name string")
    assert not os.path.exists(log)
    for attempt in range(2):
        src.append_content(rows(("content", "a"), ("error", f"attempt {attempt}")), log, 0)
    src.append_content(rows(("content", "a")), log, 1)
    found = src.read_content(spark, log, "name string")
    assert sorted((r["type"], r["name"]) for r in found.collect()) == [("content", "a"), ("content", "a"), ("error", "attempt 1")]
    assert src.is_computing(spark, log)
    rows(("event", "done")).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("type string, name string").json(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # the second stream gives the same batch again
        src.append_stream(stream, log + "2", str(tmp_path / checkpoint)).awaitTermination(60)
    assert src.read_content(spark, log + "2", "name string").count() == 1 and not src.is_computing(spark, log + "2")


def test_a_hanging_check_becomes_an_error_row(spark):
    checks = Checks()
    sleep = F.udf(lambda x: time.sleep(60) or x, "long")
    checks.register("hangs in a job", lambda t: t["shapes"].select(sleep("id").alias("id")))
    checks.register("hangs outside", lambda t: time.sleep(30))
    for i in range(4):
        checks.register(f"good {i}", lambda t, i=i: t["shapes"].where(F.col("id") >= i))
    began = time.time()
    got = [tuple(r) for r in checks.run(spark, {"shapes": spark.range(5)}, lambda name, df: df.write.format("noop").mode("overwrite").save(), time_limit=6, at_a_time=2).collect()]
    assert time.time() - began < 25
    assert got == [("hangs in a job", None, "TimeoutError: stopped after 6 seconds"), ("hangs outside", None, "TimeoutError: stopped after 6 seconds"), *((f"good {i}", 5 - i, None) for i in range(4))]


def test_vectors_in_text_forms(spark):
    forms = {"[1, 2.5]": [1, 2.5], "(1, 2)": [1, 2], "(1,)": [1], "[1, None, null]": [1, None, None], "[.5, 1., -2e3, +4]": [0.5, 1, -2000, 4], " [ 1 ,2 , ] ": [1, 2], "[]": [], "()": [], "(1)": [], "": [], "none": [], "[1, x]": [], "[1": [], "{}": [], "[1,\n2]": [1, 2], None: []}
    df = spark.createDataFrame([(k,) for k in forms], "v string").select("v", parse_vector(F.col("v")).alias("x"))
    assert {r["v"]: r["x"] for r in df.collect()} == forms
