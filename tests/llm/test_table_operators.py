"""Sharding, mixing, nearest neighbours, tool calls, and the pipeline."""

import json
import math
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from optiqal.llm import _prefix, mixing, nearest, queries, sharding, toolcalls
from tests.conftest import SF

DOCS = "doc_id long, text string, source string"


def test_growing_moves_rows_into_the_new_shard_only(spark):
    rows = [(i, "x" * (i % 50), "s") for i in range(3000)] + [(None, None, None), (5, "again", "s"), (5, "again", "s")]
    got = sharding.numbered(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 3003 and {r["law"] for r in got} == {"key"}
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got)
    assert 60 <= sum(r["grown_shard"] == 24 for r in got) <= 190
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(75 <= len(v) <= 185 for v in by.values())
    one = next(r for r in got if r["doc_id"] == 49)
    assert one["size"] == 57 and one["text_crc32"] == zlib.crc32(b"x" * 49)
    none = next(r for r in got if r["doc_id"] is None)
    assert none["size"] == 8 and none["text_crc32"] == 0


def test_shards_are_those_of_the_best_tickets(spark):
    """XXH64 of the key's text, then of the shard's number, as the library of that name has it; equal keys of any type agree."""

    def best(key, shards):
        def ticket(s):
            first = xxhash.xxh64(str(key).encode(), seed=42).intdigest() if key is not None else 42
            h = xxhash.xxh64(struct.pack("<i", s), seed=first).intdigest()
            return -math.log(((h >> 11) + 1) / 2**53)

        return min(range(shards), key=ticket)

    keys = [*range(-50, 300), 2**40, None]
    got = sharding.numbered(spark.createDataFrame([(k, None, "s") for k in keys], DOCS).withColumn("slot", F.lit("x"))).collect()
    assert {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in got} == {k: (best(k, 24), best(k, 25)) for k in keys}
    one = spark.range(1).select(*(sharding.shard_of(F.lit(7).cast(t), [1.0] * 24).alias(t) for t in ("int", "bigint", "string", "smallint"))).first()
    assert {*one} == {best(7, 24)}
    assert sharding.numbered(spark.createDataFrame([], DOCS)).count() == 0
    long = sharding.numbered(spark.createDataFrame([(1, "é" * 500_000, "s")], DOCS)).first()
    assert (long["size"], long["slot"]) == (1_000_008, 0)


def test_shares_follow_weights(spark):
    df = sharding.assign(spark.range(20_000).withColumnRenamed("id", "doc_id"), [1.0, 3.0, 0.0])
    n = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and n[1] / 20_000 == pytest.approx(0.75, abs=0.02)
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [0.0])


def refilled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full, target = share * sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 400)), ["a", "b", "é", "z", "hot", None][i % 6 if i % 2 else 4]) for i in range(900)]
    rows += [(5000, "w " * 30_000, "b"), (5001, None, "b"), (5002, "", "tiny"), (5003, "one", "tiny"), (6000, "same", "a"), (6000, "same", "a")]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = refilled(sizes)
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
    # the smallest target is 2 words, so a slot has one word
    assert all(abs(taken[s] - want[s]) <= 4 for s in sizes)
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    key = lambda x: sorted((r["doc_id"], r["size"], r["taken"]) for r in x)
    assert key(got) == key(again)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None)], DOCS)).first()["taken"] == 0
    # one row for each slot that nothing else fills: the blocks of a source are equal, and its slots are spread over the mix
    first = {}
    for r in got:
        if r["taken"]:
            first.setdefault(source[r["doc_id"]], set()).add(r["first_slot"])
        else:
            assert r["first_slot"] is None
    assert all(not a & b for s, a in first.items() for t, b in first.items() if s != t)


def test_schedule_interleaves_sources(spark):
    plan = spark.createDataFrame([("=a", 50_000), ("=b", 100_000), ("=c", 0), ("=d", 1)], "name string, quota long")
    rows = mixing.schedule(plan, 100).orderBy("slot").collect()
    slots = [r["name"] for r in rows]
    n = Counter(slots)
    assert set(n) == {"=a", "=b", "=d"} and n["=d"] == 1 and slots[-1] == "=d" and abs(n["=a"] - 500) <= 4 and abs(n["=b"] - 1000) <= 4
    for k in range(50, 1500, 50):
        assert abs(slots[:k].count("=a") - k / 3) < 5
    assert [r["nth"] for r in rows if r["name"] == "=a"] == list(range(n["=a"])) and {r["slots"] for r in rows if r["name"] == "=a"} == {n["=a"]}
    want = ["=a" if k * mixing.GOLDEN % 2**32 < 2**32 * 50_000 // 150_001 else "=b" for k in range(1501)]
    assert sum(x != y for x, y in zip(slots, want, strict=False)) == 0


def test_what_no_slot_takes_is_not_in_the_mix(spark, monkeypatch):
    whole = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda plan, block: whole(plan, block).where("slot % 2 = 0"))
    rows = [(i, "w " * (20 + i % 30), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    words = sum(len(t.split()) for _, t, _ in rows)
    assert 0.6 * words < mixing.mix(df, block=100).agg(F.sum("taken")).first()[0] < 0.9 * words
    assert 240 < mixing.mix_documents(df, block=100).count() < 360


def test_another_schedule_gives_another_mix(spark, monkeypatch):
    rows = [(i, "w " * (20 + i % 30), "abc"[i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)

    def both() -> tuple:
        return {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}, Counter(r["doc_id"] for r in mixing.mix_documents(df, block=50).collect())

    words, whole = both()
    monkeypatch.setattr(mixing, "GOLDEN", 2**31 + 2**20)  # points that crowd at two places
    other_words, other_whole = both()
    assert words != other_words and whole != other_whole
    assert max(whole.values()) <= 2 and max(other_whole.values()) <= 2


def test_the_mix_is_in_blocks_of_equal_words(spark):
    rows = [(i, "w " * (1 + i % 50), "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_documents(df, weights=(3, 1), share=1.0, block=40, slot_col="slot")
    assert out.columns == [*df.columns, "slot"]
    source, words = {}, Counter()
    for r in out.collect():
        assert source.setdefault(r["slot"], r["source"]) == r["source"]  # one source fills a slot
        words[r["slot"]] += len(r["text"].split())
    plan = mixing.plan(mixing.laid(df, "source", "text", "doc_id"), (3, 1), 1.0, 2.0)
    block = mixing.slot_words(plan, 40)
    assert block == 7  # the smaller target holds 512 slots of so many words
    assert max(words.values()) <= block + 50 and sum(words.values()) == pytest.approx(sum(len(t.split()) for _, t, _ in rows), rel=0.01)
    for k in range(200, max(source), 200):  # any stretch of the mix holds the sources as their targets
        part = Counter(source[i] for i in source if i < k)
        assert sum(words[i] for i in source if i < k and source[i] == "a") == pytest.approx(0.75 * k * block, rel=0.1), part


def test_whole_documents_near_targets(spark):
    rows = [(i, "w " * (20 + i % 30), "ab"[i % 2]) for i in range(400)]
    rows += [(7, rows[7][1], "b"), (7, "v " * 27, "b"), (None, "u u", "a"), (None, "v v", "a"), (900, None, "a"), (901, " ", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1)).withColumn("row", F.lit(2))
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    assert all(abs(words[s] - x) <= 100 for s, x in refilled(sizes).items())


def exact_nearest(ids, x, queries_, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries_:
        i = ids.index(q)
        s = (x * x[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[i] * x[i]).sum()))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(ids[j], s[j]) for j in order]
    del unit
    return out


def test_repeats_and_small_tables_give_all_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 64))
    x[1:7] = x[0] + 1e-6 * rng.normal(size=(6, 64))  # in the same cells
    ids = list(range(40))
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    rows += [rows[1]] * 6 + [(100, [1.0, 2.0]), (101, [2.0, 1.0])]
    rows += [(200 + i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(5, 32)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in nearest.search(df, df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.pop(100) == [101] and got.pop(101) == [100]
    assert all({*got.pop(200 + i)} == {200 + j for j in range(5) if j != i} for i in range(5))
    assert all(len({*got[q]}) == 5 for q in ids) and all({*got[q]} <= {*range(7)} for q in range(7))


def test_scores_of_vectors_of_any_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e200, -1e200]), (4, [3e-310, 1e-310]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("rank", F.lit(9))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest.search(df, df).collect()}
    unit = {i: np.array(v) / max(map(abs, v)) for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    assert got.keys() == {(a, b) for a in unit for b in unit if a != b}
    assert all(s == pytest.approx(unit[a] @ unit[b], abs=1e-12) for (a, b), s in got.items())


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 24))
    x[500:580] = x[7]  # many equal vectors: ties go to the smaller id
    ids = list(range(600))
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, []), (1004, [None, 1.0]), (1005, [1.0, 2.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    wanted = df.where("vec_id % 50 = 0 or vec_id in (500, 501) or vec_id is null")
    got = {}
    for r in nearest.search(wanted, df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact_nearest(ids, x, [q for q in ids if q % 50 == 0 or q in (500, 501)])
    assert set(got) == set(want)
    hit = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    assert [a for a, _ in got[500]] == [7, 501, 502, 503, 504] and [a for a, _ in got[501]] == [7, 500, 502, 503, 504]
    assert nearest.search(wanted, df.limit(0)).count() == 0 and nearest.search(df.limit(0), df).count() == 0


def test_crowded_cells_are_split(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = lambda: sorted(map(tuple, nearest.search(df.where("vec_id % 20 = 0"), df).collect()))
    whole = key()
    monkeypatch.setattr(nearest, "ROOM", 7)
    assert key() == whole


def test_cells_get_another_axis_by_the_number_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x = np.repeat(rng.normal(size=(60, 32)), 5, 0) + 0.2 * rng.normal(size=(300, 32))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [])], "vec_id long, embedding array<double>")
    vectors = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    assert nearest.depth(vectors) == nearest.depth(vectors.limit(0)) == 1
    monkeypatch.setattr(nearest, "CELL_ROWS", 300 / 64**2)
    assert nearest.depth(vectors) == 2 and nearest.depth(vectors.where("id < 299")) == 1 and nearest.depth(vectors.limit(0)) == 1
    got = {}
    for r in nearest.search(df.where("vec_id % 10 = 0"), df, k=4).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact_nearest(list(range(300)), x, list(range(0, 300, 10)), 4)
    assert set(got) == set(want) and sum(len(got[q] & {a for a, _ in w}) for q, w in want.items()) >= 0.9 * 4 * len(want)


def test_neighbours_do_not_depend_on_the_number_of_rows(spark, monkeypatch):
    """Rows that meet no query (of other dimensions) change nothing, also where they lead `depth` to two axes."""
    rng = np.random.default_rng(21)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(400, 32)))]
    more = [(1000 + i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(200, 3)))]
    few, many = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, rows + more))
    monkeypatch.setattr(nearest, "CELL_ROWS", 500 / 64**2)
    assert [nearest.depth(x.select("vec_id", F.col("embedding").alias("vector"))) for x in (few, many)] == [1, 2]
    found = lambda x: sorted(map(tuple, nearest.search(few.where("vec_id % 10 = 0"), x).collect()))
    assert found(few) == found(many)


def test_two_hashes_find_most(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 32))
    x = np.repeat(base, 5, 0) + 0.2 * rng.normal(size=(300, 32))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df.where("vec_id % 10 = 0"), df, k=4, hashes=2, probes=12).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact_nearest(list(range(300)), x, list(range(0, 300, 10)), 4)
    assert sum(len(got.get(q, set()) & {a for a, _ in w}) for q, w in want.items()) >= 0.9 * 4 * len(want)


CALLS = "conv_id long, call_id string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"
NEEDS = "conv_id long, call_id string, need string"
TOOL = {"t": {"properties": {"a": "integer", "b": "string", "c": "array"}, "required": ["a"]}}


def test_tool_calls(spark):
    calls = [(1, "x", 1, "t", '{"b":"é","a":1}'), (1, "y", 2, "t", '{"a":"1"}'), (1, "z", 3, "t", "{broken"), (1, "dup", 9, "t", '{"a":2,"d":1}'), (1, "dup", 4, "t", '{"a":2}'), (2, "x", 5, "u", '{"a":1}'), (2, "p", 1, "t", '{"a":1,"a":2}'), (2, "q", 2, "t", None), (None, "n", 1, "t", "{}")]
    results = [(1, "x", 7, "r1"), (1, "x", 6, "r0"), (1, "z", 1, "soon"), (3, "lost", 1, None), (2, "x", 9, None)]
    needs = [(1, "x", "y"), (1, "y", "z"), (1, "x", "z"), (1, "z", "nobody"), (2, "p", "q"), (2, "q", "p"), (2, "x", "p")]
    out = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(needs, NEEDS), TOOL)
    got = {(r["conv_id"], r["call_id"]): r for r in out.collect()}
    assert len(got) == 8
    assert {k: v["status"] for k, v in got.items()} == {(1, "x"): "linked", (1, "y"): "unanswered", (1, "z"): "early", (1, "dup"): "unanswered", (2, "x"): "linked", (2, "p"): "unanswered", (2, "q"): "unanswered", (3, "lost"): "orphan"}
    assert {k: v["level"] for k, v in got.items()} == {(1, "x"): 2, (1, "y"): 1, (1, "z"): 0, (1, "dup"): 0, (2, "x"): None, (2, "p"): None, (2, "q"): None, (3, "lost"): None}
    assert [k[1] for k, v in sorted(got.items(), key=lambda i: (i[0][0], i[1]["position"] or 0)) if k[0] == 1] == ["z", "dup", "y", "x"]
    assert {k for k, v in got.items() if v["valid"]} == {(1, "x"), (1, "dup")}
    m = got[1, "x"]["message"]
    assert m == json.dumps(json.loads(m), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(m) == {"arguments": {"a": 1, "b": "é"}, "id": "x", "name": "t", "position": 3, "result": "r0", "status": "linked"}
    assert json.loads(got[1, "z"]["message"])["arguments"] == "{broken"


def test_nested_schemas(spark):
    point = {"type": "object", "properties": {"x": "integer", "unit": {"type": "string", "enum": ["m", "km"]}}, "required": ["x"]}
    schema = {"t": {"properties": {"p": point, "many": {"type": "array", "items": point}, "any": {"type": "object"}, "n": {"type": "integer", "enum": [1, 2]}}, "required": ["p"]}}
    cases = {
        '{"p":{"x":1}}': True, '{"p":{"x":1,"unit":"km"},"any":{"free":[1]},"n":2}': True, '{"p":{"x":1},"many":[{"x":2},{"x":3,"unit":"m"}]}': True, '{"p":{"x":1},"many":[]}': True,
        '{"p":{"x":"1"}}': False, '{"p":{"unit":"m"}}': False, '{"p":{"x":1,"unit":"mile"}}': False, '{"p":{"x":1,"y":1}}': False, '{"p":{"x":1},"many":[{"x":2},{"x":"3"}]}': False,
        '{"p":{"x":1},"many":{"x":2}}': False, '{"p":{"x":1},"n":3}': False, '{"p":null}': False, '{}': False, '[]': False, '"p"': False, '': False,
    }
    df = spark.createDataFrame([("t", k) for k in cases] + [("t", None), (None, "{}"), ("other", '{"p":{"x":1}}')], "name string, arguments string")
    got = [r[0] for r in df.select(toolcalls.valid_arguments(F.col("name"), F.col("arguments"), schema)).collect()]
    assert got == [*cases.values(), False, False, False]


def test_levels_of_any_graph(spark):
    rng = np.random.default_rng(8)
    needs = set()
    for conv in range(12):
        for a in range(14):
            for b in rng.choice(14, rng.integers(0, 3), replace=False):
                if b < a or conv % 4 == 3:  # every fourth may have cycles
                    needs.add((conv, str(a), str(b)))
    needs |= {(99, str(i), str(i - 1)) for i in range(1, 300)} | {(98, "0", "1"), (98, "1", "0"), (98, "2", "1"), (98, "3", "2"), (98, "3", "4")}
    ids = {(c, str(i)) for c in range(12) for i in range(14)} | {(99, str(i)) for i in range(300)} | {(98, str(i)) for i in range(5)}
    want, before = {}, None
    own = {k: {(k[0], n) for c, a, n in needs if (c, a) == k} for k in ids}
    while before != len(want):
        before = len(want)
        want |= {k: max([want[x] + 1 for x in v], default=0) for k, v in own.items() if k not in want and all(x in want for x in v)}
    got = toolcalls.levels(spark.createDataFrame(sorted(ids), "conv_id long, call_id string"), spark.createDataFrame(sorted(needs), NEEDS))
    assert sorted(((r["conv_id"], r["call_id"]), r["level"]) for r in got.collect()) == sorted(want.items())


def test_tool_calls_without_rows(spark):
    e = [spark.createDataFrame([], s) for s in (CALLS, RESULTS, NEEDS)]
    assert toolcalls.link(*e, TOOL).count() == 0
    turns = [(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c " * 200), (1, 4, "assistant", None), (1, 4, "user", "d"), (None, 1, "user", "e"), (2, None, "user", "f"), (3, 1, "assistant", "g"), (1, 9, None, "h")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(7))
    got = {(r["call_id"], r["status"], r["level"], r["valid"]) for r in toolcalls.link(*toolcalls.from_conversations(df), toolcalls.ANSWER).collect()}
    assert got == {("call-1-0", "orphan", None, False), ("call-1-1", "orphan", None, False), ("call-1-3", "unanswered", 0, False), ("call-1-4", "linked", 1, False), ("call-1-5", "orphan", None, False), ("call-3-1", "unanswered", 0, True)}


def test_a_conversation_in_parts(spark):
    """One conversation of 600 turns lies in several parts, beside short ones and repeated turns."""
    rng = np.random.default_rng(3)
    turns = [(1, int(t), ("assistant", "user", "tool")[rng.integers(3)], f"text {rng.integers(9)}") for t in rng.integers(0, 400, 600)]
    turns += [(c, t, ("user", "assistant")[t % 2], "x") for c in (0, 2) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
        assert _prefix.numbered(df, "conv_id", ["turn", "role"], ["turn", "role", "text"]).where("conv_id = 1").select("bucket").distinct().count() > 1
        calls, results, needs = toolcalls.from_conversations(df)
        got = {(r["conv_id"], r["call_id"]): (r["status"], r["level"], r["position"]) for r in toolcalls.link(calls, results, needs, toolcalls.ANSWER).collect()}
        first_and_before = {(r["conv_id"], r["call_id"], r["need"]) for r in needs.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, want_needs = {}, set()
    for conv in (0, 1, 2):
        own = sorted(t[1:] for t in turns if t[0] == conv)
        name = lambda n: f"call-{conv}-{n}"  # noqa: B023, E731
        said = [n for n, t in enumerate(own, 1) if t[1] == "assistant"]
        for level, n in enumerate(said):
            after = own[n] if n < len(own) and own[n][1] != "assistant" else None
            want[conv, name(n)] = ("unanswered" if after is None else "early" if after[0] < own[n - 1][0] else "linked", level, level)
        want |= {(conv, name(n - 1)): ("orphan", None, None) for n, t in enumerate(own, 1) if t[1] != "assistant" and n - 1 not in said}
        want_needs |= {(conv, name(b), name(a)) for a, b in zip(said, said[1:])}
        if len(said) > 1:
            want_needs.add((conv, name(said[-1]), name(said[0])))
    assert got == want
    assert first_and_before == want_needs


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    names = [c[0] for c in cur.description]
    assert cols == sorted(names)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=str)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard"]
    near = {r["doc_id"] for r in queries.op3_neardup(spark, SF).where("kept").collect()}
    bad = {r["doc_id"] for r in queries.op1_decontamination(spark, SF).where("contaminated").collect()}
    got = Counter(r["doc_id"] for r in out.collect())
    assert set(got) <= near - bad and max(got.values()) <= 2
    sizes, words = Counter(), Counter()
    for r in docs.where(F.col("doc_id").isin(list(near - bad))).collect():
        sizes[r["source"]] += len(r["text"].split())
        words[r["source"]] += got[r["doc_id"]] * len(r["text"].split())
    for s, x in refilled(sizes).items():
        assert abs(words[s] - x) <= max(len(r["text"].split()) for r in docs.where(F.col("source") == s).collect())
    n = Counter(r["shard"] for r in out.collect())
    assert set(n) <= set(range(24)) and out.columns[-1] == "shard"


def test_pipeline_stages_survive_empty_and_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (2, "12 34", "en", "s", 5), (3, "some words here", "en", None, None), (3, "some words here", "en", None, None)], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema if name != "shard" else None) if name != "shard" else stage(spark, docs, SF)
        assert docs.columns[-1] == "shard"
        docs.collect()
