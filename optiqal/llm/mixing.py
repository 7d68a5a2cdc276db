"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equal numbers of words. The golden-ratio point of each slot, mapped through the cumulative
targets, names the source that fills it; slots are ranked per source, and the k-th slot of a source takes the k-th block of that
source's documents, laid end to end in a shuffled order and gone through again where the target is above the size. The sequence
ends after as many slots as hold all targets, so what a source gives is a slot's words for each point that fell to it: the
points, not the target, decide it, and their low discrepancy keeps it within a few slots of the target. What no slot takes is
not in the mix.

Sources never meet in one task: running word counts and ranks are dealt over buckets of a source (see _prefix).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiqal.functions.graph import written
from optiqal.llm._prefix import running

#: Words of a slot at most. Slots are smaller where the smallest target would have fewer than MIN_SLOTS of them, and larger
#: where the mix would have more than MAX_SLOTS.
BLOCK, MIN_SLOTS, MAX_SLOTS = 2048, 512, 1 << 24
#: Hexadecimal digits of the shuffling hash that make a bucket of a source's documents: 3 give 4,096.
DIGITS = 3
#: Slots that are ranked together, and cells (of equal width) in which a point looks for its source.
SLOT_BUCKET, CELLS = 65536, 4096
#: The golden ratio less one, in units of 2**-32: the k-th point is k times this, modulo 2**32.
GOLDEN = 2654435769


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """For (source, source_size): weight and target. Targets are as the weights, which repeat over the sources in code point
    order with null last; none is above `most` times its source's size, and what that leaves goes to the others by weight.
    Their sum is `share` of all sizes (of `most` times all sizes, if that is less).

    Filling in the order of size over weight, a source is full if it is full at the level that all later ones share.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), w.alias("weight"))
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    cap, everything = F.col("source_size") * float(most), W.partitionBy()
    x = x.select("*", cap.alias("cap"), (F.sum("source_size").over(everything) * float(share)).alias("all"), F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("filled"), F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("open"))
    x = x.withColumn("full", F.col("cap") * F.col("open") <= F.col("weight") * (F.col("all") - F.col("filled")))
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    level = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return x.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("weight") / level).alias("target"))


def laid(docs: DataFrame, source_col: str, text_col: str, key_col: str) -> DataFrame:
    """row, key, source, name (never null), size, h and bucket: docs in the order in which the blocks go through them.

    Rows without a key are laid by their texts.
    """
    key = F.coalesce(docs[key_col].cast("string"), F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")))
    h = F.md5(F.concat_ws(":", F.lit("mix"), key).cast("binary"))
    source, size = docs[source_col].cast("string"), word_count(docs[text_col].cast("string"))
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key_col].alias("key"), source.alias("source"), name(source).alias("name"), size.alias("size"), h.alias("h"))
    return named.withColumn("bucket", F.substring("h", 1, DIGITS))


def name(source: Column) -> Column:
    """A text that is never null and differs for null and each source."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def plan(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Of rows (source, size): source, source_size, weight, target, name, quota (the target in whole words) and most, the words
    of the source that slots may take."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return targets(sizes, weights, share, most).select("*", name(F.col("source")).alias("name"), F.floor(F.col("target") + 0.5).alias("quota"), F.floor(F.col("source_size") * float(most)).alias("most"))


def slot_words(plan: DataFrame, block: int = BLOCK) -> int:
    """Words of a slot, for a plan with quotas."""
    words, least = plan.where("quota > 0").agg(F.sum("quota"), F.min("quota")).first()
    return max(min(block, (least or 0) // MIN_SLOTS), -(-(words or 0) // MAX_SLOTS), 1)


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, name, nth, slots: the source of each slot of the mix, the slot's rank (from 0) among those of its source, and their number.

    plan: name, quota. Slots of `block` words, enough for all quotas. A source that no point reaches has one slot at the end.
    Sources without a quota have none.
    """
    some = plan.where("quota > 0").select("name", "quota")
    words = some.agg(F.sum("quota")).first()[0]
    count = -(-(words or 0) // block)
    up_to = W.orderBy("name")
    edge = lambda w: F.floor(F.coalesce(F.sum("quota").over(w), F.lit(0)).cast("double") * float(1 << 32) / float(words or 1))
    share = some.select("name", edge(up_to.rowsBetween(W.unboundedPreceding, -1)).alias("from"), edge(up_to.rowsBetween(W.unboundedPreceding, 0)).alias("to"))
    width = (1 << 32) // CELLS
    cells = share.where("from < to").select("*", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))).alias("cell"))
    u = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1 << 32))
    points = plan.sparkSession.range(count).select(F.col("id").alias("slot"), u.alias("u"), F.floor(u / width).alias("cell"))
    met = points.join(cells, "cell").where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to"))).select("slot", "name", F.floor(F.col("slot") / SLOT_BUCKET).alias("bucket"))
    ranked = running(met, "name", "bucket", ["slot"], F.lit(1)).select("slot", "name", F.col("before").cast("long").alias("nth"))
    slots = met.groupBy("name").agg(F.count("*").alias("slots"))
    late = some.join(slots, "name", "left_anti").select((F.lit(count) + F.row_number().over(W.orderBy("name")) - 1).cast("long").alias("slot"), "name", F.lit(0).cast("long").alias("nth"), F.lit(1).cast("long").alias("slots"))
    return ranked.join(slots, "name").select("slot", "name", "nth", "slots").unionByName(late)


def counted(docs: DataFrame, weights: Sequence[float], share: float, most: float, block: int, source_col: str, text_col: str, key_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows, plan, slots, words): docs without their texts, laid; the plan with the end of what slots can reach of a source
    (null if it has none); the schedule; the words of a slot.

    The words are counted here, once; rows and slots are tables in the shared folder.
    """
    rows = written(laid(docs.select(key_col, source_col, text_col), source_col, text_col, key_col).drop("row"), "sizes")
    wanted = written(plan(rows, weights, share, most), "plan")
    block = slot_words(wanted, block)
    slots = written(schedule(wanted, block), "slots")
    each = slots.groupBy("name").agg(((F.max("nth") + 1) * block).alias("end"))
    return rows, wanted.join(each, "name", "left").withColumn("end", F.least("most", F.coalesce("end", F.lit(0)))), slots, block


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, source_col: str = "source", text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (the words of it that slots take, repeats counted) and
    first_slot, the first slot of the mix that takes some of them (null if none does).

    Null text has no words and nothing taken. A null source is a source of its own. Rows that repeat are documents each.
    Keys that tie are laid by size. No document: no rows. Every source gives its target to within a few slots, and at most
    `most` times its size.
    """
    rows, wanted, slots, block = counted(docs, weights, share, most, block, source_col, text_col, key_col)
    placed = running(rows, "name", "bucket", ["h", "key", "size"], F.col("size")).select("name", "bucket", "nth", "key", "size", "before")
    x = placed.join(wanted.select("name", "source_size", "target", "end"), "name")
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(-int(-most // 1) - 1))).alias("pass"))
    x = x.withColumn("from", F.col("before") + F.col("pass") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), "end"))
    inside = F.when(F.col("from") < F.col("to"), F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)))
    x = x.select("*", F.explode_outer(inside).alias("nth_block"))
    x = x.join(slots.select("name", F.col("nth").alias("nth_block"), "slot"), ["name", "nth_block"], "left")
    words = F.least("to", (F.col("nth_block") + 1) * block) - F.greatest("from", F.col("nth_block") * block)
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), words)), F.lit(0)).cast("long")
    out = x.groupBy("name", "bucket", "nth", "key", "size", "source_size", "target").agg(taken.alias("taken"), F.min("slot").alias("first_slot"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, source_col: str = "source", text_col: str = "text", key_col: str = "doc_id", slot_col: str | None = None) -> DataFrame:
    """The mix as whole documents, with the columns of docs: a copy for each slot whose block holds the document's middle.

    With slot_col, a column of that name (a new one) holds the slot, by which the mix may be sorted and written.
    Documents stay whole, so a source is at its slots' words to within one document. Documents without words go.
    """
    rows, wanted, slots, block = counted(docs, weights, share, most, block, source_col, text_col, key_col)
    own = ["name", "bucket", "h", "size"]
    placed = running(rows, "name", "bucket", ["h", "key", "size"], F.col("size")).where("size > 0").join(wanted.select("name", "source_size", "end"), "name")
    x = placed.select(*own, "nth", "before", "source_size", "end", F.explode(F.sequence(F.lit(0), F.lit(-int(-most // 1) - 1))).alias("pass"))
    x = x.withColumn("middle", F.col("before") + F.floor(F.col("size") / 2) + F.col("pass") * F.col("source_size"))
    x = x.withColumn("nth_block", F.when(F.col("middle") < F.col("end"), F.floor(F.col("middle") / block)))
    x = x.join(slots.select("name", F.col("nth").alias("nth_block"), "slot"), ["name", "nth_block"], "left").groupBy(*own, "nth").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    # rows of one key, source and size are told apart by their number among these; the texts are shuffled once
    twins = W.partitionBy(*own)
    texts = laid(docs, source_col, text_col, key_col).where("size > 0")
    texts = texts.withColumn("twin", F.row_number().over(twins.orderBy(F.xxhash64(F.col("row")[text_col]))))
    x = x.withColumn("twin", F.row_number().over(twins.orderBy("nth"))).where(F.size("slots") > 0).drop("nth")
    out = texts.join(x, [*own, "twin"]).select("row", F.explode("slots").alias("slot"))
    return out.select("row.*", *([F.col("slot").alias(slot_col)] if slot_col else []))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
         sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s),
g AS (SELECT *, cap * open <= weight * (total - filled) AS is_full FROM f),
t AS (
  SELECT coalesce('=' || source, 'null') AS name, source_size,
         CASE WHEN is_full THEN cap ELSE (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0.0)) * weight
              / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target
  FROM g),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
c AS (SELECT sum(quota)::BIGINT AS words, greatest(least(2048, min(quota) // 512), ceil(sum(quota) / 16777216)::BIGINT, 1)::BIGINT AS block FROM q WHERE quota > 0),
z AS (SELECT words, block, ceil(words / block)::BIGINT AS n FROM c),
e AS (
  SELECT name, floor(coalesce(sum(quota) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 4294967296.0::DOUBLE / words::DOUBLE)::BIGINT AS lo,
         floor(sum(quota) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE * 4294967296.0::DOUBLE / words::DOUBLE)::BIGINT AS hi
  FROM q, z WHERE quota > 0),
p AS (SELECT slot, (slot * 2654435769) % 4294967296 AS u FROM (SELECT unnest(range(n)) AS slot FROM z)),
m AS (SELECT name, slot, row_number() OVER (PARTITION BY name ORDER BY slot) - 1 AS nth FROM p JOIN e ON u >= lo AND u < hi),
l AS (
  SELECT name, slot, nth FROM m
  UNION ALL
  SELECT name, n + row_number() OVER (ORDER BY name) - 1, 0 FROM q, z WHERE quota > 0 AND name NOT IN (SELECT name FROM m)),
o AS (
  SELECT d.*, row_number() OVER (ORDER BY h, doc_id, size) AS r, source_size, target, block,
         coalesce(sum(size) OVER (PARTITION BY name ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN q USING (name), z),
k AS (SELECT r, name, block, before + pass * source_size AS lo, before + pass * source_size + size AS hi FROM o, (VALUES (0), (1)) AS v(pass)),
w AS (
  SELECT r, sum(least(hi, (nth + 1) * block) - greatest(lo, nth * block))::BIGINT AS taken, min(slot)::BIGINT AS first_slot
  FROM k JOIN l ON k.name = l.name AND lo < hi AND l.nth BETWEEN lo // block AND (hi - 1) // block
  GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM o LEFT JOIN w USING (r)
"""
