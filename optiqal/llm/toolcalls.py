"""Tool-call linking: calls meet their results by identifier, are put in topological order, checked and written as JSON.

Columns only. Calls and results meet in a hash join on (conversation, identifier). The order is found level by level: a call
is placed once everything it needs is placed, one join for each level, and calls on a cycle never are. Arguments become
variants, whose text form has sorted keys and no blanks.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiqal.functions.graph import written
from optiqal.llm._prefix import numbered

#: JSON schema types and the variant types that they allow, as a pattern.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def _fits(value: Column, schema: str | Mapping) -> Column:
    """Whether a variant fits a schema; false for null."""
    if isinstance(schema, str):
        schema = {"type": schema}
    fits = F.coalesce(F.regexp_like(F.schema_of_variant(value), F.lit(f"^(?:{TYPES[schema.get('type', 'object')]})$")), F.lit(False))
    if "enum" in schema:
        fits = fits & F.coalesce(F.try_variant_get(value, "$", "string").isin(*[str(x) for x in schema["enum"]]), F.lit(False))
    if "items" in schema:
        fits = fits & F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: _fits(x, schema["items"])), F.lit(False))
    if "properties" in schema:
        for field, kind in schema["properties"].items():
            found = F.try_variant_get(value, f"$['{field}']", "variant")
            fits = fits & (_fits(found, kind) if field in schema.get("required", ()) else found.isNull() | _fits(found, kind))
        if not schema.get("additional", False):
            known = F.array(*[F.lit(f) for f in schema["properties"]]).cast("array<string>")
            keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
            fits = fits & (F.size(F.array_except(keys, known)) == 0)
    return fits


def valid_arguments(name: Column, arguments: Column, schemas: Mapping[str, Mapping]) -> Column:
    """Whether the arguments (JSON text) are an object that fits the schema of the tool of that name.

    schemas: name -> {"properties": {field: schema}, "required": [field], "additional": bool}; a field's schema is a type or
    {"type", "enum", "items", "properties", "required", "additional"}. False for unknown tools, null names, null or malformed
    text, doubled keys, missing required fields, wrong types or values, and further fields unless allowed.
    """
    value = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, schema in schemas.items():
        out = F.when(name == tool, _fits(value, schema)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _jumps(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, root, dist) of calls that need one call each: the first call down their chain that needs none or
    several, and how far it is. Distances double from round to round; chains that never end (cycles) have no row.
    """
    key = ["conv_id", "call_id"]
    at = written(single.select(*key, F.col("need").alias("root"), F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done")), "jumps")
    for _ in range(max(1, at.count().bit_length()) + 1):
        next_ = at.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("further"), F.col("dist").alias("more"), F.col("done").alias("end"))
        x = at.join(next_, ["conv_id", "root"], "left")
        on = ~F.col("done") & F.col("further").isNotNull()
        at = written(x.select(*key, F.when(on, F.col("further")).otherwise(F.col("root")).alias("root"), F.when(on, F.col("dist") + F.col("more")).otherwise(F.col("dist")).alias("dist"), (F.col("done") | F.col("further").isNull() | F.col("end")).alias("done")), "jumps")
        if at.where("not done").isEmpty():
            break
    return at.where("done").drop("done")


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that need no other call of theirs, else one more than the highest they need.

    needs: (conv_id, call_id, need). Needs that name no call of the conversation are left out. Calls on or behind a cycle
    have no row. Chains of calls with one need each are jumped over in rounds that grow with the logarithm of their length;
    calls with several needs are placed once all their needs are, so the other rounds are as many as such calls in a row.
    """
    key = ["conv_id", "call_id"]
    known = calls.select(*key).distinct()
    edges = needs.select(*key, "need").distinct().join(known.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi").join(known, key, "left_semi")
    edges = written(edges, "needs")
    count = edges.groupBy(*key).agg(F.count("*").alias("n"))
    split = edges.join(count, key)
    jumps = written(_jumps(split.where("n = 1")), "jumps")
    placed = written(known.join(edges, key, "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    # needs of the others, with each chain between replaced by its length; one that ends in a cycle is never met
    chained = split.where("n = 1").select(*key).withColumnsRenamed({"call_id": "need"}).withColumn("chained", F.lit(True))
    over = split.where("n > 1").join(chained, ["conv_id", "need"], "left").join(jumps.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left")
    root = F.when(F.col("chained"), F.col("root")).otherwise(F.col("need"))
    waiting = written(over.select(*key, root.alias("need"), (F.coalesce("dist", F.lit(0)) + 1).alias("step"), F.lit(None).cast("long").alias("met")), "needs")
    all_placed = [placed]
    while not placed.isEmpty() and not waiting.isEmpty():
        seen = placed.select("conv_id", F.col("call_id").alias("need"), "level")
        waiting = written(waiting.join(seen, ["conv_id", "need"], "left").select(*key, "need", "step", F.coalesce("met", F.col("level") + F.col("step")).alias("met")), "needs")
        ready = waiting.groupBy(*key).agg(F.count("*").alias("n"), F.count("met").alias("m"), F.max("met").alias("level")).where("n = m")
        placed = written(ready.select(*key, "level"), "levels")
        waiting = waiting.join(placed, key, "left_anti")
        all_placed.append(placed)
    ends = reduce(DataFrame.unionByName, all_placed)
    along = jumps.join(ends.withColumnsRenamed({"call_id": "root"}), ["conv_id", "root"]).select(*key, (F.col("level") + F.col("dist")).alias("level"))
    return ends.unionByName(along)


def link(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per call, and one per result without a call: conv_id, call_id, status, level, position, valid, message.

    calls: conv_id, call_id, turn, name, arguments (JSON text). results: conv_id, call_id, turn, content.
    status: linked, unanswered, early (the result comes before the call), orphan (no such call). Of calls or results that
    share an identifier the one with the least turn (then text) counts; null identifiers take no part. level: see levels; null
    on cycles. position: rank in the conversation by level and turn, from 0, cycles last and orphans null. message: canonical
    JSON, keys sorted, with null for what is missing; malformed arguments are kept as a string.
    level takes as many rounds as calls with several needs follow one another, besides those of levels() for chains.
    """
    key = ["conv_id", "call_id"]
    whole = lambda df: df.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    first = lambda df, *more: whole(df).groupBy(*key).agg(F.min(F.struct("turn", *more)).alias("x")).select(*key, "x.*")
    call = first(calls, "name", "arguments").withColumn("called", F.lit(True))
    result = first(results, "content").withColumnRenamed("turn", "result_turn").withColumn("answered", F.lit(True))
    x = call.join(result.hint("shuffle_hash"), key, "full").join(levels(call, whole(needs)), key, "left")
    order = [F.col("called").isNull(), F.col("level").isNull(), F.col("level"), F.col("turn"), F.col("call_id")]
    x = numbered(x, "conv_id", order, order).withColumn("position", F.when(F.col("called"), F.col("before")).cast("long"))
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked")
    x = x.withColumn("status", status).withColumn("valid", valid_arguments(F.col("name"), F.col("arguments"), schemas))
    as_text = F.try_variant_get(F.try_parse_json(F.to_json(F.struct(F.col("arguments").alias("text")))), "$.text", "variant")
    arguments = F.coalesce(F.try_parse_json("arguments"), as_text)
    body = F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("position").alias("position"), F.col("content").alias("result"), F.col("status").alias("status"))
    return x.select(*key, "status", F.col("level").cast("long").alias("level"), "position", "valid", F.to_json(body, {"ignoreNullFields": "false"}).alias("message"))


#: The tool as which an assistant's turn is read. It takes answers of up to LONG words only.
LONG = 160
ANSWER = {
    "answer": {
        "properties": {
            "turn": "integer",
            "text": "string",
            "words": {"type": "object", "properties": {"count": "integer", "size": {"type": "string", "enum": ["short", "medium"]}}, "required": ["count", "size"]},
            "after": {"type": "array", "items": {"type": "string", "enum": ["user", "system", "tool"]}},
        },
        "required": ["turn", "text", "words", "after"],
    }
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and needs of plain conversations (conv_id, turn, role, text).

    Each assistant turn is a call of the tool `answer`; its arguments name the role of the turn before and the answer's size.
    Every other turn is the result of the call in the turn before it, and an orphan if that is no call. A call needs the one
    before it, and the last of a conversation the first one too. Null text is an empty one. A conversation of any length is
    numbered in parts; only the rows of one turn and role whose texts begin alike stay in one.
    """
    x = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    x = numbered(x, "conv_id", ["turn", "role", F.left("text", F.lit(32))], ["turn", "role", "text"]).withColumn("nth", F.col("before") + 1)
    call = F.when(F.col("role") == "assistant", F.col("nth"))
    part, so_far = ["conv_id", "bucket"], W.partitionBy("conv_id").orderBy("bucket")
    ends = x.groupBy(*part).agg(F.max_by("role", "nth").alias("role"), F.max(call).alias("latest"), F.min(call).alias("earliest"))  # a row a part
    ends = ends.select(*part, F.lag("role").over(so_far).alias("role_of_part_before"), F.max("latest").over(so_far.rowsBetween(W.unboundedPreceding, -1)).alias("call_of_parts_before"), F.min("earliest").over(W.partitionBy("conv_id")).alias("first"), F.max("latest").over(W.partitionBy("conv_id")).alias("last"))
    own = W.partitionBy(*part).orderBy("nth")
    x = x.join(ends, part).withColumn("role_before", F.coalesce(F.lag("role").over(own), F.col("role_of_part_before")))
    x = x.withColumn("call_before", F.coalesce(F.max(call).over(own.rowsBetween(W.unboundedPreceding, -1)), F.col("call_of_parts_before")))
    x = written(x.select("conv_id", "turn", "role", "text", "nth", "role_before", "call_before", "first", "last"), "turns")  # read by all three tables
    called = lambda n: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), n.cast("string"))
    said = x.where("role = 'assistant'").withColumn("call_id", called(F.col("nth")))
    count = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    size = F.when(count < LONG // 2, "short").when(count <= LONG, "medium").otherwise("long")
    after = F.when(F.col("role_before").isNull(), F.array().cast("array<string>")).otherwise(F.array("role_before"))
    calls = said.select("conv_id", "call_id", "turn", F.lit("answer").alias("name"), F.to_json(F.struct("turn", "text", F.struct(count.alias("count"), size.alias("size")).alias("words"), after.alias("after"))).alias("arguments"))
    results = x.where("role <> 'assistant'").select("conv_id", called(F.col("nth") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    before, first = called(F.col("call_before")), called(F.col("first"))
    before = F.when(F.col("call_before").isNotNull(), before)  # concat_ws leaves nulls out
    needs = said.select("conv_id", "call_id", F.explode(F.when(F.col("nth") == F.col("last"), F.array_distinct(F.array(before, first))).otherwise(F.array(before))).alias("need"))
    return calls, results, needs.where("need is not null and need <> call_id")


ORACLE_SQL = r"""
WITH x AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (
  SELECT *, row_number() OVER w AS nth, lag(role) OVER w AS role_before, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lead(turn) OVER w AS next_turn,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS count
  FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (
  SELECT *, 'call-' || conv_id || '-' || nth AS call_id, row_number() OVER (PARTITION BY conv_id ORDER BY nth) - 1 AS level,
         CASE WHEN count < 80 THEN 'short' WHEN count <= 160 THEN 'medium' ELSE 'long' END AS size,
         CASE WHEN role_before IS NULL THEN [] ELSE [role_before] END AS after,
         next_role IS NOT NULL AND next_role <> 'assistant' AS answered
  FROM n WHERE role = 'assistant'),
c AS (
  SELECT *, CASE WHEN NOT answered THEN 'unanswered' WHEN next_turn < turn THEN 'early' ELSE 'linked' END AS status FROM s)
SELECT conv_id, call_id, status, level, level AS position, size <> 'long' AND (role_before IS NULL OR role_before IN ('user', 'system', 'tool')) AS valid,
       to_json({'arguments': {'after': after, 'text': text, 'turn': turn, 'words': {'count': count, 'size': size}}, 'id': call_id, 'name': 'answer',
                'position': level, 'result': CASE WHEN answered THEN next_text END, 'status': status})::VARCHAR AS message
FROM c
UNION ALL
SELECT conv_id, 'call-' || conv_id || '-' || (nth - 1), 'orphan', NULL, NULL, false,
       to_json({'arguments': NULL, 'id': 'call-' || conv_id || '-' || (nth - 1), 'name': NULL, 'position': NULL, 'result': text, 'status': 'orphan'})::VARCHAR
FROM n WHERE role <> 'assistant' AND coalesce(role_before, '') <> 'assistant'
"""
