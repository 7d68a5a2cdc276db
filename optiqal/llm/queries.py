"""The queries of this subpackage over the given tables, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optiqal.llm import decontamination, exactdedup, language, licenses, mixing, nearest, neardup, passages, sharding, spelling, toolcalls, trie, urlfilter


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.find_matches(docs, read(spark, sf_dir, "benchmark")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.digest(language.identify(docs.select("doc_id", "text"), docs.where(~language.held_out(docs["doc_id"]))))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op4_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.digest(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest.search(rows.where(F.col("vec_id") % 50 == 0), rows)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.numbered(read(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, needs = toolcalls.from_conversations(read(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, needs, toolcalls.ANSWER)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(read(spark, sf_dir, "pages"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_language, op3_neardup, op4_exactdedup, op5_mixing, op6_nearest, op7_sharding, op8_passages, op9_licenses, op10_toolcalls, op11_trie, op12_urlfilter, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op10_toolcalls": toolcalls.ORACLE_SQL, "op11_trie": trie.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL}
