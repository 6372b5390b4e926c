"""The corpus pipeline: documents in, token files out. Each stage's result is written as Parquet
and read again as the next stage's documents.

1. quality: documents that the classifier rejects go.
2. near-dedup: of each class of near copies the document of smallest doc_id stays.
3. decontaminate: documents that leak a benchmark item go.
4. mix: documents are repeated so that the languages' expected token shares meet the targets;
   no document is thinned (rates are at least 1), so every clean document stays.
5. token files: texts become shards of token ids; the rows are the index read back from them.

Defined results: stages 1 to 4 return the columns they got, whatever their names and types (rows
travel as one struct beside what a stage adds). Null texts are empty; empty and word-less texts
are no copies of each other and leak nothing. Rows that share doc_id and text are one row after
stage 2 (of rows that differ in other columns the one that comes first as text); null doc_ids
stay unless their text is a copy. Every stage gives no row for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.decontaminate import leaks
from faultline.llm.mixing import apply_rates, soft_mixture
from faultline.llm.near_dup import near_duplicates
from faultline.llm.quality import with_quality
from faultline.llm.queries import TARGETS, TOKENIZER, labelled_domains
from faultline.llm.shared import drop_folder, new_dir, saved, small, table, whole_row
from faultline.llm.token_files import token_files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents below this score go.
MIN_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_quality(docs, table(spark, sf_dir, "labels")).where(F.col("score") >= MIN_QUALITY).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by doc_id and text; of rows that share both one stays."""
    classes = near_duplicates(docs, with_hash=True).select("doc_id", "text_hash", "class_id")
    gone = classes.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "text_hash").distinct()
    own = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    kept = own.join(small(gone, gone.count()), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti")
    n = classes.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct("doc_id", "text_hash")).alias("texts")).first()
    if n["rows"] != n["texts"]:
        kept = kept.groupBy("id", "hash").agg(F.min_by("row", F.col("row").cast("string")).alias("row"))
    return kept.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = docs.select(whole_row(docs), F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"))
    found = leaks(own.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    found = saved(found, "leaks")
    return own.join(small(found, found.count()), "key", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_rates(docs, soft_mixture(docs, labelled_domains(spark, sf_dir), TARGETS, min_rate=1.0))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing to target weights", mix), ("token-ID output", write_tokens)]

#: The classifier and the fitted rates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        folder = new_dir(spark, f"stage-{k}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(folder)
        if before:
            drop_folder(spark, before)  # of the stages only the last result is kept
        docs, before = spark.read.schema(out.schema).parquet(folder), folder
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
