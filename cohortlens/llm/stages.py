"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame, all but the last with the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.llm.jaccard import jaccard_classes
from cohortlens.llm.language import identify, remainder
from cohortlens.llm.packing import count_words, pack
from cohortlens.llm.quality import score_quality
from cohortlens.llm.substrings import remove_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return score_quality(docs).where("kept").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, which becomes their ``lang``; learnt from the stage's own input, held-out rows aside."""
    learn = F.coalesce(remainder("doc_id", 4) != 2, F.lit(True))
    return identify(docs, learn).where("not rejected").withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id (null ids last); of rows equal in id and text, one."""
    chosen = jaccard_classes(docs).where("kept").select(F.col("doc_id").alias("chosen"), "text_hash").distinct()
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    kept = hashed.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col("__hash") == F.col("text_hash")), "left_semi")
    own = Window.partitionBy("doc_id", "__hash").orderBy(F.lit(0))
    return kept.withColumn("__copy", F.row_number().over(own)).where("__copy = 1").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated 35-word windows; a document that changes is its kept words, joined by blanks."""
    changed = remove_repeats(docs, carry=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = changed.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of every document, without its text."""
    return pack(count_words(docs).drop("text"))
