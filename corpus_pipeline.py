"""The corpus pipeline: each stage reads what its predecessor kept and writes Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.llm import jaccard_join, mixing, packing, quality_classifier, quality_rules
from coordspark.llm.queries import byte_bpe
from coordspark.llm.tables import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier doesn't reject. Null and empty texts are scored like any; repeated rows get one score."""
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep, without the lines that failed. Null and empty texts have too few words and go."""
    kept = quality_rules.clean(docs).where("quality_rules.kept")
    text = F.col("quality_rules.clean_text")
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id; rows without an id stay.

    Rows of one id are one document: of those that differ, the one of the least hash stands for it.
    """
    docs = docs.select(*COLUMNS)
    mark = F.xxhash64(*COLUMNS)
    first = jaccard_join.join(docs, with_links=False).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("mark"))
    first = written(rows.join(first, "doc_id", "left_semi"), "distinct")
    kept = docs.withColumn("mark", mark).join(first, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    return kept.select(*COLUMNS).unionAll(docs.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks; a null source is one of its own."""
    return mixing.repeated(mixing.mix(docs)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; null and empty texts are the closing id."""
    return packing.pack(docs, byte_bpe())


STAGES = [("quality_classifier", classified), ("quality_rules", cleaned), ("jaccard_join", distinct), ("mixing", mixed), ("packing", packed)]
#: Learned scores can't be stated in SQL; the tests see only that each stage leaves rows of these columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
