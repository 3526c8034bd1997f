"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. A stage's result is written and read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, line_dedup, ngram_join, packing, quality
from tallyframe.llm.common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts have a score too, that of no words; ties of score fall alike, repeated
    rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out(labels["doc_id"])))
    return docs.where(quality.scorer(model)(docs["text"]) >= 0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one, however short.

    Every row stays; a document of which nothing is left has an empty text."""
    return line_dedup.without_duplicate_lines(docs, min_words=1)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The result of ``line_stage`` without the documents it emptied.

    A document goes when nothing but white space is left of what had more before: all of it
    stands in earlier documents. Null, empty and blank texts stay as they are; of equal rows
    (doc_id and text) all keep their lines, for a row does not come before itself.
    """
    left = line_stage(spark, docs.withColumn("_worded", docs["text"].rlike(r"\S")), sf_dir)
    return left.where(~F.coalesce(F.col("_worded"), F.lit(False)) | F.col("text").rlike(r"\S")).drop("_worded")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The smallest doc_id of a group stays; texts without words are nobody's copy and stay.
    """
    return ngram_join.keep_one(docs, 5, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without copies of test items; null and empty texts hold none and stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences, with their token ids.

    Null and empty texts are the closing id alone; repeated rows are packed once each.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL can state the classifier, the alignment or the tokenizer; see tests/llm for brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
    return docs
