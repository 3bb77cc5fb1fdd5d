"""A training corpus from raw documents: five stages, each written and read again.

toxicity, near duplicates, repeated passages, benchmark leaks, tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblore.llm.decontamination import contamination
from joblore.llm.jaccard_join import jaccard_groups
from joblore.llm.scratch import stash
from joblore.llm.sentencepiece import encode
from joblore.llm.suffix_dedup import remove_repeats
from joblore.llm.text_cnn import train, with_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the raw documents' labels.

    Rows are judged one by one, whatever their id; a null text counts as an empty one and stays null. Without
    any label nothing goes.
    """
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weight.any() and not model.bias:  # it has seen no label
        return docs.select(COLUMNS)
    return with_toxicity(docs.select(COLUMNS), model, score_col="toxicity").filter("toxicity < 0.5").drop("toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by J >= 0.8 of five-word shingles.

    Rows that repeat a doc_id stay or go together; rows without doc_id, and null, empty and blank texts, stay.
    """
    gone = jaccard_groups(docs, ngram=5, num=80, den=100).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that an earlier one holds; n_chars is counted anew.

    Texts that lose all bytes stay as empty ones, a null text becomes empty. Rows that repeat a doc_id don't
    remove from each other, rows without doc_id neither lose bytes nor make others lose them.
    """
    cut = remove_repeats(docs, length=50, carry=("lang", "source"))
    return cut.select("doc_id", "text", "rest.lang", "rest.source", F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of a benchmark item.

    Rows that repeat a doc_id stay or go together; rows without doc_id stay, as do null and empty texts.
    """
    hit = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select("doc_id").distinct()
    return docs.select(COLUMNS).join(hit, "doc_id", "left_anti").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text, row by row; null and empty texts have none."""
    return encode(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: SQL can't express the classifier's training or the segmentation; the tests check each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between two stages the rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
