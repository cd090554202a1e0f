"""From raw documents to a training mix, in five stages of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs; so a lost executor costs no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import decontam, langid, linededup, mixing, nearcopies
from footfall.llm.common import documents, named_as, plain, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: texts that are null, empty or without letters, or where none gets half.

    Null ids and repeated rows are judged by their texts, very long ones by all of them; of languages with
    the same score the first by name counts. Columns of any name stay, `score` and `lang_pred` too. An empty
    table gives none.
    """
    return langid.reject_unidentified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows leave the texts; all documents stay, and n_chars follows.

    Nulls, empty and short texts stay as they are, very long ones are read whole, and rows that agree in
    id and text are changed alike. The first occurrence is that of the smallest id, then the first place.
    Columns of any name stay, and an empty table gives none.
    """
    same = ("doc_id", "text", "n_chars")
    out = linededup.drop_repeated_lines(plain(docs, *same))
    length = F.when(F.col("lines removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return named_as(out.withColumn("n_chars", length), docs, *same)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; null ids come last.

    Rows that share an id are told apart by their texts, and those that agree in both are one. Null and
    empty texts are copies of each other, and very long ones are compared by all their shingles. Of rows
    with one id the text with the smaller hash stays. Columns of any name stay. An empty table gives none.
    """
    return nearcopies.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, each row by its own text whatever its id.

    Null and empty texts stay, very long ones are searched whole, and rows that agree in id and text stay or go
    together. Columns of any name stay; an empty table gives none, and an empty benchmark keeps all.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its text and the words that the mix takes of it: 0, its size, or twice that.

    Null and empty texts have size 0 and stay with 0 taken; null ids and sources are in their groups, very long
    texts count in full, and of documents of one size a seeded hash of the row decides. Other columns than those
    named go; an empty table gives none.
    """
    return mixing.mix(docs, keep=("text", "lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Near copies and naive Bayes have no SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
