"""From raw documents to packed sequences: classify, drop near copies, cut repeats, hide personal data, pack.

Every stage takes all rows its predecessor kept. ``run`` writes each stage's rows to the shared folder
and goes on from the files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm import jaccard_join, packing, quality, substring_dedup, surrogates
from lodestat.llm.repeats import row_keys
from lodestat.sources.files import stored

#: The stages can't be expressed in SQL; tests/llm compares the whole run with a plain computation.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns of documents with the keys of a row."""
    return docs.withColumns(row_keys())


def _with_text(docs: DataFrame) -> DataFrame:
    """The number of characters follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    kept = quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("_doc", "_row").distinct()
    return _keyed(docs).join(kept, ["_doc", "_row"], "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    rows, _ = jaccard_join.jaccard_join(docs, k=5, percent=80)
    kept = rows.where("kept").select("_doc", "_row").distinct()
    return _keyed(docs).join(kept, ["_doc", "_row"], "left_semi").dropDuplicates(["_doc", "_row"]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words that repeat 20 words found earlier."""
    return _with_text(substring_dedup.cleaned(docs))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by surrogates."""
    return _with_text(surrogates.replace(docs).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", drop_near_copies), ("substring dedup", cut_repeats),
          ("PII surrogates", hide_personal_data), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
