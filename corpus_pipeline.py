"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, folder of tables) and returns the rows it keeps; all but the
last return the columns of ``documents``. ``run`` writes every stage's rows to the shared
folder and reads them back as the next one's input, so a lost executor repeats one stage at
most; a stage's other tables go with its end. Every stage works on all rows of its input; an
empty input gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbook.llm import bpe, decontamination, line_dedup, quality, resemblance, simhash
from trialbook.session import scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that stand on too many pages of their source; n_chars follows."""
    found = line_dedup.drop_boilerplate(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: similarity of the
    five-word shingles of at least 0.8."""
    return simhash.keep_one(docs, similarity=resemblance.SIMILARITY)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids and n_tokens, less the text, which the ids decode to."""
    coded = bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long")).drop("text")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding", token_ids),
]

#: SQL can express neither the fitted classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return docs
