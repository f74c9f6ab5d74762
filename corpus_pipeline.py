"""A training corpus from ``documents``: quality rules, near-duplicates, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of their input. A stage's result is written as Parquet in
the shared folder and read again as the next one's input, so a lost executor never reaches behind the last table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, mixing, quality_rules, simhash, token_output
from tesserae.llm.shared import new_folder, remove

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Milder than op6's: a corpus that was filtered already keeps most of its documents.
TARGETS: dict[str, dict[str, float] | float] = {"source": 0.8, "lang": 0.9, "topic": 0.95}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    judged = quality_rules.apply_rules(docs.select(F.struct("*").alias("doc"), "text"), keep=["doc"])
    return judged.where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group: that of the smallest id."""
    return simhash.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold passages of two items or more; a passage of a single one is cut out."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens by source, language and length meet the targets."""
    return mixing.mix(mixing.dimensions(docs, docs.columns), TARGETS).where("selected").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left; a row per document, read back from them."""
    return token_output.read_documents(spark, *token_output.write_tokens(docs, TOKENIZER))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: Fingerprint groups, raking and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k > 1:
                remove(f"{folder}/{k - 1}")  # its reader has been written
        docs = stage(spark, docs, sf_dir)
    remove(f"{folder}/{len(STAGES) - 1}")  # the last stage has written its files, and reads no others
    return docs
