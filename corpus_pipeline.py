"""From documents to token files: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cataloom.llm import decontaminate, mixing, quality_rules, simhash, token_output
from cataloom.llm.common import materialize, scratch_path, table
from cataloom.llm.queries import OUTPUT_MODEL


#: A session setting that names the folder for what the pipeline makes; without it the files go with the driver.
OUTPUT = "cataloom.output.dir"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host rules keep. Null and empty texts go, a null source is a host like others, repeated rows stay; an empty table gives none."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest id. Rows without an id stay, rows of one id stay or go together; null texts are empty ones."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay; without benchmark items all do."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, output shard after output shard, shuffled inside each. Null texts have no words, a null source is the last one."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write ORC files of token ids in the mix's order and return each row's place and checksum, read from them.

    Null texts give the end id alone; an empty table gives no rows.
    """
    kept = spark.conf.get(OUTPUT, None)
    folder = f"{kept.rstrip('/')}/tokens-{uuid.uuid4().hex}" if kept else scratch_path(spark, "pipeline-tokens")
    token_output.write_tokens(docs, folder, public_tokenizers.path(OUTPUT_MODEL), keep_order=True)
    return token_output.token_digest(spark, folder)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("token output", tokens)]

#: SQL knows neither XXH64 nor the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
