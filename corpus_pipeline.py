"""From raw documents to token ids: quality, near copies, benchmark passages, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it back as the next stage's documents. All stages but the last return the columns of the documents.
"""
from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from roamlog.llm import bpe, decontaminate, minhash, quality, secrets
from roamlog.llm.common import table
from roamlog.session import delete_paths, stage_root, staged_count, take_staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the stage before, no longer read once the next one begins.
_BEFORE: list[str] = []


def _tidy(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_paths(spark, _BEFORE)
        _BEFORE.clear()
        before = staged_count()
        out = stage(spark, docs, sf_dir)
        _BEFORE.extend(take_staged(before))
        return out

    return run_stage


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return minhash.keep_one_each(docs, width=5, percent=80)


@_tidy
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@_tidy
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and ``n_chars`` follows; every document stays."""
    return secrets.redact(docs)


@_tidy
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "lang", "source", "text"])
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination), ("secret_scan", secret_scan), ("bpe_encoding", bpe_encoding),
]
#: A forest, signatures and a tokenizer decide rows and columns here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), f"{stage_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        if k:
            delete_paths(spark, [f"{root}/{k - 1}-{STAGES[k - 1][0]}"])
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
