"""The corpus pipeline: from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs. All stages but the last return the columns of documents.

- quality: rows rejected by the base rules or the language's perplexity bands go.
- near_dedup: of each class of near copies the row with the least id stays.
- decontaminate: rows that hold a benchmark item go.
- mix: rows are taken 0, 1 or 2 times, so that sources meet their target weights; a row taken twice is
  there twice.
- tokens: the rows' token files are written and read back; doc_id, start, n_tokens, ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracksift.llm import decontaminate, mixing, near_dup, quality, token_file
from tracksift.llm.queries import tokenizer_path
from tracksift.session import cut, drop, scratch_paths, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_file.encode_documents(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("mix", mix_stage), ("tokens", token_stage)]

#: Consistent sampling, the language model and the tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all of documents; a stage's intermediate tables go when its rows are written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = scratch_paths()
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        made = [p for p in scratch_paths() if p not in before]
        drop(spark, *made[:-1], *([last] if last else []))
        last = made[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
