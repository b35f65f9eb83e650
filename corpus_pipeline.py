"""Training-data pipeline over documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows it is given, and returns a DataFrame; its
result is written as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. Labels are read from sf_dir. No SQL can express the classifier.

Nulls and empty texts follow each operator's docstring; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import scratch
from lodestone.sources import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those whose quality score is below 0.7."""
    from lodestone.llm.quality_net import accepted, fit

    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id."""
    from lodestone.llm.neardup import deduplicated

    return deduplicated(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows."""
    from lodestone.llm.secrets import redacted

    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document comes as often as the mix takes it."""
    from lodestone.llm.mixing import mixed

    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes that they decode to."""
    import public_tokenizers
    from lodestone.llm.bpe import encode

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = scratch(docs, f"stage{n}")
    return docs
