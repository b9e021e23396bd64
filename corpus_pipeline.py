"""Training corpus from raw documents: language ID, near duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import common, jaccard, language, packing, secrets

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what no language explains: texts that are null, without a letter or incompressible."""
    common.tuned(spark)
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    common.tuned(spark)
    return jaccard.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks credentials that one source alone holds and that look live; every document stays."""
    common.tuned(spark)
    return secrets.mask_owned(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into windows: one row per piece, as the packing query returns them."""
    import public_tokenizers

    common.tuned(spark)
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the language models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a written table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
