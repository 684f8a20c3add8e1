"""Documents to training sequences: five stages, each over all that the one before kept.

language ID drops documents without a letter and corrects ``lang`` where it is sure; MinHash leaves one document of each group of
near-duplicates (similarity NEAR_PERCENT or more); PII masks personal data; mixing draws documents to the sources' target
weights, some twice; packing lays the token pieces out in sequences.

Very long texts are read whole by every stage: in slices by the first two, by prefixes in blocks by the third, as numbers by the fourth, and
cut into pieces of a sequence's length only by the last.

What a stage wrote beside its result, and the result of the stage before it, is deleted once its own result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import langid, minhash, mixing, packing, pii
from millrace.session import remove, scratch, stored_at, table

#: Contracts of single queries, as op9's 85, don't bind the stage.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null and empty texts and those without a letter; repeated rows stay or go together; an empty table gives no
    rows; columns stay as they are, but for ``lang`` where the prediction is sure or it is null."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the least doc_id stays (null last), of ties the least by text hash and columns; null texts and texts
    without words are alike to nothing and stay; an empty table gives no rows; columns stay as they are."""
    return minhash.keep_one(docs, percent=NEAR_PERCENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; null texts stay null and empty ones empty; repeated rows get equal texts; an empty table gives no rows;
    columns stay as they are, but for ``text`` and ``n_chars``."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come not at all, once or twice; null texts have no words and null sources are one source; repeated rows are drawn each for
    itself; ties go by doc_id and hashes; an empty table gives no rows; columns stay as they are."""
    return mixing.expand(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece; null and empty texts are an end id alone; repeated rows are packed each for itself; ties go by
    doc_id and piece; an empty table gives no rows; the columns are packing's own."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained network and a tokenizer take part; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = stored_at(stage(spark, docs, sf_dir), "stage")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
