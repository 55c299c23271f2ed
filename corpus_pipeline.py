"""The corpus pipeline: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets; its result is written as
Parquet and read again in between. All stages but the last keep the columns of their input, whatever
else it has and whatever its names, find text and doc_id by exact name, give an empty table for an empty
one, and read texts whole, in time and memory that grow with a text's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import language_id, pii
from loomwright.llm.common import held_out, stored, table
from loomwright.llm.exact_dedup import drop_exact_copies
from loomwright.llm.packing import pack_documents
from loomwright.llm.queries import END_ID, SEQUENCE_TOKENS, tokenizer_file
from loomwright.llm.set_similarity import drop_near_copies

#: Shingles of five words; near copies share 0.8 of their shingles.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those whose text is null, empty or has no letter.

    Texts that are merely ambiguous, or of a tie between languages, stay, as do null ids and rows that
    repeat. Without any labelled text nothing can be told, and all rows stay.
    """
    return language_id.drop_undetermined(docs, language_id.learn(docs, ~held_out(F.col("doc_id"))))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays, null ids last.

    Null and empty texts are equal to each other. Of rows equal in text and id any one stays.
    """
    return drop_exact_copies(docs, keep="largest")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the smallest doc_id stays.

    Near duplicates share SIMILARITY of their distinct shingles of SHINGLE_WORDS words, by whole texts.
    Null and empty texts are near duplicates of each other. Rows of one id stay or go together, and rows
    with a null id stay; there are no ties else.
    """
    return drop_near_copies(docs, SHINGLE_WORDS, SIMILARITY)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, become marks; n_chars follows the text.

    No row goes. Null and empty texts, and texts without personal data, stay as they are (n_chars of a
    null text too); equal texts get equal marks. Where spans overlap the first one counts.
    """
    names = docs.columns
    clean = pii.sanitise(docs).toDF(*[f"__c{i}" for i in range(len(names))])
    text, chars = (f"__c{names.index(name)}" for name in ("text", "n_chars"))
    counted = F.when(F.col(text).isNotNull(), F.length(text).cast(clean.schema[chars].dataType)).otherwise(F.col(chars))
    return clean.withColumn(chars, counted).toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of SEQUENCE_TOKENS tokens.

    Null texts count as empty, which is one token; rows that repeat are packed each for itself, and
    pieces of equal length in the order of the rows.
    """
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), END_ID, SEQUENCE_TOKENS)


STAGES = [
    ("language", known_language),
    ("exact_dedup", no_exact_copies),
    ("near_dedup", no_near_copies),
    ("pii", no_personal_data),
    ("packing", packed),
]

#: SQL has neither the language model nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
