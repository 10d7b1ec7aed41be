"""The corpus pipeline: quality rules, near-duplicate removal, repeated-passage removal, mixing and packing.

STAGES are (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs; all but the last return the columns of documents.

Defined results, of every stage: a null id is an id that equals no other, a null source is a source of its own, other columns may be
null, clash in name with an operator's own, and pass through. Of empty tables come empty tables. What ties or repeats is said
at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.llm import harmonic_packing, minhash_tensor, mixing, quality_rules, suffix_dedup
from cleargrain.llm.shared import read_table, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and short texts (under 20 words) are rejected. Repeated rows are judged alike."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8): the one of the smallest id.

    Texts without words are linked with nothing and stay, as do rows with a null id. Rows that share an id are one document
    and stay or go together.
    """
    return minhash_tensor.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that strings of 200 bytes repeat anywhere in the corpus; n_chars is that of the new text.

    All occurrences go, so of repeated rows nothing is left. A null text stays null, with n_chars null.
    """
    return _counted(suffix_dedup.without_repeats(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; words taken twice make a second row of the same id.

    Texts without words are never taken. Repeated rows each take their place.
    """
    return _counted(mixing.mixed_rows(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences of 2048 tokens; a null or empty text is its end token. Repeated rows are packed once each."""
    return harmonic_packing.digests(harmonic_packing.packed(docs, harmonic_packing.word_bpe()))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packing),
]

#: Random permutations and the tokenizer have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
