"""From documents to packed training sequences: five stages, each by one operator of tidemark.llm.

Stages take any columns beside doc_id and text (and lang, where quality rules are told languages apart by it), and an empty table,
which gives an empty one. Rows are kept or dropped whole; only suffix_dedup changes texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ngram_join, packing, quality_rules, suffix_dedup, toxicity
from tidemark.llm.common import checkpoint, table
from tidemark.llm.queries import BYTE_RANKS, PIECES, WORD_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labels of these documents, scores below 0.5.

    Null and empty texts have the model's score for no words; repeated rows are scored each, whatever their length; labels of
    documents that aren't there, or that say nothing, are left out. Without labels of both kinds the model is untrained and all stay.
    """
    return toxicity.without_toxic(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, the fertility bands and the floors of their language.

    Null, empty and blank texts have no words, fail the base rules and go. A null language is a language of its own; repeated rows are
    judged, and count for the floors, each.
    """
    return quality_rules.without_rejected(docs, PIECES, second=BYTE_RANKS, language="lang")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by a Jaccard similarity of 0.8 on five-word shingles.

    Null, empty and blank texts link with nothing and stay. Rows without an id take part after all others. Rows that share an id go only
    by their own text; of rows with the same id and text one stays.
    """
    return ngram_join.keep_one(docs, width=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 400-byte strings and 50-word passages that occur more than once among them; n_chars is counted anew.

    Null texts stay null and texts under 400 bytes and 50 words as they are; repeated rows lose what they share, which may be all. A
    character that loses some of its bytes goes. Passages are equal if their words are, whatever white space is between them.
    """
    kept = suffix_dedup.without_repeats(docs, words=True)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens.

    Null and empty texts are one piece, the end mark; longer texts than a sequence are cut; repeated rows are packed each.
    """
    return packing.pack(docs, WORD_BPE, size=4096, end=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: Models, tokenizers and suffix arrays are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is cut off from its lineage, as it is read several times."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
