"""The corpus pipeline: language ID, near-dedup, mixing, tokenization.

Every stage works on all rows that its predecessor kept, written as Parquet and read again; all
but the last return the columns of ``documents``, input columns named like an operator's own
among them. Null texts and texts without a letter are rejected by language ID, so later stages
don't see them; empty tables pass through. Whole texts are read, however long. Of rows that
repeat key and text one stays; ties between documents go to the smaller key.
"""

from __future__ import annotations

import posixpath

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from forgeframe.llm import language_id, mixing, sentencepiece_bpe, simhash
from forgeframe.llm._common import Scratch, crc_mod, fresh

#: A text is in no known language if the sample of the likeliest one lacks so large a share of its letters.
STRANGE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts in none of the learned languages."""
    aside = {c: fresh(c) for c in docs.columns if c in language_id.OWN}
    found = language_id.identify(docs.withColumnsRenamed(aside), docs.filter(crc_mod("doc_id", 5) != 0))
    kept = found.filter(f"lang_pred <> 'und' and unknown < {STRANGE}").drop(*language_id.OWN)
    return kept.withColumnsRenamed({new: old for old, new in aside.items()}).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts or of texts alike in 0.8 of their five-word shingles."""
    return simhash.deduplicate(docs, words=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weights 3, 1, 2 in turn, 1.5 times all words, no source more than twice; repeats are rows."""
    return mixing.mix(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every whole text, and how many they are."""
    return sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", without_copies),
    ("mixing", mixed),
    ("sentencepiece", tokenized),
]

#: Suffix automata, SimHash groups and BPE have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(posixpath.join(sf_dir, "documents.parquet"))
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
