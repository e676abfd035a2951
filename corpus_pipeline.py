"""The corpus pipeline: documents that pass language identification and quality rules, one of each group of near-duplicates, mixed
to target weights by source and packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import store, table
from pagemill.llm.langid import UND, identify_language
from pagemill.llm.mixing import mixed_documents
from pagemill.llm.neardup import without_near_duplicates
from pagemill.llm.packing import pack
from pagemill.llm.quality import quality_rules

#: A document whose best language has less posterior probability than this is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.5
#: Words that a worker keeps in the stages that look words up; fewer than the operators alone do, as workers serve all stages.
WORDS_KEPT = 300_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; those predicted und (null and empty texts and those without a letter among them), or
    with a score under LEAST_LANGUAGE_SCORE, go. Texts of any length are read whole; equal texts, as in repeated rows, fare alike;
    columns of any name are kept; an empty table stays empty."""
    found = identify_language(docs, carry=True, cache=WORDS_KEPT)
    return found.where((found["lang_pred"] != UND) & (found["score"] >= LEAST_LANGUAGE_SCORE)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null, empty and short texts go. Texts of any length are read whole, equal ones fare
    alike, columns of any name are kept, and an empty table stays empty; without labels the base rules decide alone."""
    return quality_rules(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more. That of the smallest
    doc_id stays (nulls last; ties by a digest of the text), one of repeated rows, and one for each doc_id of texts without a
    word. Columns of any name are kept; an empty table stays empty."""
    return without_near_duplicates(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, by training position: a row for each use of a document, none for those not used. A null source is one of
    its own; texts without a word (null, empty) are never used; repeated rows count as often as they are there. Columns of any
    name are kept, text and n_chars of the one document a source that is cut are those of what is used. An empty table stays
    empty."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces in sequences of 4096 tokens; which sequence a piece is in follows from lengths, not from its
    training position. Null and empty texts are an end token, long ones are cut, repeated rows are packed again, further columns
    are dropped, an empty table gives no rows."""
    return pack(docs, cache=WORDS_KEPT)


STAGES = [("language_id", language_id), ("quality_rules", quality), ("near_dedup", near_dedup), ("mix_sources", mix), ("pack", packing)]
#: Learned models and tokenizers have no SQL. Tests hold the rows of every stage and of run() against brute force on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each but the last stored. Nulls, empty and long texts, ties, repeated rows, clashing
    names and an empty table fare as the stages say."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
