"""A corpus in five stages: toxic documents go, one of each group of similar documents stays,
repeated passages are cut, personal data gets pseudonyms, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, with ``n_chars`` as it is after the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estimark.llm import ngram_join, packing, pii, suffix_dedup, toxicity
from estimark.llm.common import settled


#: Bytes of a passage that may not occur twice: fifty words of five bytes with their blanks.
PASSAGE = 250


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars, if there is such a column, as long as the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of those here, doesn't predict as
    toxic; rows that repeat an id stay or go each by its text. Without labels, or with labels of one kind
    only, the model decides by its fixed patterns. An empty table stays empty."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # the text goes to and from Python once, beside the row's other columns
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    kept = toxicity.score(rows, model, ["text", "row"]).where("predicted = 0")
    return kept.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose word 5-grams are alike (0.8 and more, by links), the one with the smallest
    id; documents without words stay."""
    return ngram_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that occur twice; a null text stays null, and a text that
    was all repeated becomes empty."""
    return counted(suffix_dedup.without_repeats(docs, PASSAGE), docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data, under the session's key."""
    return counted(pii.pseudonymise(docs, pii.key_of(spark), found=None), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 2,048 tokens."""
    return packing.packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", not_toxic), ("ngram_join", one_of_each), ("suffix_dedup", without_repeats), ("pii", pseudonyms), ("packing", packed)]

#: Learned scores, tokenisation and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
