"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
All but the last return the columns of documents:

1. language ID: documents in no learned language go;
2. n-gram Jaccard join: one document of each group of near-duplicates stays;
3. suffix dedup: stretches of 50 words or more that occur more than once go from the text, whatever their length in bytes;
4. personal data: each span is replaced by its kind;
5. best-fit packing: one row per piece, with its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import jaccard, language, packing, pii, suffixes
from palimpsest.llm.common import read_table, scratch, written
from palimpsest.llm.queries import tokenizer_path

#: Words of the shortest stretch that suffix dedup takes. A rule of bytes would miss passages of short words: of those of over 50
#: words that documents of sf0.1 share, nearly half have less than 400 bytes, the shortest 155.
PASSAGE_WORDS = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_languages(docs, language.fit(docs.where(~language.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each_group(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(docs, PASSAGE_WORDS * suffixes.WORD, words=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Byte-pair encoding and packing are beyond SQL; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, every stage applied in turn to the whole table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, kept=True)
    return docs
