"""A corpus pipeline of five operators: from raw documents to packed sequences.

Each stage takes what its predecessor kept, written as Parquet and read again:

1. toxicity - documents that the grammar rejects go;
2. n-gram Jaccard join - of each group of near duplicates (five-word shingles, Jaccard
   similarity 0.8) one document stays;
3. benchmark decontamination - contaminated documents go, shorter passages are cut out;
4. PII - validated numbers, dates, addresses and secrets become pseudonyms;
5. best-fit packing - documents become pieces of sequences.

Edge cases, for each stage: null and empty texts are clean, have no partner and no
personal data, stay to the end and become one piece of one id; very long texts are read
whole; of texts that tie (equal sets of shingles) the one with the smallest id stays;
rows that repeat an id and a text become one in the join stage; rows without an id stay,
as do all columns, whatever their names; empty tables give empty tables.

Pseudonyms need the session's key (``spark.facetry.pii.key``); a session without one
gets the test key of the registered queries, which is for invented documents only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetry.llm import decontam, ngram_join, packing, pii, toxicity
from facetry.llm.queries import TEST_KEY
from facetry.session import drop_folder, settled, shared_folder
from facetry.sources.tables import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, size=5, similarity=(80, 100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_texts(docs, pii.key_of(spark, TEST_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", pseudonymise),
    ("best_fit_packing", pack),
]

#: Tokenizing and keyed permutations can't be said in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Tables between stages are in the shared folder and
    go once the result is stored there."""
    docs, folders = table(spark, sf_dir, "documents"), []
    try:
        for name, stage in STAGES[:-1]:
            folders.append(shared_folder(spark, f"stage-{name}"))
            stage(spark, docs, sf_dir).write.parquet(folders[-1])
            docs = spark.read.parquet(folders[-1])
        return settled(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        for folder in folders:
            drop_folder(spark, folder)
