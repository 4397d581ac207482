"""A training corpus from raw documents: quality, near-duplicates, repeated passages, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import line_crf, lsh_forest, mixing, packing, phrase_automata
from ledgerleaf.llm.common import documents, free_names
from ledgerleaf.store import materialize

#: Score from which a document is good.
GOOD = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model doesn't reject. Without labels of both kinds there is no model, and all stay.

    Defined cases: null and empty texts are one empty line and are judged as such; rows are judged each on its text, so
    repeated rows and rows without an id fare like any other; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = line_crf.train(docs, labels)
    if not (model.weights.any() or model.pairs.any()):
        return docs
    (name,) = free_names(docs, "_line_score")
    return line_crf.with_score(docs, model, name).filter(F.col(name) >= GOOD).drop(name)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least doc_id (``lsh_forest.one_of_each`` has the cases)."""
    return lsh_forest.one_of_each(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier one has; ``n_chars`` follows the text.

    Defined cases: documents without an id lose nothing; null and empty texts stay; documents that lose all their words go.
    """
    cut = phrase_automata.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as their source's target takes them; null is a source of its own."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens; a null or empty text is its end alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("substring_dedup", cut_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier. Tests compare the operators that the stages use; none runs all stages yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
