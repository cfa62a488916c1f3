"""Corpus pipeline over documents: stages are (name, function of session, documents, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import bpe_automaton, dart_minhash, line_dedup, quality_qda, winnow
from sheafwork.llm.common import unbounded, written
from sheafwork.llm.queries import TOKENIZER, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go; rows without doc_id stay. Rows that repeat a doc_id go if one of them is
    rejected; an empty table stays empty."""
    found = quality_qda.score_documents(docs, table(spark, folder, "labels"))
    return docs.join(unbounded(found.where("predicted = 0").select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts keep a repeated line in the smallest doc_id only; n_chars follows the text. Rows that repeat a doc_id count as one
    document, rows without doc_id keep all lines, and an empty table stays empty."""
    names = docs.columns
    docs = docs.toDF(*[f"own_{c}" if c in line_dedup.ADDED else c for c in names])  # columns of documents stay, whatever their names
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("text", F.col("kept")).withColumn(
        "n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType)).select(*docs.columns).toDF(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The smallest doc_id of each class of near copies stays; so do rows without doc_id.

    Copies whose lines all went in the stage before are equal texts without words: one of each such text stays too. An empty
    table stays empty, and rows that repeat a doc_id go or stay together.
    """
    found = dart_minhash.near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    gone = found.unionByName(dart_minhash.wordless_copies(docs))
    return docs.join(unbounded(gone), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; rows without doc_id stay. Rows that repeat a doc_id go if one of them
    holds it; an empty table stays empty."""
    found = winnow.decontaminate(docs, table(spark, folder, "benchmark"))
    return docs.join(unbounded(found.where("n_hit > 0").select("doc_id")), "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The kept documents with n_tokens, ids and decoded text, row by row: null and empty texts have no tokens, repeated rows and
    rows without doc_id are encoded like any other, and an empty table stays empty."""
    return bpe_automaton.encode_documents(docs, TOKENIZER)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: The classifier, near-duplicate and encoding stages have no SQL counterpart; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = written(docs, "pipeline")
    return docs
