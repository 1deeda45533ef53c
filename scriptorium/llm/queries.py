"""Registered queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, history, knn, mixing, near_dups, pii, qa_defects, splitter
from scriptorium.plans.session import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded ids are the text again."""
    rows = bpe.decode_column(p6_ids(spark, sf_dir), "doc_id", "ids")
    return rows.select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.found(table(spark, sf_dir, "documents_norm"), table(spark, sf_dir, "chunks"))


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.repeated_chunks(table(spark, sf_dir, "chunks"))
    return rows.select("chunk_row", rows.similarity.cast("decimal(9,6)").cast("double").alias("similarity"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_defects.found(table(spark, sf_dir, "golden_qa"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.found(table(spark, sf_dir, "chunks"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.records(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.found(table(spark, sf_dir, "chunk_vectors"))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.neighbours(table(spark, sf_dir, "chunk_vectors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitter.found(table(spark, sf_dir, "documents_norm"))


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitter.chunk_rows(table(spark, sf_dir, "documents_norm"))


def p5_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces without what they repeat, joined again, and how the pieces lie."""
    rows = splitter.split_segments(table(spark, sf_dir, "documents_norm"), with_text=True)
    piece = lambda p, since: F.substring("text", since + 1, p["end"] - since)
    new = F.transform("pieces", lambda p, i: piece(p, F.when(i == 0, F.lit(0)).otherwise(p["start"] + splitter.OVERLAP)))
    follow = F.transform("pieces", lambda p, i: (i == 0) | (p["start"] + splitter.OVERLAP == F.element_at("pieces", F.greatest(i, F.lit(1)).cast("int"))["end"]))
    return rows.select(
        F.col("rid").alias("delivery_id"), "segment_index", F.sha2(F.array_join(new, ""), 256).alias("sha"), F.forall("pieces", lambda p: p["end"] - p["start"] <= splitter.LIMIT).alias("within"),
        F.forall(follow, lambda x: x).alias("overlap"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.select(table(spark, sf_dir, "documents"), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_matches": p1_matches,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_chunks": p5_chunks,
    "p5_joined": p5_joined,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_selection": p7_selection,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}
