"""Command line: build an index of files, query it, answer questions, print statistics.

    python -m scriptorium.cli index FOLDER ROOT [--strategy recursive]
    python -m scriptorium.cli query ROOT sparse|dense|hybrid|reranked QUESTION...
    python -m scriptorium.cli ask ROOT QUESTION...
    python -m scriptorium.cli chunk-stats FOLDER
    python -m scriptorium.cli golden-summary FILE
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import STRATEGIES, Settings
from scriptorium.operators import evaluation, retrieval
from scriptorium.operators.chunking import chunk_documents, chunk_stats
from scriptorium.plans import pipeline, snapshot
from scriptorium.plans.session import local_session, ship
from scriptorium.providers import embedding_udf
from scriptorium.sources.files import ingest, read_golden


def _questions(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def retrieve(spark: SparkSession, root: str, channel: str, texts: list[str], settings: Settings) -> DataFrame:
    """The results of one channel for a list of questions."""
    manifest, chunks, vectors = snapshot.open_snapshot(spark, root, settings.chunk_strategy, settings)
    queries, index = _questions(spark, texts), snapshot.stored_index(spark, manifest)
    if channel == "sparse":
        return retrieval.bm25_topk(queries, k=settings.sparse_top_k, index=index)
    if channel == "dense":
        return retrieval.dense_topk(queries.select("query_id", embedding_udf()(F.col("query")).alias("vector")), vectors, settings.dense_top_k)
    if channel == "hybrid":
        return pipeline.retrieve_hybrid(queries, chunks, vectors, settings, index=index)
    return pipeline.retrieve_reranked(queries, chunks, vectors, settings, index=index).select("query_id", "chunk_id", "rank", "hybrid_rank", "reranker_score", "source_file")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | snapshot.Manifest:
    parser = argparse.ArgumentParser(prog="scriptorium", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--strategy", choices=STRATEGIES, default="recursive")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("folder")
    index.add_argument("root")
    query = commands.add_parser("query")
    query.add_argument("root")
    query.add_argument("channel", choices=("sparse", "dense", "hybrid", "reranked"))
    query.add_argument("questions", nargs="+")
    ask = commands.add_parser("ask")
    ask.add_argument("root")
    ask.add_argument("questions", nargs="+")
    commands.add_parser("chunk-stats").add_argument("folder")
    commands.add_parser("golden-summary").add_argument("file")
    given = parser.parse_args(arguments)
    settings = Settings(chunk_strategy=given.strategy)
    spark = spark or local_session()
    ship(spark)
    if given.command == "index":
        documents = ingest(spark, given.folder).where("error_class is null")
        manifest = snapshot.build(chunk_documents(documents.dropDuplicates(["document_id"]), settings), given.root, settings)
        print(manifest)
        return manifest
    if given.command == "query":
        rows = retrieve(spark, given.root, given.channel, given.questions, settings).orderBy("query_id", "rank")
    elif given.command == "ask":
        manifest, chunks, vectors = snapshot.open_snapshot(spark, given.root, settings.chunk_strategy, settings)
        rows = pipeline.answer_with_policy(_questions(spark, given.questions), chunks, vectors, settings, index=snapshot.stored_index(spark, manifest)).orderBy("answer_id")
    elif given.command == "chunk-stats":
        documents = ingest(spark, given.folder).where("error_class is null")
        parts = [chunk_stats(chunk_documents(documents, settings, strategy)) for strategy in STRATEGIES]
        rows = parts[0].union(parts[1]).union(parts[2])
    else:
        rows = evaluation.distribution(read_golden(spark, given.file)).orderBy("dimension", "value")
    rows.show(100, truncate=120)
    return rows


if __name__ == "__main__":
    main()
