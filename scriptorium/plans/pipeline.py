"""Composed queries: hybrid retrieval, reranking, answering, verification, scoring, policy.

Each stage runs once; a stage's errors stop the chain in strict mode and never lead to a silent fallback
on one channel. The models of the chain are ``Providers``: any of them can be replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULTS, Settings
from scriptorium.errors import GenerationError, RetrievalError, raise_for_errors
from scriptorium.operators import answers as A
from scriptorium.operators import retrieval as R
from scriptorium.plans.session import discard, materialize, release
from scriptorium.providers import embedding_udf, extractive_answer, hash_embeddings, lexical_verdict, overlap_score


@dataclass(frozen=True)
class Providers:
    """The models of the chains, deterministic ones unless others are given.

    ``embed``: list of texts to list of vectors. ``rerank``: columns (query, text) to a score, such as
    ``providers.rerank_udf`` of a pair scorer. ``generate``: columns (question, evidence entries) to an
    answer. ``judge``: columns (answer, evidence text) to a struct ``verdict, rationale``.
    """

    embed: Callable[[list[str]], list[list[float]]] = hash_embeddings
    rerank: Callable[[Column, Column], Column] = overlap_score
    generate: Callable[[Column, Column], Column] = lambda question, evidence: extractive_answer(evidence)
    judge: Callable[[Column, Column], Column] = lambda answer, evidence: F.struct(lexical_verdict(answer, evidence).alias("verdict"), F.lit("share of common tokens").alias("rationale"))


DETERMINISTIC = Providers()


def _require_provenance(dense: DataFrame, sparse: DataFrame, vectors: DataFrame, chunks: DataFrame) -> None:
    """A chunk in both lists of a query must be the same chunk in both tables. The tables are compared once
    for each chunk, by a digest, not once for each hit."""
    shared = [c for c in R.SHARED if c in vectors.columns and c in chunks.columns]
    if not shared:
        return
    digest = lambda name: F.unhex(F.sha2(F.to_json(F.struct(*shared)), 256)).alias(name)
    both = vectors.select("chunk_id", digest("a")).join(chunks.select("chunk_id", digest("b")), "chunk_id")
    differing = materialize(both.where("a <> b").select("chunk_id").distinct(), "differing")
    if not differing.isEmpty():
        hits = dense.select("query_id", "chunk_id").join(sparse.select("query_id", "chunk_id"), ["query_id", "chunk_id"]).join(differing, "chunk_id")
        raise_for_errors(hits.withColumn("error_class", F.lit("provenance_mismatch")), "retrieval")
    discard(differing)


def retrieve_hybrid(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS, k: int | None = None, providers: Providers = DETERMINISTIC, index: R.SparseIndex | None = None
) -> DataFrame:
    """Both channels, checked, fused. Queries without a token are refused before anything is embedded.
    ``index`` is the stored sparse index of a snapshot; vectors that carry their chunks' provenance are
    held against the chunk table in the fusion."""
    raise_for_errors(R.query_problems(queries), "retrieval")
    embed = embedding_udf(providers.embed)
    asked = materialize(queries.select("query_id", "query", embed(F.col("query")).alias("vector")), "queries")
    raise_for_errors(R.width_problems(asked, vectors), "retrieval")
    k = settings.hybrid_top_k if k is None else k
    dense = materialize(R.dense_topk(asked, vectors, max(k, settings.dense_top_k)), "dense")
    sparse = materialize(R.bm25_topk(queries, chunks, max(k, settings.sparse_top_k), index), "sparse")
    raise_for_errors(R.hit_problems(dense), "retrieval")
    for hits in (dense, sparse):
        raise_for_errors(R.ranking_problems(hits), "retrieval")
    _require_provenance(dense, sparse, vectors, chunks)
    if index is not None:  # hits of a stored index that the chunk table lacks
        sparse = sparse.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    fused = materialize(R.rrf(dense, sparse, settings, k), "fused")
    discard(asked, dense, *([sparse] if index is None else []))
    release(queries.sparkSession)
    return fused


def retrieve_reranked(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS, top_k: int | None = None, providers: Providers = DETERMINISTIC, index: R.SparseIndex | None = None
) -> DataFrame:
    """Hybrid candidates at ``rerank_candidate_k``, reordered by the reranker, cut to the final k."""
    top_k = settings.rerank_top_k if top_k is None else R.require_top_k(top_k)
    if top_k > settings.rerank_candidate_k:
        raise RetrievalError("the final k must not exceed the candidates")
    fused = retrieve_hybrid(queries, chunks, vectors, settings, settings.rerank_candidate_k, providers, index)
    # scores without the texts they are made of: neither these nor the model are there once more
    texts = R.hydrate(fused.join(queries.select("query_id", "query"), "query_id"), chunks)
    scored = materialize(texts.select(*fused.columns, "error_class", providers.rerank(F.col("query"), F.col("text")).alias("own_score")), "candidates")
    raise_for_errors(scored, "retrieval")
    best = materialize(R.rerank(scored.drop("error_class"), F.col("own_score"), top_k).drop("own_score"), "best")
    raise_for_errors(best, "retrieval", "rerank_error")
    discard(fused, scored)
    release(queries.sparkSession)
    ranked = R.hydrate(best.join(queries.select("query_id", "query"), "query_id"), chunks).drop("error_class")
    return materialize(ranked, "reranked")


def generate(queries: DataFrame, reranked: DataFrame, providers: Providers = DETERMINISTIC) -> tuple[DataFrame, DataFrame]:
    """``(answers, evidence)``: one grounded answer for each query, also for those without evidence.
    Blank answers and citations of what is not there are errors."""
    evidence = A.build_evidence(reranked).join(reranked.select(F.col("query_id").alias("answer_id"), "chunk_id", "dense_rank", "sparse_rank"), ["answer_id", "chunk_id"])
    evidence = materialize(evidence, "evidence")
    release(queries.sparkSession)
    raise_for_errors(A.evidence_problems(evidence), "generation")
    entry = F.struct("citation_number", "text", "chunk_id", "source_file")
    given = evidence.groupBy("answer_id").agg(F.array_sort(F.collect_list(entry)).alias("evidence"))  # top-k entries
    rows = queries.select(F.col("query_id").alias("answer_id"), F.col("query").alias("question")).join(given, "answer_id", "left")
    answers = rows.select("answer_id", "question", providers.generate(F.col("question"), F.col("evidence")).alias("answer_text"), F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence_count"))
    answers = materialize(answers, "answers")
    release(queries.sparkSession)
    raise_for_errors(A.answer_problems(answers, F.col("evidence_count")), "generation")
    return answers, evidence


def verify(answers: DataFrame, evidence: DataFrame, providers: Providers = DETERMINISTIC) -> DataFrame:
    """A verdict for each citation, with its chunk; answers without citations never reach the judge, and
    the judge's output is checked."""
    marks = A.occurrences(answers)
    texts = evidence.select("answer_id", "citation_number", F.col("text").alias("evidence_text"))
    rows = A.resolve_citations(marks, evidence).join(answers.select("answer_id", "answer_text"), "answer_id").join(texts, ["answer_id", "citation_number"], "left")
    judged = rows.withColumn("j", providers.judge(F.col("answer_text"), F.coalesce("evidence_text", F.lit(""))))
    verdicts = materialize(judged.select("answer_id", "occurrence_id", "citation_number", "chunk_id", "j.verdict", "j.rationale"), "verdicts")
    raise_for_errors(A.judge_problems(marks, verdicts), "generation")
    return verdicts


# -- entry points: each stage once -------------------------------------------------------------------


@dataclass(frozen=True)
class Chain:
    """What the stages of a chain gave; stages that did not run are None."""

    reranked: DataFrame
    answers: DataFrame
    evidence: DataFrame
    verdicts: DataFrame | None = None
    scored: DataFrame | None = None


def retrieve_and_generate(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS, providers: Providers = DETERMINISTIC, index: R.SparseIndex | None = None) -> Chain:
    """Retrieval, reranking and an answer for each query."""
    reranked = retrieve_reranked(queries, chunks, vectors, settings, None, providers, index)
    return Chain(reranked, *generate(queries, reranked, providers))


def retrieve_generate_and_verify(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS, providers: Providers = DETERMINISTIC, index: R.SparseIndex | None = None) -> Chain:
    """The same with a verdict for each citation."""
    done = retrieve_and_generate(queries, chunks, vectors, settings, providers, index)
    return Chain(done.reranked, done.answers, done.evidence, verify(done.answers, done.evidence, providers))


def retrieve_generate_verify_and_score(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS, providers: Providers = DETERMINISTIC, index: R.SparseIndex | None = None) -> Chain:
    """The same with a confidence for each answer, after the report's integrity was checked."""
    done = retrieve_generate_and_verify(queries, chunks, vectors, settings, providers, index)
    raise_for_errors(A.confidence_problems(done.answers, done.verdicts, done.evidence), "generation")
    scored = materialize(A.confidence(done.answers, done.verdicts, done.evidence, settings), "scored")
    return Chain(done.reranked, done.answers, done.evidence, done.verdicts, scored)


def answer_with_policy(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS, providers: Providers = DETERMINISTIC, index: R.SparseIndex | None = None) -> DataFrame:
    """The whole chain: ``answer_id, answer_text, decision, abstained, abstention_reason, score``."""
    done = retrieve_generate_verify_and_score(queries, chunks, vectors, settings, providers, index)
    if not A.policy_problems(done.scored, A.tallies(done.answers, done.verdicts)).where("error_class <> 'bad_score'").isEmpty():
        raise GenerationError("generation: policy_input")
    return A.final_answers(done.answers, A.decide(done.scored, settings)).join(done.scored.select("answer_id", "score"), "answer_id")

