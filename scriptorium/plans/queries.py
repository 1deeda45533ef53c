"""Registered queries of the retrieval and evaluation operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions import vectors as V
from scriptorium.operators import answers as A
from scriptorium.operators import chunking as C
from scriptorium.operators import corpus as D
from scriptorium.operators import evaluation as E
from scriptorium.operators import retrieval as R
from scriptorium.plans import snapshot as S
from scriptorium.plans.session import materialize, spread, table
from scriptorium.sources.files import discover
from scriptorium.streaming.ingest import event_counts

Query = Callable[[SparkSession, str], DataFrame]
NEAR = 0.30  # the embeddings of the test tables are never nearer than about 0.6


# -- shared inputs ---------------------------------------------------------------------------------


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return D.clean_chunks(table(spark, d, "chunks"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "golden_qa").where("id is not null and question is not null")
    return rows.groupBy(F.col("id").alias("query_id")).agg(F.min("question").alias("query"))


def probe_queries(spark: SparkSession) -> DataFrame:
    """Queries with few or no matches; they show the zero-score fill."""
    rows = [("absent", "qqzzxx vvkkjj"), ("common", "the the and"), ("mixed", "ERR_TLS_5164 qqzzxx"), ("rare", "cascusson")]
    return spark.createDataFrame(rows, "query_id string, query string")


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk_vectors")
    good = V.is_valid(V.as_double(F.col("embedding"))) & (F.size("embedding") == 64)
    return rows.where(good).select("vec_id", "chunk_id", V.as_double(F.col("embedding")).alias("vector"))


def earlier_hits(spark: SparkSession, d: str) -> DataFrame:
    """The earlier run as a ranking: rows that repeat once, ranks given anew by the earlier ranks."""
    rows = table(spark, d, "dense_hits").where("query_vec_id is not null and chunk_id is not null")
    best = rows.groupBy(F.col("query_vec_id").alias("query_id"), "chunk_id").agg(F.min("rank").alias("was"))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("was"), "chunk_id")
    return best.select("query_id", "chunk_id", F.row_number().over(order).alias("rank"))


def vector_hits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks nearest to every vector whose id is divisible by 100, by their best vector."""
    vectors = unit_vectors(spark, d)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return R.dense_topk(asked, vectors.where("chunk_id is not null").select("chunk_id", "vector"), 10).select("query_id", "chunk_id", "rank")


def made_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with citations, made of the golden answers by arithmetic that SQL can repeat."""
    rows = table(spark, d, "golden_qa").where("id is not null").groupBy("id").agg(F.min("expected_answer").alias("a"), F.min("question").alias("q"))
    n = F.length("id")
    text = F.when(F.col("a").isNull(), F.concat(F.lit("Sorry, "), F.lit(X.INSUFFICIENT_MARKER), F.lit("."))).when(n % 5 == 0, F.col("a")).otherwise(
        F.concat("a", F.lit(" ["), (n % 4 + 1).cast("string"), F.lit("] Also so ["), (F.length("a") % 7).cast("string"), F.lit("] and [1]."))
    )
    return rows.select(F.col("id").alias("answer_id"), text.alias("answer_text"), (n % 3 + 3).alias("evidence_count"))


def made_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = made_answers(spark, d).select("answer_id", F.explode(F.sequence(F.lit(1), "evidence_count")).alias("citation_number"))
    n, k = F.length("answer_id"), F.col("citation_number")
    return rows.select("answer_id", k, F.concat(F.lit("c"), ((n + k) % 11).cast("string")).alias("chunk_id"), F.when((n + k) % 3 > 0, k).alias("dense_rank"), F.when((n + k) % 4 > 0, k).alias("sparse_rank"))


def made_verdicts(spark: SparkSession, d: str) -> DataFrame:
    answers = made_answers(spark, d)
    marks = A.resolve_citations(A.occurrences(answers), made_evidence(spark, d))
    place = (F.length("answer_id") + F.col("occurrence_id") * 3 + F.col("citation_number")) % 9
    verdict = F.when(place < 5, "supported").when(place == 5, "partially_supported").when(place == 6, "unsupported").when(place == 7, "contradicted").otherwise("supported")
    return marks.where("chunk_id is not null").select("answer_id", "occurrence_id", "citation_number", "chunk_id", verdict.alias("verdict"))


def made_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.confidence(made_answers(spark, d), made_verdicts(spark, d), made_evidence(spark, d))


def golden(spark: SparkSession, d: str) -> DataFrame:
    """Golden cases, one for each id; lists and texts by their smallest value, as rows of one id agree."""
    rows = table(spark, d, "golden_qa").where("id is not null")
    kept = [c for c in rows.columns if c not in ("id", "requires_multi_document_reasoning", "authored_at")]
    return rows.groupBy("id").agg(*(F.min(c).alias(c) for c in kept), F.bool_or("requires_multi_document_reasoning").alias("requires_multi_document_reasoning"))


def made_decisions(spark: SparkSession, d: str) -> DataFrame:
    place = F.length("id") % 7
    decision = F.when(place < 4, "answered").when(place == 4, "abstained_contradiction").when(place == 5, "abstained_low_confidence").otherwise("abstained_insufficient_evidence")
    return golden(spark, d).select("id", decision.alias("decision"))


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents_norm").select("delivery_id", "segments")).select("delivery_id", F.posexplode("segments").alias("segment_index", "s"))
    return rows.select("delivery_id", "segment_index", F.col("s.text").alias("text"), F.col("s.section_heading").alias("section_heading"), F.col("s.page_number").alias("page_number"))


def digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "\x01"), 256)


# -- queries ---------------------------------------------------------------------------------------


def tokenize_docs(s: SparkSession, d: str) -> DataFrame:
    rows = spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", X.tokenize(F.col("text")).alias("t")).where("t is not null")
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), digest(F.col("t")).alias("digest"))


def term_stats_idf(s: SparkSession, d: str) -> DataFrame:
    return R.sparse_index(corpus(s, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return R.bm25_topk(questions(s, d), materialize(corpus(s, d), "corpus"))


def bm25_zero_fill(s: SparkSession, d: str) -> DataFrame:
    return R.bm25_topk(probe_queries(s), materialize(corpus(s, d), "corpus"))


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    vectors = unit_vectors(s, d)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return R.dense_topk(asked, vectors.select(F.col("vec_id").alias("chunk_id"), "vector")).withColumnRenamed("chunk_id", "vec_id")


def rrf_hybrid(s: SparkSession, d: str) -> DataFrame:
    return R.rrf(vector_hits(s, d), earlier_hits(s, d))


def rrf_union_sides(s: SparkSession, d: str) -> DataFrame:
    return R.channel_counts(R.rrf(vector_hits(s, d), earlier_hits(s, d), k=100))


def ranking_integrity(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "dense_hits").select(F.col("query_vec_id").alias("query_id"), "chunk_id", "rank")
    return R.ranking_problems(rows)


def provenance_mismatch(s: SparkSession, d: str) -> DataFrame:
    fields = ("document_id", "chunk_index", "source_file")
    hits = table(s, d, "dense_hits").select(F.lit(1).alias("query_id"), "chunk_id", *fields).distinct()
    return R.provenance_problems(hits, corpus(s, d).select(F.lit(1).alias("query_id"), "chunk_id", *fields), fields).select("chunk_id", F.array_join("fields", ",").alias("fields"))


def rerank_overlap(s: SparkSession, d: str) -> DataFrame:
    from scriptorium.providers import overlap_score

    chunks, asked = materialize(corpus(s, d), "corpus"), questions(s, d)
    # the texts come last and stay behind, so that only ids and scores are ranked
    hits = R.hydrate(R.bm25_topk(asked, chunks, 20).join(asked, "query_id"), chunks)
    scored = hits.select("query_id", "chunk_id", "rank", F.round(overlap_score(F.col("query"), F.col("text")), 9).alias("own_score"))
    return R.rerank(scored, F.col("own_score")).select("query_id", "chunk_id", "rank", "hybrid_rank", "reranker_score")


def hydrate_hits(s: SparkSession, d: str) -> DataFrame:
    rows = R.hydrate(earlier_hits(s, d), corpus(s, d))
    return rows.select("query_id", "chunk_id", "rank", F.sha2("text", 256).alias("text_sha"), "source_file", "section_heading", "page_number", "error_class")


def query_problems(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").select(F.col("chunk_row").alias("query_id"), F.col("text").alias("query"))
    return R.query_problems(rows)


def chunk_fixed(s: SparkSession, d: str) -> DataFrame:
    rows = segment_rows(s, d).select("delivery_id", "segment_index", F.posexplode(C.fixed_windows(F.col("text"), 1000, 200)).alias("piece", "t"))
    return rows.select("delivery_id", "segment_index", "piece", F.length("t").alias("chars"), F.sha2("t", 256).alias("sha"))


def chunk_fixed_stats(s: SparkSession, d: str) -> DataFrame:
    documents = table(s, d, "documents_norm").select(F.col("delivery_id").cast("string").alias("document_id"), "source_file", "segments")
    return C.chunk_stats(C.chunk_documents(documents, strategy="fixed"))


def chunk_table_stats(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_stats(corpus(s, d))


def chunk_recursive(s: SparkSession, d: str) -> DataFrame:
    documents = spread(table(s, d, "documents_norm").select(F.col("delivery_id").cast("string").alias("document_id"), "source_file", "segments"))
    return C.chunk_documents(documents, strategy="recursive").select("chunk_id", "document_id", "chunk_index", "character_count", "section_heading", "page_number")


def chunk_recursive_invariants(s: SparkSession, d: str) -> DataFrame:
    """For each oversized segment: packed pieces joined give the stripped text, and none is too long."""
    cut = F.udf(C.pack, "array<string>", useArrow=True)
    rows = segment_rows(s, d).where(F.length("text") > 800).select("delivery_id", "segment_index", "text", cut("text", F.lit(800)).alias("p"))
    return rows.select("delivery_id", "segment_index", F.sha2(F.array_join("p", ""), 256).alias("sha"), F.forall("p", lambda x: F.length(x) <= 800).alias("within"))


def chunk_semantic(s: SparkSession, d: str) -> DataFrame:
    documents = table(s, d, "documents_norm").select(F.col("delivery_id").cast("string").alias("document_id"), "source_file", "segments")
    return C.chunk_documents(documents, strategy="semantic").select("chunk_id", "document_id", "chunk_index", "character_count", "section_heading", "page_number")


def chunk_semantic_units(s: SparkSession, d: str) -> DataFrame:
    rows = segment_rows(s, d).where("text is not null").select("delivery_id", "segment_index", C.semantic_units(F.col("text")).alias("u"))
    return rows.select("delivery_id", "segment_index", F.size("u").alias("units"), digest(F.col("u")).alias("digest"))


def normalize_text(s: SparkSession, d: str) -> DataFrame:
    rows = segment_rows(s, d).select("delivery_id", "segment_index", X.normalize_text(F.col("text")).alias("t")).where("t is not null")
    return rows.select("delivery_id", "segment_index", F.length("t").alias("chars"), F.sha2("t", 256).alias("sha"))


def document_identity(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where("text is not null")
    return rows.select("doc_id", X.document_id(F.encode("text", "UTF-8")).alias("content_id"))


def loader_dispatch(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents_norm").groupBy(X.file_type(F.col("source_file")).alias("kind")).agg(F.count("*").alias("n"))


def discover_corpus(s: SparkSession, d: str) -> DataFrame:
    rows = discover(table(s, d, "documents_norm").where("raw_path is not null").select(F.col("raw_path").alias("path")))
    return rows.select("source_file", F.size("paths").cast("bigint").alias("paths"), "ambiguous")


def canonical_order(s: SparkSession, d: str) -> DataFrame:
    return D.canonical_positions(corpus(s, d))


def chunk_identity(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d)
    made = X.chunk_id(F.col("document_id"), F.col("chunking_strategy"), F.col("chunk_index"), F.col("text"))
    return c.select("chunk_id", made.alias("made_id"))


def corpus_validation(s: SparkSession, d: str) -> DataFrame:
    return D.corpus_problems(table(s, d, "chunks"))


def snapshot_fingerprint(s: SparkSession, d: str) -> DataFrame:
    """The fingerprint of each source file's own small snapshot (chunks of one file, in order)."""
    rows = corpus(s, d).where("source_file is not null and document_id is not null")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("document_id", "chunk_index", "chunk_id"))), lambda r: r["chunk_id"])
    return rows.groupBy("source_file", "document_id").agg(ids.alias("ids")).select("source_file", "document_id", S.fingerprint_column(F.col("ids"), "recursive", "text-embedding-3-small").alias("snapshot_id"))


def sync_check(s: SparkSession, d: str) -> DataFrame:
    return D.id_sync(corpus(s, d), table(s, d, "chunk_vectors").where("chunk_id is not null"))


def dedup_exact(s: SparkSession, d: str) -> DataFrame:
    rows = D.exact_duplicates(corpus(s, d))
    return rows.select("skipped_chunk_id", "canonical_chunk_id", "duplicate_type", "similarity")


def _embedded(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").where(V.is_valid(V.as_double(F.col("embedding"))))
    return rows.select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("text"), "embedding")


def dedup_near_pairs(s: SparkSession, d: str) -> DataFrame:
    rows = D.near_pairs(_embedded(s, d).select("pos", V.as_double(F.col("embedding")).alias("v")), NEAR)
    return rows.select("a", "b", F.round("similarity", 6).alias("similarity"))


def dedup_greedy(s: SparkSession, d: str) -> DataFrame:
    _, duplicates = D.deduplicate(_embedded(s, d), NEAR)
    return duplicates.select("pos", "target", "duplicate_type", F.round("similarity", 6).alias("similarity"))


def dedup_counts(s: SparkSession, d: str) -> DataFrame:
    return D.duplicate_counts(D.clean_duplicate_type(table(s, d, "duplicate_records")))


def vector_validation(s: SparkSession, d: str) -> DataFrame:
    return D.vector_problems(table(s, d, "chunk_vectors"))


def evidence_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = corpus(s, d).select("chunk_id", X.evidence_block(F.col("chunk_index") + 1, F.col("source_file"), F.col("section_heading"), F.col("page_number"), F.col("text")).alias("b"))
    return rows.select("chunk_id", F.length("b").alias("chars"), F.sha2("b", 256).alias("sha"))


def evidence_texts(s: SparkSession, d: str) -> DataFrame:
    """Evidence of the earlier run's hits, as one text for each query."""
    hits = R.hydrate(earlier_hits(s, d), corpus(s, d)).where("error_class is null")
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = A.evidence_text(A.build_evidence(hits.withColumn("rank", F.row_number().over(order))))
    return rows.select("answer_id", F.length("evidence").alias("chars"), F.sha2("evidence", 256).alias("sha"))


def citations_distinct(s: SparkSession, d: str) -> DataFrame:
    return made_answers(s, d).select("answer_id", F.array_join(X.citations(F.col("answer_text")).cast("array<string>"), ",").alias("cited"))


def citation_occurrences(s: SparkSession, d: str) -> DataFrame:
    return A.occurrences(made_answers(s, d))


def citation_range_errors(s: SparkSession, d: str) -> DataFrame:
    rows = A.answer_problems(made_answers(s, d), F.col("evidence_count"))
    return rows.select("answer_id", "error_class", F.array_join(F.col("offenders").cast("array<string>"), ",").alias("offenders"))


def annotate_answer(s: SparkSession, d: str) -> DataFrame:
    return made_answers(s, d).select("answer_id", X.annotate(F.col("answer_text")).alias("annotated"))


def prompts(s: SparkSession, d: str) -> DataFrame:
    rows = golden(s, d).where("question is not null")
    made = X.correctness_prompt(F.col("question"), F.coalesce("expected_facts", F.array().cast("array<string>")), F.coalesce("expected_answer", F.lit("")))
    return rows.select("id", F.sha2(X.prompt(F.col("question"), F.col("notes")), 256).alias("user_sha"), F.sha2(made, 256).alias("judge_sha"))


def judge_output_errors(s: SparkSession, d: str) -> DataFrame:
    marks = A.occurrences(made_answers(s, d))
    n, o = F.length("answer_id"), F.col("occurrence_id")
    judged = marks.where((n + o) % 8 != 0).select(
        "answer_id", F.when((n + o) % 11 == 0, o + 50).otherwise(o).alias("occurrence_id"), F.when((n + o) % 7 == 0, F.col("citation_number") + 1).otherwise(F.col("citation_number")).alias("citation_number"),
        F.when((n + o) % 5 == 0, "fine").otherwise("supported").alias("verdict"), F.when((n + o) % 9 == 0, " ").otherwise("because").alias("rationale"),
    )
    return A.judge_problems(marks, judged)


def verification_tallies(s: SparkSession, d: str) -> DataFrame:
    return A.tallies(made_answers(s, d), made_verdicts(s, d))


def confidence_score(s: SparkSession, d: str) -> DataFrame:
    return made_scores(s, d)


def abstention_decision(s: SparkSession, d: str) -> DataFrame:
    return A.decide(made_scores(s, d)).select("answer_id", "decision", "abstained")


def final_answers(s: SparkSession, d: str) -> DataFrame:
    rows = A.final_answers(made_answers(s, d), A.decide(made_scores(s, d)))
    return rows.select("answer_id", "decision", F.sha2("answer_text", 256).alias("text_sha"), "abstention_reason")


def policy_integrity(s: SparkSession, d: str) -> DataFrame:
    scored = made_scores(s, d).withColumn("supported_count", F.col("supported_count") + (F.length("answer_id") % 10 == 0).cast("int"))
    return A.policy_problems(scored, A.tallies(made_answers(s, d), made_verdicts(s, d)))


def insufficiency_flag(s: SparkSession, d: str) -> DataFrame:
    return made_answers(s, d).select("answer_id", X.is_insufficient(F.col("answer_text")).alias("insufficient"))


def evidence_numbering(s: SparkSession, d: str) -> DataFrame:
    rows = made_evidence(s, d).where((F.length("answer_id") + F.col("citation_number")) % 13 != 0)
    return A.evidence_problems(rows)


def eval_retrieval_at_k(s: SparkSession, d: str) -> DataFrame:
    chunks = materialize(corpus(s, d), "corpus")
    results = R.hydrate(R.bm25_topk(questions(s, d), chunks), chunks).select("query_id", "rank", "source_file", "text")
    return E.retrieval_metrics(golden(s, d), results, 5)


def eval_correctness(s: SparkSession, d: str) -> DataFrame:
    rows = golden(s, d).where("expected_facts is not null").select("id", F.posexplode("expected_facts").alias("i", "f"))
    place = (F.length("id") + F.col("i") * 2) % 6
    verdict = F.when(place < 3, "correct").when(place == 3, "partially_correct").when(place == 4, "missing").otherwise("contradicted")
    verdicts = rows.select("id", (F.col("i") + 1).alias("fact_id"), verdict.alias("verdict"))
    return E.correctness(golden(s, d), made_decisions(s, d), verdicts)


def eval_faithfulness(s: SparkSession, d: str) -> DataFrame:
    rows = golden(s, d).select("id", F.explode(F.sequence(F.lit(1), F.length("id") % 4 + 1)).alias("claim_id")).where((F.length("id") + F.col("claim_id")) % 17 != 0)
    place = (F.length("id") + F.col("claim_id")) % 5
    verdict = F.when(place < 2, "supported").when(place == 2, "partially_supported").when(place == 3, "unsupported").otherwise("contradicted")
    return E.faithfulness(made_decisions(s, d), rows.select("id", "claim_id", verdict.alias("verdict")))


def eval_citations(s: SparkSession, d: str) -> DataFrame:
    rows = golden(s, d).select("id", F.explode(F.array_union(F.coalesce("expected_source_files", F.array().cast("array<string>")), F.array(F.lit("other.md")))).alias("source_file"))
    place = (F.length("id") + F.length("source_file")) % 4
    verdict = F.when(place < 2, "supported").when(place == 2, "partially_supported").otherwise("unsupported")
    return E.citation_metrics(golden(s, d), made_decisions(s, d), rows.where((F.length("id") + F.length("source_file")) % 5 != 0).select("id", "source_file", verdict.alias("verdict")))


def eval_abstention_cases(s: SparkSession, d: str) -> DataFrame:
    return E.abstention_cases(golden(s, d), made_decisions(s, d))


def eval_abstention_rates(s: SparkSession, d: str) -> DataFrame:
    return E.abstention_rates(E.abstention_cases(golden(s, d), made_decisions(s, d)))


def golden_problems(s: SparkSession, d: str) -> DataFrame:
    return E.golden_problems(golden(s, d))


def golden_distribution(s: SparkSession, d: str) -> DataFrame:
    return E.distribution(golden(s, d))


def golden_report(s: SparkSession, d: str) -> DataFrame:
    return E.dataset_report(table(s, d, "golden_qa"), table(s, d, "documents"))


def event_windows(s: SparkSession, d: str) -> DataFrame:
    rows = event_counts(table(s, d, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("value", 4).alias("value"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        tokenize_docs, term_stats_idf, bm25_topk, bm25_zero_fill, dense_topk, rrf_hybrid, rrf_union_sides, ranking_integrity, provenance_mismatch, rerank_overlap, hydrate_hits, query_problems,
        chunk_fixed, chunk_fixed_stats, chunk_table_stats, chunk_recursive, chunk_recursive_invariants, chunk_semantic, chunk_semantic_units, normalize_text, document_identity, loader_dispatch,
        discover_corpus, canonical_order, chunk_identity, corpus_validation, snapshot_fingerprint, sync_check, dedup_exact, dedup_near_pairs, dedup_greedy, dedup_counts, vector_validation,
        evidence_blocks, evidence_texts, citations_distinct, citation_occurrences, citation_range_errors, annotate_answer, prompts, judge_output_errors, verification_tallies, confidence_score,
        abstention_decision, final_answers, policy_integrity, insufficiency_flag, evidence_numbering, eval_retrieval_at_k, eval_correctness, eval_faithfulness, eval_citations, eval_abstention_cases,
        eval_abstention_rates, golden_problems, golden_distribution, golden_report, event_windows,
    )
}
