"""Registered queries of sources, snapshots, providers and composed chains, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import answers as A
from scriptorium.operators import chunking as C
from scriptorium.operators import corpus as D
from scriptorium.operators import retrieval as R
from scriptorium.plans import pipeline as P
from scriptorium.plans import snapshot as S
from scriptorium.plans.session import materialize, new_dir, spread, table
from scriptorium.providers import embedding_udf, rerank_udf
from scriptorium.sources import files as I

# -- shared inputs ---------------------------------------------------------------------------------


def corpus(s: SparkSession, d: str) -> DataFrame:
    return D.clean_chunks(table(s, d, "chunks"))


def one_strategy(s: SparkSession, d: str) -> DataFrame:
    """A corpus that an index takes: one strategy, every document and place once."""
    rows = corpus(s, d).where("chunking_strategy = 'recursive' and document_id is not null and chunk_index is not null and source_file is not null")
    first = F.row_number().over(Window.partitionBy("document_id", "chunk_index").orderBy("chunk_id"))
    return rows.withColumn("place", first).where("place = 1").drop("place")


def questions(s: SparkSession, d: str) -> DataFrame:
    """Questions with a token, one for each id."""
    rows = table(s, d, "golden_qa").where("id is not null and question is not null").groupBy(F.col("id").alias("query_id")).agg(F.min("question").alias("query"))
    return rows.where(F.size(X.tokenize(F.col("query"))) > 0)


def hashed(chunks: DataFrame) -> DataFrame:
    """Vectors of the deterministic provider, with their chunks' provenance, as a snapshot stores them."""
    known = ("text", *(c for c in R.SHARED if c != "text"))
    return chunks.select("chunk_id", *known, embedding_udf()(F.col("text")).alias("vector"))


def plain(text: Column) -> Column:
    """Letters, digits and single blanks only."""
    return F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))


def made_files(s: SparkSession, d: str, kind: str) -> DataFrame:
    """Files ``(path, content)``: a heading and a paragraph made of each golden case, of one type."""
    rows = table(s, d, "golden_qa").where("id is not null and question is not null").groupBy("id").agg(F.min("question").alias("q"))
    head, body = F.concat(F.lit("Case "), plain(F.col("id"))), plain(F.col("q"))
    forms = {
        "txt": F.concat(head, F.lit("\r\n\r\n\r\n\r\n"), body, F.lit("  \r\n")),
        "md": F.concat(F.lit("# "), head, F.lit("\n\n*"), body, F.lit("*\n\n## Part\n\nend\n")),
        "html": F.concat(F.lit("<html><head><title>x</title></head><body><h1>"), head, F.lit("</h1><p>"), body, F.lit("</p><script>no()</script><h2>Part</h2><p>end &amp; more</p></body></html>")),
    }
    return spread(rows.select(F.concat(F.lit("/made/"), plain(F.col("id")), F.lit(f".{kind}")).alias("path"), F.encode(forms[kind], "UTF-8").alias("content")))


def segment_table(documents: DataFrame) -> DataFrame:
    rows = documents.select("source_file", "file_type", "error_class", F.posexplode("segments").alias("n", "s"))
    return rows.select("source_file", "file_type", "n", F.col("s.text").alias("text"), F.col("s.section_heading").alias("section_heading"), F.col("s.page_number").alias("page_number"), "error_class")


# -- sources ---------------------------------------------------------------------------------------


def parse_text_files(s: SparkSession, d: str) -> DataFrame:
    return segment_table(I.parse_files(made_files(s, d, "txt")))


def parse_markdown_files(s: SparkSession, d: str) -> DataFrame:
    return segment_table(I.parse_files(made_files(s, d, "md")))


def parse_html_files(s: SparkSession, d: str) -> DataFrame:
    return segment_table(I.parse_files(made_files(s, d, "html")))


def ingest_documents(s: SparkSession, d: str) -> DataFrame:
    """Texts of ``documents`` as files, parsed, written as processed documents and loaded again."""
    rows = spread(table(s, d, "documents").where("text is not null").select(F.concat(F.lit("/made/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")))
    folder = new_dir(s, "processed")
    I.write_processed(I.parse_files(rows), folder)
    loaded = I.read_processed(s, folder).select("source_file", "document_id", F.col("segments")[0]["text"].alias("t"))
    return loaded.select("source_file", "document_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("sha"))


def raw_copies(s: SparkSession, d: str) -> DataFrame:
    """Raw copies keep every byte and the base name only."""
    rows = spread(table(s, d, "documents").where("text is not null").select(F.concat(F.lit("/a/b/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")))
    folder = new_dir(s, "raw")
    I.write_raw(rows, folder)
    return s.read.parquet(folder).select("source_file", "document_id", F.sha2("content", 256).alias("sha"))


def discover_files(s: SparkSession, d: str) -> DataFrame:
    """Discovery over the raw paths of the deliveries, through the operator."""
    rows = I.discover(table(s, d, "documents_norm").where("raw_path is not null").select(F.col("raw_path").alias("path")))
    return rows.select("source_file", F.size("paths").alias("n"), F.array_join("paths", "|").alias("paths"), "ambiguous")


def golden_json_lines(s: SparkSession, d: str) -> DataFrame:
    """Golden cases written as JSON lines and read again."""
    fields = [f.name for f in I.GOLDEN]
    kept = [c for c in fields if c not in ("id", "requires_multi_document_reasoning")]
    rows = table(s, d, "golden_qa").where("id is not null").groupBy("id").agg(*(F.min(c).alias(c) for c in kept), F.bool_or("requires_multi_document_reasoning").alias("requires_multi_document_reasoning"))
    folder = new_dir(s, "golden")
    I.to_json_rows(rows.select(*fields)).coalesce(1).write.text(folder)
    lists = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|", "~").alias(c) for c in ("expected_facts", "expected_source_files", "tags")]
    return I.read_golden(s, folder).select("id", "question", "answerability", "difficulty", "requires_multi_document_reasoning", "expected_answer", *lists, "notes")


def chunk_exchange(s: SparkSession, d: str) -> DataFrame:
    """Chunks through their exchange form and back."""
    rows = corpus(s, d)
    back = I.from_json_rows(I.to_json_rows(rows), rows.schema)
    return back.select("chunk_id", "document_id", "chunk_index", F.sha2("text", 256).alias("sha"), "section_heading", "page_number", "chunking_strategy", "character_count")


def metadata_problems(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks")
    return D.metadata_problems(rows.select(F.col("chunk_row").cast("string").alias("chunk_id"), *(c for c in rows.columns if c not in ("chunk_row", "chunk_id"))), "recursive")


# -- chunking --------------------------------------------------------------------------------------


def segment_texts(s: SparkSession, d: str) -> DataFrame:
    rows = spread(table(s, d, "documents_norm").select("delivery_id", "segments")).select("delivery_id", F.posexplode("segments").alias("segment_index", "s"))
    return rows.select("delivery_id", "segment_index", F.col("s.text").alias("text"))


def recursive_joined(s: SparkSession, d: str) -> DataFrame:
    """Packed pieces joined, and overlapped pieces joined without what they repeat, are the stripped text."""
    cut = F.udf(C.pack, "array<string>", useArrow=True)
    led = F.udf(C.recursive_pieces, "array<string>", useArrow=True)
    rows = segment_texts(s, d).where("text is not null").select("delivery_id", "segment_index", cut("text", F.lit(600)).alias("p"), led("text", F.lit(800), F.lit(200)).alias("o"))
    packed = F.transform("p", lambda x: F.length(x))
    # a piece repeats the end of the packed piece before it, 200 characters at most
    new = F.transform("o", lambda x, i: F.when(i == 0, x).otherwise(F.substring(x, F.least(F.lit(200), F.element_at(packed, i.cast("int"))) + 1, F.length(x))))
    whole = F.when(F.size("p") == F.size("o"), F.array_join(new, "")).otherwise(F.array_join("p", ""))
    return rows.select("delivery_id", "segment_index", F.sha2(F.array_join("p", ""), 256).alias("sha"), F.sha2(whole, 256).alias("overlap_sha"), F.forall("p", lambda x: F.length(x) <= 600).alias("packed_fit"), F.forall("o", lambda x: F.length(x) <= 800).alias("overlapped_fit"))


def recursive_sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentences of equal length, as many as the chunk's number says: packing takes whole ones."""
    cut = F.udf(C.recursive_pieces, "array<string>", useArrow=True)
    rows = corpus(s, d).where("chunk_index is not null").select("chunk_id", F.repeat(F.lit("aaaa bbbb. "), F.col("chunk_index") % 23 + 1).alias("t"))
    return rows.select("chunk_id", F.posexplode(cut("t", F.lit(55), F.lit(0))).alias("n", "piece"))


def chunk_rows_hold(s: SparkSession, d: str) -> DataFrame:
    """Recursive and semantic chunks of every delivery: how they are numbered and measured."""
    documents = spread(table(s, d, "documents_norm").select(F.col("delivery_id").cast("string").alias("document_id"), "source_file", "segments"))
    parts = []
    for strategy in ("recursive", "semantic"):
        rows = C.chunk_documents(documents, strategy=strategy)
        measured = F.col("character_count") == F.length("text")
        made = F.col("chunk_id") == X.chunk_id(F.col("document_id"), F.col("chunking_strategy"), F.col("chunk_index"), F.col("text"))
        by = rows.groupBy("document_id", "chunking_strategy").agg(F.min("chunk_index").alias("low"), (F.max("chunk_index") + 1 == F.count("*")).alias("dense"), F.bool_and(measured & made).alias("right"), F.max("character_count").alias("longest"))
        parts.append(by.select("document_id", "chunking_strategy", "low", "dense", "right", (F.col("longest") <= 1000).alias("within") if strategy == "recursive" else F.lit(True).alias("within")))
    return parts[0].union(parts[1])


def group_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Units of a segment joined where neighbours begin with the same letter, by vectors of that letter."""

    def letters(texts: list[str]) -> list[list[float]]:
        return [[1.0, 0.0] if t[0] in "aeiouAEIOU" else [0.0, 1.0] for t in texts]

    cut = F.udf(lambda t: C.semantic_pieces(t, letters, 0.5, 10**9), "array<string>", useArrow=True)
    rows = segment_texts(s, d).where("text is not null").select("delivery_id", "segment_index", cut("text").alias("p"))
    return rows.select("delivery_id", "segment_index", F.size("p").alias("pieces"))


# -- checks of stages ------------------------------------------------------------------------------


def provenance_planted(s: SparkSession, d: str) -> DataFrame:
    """Chunks whose two sides disagree, planted by the chunk's number."""
    fields = ("document_id", "chunk_index", "source_file")
    rows = corpus(s, d).select(F.lit(1).alias("query_id"), "chunk_id", *fields)
    n = F.col("chunk_index")
    other = rows.withColumn("source_file", F.when(n % 3 == 0, F.concat("source_file", F.lit("x"))).otherwise(F.col("source_file"))).withColumn("document_id", F.when(n % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("document_id")))
    return R.provenance_problems(rows, other, fields).select("chunk_id", F.array_join("fields", ",").alias("fields"))


def dense_hit_problems(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "dense_hits").select(F.col("query_vec_id").alias("query_id"), "chunk_id", "document_id", "source_file", "chunk_index", "rank", "distance")
    return R.hit_problems(rows)


def query_vector_problems(s: SparkSession, d: str) -> DataFrame:
    """Every stored vector as a query against the vectors of the usual length."""
    rows = table(s, d, "chunk_vectors")
    return R.width_problems(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), rows.where("size(embedding) = 64").select(F.col("embedding").alias("vector")))


def confidence_inputs(s: SparkSession, d: str) -> DataFrame:
    """Verdict reports with planted faults against the answers' real citations and evidence."""
    from scriptorium.plans.queries import made_answers, made_evidence, made_verdicts

    n, o = F.length("answer_id"), F.col("occurrence_id")
    verdicts = made_verdicts(s, d).where((n + o) % 7 != 0).withColumn("chunk_id", F.when((n + o) % 5 == 0, F.lit("elsewhere")).otherwise(F.col("chunk_id")))
    return A.confidence_problems(made_answers(s, d), verdicts, made_evidence(s, d))


def all_prompts(s: SparkSession, d: str) -> DataFrame:
    """The four prompts of each golden case and of the system, as digests."""
    kept = ("question", "expected_answer", "notes")
    rows = table(s, d, "golden_qa").where("id is not null and question is not null").groupBy("id").agg(*(F.min(c).alias(c) for c in kept), F.min("expected_facts").alias("facts"))
    q, a, e = F.col("question"), F.coalesce("expected_answer", F.lit("")), F.coalesce("notes", F.lit(""))
    sha = lambda c, name: F.sha2(c, 256).alias(name)
    return rows.select(
        "id", sha(X.prompt(q, e), "answer_sha"), sha(X.judge_prompt(q, a, e), "judge_sha"), sha(X.correctness_prompt(q, F.coalesce("facts", F.array().cast("array<string>")), a), "correctness_sha"),
        sha(X.faithfulness_prompt(q, a, e), "faithfulness_sha"),
    )


# -- providers and chains --------------------------------------------------------------------------


def embedded_chunks(s: SparkSession, d: str) -> DataFrame:
    """Vectors of the deterministic provider: their length, sum and first value."""
    rows = spread(corpus(s, d).select("chunk_id", "text")).select("chunk_id", embedding_udf()(F.col("text")).alias("v"))
    return rows.select("chunk_id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("v", 1), 6).alias("first"))


def rerank_injected(s: SparkSession, d: str) -> DataFrame:
    """Reranking by an injected pair scorer: the lengths of both texts decide."""
    score = rerank_udf(lambda pairs: [float((len(t) * 7 + len(q)) % 97) for q, t in pairs])
    chunks, asked = materialize(corpus(s, d), "corpus"), questions(s, d)
    hits = R.hydrate(R.bm25_topk(asked, chunks, 20).join(asked, "query_id"), chunks)
    scored = materialize(hits.select("query_id", "chunk_id", "rank", score(F.col("query"), F.col("text")).alias("own_score")), "scored")
    rows = R.rerank(scored, F.col("own_score"))
    return rows.select("query_id", "chunk_id", "rank", "hybrid_rank", "reranker_score")


def hybrid_chain(s: SparkSession, d: str) -> DataFrame:
    chunks = materialize(corpus(s, d), "corpus")
    return P.retrieve_hybrid(questions(s, d), chunks, materialize(hashed(chunks), "vectors")).select("query_id", "chunk_id", "rank", "rrf_score", "dense_rank", "sparse_rank")


def reranked_chain(s: SparkSession, d: str) -> DataFrame:
    chunks = materialize(corpus(s, d), "corpus")
    rows = P.retrieve_reranked(questions(s, d), chunks, materialize(hashed(chunks), "vectors"))
    return rows.select("query_id", "chunk_id", "rank", "hybrid_rank", F.round("reranker_score", 9).alias("reranker_score"))


def generated_answers(s: SparkSession, d: str) -> DataFrame:
    chunks = materialize(corpus(s, d), "corpus")
    done = P.retrieve_and_generate(questions(s, d), chunks, materialize(hashed(chunks), "vectors"))
    return done.answers.select("answer_id", "answer_text", "evidence_count")


def verified_answers(s: SparkSession, d: str) -> DataFrame:
    """The chain to the policy with an injected generator and judge."""
    told = P.Providers(
        generate=lambda question, evidence: F.concat(F.lit("From the first entry ["), F.element_at(evidence, 1)["citation_number"].cast("string"), F.lit("] and the last ["), F.element_at(evidence, -1)["citation_number"].cast("string"), F.lit("].")),
        judge=lambda answer, evidence: F.struct(F.when(F.length(evidence) % 4 == 0, "partially_supported").when(F.length(evidence) % 11 == 0, "contradicted").otherwise("supported").alias("verdict"), F.lit("by length").alias("rationale")),
    )
    chunks = materialize(corpus(s, d), "corpus")
    rows = P.answer_with_policy(questions(s, d), chunks, materialize(hashed(chunks), "vectors"), providers=told)
    return rows.select("answer_id", "decision", "abstained", "answer_text", F.round("score", 6).alias("score"))


# -- snapshots -------------------------------------------------------------------------------------


def built_snapshot(s: SparkSession, d: str) -> tuple[DataFrame, str, S.Manifest]:
    chunks, root = materialize(one_strategy(s, d), "request"), new_dir(s, "index")
    return chunks, root, S.build(chunks, root)


def snapshot_counts(s: SparkSession, d: str) -> DataFrame:
    """A build, the same request again (used again as it is), and one with less in it (built anew)."""
    chunks, root, first = built_snapshot(s, d)
    again = S.build(chunks, root)
    third = S.build(chunks.where("chunk_index > 0"), root)
    rows = [(first.chunks_before, first.chunks_after, first.exact_duplicates, first.near_duplicates, first.embedding_dimension, again == first, third.snapshot_id != first.snapshot_id, third.chunks_before)]
    return s.createDataFrame(rows, "chunks_before bigint, chunks_after bigint, exact bigint, near bigint, width int, reused boolean, rebuilt boolean, later_before bigint")


def snapshot_duplicates(s: SparkSession, d: str) -> DataFrame:
    """The duplicate report that a snapshot stores, with the provenance of both sides."""
    _, _, manifest = built_snapshot(s, d)
    return s.read.parquet(f"{manifest.path}/duplicates").select("skipped_chunk_id", "skipped_document_id", "skipped_source_file", "canonical_chunk_id", "canonical_document_id", "duplicate_type", "similarity")


def snapshot_search(s: SparkSession, d: str) -> DataFrame:
    """Sparse search from the stored index of the active snapshot."""
    _, root, _ = built_snapshot(s, d)
    manifest, _, _ = S.open_snapshot(s, root, "recursive")
    return R.bm25_topk(questions(s, d), index=S.stored_index(s, manifest))


def snapshot_checks(s: SparkSession, d: str) -> DataFrame:
    """What the integrity check says of a snapshot as it is, and of one whose tables were changed."""
    _, root, manifest = built_snapshot(s, d)
    fine = S.content_agrees(s, manifest)
    vectors = materialize(s.read.parquet(f"{manifest.path}/vectors"), "kept")
    lost = materialize(vectors.where(F.length("text") % 2 == 0), "less")
    lost.write.mode("overwrite").parquet(f"{manifest.path}/vectors")
    without = S.content_agrees(s, manifest)
    vectors.withColumn("text", F.concat("text", F.lit("."))).write.mode("overwrite").parquet(f"{manifest.path}/vectors")
    changed = S.content_agrees(s, manifest)
    vectors.write.mode("overwrite").parquet(f"{manifest.path}/vectors")
    return s.createDataFrame([(fine, without, changed, S.content_agrees(s, manifest))], "fine boolean, without_vectors boolean, with_other_texts boolean, restored boolean")


QUERIES = {
    f.__name__: f
    for f in (
        parse_text_files, parse_markdown_files, parse_html_files, ingest_documents, raw_copies, discover_files, golden_json_lines, chunk_exchange, metadata_problems, recursive_joined, recursive_sentences, chunk_rows_hold,
        group_neighbours, provenance_planted, dense_hit_problems, query_vector_problems, confidence_inputs, all_prompts, embedded_chunks, rerank_injected, hybrid_chain, reranked_chain, generated_answers, verified_answers,
        snapshot_counts, snapshot_duplicates, snapshot_search, snapshot_checks,
    )
}
