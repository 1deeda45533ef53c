"""DuckDB counterparts of the queries in ``chains``, written independently of the Spark plans."""

from __future__ import annotations

from scriptorium.plans.oracles import ANSWERS, CORPUS, EVIDENCE, FILETYPE, MARKER, OCCURRENCES, SEGMENTS, TEXT_NORMAL, TOKEN, bm25, strategy, strip, tokens

PLAIN = lambda x: f"trim(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g'))"
CASES = f"made AS (SELECT id, {PLAIN('id')} AS i, {PLAIN('min(question)')} AS q FROM golden_qa WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id)"
ASKED = f"questions AS (SELECT * FROM (SELECT id AS query_id, min(question) AS query FROM golden_qa WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id) WHERE len(regexp_extract_all(query, '{TOKEN}')) > 0)"
ONE = """one AS (SELECT * EXCLUDE (p) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY chunk_id) AS p FROM corpus
  WHERE chunking_strategy = 'recursive' AND document_id IS NOT NULL AND chunk_index IS NOT NULL AND source_file IS NOT NULL) WHERE p = 1)"""
HEADS = "heads AS (SELECT *, first_value(struct_pack(c := chunk_id, d := document_id, f := source_file)) OVER (PARTITION BY text ORDER BY document_id, chunk_index, chunk_id) AS h FROM one)"
#: The deterministic vectors: 32 centred bytes of the text's digest.
HEX = "(strpos('0123456789abcdef', substr({h}, {i}, 1)) - 1)"
VECTOR = lambda x: f"list_transform(range(1, 33), lambda i: (16 * {HEX.format(h=f'sha256({x})', i='2 * i - 1')} + {HEX.format(h=f'sha256({x})', i='2 * i')} - 127.5::DOUBLE) / 127.5)"
COSINE = "CASE WHEN sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)) = 0 THEN 0.0 ELSE list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) END"


def hybrid(each: int, k: int) -> str:
    """``fused``: the ``k`` best of both channels of ``each`` results."""
    return f"""{bm25(each)},
  qv AS (SELECT query_id, {VECTOR('query')} AS v FROM questions), cv AS (SELECT chunk_id, {VECTOR('text')} AS v FROM corpus),
  dense AS (SELECT query_id, chunk_id, CAST(r AS INT) AS rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round({COSINE}, 12) DESC, chunk_id) AS r FROM qv q, cv c) WHERE r <= {each}),
  both_sides AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(0.7 / (60 + d.rank), 0.0) + coalesce(0.3 / (60 + s.rank), 0.0) AS score
    FROM dense d FULL JOIN hits s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
  fused AS (SELECT query_id, chunk_id, CAST(r AS INT) AS rank, round(score, 9) AS rrf_score, dense_rank, sparse_rank FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, least(dense_rank, sparse_rank), dense_rank NULLS LAST, sparse_rank NULLS LAST, chunk_id) AS r FROM both_sides) WHERE r <= {k})"""


RERANKED = f"""scored_pairs AS (SELECT f.query_id, f.chunk_id, f.rank AS hybrid_rank, f.dense_rank, f.sparse_rank, c.text, coalesce(len(list_intersect(list_distinct({tokens('query')}), {tokens('text')})) / nullif(list_unique({tokens('query')}), 0)::DOUBLE, 0.0) AS s
    FROM fused f JOIN questions USING (query_id) JOIN corpus c USING (chunk_id)),
  reranked AS (SELECT *, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, hybrid_rank, chunk_id) AS r FROM scored_pairs) WHERE r <= 5)"""
FACTS_NUMBERED = "array_to_string(list_transform(range(1, len(facts) + 1), lambda i: i || '. ' || facts[i]), chr(10))"
LABEL = "'Evidence (untrusted material):' || chr(10) || chr(10)"
NOTE = lambda part: f"chr(10) || chr(10) || '{part}'"
MARKED = """list_aggregate(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(m) THEN '<occurrence id="' || i || '">' || m[i] || '</occurrence>' ELSE '' END), 'string_agg', '')"""

CHAIN_ORACLES: dict[str, str] = {
    "parse_text_files": f"WITH {CASES} SELECT i || '.txt' AS source_file, 'txt' AS file_type, 0::INT AS n, trim('Case ' || i || chr(10) || chr(10) || q, chr(10)) AS text, NULL::VARCHAR AS section_heading, NULL::INT AS page_number, NULL::VARCHAR AS error_class FROM made",
    "parse_markdown_files": f"""WITH {CASES} SELECT i || '.md' AS source_file, 'markdown' AS file_type, n::INT AS n, text, section_heading, NULL::INT AS page_number, NULL::VARCHAR AS error_class FROM
        (SELECT i, 0 AS n, q AS text, 'Case ' || i AS section_heading FROM made UNION ALL SELECT i, 1, 'end', 'Case ' || i || ' > Part' FROM made)""",
    "parse_html_files": f"""WITH {CASES} SELECT i || '.html' AS source_file, 'html' AS file_type, n::INT AS n, text, section_heading, NULL::INT AS page_number, NULL::VARCHAR AS error_class FROM
        (SELECT i, 0 AS n, q AS text, 'Case ' || i AS section_heading FROM made UNION ALL SELECT i, 1, 'end & more', 'Case ' || i || ' > Part' FROM made)""",
    "ingest_documents": f"SELECT * FROM (SELECT doc_id || '.txt' AS source_file, sha256(text) AS document_id, length(t)::INT AS chars, sha256(t) AS sha FROM (SELECT doc_id, text, {TEXT_NORMAL('text')} AS t FROM documents WHERE text IS NOT NULL))",
    "raw_copies": "SELECT doc_id || '.txt' AS source_file, sha256(text) AS document_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL",
    "discover_files": f"SELECT source_file, len(paths)::INT AS n, array_to_string(paths, '|') AS paths, len(paths) > 1 AS ambiguous FROM (SELECT regexp_extract(raw_path, '([^/]+)$', 1) AS source_file, list_sort(list(DISTINCT raw_path)) AS paths FROM documents_norm WHERE {FILETYPE('raw_path')} IS NOT NULL GROUP BY 1)",
    "golden_json_lines": "SELECT id, min(question) AS question, min(answerability) AS answerability, min(difficulty) AS difficulty, bool_or(requires_multi_document_reasoning) AS requires_multi_document_reasoning, min(expected_answer) AS expected_answer, "
    + ", ".join(f"coalesce(array_to_string(list_transform(min({c}), lambda x: coalesce(x, '~')), '|'), '') AS {c}" for c in ("expected_facts", "expected_source_files", "tags"))
    + ", min(notes) AS notes FROM golden_qa WHERE id IS NOT NULL GROUP BY id",
    "chunk_exchange": f"WITH {CORPUS} SELECT chunk_id, document_id, chunk_index, sha256(text) AS sha, section_heading, page_number, chunking_strategy, character_count FROM corpus",
    "metadata_problems": f"""SELECT * FROM (SELECT chunk_row::VARCHAR AS chunk_id, CASE WHEN coalesce({strip('document_id')}, '') = '' THEN 'no_document_id' WHEN coalesce({strip('text')}, '') = '' THEN 'no_text' WHEN coalesce({strip('source_file')}, '') = '' THEN 'no_source_file'
        WHEN chunk_index IS NULL OR chunk_index < 0 THEN 'bad_chunk_index' WHEN page_number < 1 THEN 'bad_page_number' WHEN section_heading IS NOT NULL AND {strip('section_heading')} = '' THEN 'blank_heading'
        WHEN {strategy('chunking_strategy')} IS NULL THEN 'unknown_strategy' WHEN {strategy('chunking_strategy')} <> 'recursive' THEN 'other_strategy' END AS error_class FROM chunks) WHERE error_class IS NOT NULL""",
    "recursive_joined": f"WITH {SEGMENTS} SELECT delivery_id, segment_index, sha256({strip('s.text')}) AS sha, sha256({strip('s.text')}) AS overlap_sha, true AS packed_fit, true AS overlapped_fit FROM segs WHERE s.text IS NOT NULL",
    "recursive_sentences": f"""WITH {CORPUS}, made AS (SELECT chunk_id, chunk_index % 23 + 1 AS k, trim(repeat('aaaa bbbb. ', (chunk_index % 23 + 1)::BIGINT)) AS t FROM corpus WHERE chunk_index IS NOT NULL)
        SELECT chunk_id, CAST(i AS INT) AS n, substring(t, (55 * i + 1)::BIGINT, 55) AS piece FROM (SELECT *, unnest(range(0, (k + 4) // 5)) AS i FROM made)""",
    "chunk_rows_hold": f"""WITH {SEGMENTS}, docs AS (SELECT DISTINCT delivery_id::VARCHAR AS document_id FROM segs WHERE s.text IS NOT NULL AND {strip('s.text')} <> '')
        SELECT document_id, k AS chunking_strategy, 0::INT AS low, true AS dense, true AS right, true AS within FROM docs, (VALUES ('recursive'), ('semantic')) t(k)""",
    "group_neighbours": f"""WITH {SEGMENTS}, parts AS (SELECT delivery_id, segment_index, s.text AS t, list_filter(list_transform(string_split(s.text, chr(10) || chr(10)), lambda u: {strip('u')}), lambda u: u <> '') AS a,
          list_filter(list_transform(string_split(s.text, chr(10)), lambda u: {strip('u')}), lambda u: u <> '') AS b FROM segs WHERE s.text IS NOT NULL),
        units AS (SELECT delivery_id, segment_index, CASE WHEN len(a) > 1 THEN a WHEN len(b) > 1 THEN b ELSE list_filter([{strip('t')}], lambda u: u <> '') END AS u FROM parts),
        marks AS (SELECT delivery_id, segment_index, list_transform(u, lambda x: contains('aeiouAEIOU', x[1])) AS m FROM units)
        SELECT delivery_id, segment_index, CASE WHEN len(m) = 0 THEN 0 ELSE 1 + len(list_filter(range(2, len(m) + 1), lambda i: m[i] <> m[i - 1])) END::INT AS pieces FROM marks""",
    "provenance_planted": f"""WITH {CORPUS} SELECT * FROM (SELECT chunk_id, concat_ws(',', CASE WHEN chunk_index % 5 = 0 AND document_id IS NOT NULL THEN 'document_id' END, CASE WHEN chunk_index % 3 = 0 AND source_file IS NOT NULL THEN 'source_file' END) AS fields FROM corpus) WHERE fields <> ''""",
    "dense_hit_problems": f"""SELECT * FROM (SELECT query_vec_id AS query_id, chunk_id, CASE WHEN coalesce({strip('chunk_id')}, '') = '' THEN 'no_id' WHEN coalesce({strip('document_id')}, '') = '' THEN 'no_document_id' WHEN coalesce({strip('source_file')}, '') = '' THEN 'no_source_file'
        WHEN chunk_index IS NULL OR chunk_index < 0 THEN 'bad_chunk_index' WHEN rank IS NULL OR rank < 1 THEN 'bad_rank' WHEN distance IS NULL OR NOT isfinite(distance) OR distance < -1e-9 THEN 'bad_distance' END AS error_class FROM dense_hits) WHERE error_class IS NOT NULL""",
    "query_vector_problems": """SELECT * FROM (SELECT vec_id AS query_id, CASE WHEN embedding IS NULL OR len(embedding) = 0 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'bad_vector'
        WHEN len(embedding) <> 64 THEN 'width_mismatch' END AS error_class FROM chunk_vectors) WHERE error_class IS NOT NULL""",
    "confidence_inputs": f"""WITH {ANSWERS}, {OCCURRENCES}, {EVIDENCE}, given AS (SELECT m.answer_id, occurrence_id, m.citation_number, CASE WHEN (length(m.answer_id) + occurrence_id) % 5 = 0 THEN 'elsewhere' ELSE e.chunk_id END AS chunk_id
          FROM marks m JOIN evidence e ON m.answer_id = e.answer_id AND m.citation_number = e.citation_number WHERE (length(m.answer_id) + occurrence_id) % 7 <> 0),
        repeated AS (SELECT answer_id FROM evidence GROUP BY answer_id HAVING count(*) > count(DISTINCT chunk_id)),
        r AS (SELECT a.answer_id, a.answer_id IN (SELECT m.answer_id FROM marks m LEFT JOIN given g ON m.answer_id = g.answer_id AND m.occurrence_id = g.occurrence_id WHERE g.answer_id IS NULL) AS x,
          a.answer_id IN (SELECT answer_id FROM repeated) AS y, a.answer_id IN (SELECT answer_id FROM given WHERE chunk_id = 'elsewhere') AS z FROM answers a)
        SELECT * FROM (SELECT answer_id, CASE WHEN x THEN 'report_mismatch' WHEN y THEN 'repeated_retrieval' WHEN z THEN 'chunk_mismatch' END AS error_class FROM r) WHERE error_class IS NOT NULL""",
    "all_prompts": f"""WITH g AS (SELECT id, min(question) AS q, coalesce(min(expected_answer), '') AS a, coalesce(min(notes), '') AS e, coalesce(min(expected_facts), []) AS facts FROM golden_qa WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id),
        c AS (SELECT *, regexp_extract_all(a, '\\[[0-9]+\\]') AS m, regexp_split_to_array(a, '\\[[0-9]+\\]') AS p FROM g)
        SELECT id, sha256({LABEL} || e || {NOTE('Question: ')} || q || {NOTE('Answer with citations:')}) AS answer_sha,
          sha256('Question: ' || q || {NOTE('Answer:')} || chr(10) || {MARKED} || chr(10) || chr(10) || {LABEL} || e) AS judge_sha,
          sha256('Question: ' || q || {NOTE('Facts:')} || chr(10) || coalesce({FACTS_NUMBERED}, '') || {NOTE('Answer:')} || chr(10) || a) AS correctness_sha,
          sha256('Question: ' || q || {NOTE('Answer:')} || chr(10) || a || chr(10) || chr(10) || {LABEL} || e) AS faithfulness_sha FROM c""",
    "embedded_chunks": f"WITH {CORPUS} SELECT chunk_id, 32::INT AS width, round(list_sum(v), 6) AS total, round(v[1], 6) AS first FROM (SELECT chunk_id, {VECTOR('text')} AS v FROM corpus)",
    "rerank_injected": f"""WITH {CORPUS}, {ASKED}, {bm25(20)}, r AS (SELECT h.query_id, h.chunk_id, h.rank AS hybrid_rank, ((length(text) * 7 + length(query)) % 97)::DOUBLE AS reranker_score FROM hits h JOIN questions USING (query_id) JOIN corpus USING (chunk_id))
        SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, hybrid_rank, reranker_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, hybrid_rank, chunk_id) AS rank FROM r) WHERE rank <= 5""",
    "hybrid_chain": f"WITH {CORPUS}, {ASKED}, {hybrid(10, 10)} SELECT * FROM fused",
    "reranked_chain": f"WITH {CORPUS}, {ASKED}, {hybrid(20, 20)}, {RERANKED} SELECT query_id, chunk_id, rank, hybrid_rank, round(s, 9) AS reranker_score FROM reranked",
    "generated_answers": f"""WITH {CORPUS}, {ASKED}, {hybrid(20, 20)}, {RERANKED}, n AS (SELECT query_id, count(*) AS k, max(CASE WHEN rank = 1 THEN text END) AS t FROM reranked GROUP BY 1)
        SELECT query_id AS answer_id, CASE WHEN t IS NULL THEN 'I cannot answer: {MARKER}.' ELSE trim(regexp_replace(regexp_extract(t, '^[^.!?\\n]*'), '\\[[0-9]+\\]', '', 'g')) || ' [1].' END AS answer_text, coalesce(k, 0)::INT AS evidence_count FROM questions LEFT JOIN n USING (query_id)""",
    "verified_answers": f"""WITH {CORPUS}, {ASKED}, {hybrid(20, 20)}, {RERANKED}, n AS (SELECT query_id, count(*) AS k FROM reranked GROUP BY 1),
        v AS (SELECT r.query_id, r.chunk_id, CASE WHEN length(text) % 4 = 0 THEN 'partially_supported' WHEN length(text) % 11 = 0 THEN 'contradicted' ELSE 'supported' END AS verdict, dense_rank IS NOT NULL AND sparse_rank IS NOT NULL AS dual
          FROM reranked r JOIN n USING (query_id), (VALUES (1), (2)) o(o) WHERE r.rank = CASE WHEN o = 1 THEN 1 ELSE k END),
        s AS (SELECT query_id, avg(CASE verdict WHEN 'supported' THEN 1.0::DOUBLE WHEN 'partially_supported' THEN 0.5 ELSE 0.0 END) AS cs, bool_or(verdict = 'contradicted') AS bad, count(DISTINCT CASE WHEN dual THEN chunk_id END) / count(DISTINCT chunk_id)::DOUBLE AS ra FROM v GROUP BY 1),
        f AS (SELECT query_id, k, bad, round((0.9 * cs + 0.1 * ra) / (0.9 + 0.1), 9) AS score FROM s JOIN n USING (query_id)),
        d AS (SELECT *, CASE WHEN bad THEN 'abstained_contradiction' WHEN score < 0.8 THEN 'abstained_low_confidence' ELSE 'answered' END AS decision FROM f)
        SELECT query_id AS answer_id, decision, decision <> 'answered' AS abstained, CASE WHEN decision = 'answered' THEN 'From the first entry [1] and the last [' || k || '].' ELSE 'I can''t answer that reliably from the documents at hand.' END AS answer_text, round(score, 6) AS score FROM d""",
    "snapshot_counts": f"""WITH {CORPUS}, {ONE} SELECT count(*) AS chunks_before, count(DISTINCT text) AS chunks_after, count(*) - count(DISTINCT text) AS exact, 0::BIGINT AS near, 32::INT AS width, true AS reused, true AS rebuilt, count(*) FILTER (chunk_index > 0) AS later_before FROM one""",
    "snapshot_duplicates": f"""WITH {CORPUS}, {ONE}, {HEADS} SELECT chunk_id AS skipped_chunk_id, document_id AS skipped_document_id, source_file AS skipped_source_file, h.c AS canonical_chunk_id, h.d AS canonical_document_id, 'exact' AS duplicate_type, 1.0::DOUBLE AS similarity FROM heads WHERE chunk_id <> h.c""",
    "snapshot_search": f"WITH {CORPUS.replace('corpus AS', 'whole AS', 1)}, {ONE.replace('FROM corpus', 'FROM whole')}, {HEADS}, corpus AS (SELECT * FROM heads WHERE chunk_id = h.c), {ASKED}, {bm25(10)} SELECT * FROM hits",
    "snapshot_checks": "SELECT true AS fine, false AS without_vectors, false AS with_other_texts, true AS restored",
}
