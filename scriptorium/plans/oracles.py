"""DuckDB counterparts of the registered queries, written independently of the Spark plans."""

from __future__ import annotations

TOKEN = r"[\p{L}\p{N}_]+(?:\.[0-9]+)*"
BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_BLANK = BLANK.replace("[\\s", "[ \\t\\x0B\\f")
MARKER = "the supplied documents do not provide enough information"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{BLANK}+|{BLANK}+\\z', '', 'g')"


def tokens(x: str) -> str:
    """Lower-case tokens; a capital I with a dot becomes an i and a combining dot, as Unicode has it."""
    return f"list_transform(regexp_extract_all({x}, '{TOKEN}'), lambda w: lower(replace(w, chr(304), 'i' || chr(775))))"


def strategy(x: str) -> str:
    return f"CASE WHEN lower({strip(x)}) IN ('fixed','recursive','semantic') THEN lower({strip(x)}) END"


CORPUS = f"""corpus AS (
  SELECT chunk_id, document_id, chunk_index, text, source_file, section_heading, page_number,
         {strategy("chunking_strategy")} AS chunking_strategy, coalesce(character_count, length(text)) AS character_count
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_row) AS place
        FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND {strip("text")} <> '') WHERE place = 1)"""
QUESTIONS = "questions AS (SELECT id AS query_id, min(question) AS query FROM golden_qa WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id)"
PROBES = "questions AS (SELECT * FROM (VALUES ('absent','qqzzxx vvkkjj'), ('common','the the and'), ('mixed','ERR_TLS_5164 qqzzxx'), ('rare','cascusson')) t(query_id, query))"
TERMS = f"""
  toks AS (SELECT chunk_id, {tokens("text")} AS t FROM corpus),
  size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
  posts AS (SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY term, chunk_id),
  dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
  raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, size),
  idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""


def bm25(k: int) -> str:
    return f"""{TERMS},
  asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("query")}) AS term FROM questions) GROUP BY query_id, term),
  weights AS (SELECT posts.term, chunk_id, CAST(round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * 1e9) AS BIGINT) AS w FROM posts JOIN idfs ON posts.term = idfs.term, size
              WHERE posts.term IN (SELECT term FROM asked)),
  scored AS (SELECT query_id, chunk_id, CAST(sum(w * qtf) AS BIGINT) AS units FROM asked JOIN weights USING (term) GROUP BY query_id, chunk_id),
  everything AS (SELECT q.query_id, c.chunk_id, c.document_id, c.chunk_index, coalesce(s.units, 0) AS units
                 FROM (SELECT DISTINCT query_id FROM asked) q CROSS JOIN corpus c LEFT JOIN scored s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id),
  hits AS (SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(units / 1e9, 6) AS bm25_score FROM
           (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, document_id NULLS FIRST, chunk_index NULLS FIRST, chunk_id) AS rank FROM everything) WHERE rank <= {k})"""


GOOD = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
UNIT = f"""units AS (SELECT vec_id, chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM
  (SELECT vec_id, chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM chunk_vectors WHERE {GOOD}))"""
COS = "CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0 ELSE list_dot_product(a.v, b.v) / (a.nrm * b.nrm) END"
NEARV = f"""near AS (SELECT a.vec_id AS query_id, b.vec_id, b.chunk_id, {COS} AS similarity FROM units a, units b WHERE a.vec_id % 100 = 0)"""
EARLIER = """earlier AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY was NULLS LAST, chunk_id) AS INT) AS rank FROM
  (SELECT query_vec_id AS query_id, chunk_id, min(rank) AS was FROM dense_hits WHERE query_vec_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL))"""
VECHITS = f"""{UNIT}, {NEARV},
  vechits AS (SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best DESC, chunk_id) AS INT) AS rank FROM
    (SELECT query_id, chunk_id, max(round(similarity, 12)) AS best FROM near WHERE chunk_id IS NOT NULL GROUP BY ALL)) WHERE rank <= 10)"""
FUSED = """fused AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank,
    coalesce(0.7 / (60 + d.rank), 0.0) AS dc, coalesce(0.3 / (60 + s.rank), 0.0) AS sc FROM vechits d FULL JOIN earlier s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dc + sc, 12) DESC, least(dense_rank, sparse_rank), dense_rank NULLS LAST, sparse_rank NULLS LAST, chunk_id) AS rank FROM fused)"""
SEGMENTS = "segs AS (SELECT delivery_id, CAST(i - 1 AS INT) AS segment_index, segments[i] AS s FROM (SELECT delivery_id, segments, unnest(range(1, len(segments) + 1)) AS i FROM documents_norm))"
GOLDEN = """golden AS (SELECT id, min(question) AS question, min(answerability) AS answerability, min(question_type) AS question_type, min(difficulty) AS difficulty, min(expected_answer) AS expected_answer,
    min(expected_facts) AS expected_facts, min(expected_source_files) AS expected_source_files, min(expected_identifiers) AS expected_identifiers, min(acceptable_source_files) AS acceptable_source_files,
    min(tags) AS tags, min(notes) AS notes, bool_or(requires_multi_document_reasoning) AS many FROM golden_qa WHERE id IS NOT NULL GROUP BY id)"""
ANSWERS = f"""answers AS (SELECT id AS answer_id, CASE WHEN a IS NULL THEN 'Sorry, {MARKER}.' WHEN length(id) % 5 = 0 THEN a
      ELSE a || ' [' || (length(id) % 4 + 1) || '] Also so [' || (length(a) % 7) || '] and [1].' END AS answer_text, length(id) % 3 + 3 AS evidence_count
    FROM (SELECT id, min(expected_answer) AS a FROM golden_qa WHERE id IS NOT NULL GROUP BY id))"""
OCCURRENCES = r"""pieces AS (SELECT answer_id, regexp_extract_all(answer_text, '\[([0-9]+)\]', 0) AS m, regexp_split_to_array(answer_text, '\[[0-9]+\]') AS p FROM answers),
  marks AS (SELECT answer_id, CAST(i AS INT) AS occurrence_id, TRY_CAST(m[i][2:-2] AS INT) AS citation_number,
      CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS start_offset, CAST(length(m[i]) AS INT) AS width
    FROM (SELECT answer_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM pieces))"""
EVIDENCE = """evidence AS (SELECT answer_id, CAST(k AS INT) AS citation_number, 'c' || ((length(answer_id) + k) % 11) AS chunk_id,
    CASE WHEN (length(answer_id) + k) % 3 > 0 THEN k END AS dense_rank, CASE WHEN (length(answer_id) + k) % 4 > 0 THEN k END AS sparse_rank
  FROM (SELECT answer_id, unnest(range(1, evidence_count + 1)) AS k FROM answers))"""
VERDICTS = """verdicts AS (SELECT answer_id, occurrence_id, citation_number, chunk_id, CASE WHEN pl < 5 THEN 'supported' WHEN pl = 5 THEN 'partially_supported' WHEN pl = 6 THEN 'unsupported' WHEN pl = 7 THEN 'contradicted' ELSE 'supported' END AS verdict
  FROM (SELECT m.*, e.chunk_id, (length(m.answer_id) + occurrence_id * 3 + m.citation_number) % 9 AS pl FROM marks m JOIN evidence e ON m.answer_id = e.answer_id AND m.citation_number = e.citation_number))"""
TALLIES = """tallies AS (SELECT a.answer_id, count(v.answer_id) AS total_occurrences, count(*) FILTER (verdict = 'supported') AS supported_count, count(*) FILTER (verdict = 'partially_supported') AS partially_supported_count,
    count(*) FILTER (verdict = 'unsupported') AS unsupported_count, count(*) FILTER (verdict = 'contradicted') AS contradicted_count, coalesce(bool_and(verdict = 'supported') FILTER (v.answer_id IS NOT NULL), true) AS all_supported
  FROM answers a LEFT JOIN verdicts v ON a.answer_id = v.answer_id GROUP BY a.answer_id)"""
SCORE = "CASE verdict WHEN 'supported' THEN 1.0::DOUBLE WHEN 'correct' THEN 1.0 WHEN 'partially_supported' THEN 0.5 WHEN 'partially_correct' THEN 0.5 ELSE 0.0 END"
SCORES = f"""support AS (SELECT answer_id, avg({SCORE}) AS s, count(*) AS n FROM verdicts GROUP BY answer_id),
  agree AS (SELECT answer_id, count(*) AS cited_chunks, count(*) FILTER (dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) AS dual FROM
    (SELECT DISTINCT v.answer_id, v.chunk_id, e.dense_rank, e.sparse_rank FROM verdicts v JOIN evidence e ON v.answer_id = e.answer_id AND v.chunk_id = e.chunk_id) GROUP BY answer_id),
  scores0 AS (SELECT a.answer_id, contains(lower(answer_text), '{MARKER}') AS says, s, n, cited_chunks, dual, t.* EXCLUDE (answer_id, all_supported)
    FROM answers a LEFT JOIN support USING (answer_id) LEFT JOIN agree USING (answer_id) JOIN tallies t USING (answer_id)),
  scores1 AS (SELECT *, coalesce(says, false) AND n IS NULL AS ins, CASE WHEN says AND n IS NULL THEN 0.0 ELSE s END AS cs, CASE WHEN says AND n IS NULL THEN 0.0 ELSE dual / nullif(cited_chunks, 0)::DOUBLE END AS ra FROM scores0),
  scores AS (SELECT answer_id, round(cs, 9) AS citation_support, round(ra, 9) AS retrieval_agreement, round((0.9 * cs + 0.1 * ra) / (0.9 + 0.1), 9) AS score, total_occurrences, supported_count, partially_supported_count,
    unsupported_count, contradicted_count, coalesce(cited_chunks, 0) AS cited_chunks, coalesce(dual, 0) AS dual_channel_chunks, ins AS is_insufficient, contradicted_count > 0 AS has_contradiction,
    CASE WHEN n IS NULL AND NOT says THEN 'no_citation' END AS error_class FROM scores1)"""
DECIDED = """decided AS (SELECT answer_id, CASE WHEN error_class IS NOT NULL OR score IS NULL THEN NULL WHEN is_insufficient THEN 'abstained_insufficient_evidence' WHEN has_contradiction THEN 'abstained_contradiction'
    WHEN unsupported_count > 0 THEN 'abstained_unsupported_citation' WHEN score < 0.8 THEN 'abstained_low_confidence' ELSE 'answered' END AS decision FROM scores)"""
CHAIN = ", ".join((ANSWERS, OCCURRENCES, EVIDENCE, VERDICTS, TALLIES, SCORES, DECIDED))
DECISIONS = """decisions AS (SELECT id, CASE WHEN length(id) % 7 < 4 THEN 'answered' WHEN length(id) % 7 = 4 THEN 'abstained_contradiction' WHEN length(id) % 7 = 5 THEN 'abstained_low_confidence' ELSE 'abstained_insufficient_evidence' END AS decision FROM golden)"""
LISTS = ("expected_facts", "expected_source_files", "expected_identifiers", "acceptable_source_files", "tags")
L = lambda n: f"coalesce({n}, [])"
TEXT_NORMAL = lambda x: strip(f"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(0), ''), '\\r\\n?', chr(10), 'g'), '{LINE_BLANK}+(\\n|\\z)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
CASES = """cases AS (SELECT expected, abst FROM (SELECT answerability = 'unanswerable' AS expected, decision <> 'answered' AS abst FROM golden JOIN decisions USING (id)))"""
FILETYPE = lambda x: f"CASE WHEN regexp_matches(lower({x}), '\\.txt\\z') THEN 'txt' WHEN regexp_matches(lower({x}), '\\.(md|markdown)\\z') THEN 'markdown' WHEN regexp_matches(lower({x}), '\\.(html|htm)\\z') THEN 'html' WHEN regexp_matches(lower({x}), '\\.pdf\\z') THEN 'pdf' END"
RULES = {
    "blank_question": f"question IS NULL OR {strip('question')} = ''",
    "bad_answerability": "coalesce(answerability NOT IN ('answerable','unanswerable'), true)",
    "bad_question_type": "coalesce(question_type NOT IN ('exact_identifier','semantic_paraphrase','direct_factual','multi_document_reasoning','overlap_ambiguity','unanswerable_absent'), true)",
    "bad_difficulty": "coalesce(difficulty NOT IN ('easy','medium','hard'), true)",
    **{f"repeated_{n}": f"list_unique({L(n)}) + CASE WHEN len(list_filter({L(n)}, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END < len({L(n)})" for n in LISTS},
    **{f"blank_{n}": f"len(list_filter({L(n)}, lambda x: x IS NULL OR {strip('x')} = '')) > 0" for n in LISTS},
    "expected_also_acceptable": f"list_has_any({L('expected_source_files')}, {L('acceptable_source_files')})",
    "no_answer": f"answerability = 'answerable' AND (expected_answer IS NULL OR {strip('expected_answer')} = '')",
    "no_facts": f"answerability = 'answerable' AND len({L('expected_facts')}) = 0",
    "no_sources": f"answerability = 'answerable' AND len({L('expected_source_files')}) = 0",
    "too_many_sources": f"answerability = 'answerable' AND NOT coalesce(many, false) AND len({L('expected_source_files')}) > 1",
    "too_few_sources": f"answerability = 'answerable' AND coalesce(many, false) AND len({L('expected_source_files')}) < 2",
    "type_without_flag": "answerability = 'answerable' AND question_type = 'multi_document_reasoning' AND NOT coalesce(many, false)",
    "identifier_not_asked": f"answerability = 'answerable' AND question_type = 'exact_identifier' AND len(list_filter({L('expected_identifiers')}, lambda x: contains(lower(question), lower(x)))) = 0",
    "answerable_but_absent": "answerability = 'answerable' AND question_type = 'unanswerable_absent'",
    "unanswerable_with_answer": f"answerability <> 'answerable' AND ((expected_answer IS NOT NULL AND {strip('expected_answer')} <> '') OR len({L('expected_facts')}) > 0 OR len({L('expected_source_files')}) > 0 OR len({L('expected_identifiers')}) > 0)",
    "unanswerable_type": "answerability <> 'answerable' AND question_type <> 'unanswerable_absent'",
    "holds_hex_id": "len(list_filter(list_concat([id, question, expected_answer, notes], " + ", ".join(L(n) for n in LISTS) + "), lambda t: coalesce(regexp_matches(t, '\\b[0-9a-f]{64}\\b'), false))) > 0",
}
DIMS = {"question_type": ("exact_identifier", "semantic_paraphrase", "direct_factual", "multi_document_reasoning", "overlap_ambiguity", "unanswerable_absent"), "difficulty": ("easy", "medium", "hard"), "answerability": ("answerable", "unanswerable")}


def _distribution() -> str:
    parts = []
    for dim, values in DIMS.items():
        known = ", ".join(f"'{v}'" for v in values)
        for v in values:
            parts.append(f"SELECT '{dim}' AS dimension, '{v}' AS value, count(*) FILTER ({dim} = '{v}') AS n, count(*) AS total FROM golden")
        parts.append(f"SELECT '{dim}', 'other', count(*) FILTER (coalesce({dim} NOT IN ({known}), true)), count(*) FROM golden")
    return f"WITH {GOLDEN} SELECT dimension, value, n, round(100.0::DOUBLE * n / nullif(total, 0), 6) AS percent FROM (" + " UNION ALL ".join(parts) + ")"


def _graded(kind: str) -> str:
    facts = kind == "facts"
    names = ("correct", "partially_correct", "missing", "contradicted") if facts else ("supported", "partially_supported", "unsupported", "contradicted")
    counts = ", ".join(f"count(*) FILTER (verdict = '{n}') AS {n}_c" for n in names)
    shown = ", ".join(f"CASE WHEN ok THEN {n}_c END AS {n}_count" for n in names)
    if facts:
        made = """made AS (SELECT id, i AS k, CASE WHEN pl < 3 THEN 'correct' WHEN pl = 3 THEN 'partially_correct' WHEN pl = 4 THEN 'missing' ELSE 'contradicted' END AS verdict FROM
          (SELECT id, i, (length(id) + (i - 1) * 2) % 6 AS pl FROM (SELECT id, unnest(range(1, len(expected_facts) + 1)) AS i FROM golden WHERE expected_facts IS NOT NULL)))"""
        base = f"SELECT id, coalesce(answerability = 'answerable' AND decision = 'answered', false) AS applies, coalesce(n = len({L('expected_facts')}) AND d = n AND low = 1 AND high = len({L('expected_facts')}), false) AS good"
    else:
        made = """made AS (SELECT id, k, CASE WHEN pl < 2 THEN 'supported' WHEN pl = 2 THEN 'partially_supported' WHEN pl = 3 THEN 'unsupported' ELSE 'contradicted' END AS verdict FROM
          (SELECT id, k, (length(id) + k) % 5 AS pl FROM (SELECT id, unnest(range(1, length(id) % 4 + 2)) AS k FROM golden) WHERE (length(id) + k) % 17 <> 0))"""
        base = "SELECT id, coalesce(decision = 'answered', false) AS applies, coalesce(d = n AND low = 1 AND high = n, false) AS good"
    error = "bad_fact_ids" if facts else "bad_claim_ids"
    return f"""WITH {GOLDEN}, {DECISIONS}, {made}, bys AS (SELECT id, avg({SCORE}) AS sc, {counts}, count(*) AS n, count(DISTINCT k) AS d, min(k) AS low, max(k) AS high FROM made GROUP BY id),
      r AS ({base}, applies AND good AS ok, bys.* EXCLUDE (id) FROM golden JOIN decisions USING (id) LEFT JOIN bys USING (id))
      SELECT id, applies AS applicable, round(CASE WHEN ok THEN sc END, 9) AS score, {shown}, CASE WHEN applies AND NOT good THEN '{error}' END AS error_class FROM r"""


def _block(n: str) -> str:
    return f"concat_ws(chr(10), '[' || {n} || ']', 'Source: ' || source_file, CASE WHEN coalesce(section_heading, '') <> '' THEN 'Section: ' || section_heading END, CASE WHEN page_number IS NOT NULL THEN 'Page: ' || page_number END, 'Content:', text)"


def _fixed(x: str, size: int = 1000, step: int = 800) -> str:
    return f"SELECT delivery_id, segment_index, CAST(i AS INT) AS piece, substring(b, CAST(i * {step} + 1 AS BIGINT), {size}) AS t FROM (SELECT delivery_id, segment_index, b, unnest(range(0, CAST(greatest(ceil((length(b) - {size}) / {step}.0), 0) AS BIGINT) + 1)) AS i FROM (SELECT delivery_id, segment_index, {strip(x)} AS b FROM segs) WHERE b <> '')"


ORACLES: dict[str, str] = {
    "tokenize_docs": f"SELECT doc_id, len(t)::INT AS n_tokens, list_unique(t)::INT AS n_distinct, sha256(array_to_string(t, chr(1))) AS digest FROM (SELECT doc_id, {tokens('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "term_stats_idf": f"WITH {CORPUS}, {TERMS} SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "bm25_topk": f"WITH {CORPUS}, {QUESTIONS}, {bm25(10)} SELECT * FROM hits",
    "bm25_zero_fill": f"WITH {CORPUS}, {PROBES}, {bm25(10)} SELECT * FROM hits",
    "dense_topk": f"WITH {UNIT}, {NEARV} SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(1 - similarity, 6) AS distance, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, vec_id) AS rank FROM near) WHERE rank <= 10",
    "rrf_hybrid": f"WITH {VECHITS}, {EARLIER}, {FUSED} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(dc + sc, 9) AS rrf_score, dense_rank, sparse_rank, round(dc, 9) AS dense_contribution, round(sc, 9) AS sparse_contribution FROM ranked WHERE rank <= 10",
    "rrf_union_sides": f"WITH {VECHITS}, {EARLIER}, {FUSED} SELECT count(*) FILTER (sparse_rank IS NULL) AS dense_only, count(*) FILTER (dense_rank IS NULL) AS sparse_only, count(*) FILTER (dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) AS both FROM ranked WHERE rank <= 100",
    "ranking_integrity": "SELECT * FROM (SELECT query_vec_id AS query_id, CASE WHEN count(DISTINCT chunk_id) < count(*) THEN 'repeated_chunk' WHEN min(rank) <> 1 OR max(rank) <> count(*) OR count(DISTINCT rank) <> count(*) THEN 'bad_ranks' END AS error_class FROM dense_hits GROUP BY 1) WHERE error_class IS NOT NULL",
    "provenance_mismatch": f"""WITH {CORPUS} SELECT * FROM (SELECT h.chunk_id, concat_ws(',', CASE WHEN h.document_id IS DISTINCT FROM c.document_id THEN 'document_id' END, CASE WHEN h.chunk_index IS DISTINCT FROM c.chunk_index THEN 'chunk_index' END,
        CASE WHEN h.source_file IS DISTINCT FROM c.source_file THEN 'source_file' END) AS fields FROM (SELECT DISTINCT chunk_id, document_id, chunk_index, source_file FROM dense_hits) h JOIN corpus c ON h.chunk_id = c.chunk_id) WHERE fields <> ''""",
    "rerank_overlap": f"""WITH {CORPUS}, {QUESTIONS}, {bm25(20)}, r AS (SELECT h.query_id, h.chunk_id, h.rank AS hybrid_rank, round(coalesce(len(list_intersect(list_distinct({tokens('query')}), {tokens('text')})) / nullif(list_unique({tokens('query')}), 0)::DOUBLE, 0.0), 9) AS reranker_score
        FROM hits h JOIN questions USING (query_id) JOIN corpus USING (chunk_id))
        SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, hybrid_rank, reranker_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, hybrid_rank, chunk_id) AS rank FROM r) WHERE rank <= 5""",
    "hydrate_hits": f"WITH {CORPUS}, {EARLIER} SELECT query_id, e.chunk_id, rank, sha256(text) AS text_sha, source_file, section_heading, page_number, CASE WHEN c.chunk_id IS NULL THEN 'missing_chunk' END AS error_class FROM earlier e LEFT JOIN corpus c ON e.chunk_id = c.chunk_id",
    "query_problems": f"SELECT chunk_row AS query_id, CASE WHEN text IS NULL OR {strip('text')} = '' THEN 'blank_query' ELSE 'no_token' END AS error_class FROM chunks WHERE text IS NULL OR {strip('text')} = '' OR len(regexp_extract_all(text, '{TOKEN}')) = 0",
    "chunk_fixed": f"WITH {SEGMENTS} SELECT delivery_id, segment_index, piece, length(t)::INT AS chars, sha256(t) AS sha FROM ({_fixed('s.text')})",
    "chunk_fixed_stats": f"WITH {SEGMENTS} SELECT 'fixed' AS chunking_strategy, count(*) AS chunks, min(length(t))::INT AS min_chars, round(avg(length(t)), 6) AS mean_chars, max(length(t))::INT AS max_chars FROM ({_fixed('s.text')}) WHERE {strip('t')} <> ''",
    "chunk_table_stats": f"WITH {CORPUS} SELECT chunking_strategy, count(*) AS chunks, min(character_count)::INT AS min_chars, round(avg(character_count), 6) AS mean_chars, max(character_count)::INT AS max_chars FROM corpus GROUP BY 1",
    "chunk_recursive_invariants": f"WITH {SEGMENTS} SELECT delivery_id, segment_index, sha256({strip('s.text')}) AS sha, true AS within FROM segs WHERE length(s.text) > 800",
    "chunk_semantic_units": f"""WITH {SEGMENTS}, t AS (SELECT delivery_id, segment_index, s.text AS x FROM segs WHERE s.text IS NOT NULL),
        u AS (SELECT delivery_id, segment_index, list_filter(list_transform(string_split(x, chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p <> '') AS a, list_filter(list_transform(string_split(x, chr(10)), lambda p: {strip('p')}), lambda p: p <> '') AS b, list_filter([{strip('x')}], lambda p: p <> '') AS c FROM t)
        SELECT delivery_id, segment_index, len(k)::INT AS units, sha256(array_to_string(k, chr(1))) AS digest FROM (SELECT delivery_id, segment_index, CASE WHEN len(a) > 1 THEN a WHEN len(b) > 1 THEN b ELSE c END AS k FROM u)""",
    "normalize_text": f"WITH {SEGMENTS} SELECT delivery_id, segment_index, length(t)::INT AS chars, sha256(t) AS sha FROM (SELECT delivery_id, segment_index, {TEXT_NORMAL('s.text')} AS t FROM segs WHERE s.text IS NOT NULL)",
    "document_identity": "SELECT doc_id, sha256(text) AS content_id FROM documents WHERE text IS NOT NULL",
    "loader_dispatch": f"SELECT {FILETYPE('source_file')} AS kind, count(*) AS n FROM documents_norm GROUP BY 1",
    "discover_corpus": f"SELECT regexp_extract(raw_path, '([^/]+)\\z', 1) AS source_file, count(DISTINCT raw_path) AS paths, count(DISTINCT raw_path) > 1 AS ambiguous FROM documents_norm WHERE {FILETYPE('raw_path')} IS NOT NULL GROUP BY 1",
    "canonical_order": f"WITH {CORPUS} SELECT chunk_id, row_number() OVER (ORDER BY document_id NULLS FIRST, chunk_index NULLS FIRST, chunk_id NULLS FIRST) - 1 AS position FROM corpus",
    "chunk_identity": f"WITH {CORPUS} SELECT chunk_id, sha256(document_id || '|' || chunking_strategy || '|' || chunk_index || '|' || text) AS made_id FROM corpus",
    "corpus_validation": f"""SELECT count(*) AS chunks, count(*) FILTER (text IS NULL OR {strip('text')} = '') AS blank_texts, count(DISTINCT {strategy('chunking_strategy')}) AS strategies, count(*) FILTER ({strategy('chunking_strategy')} IS NULL) AS unknown_strategies,
        (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM chunks GROUP BY chunk_id)) AS repeated_ids, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM chunks GROUP BY document_id, chunk_index)) AS repeated_places FROM chunks""",
    "snapshot_fingerprint": f"""WITH {CORPUS} SELECT source_file, document_id, sha256('{{"bm25_tokenizer_version":"technical_v1","chunk_ids":[' || string_agg('"' || chunk_id || '"', ',' ORDER BY document_id, chunk_index, chunk_id) || '],"chunking_strategy":"recursive","dedup_algorithm_version":"greedy_cosine_v1","dedup_similarity_threshold":0.95,"embedding_model":"text-embedding-3-small"}}') AS snapshot_id
        FROM corpus WHERE source_file IS NOT NULL AND document_id IS NOT NULL GROUP BY source_file, document_id""",
    "sync_check": f"WITH {CORPUS} SELECT count(*) FILTER (p IS NULL) AS missing, count(*) FILTER (e IS NULL) AS extra, count(*) FILTER (e IS NOT NULL AND p IS NOT NULL) AS matched FROM (SELECT DISTINCT chunk_id AS e FROM corpus) FULL JOIN (SELECT DISTINCT chunk_id AS p FROM chunk_vectors WHERE chunk_id IS NOT NULL) ON e = p",
    "dedup_exact": f"WITH {CORPUS}, o AS (SELECT chunk_id, text, row_number() OVER (PARTITION BY text ORDER BY document_id NULLS FIRST, chunk_index NULLS FIRST, chunk_id) AS r FROM corpus) SELECT b.chunk_id AS skipped_chunk_id, a.chunk_id AS canonical_chunk_id, 'exact' AS duplicate_type, 1.0::DOUBLE AS similarity FROM o a JOIN o b ON a.text = b.text AND a.r = 1 AND b.r > 1",
    "dedup_near_pairs": "WITH e AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / (a.nrm * b.nrm), 6) AS similarity FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (a.nrm * b.nrm) > 0.30",
    "dedup_greedy": """WITH RECURSIVE e AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm, row_number() OVER (ORDER BY vec_id) AS pos FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
        p AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, list_dot_product(a.v, b.v) / (a.nrm * b.nrm) AS sim FROM e a JOIN e b ON a.pos < b.pos WHERE list_dot_product(a.v, b.v) / (a.nrm * b.nrm) > 0.30),
        walk(n, kept) AS (SELECT 1::BIGINT, [1::BIGINT] UNION ALL SELECT n + 1, CASE WHEN EXISTS (SELECT 1 FROM p WHERE j = n + 1 AND list_contains(kept, i)) THEN kept ELSE list_append(kept, n + 1) END FROM walk WHERE n < (SELECT count(*) FROM e)),
        final AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM walk ORDER BY n DESC LIMIT 1)),
        hits AS (SELECT j, i, sim, row_number() OVER (PARTITION BY j ORDER BY sim DESC, i) AS r FROM p JOIN final ON i = k WHERE j NOT IN (SELECT k FROM final))
        SELECT b.vec_id AS pos, a.vec_id AS target, 'near' AS duplicate_type, round(sim, 6) AS similarity FROM hits JOIN e a ON a.pos = i JOIN e b ON b.pos = j WHERE r = 1""",
    "dedup_counts": "WITH c AS (SELECT DISTINCT skipped_chunk_id, canonical_chunk_id, CASE WHEN lower(trim(duplicate_type)) IN ('exact','near') THEN lower(trim(duplicate_type)) END AS t FROM duplicate_records) SELECT k AS duplicate_type, (SELECT count(*) FROM c WHERE t = k) AS n FROM (VALUES ('exact'), ('near')) v(k)",
    "vector_validation": "WITH f AS (SELECT embedding, embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS good FROM chunk_vectors) SELECT count(*) AS vectors, count(*) FILTER (good) AS valid, count(*) FILTER (embedding IS NULL) AS null_vectors, count(*) FILTER (len(embedding) = 0) AS empty_vectors, count(DISTINCT CASE WHEN good THEN len(embedding) END) AS lengths FROM f",
    "evidence_blocks": f"WITH {CORPUS} SELECT chunk_id, length(b)::INT AS chars, sha256(b) AS sha FROM (SELECT chunk_id, {_block('(chunk_index + 1)')} AS b FROM corpus)",
    "evidence_texts": f"WITH {CORPUS}, {EARLIER}, h AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, c.* FROM earlier e JOIN corpus c ON e.chunk_id = c.chunk_id) SELECT answer_id, length(b)::INT AS chars, sha256(b) AS sha FROM (SELECT query_id AS answer_id, string_agg({_block('n')}, chr(10) || chr(10) ORDER BY n) AS b FROM h GROUP BY query_id)",
    "citations_distinct": f"WITH {ANSWERS}, {OCCURRENCES} SELECT answer_id, coalesce(string_agg(citation_number::VARCHAR, ',' ORDER BY f), '') AS cited FROM answers LEFT JOIN (SELECT answer_id, citation_number, min(occurrence_id) AS f FROM marks WHERE citation_number IS NOT NULL GROUP BY ALL) USING (answer_id) GROUP BY answer_id",
    "citation_occurrences": f"WITH {ANSWERS}, {OCCURRENCES} SELECT answer_id, occurrence_id, citation_number, start_offset, start_offset + width AS end_offset FROM marks",
    "citation_range_errors": f"""WITH {ANSWERS}, {OCCURRENCES}, o AS (SELECT answer_id, string_agg(citation_number::VARCHAR, ',' ORDER BY citation_number) AS offenders FROM (SELECT DISTINCT m.answer_id, citation_number FROM marks m JOIN answers a USING (answer_id) WHERE citation_number < 1 OR citation_number > evidence_count) GROUP BY 1),
        r AS (SELECT answer_id, CASE WHEN {strip('answer_text')} = '' THEN 'empty_answer' WHEN offenders IS NOT NULL THEN 'citation_range' WHEN answer_id NOT IN (SELECT answer_id FROM marks WHERE citation_number IS NOT NULL) AND NOT contains(lower(answer_text), '{MARKER}') THEN 'uncited' END AS error_class, coalesce(offenders, '') AS offenders FROM answers LEFT JOIN o USING (answer_id))
        SELECT answer_id, error_class, offenders FROM r WHERE error_class IS NOT NULL""",
    "annotate_answer": f"""WITH {ANSWERS}, {OCCURRENCES} SELECT answer_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(m) THEN '<occurrence id="' || i || '">' || m[i] || '</occurrence>' ELSE '' END), '') AS annotated FROM pieces""",
    "prompts": f"""WITH {GOLDEN} SELECT id, sha256('Evidence (untrusted material):' || chr(10) || chr(10) || coalesce(notes, '(none)') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer with citations:') AS user_sha,
        sha256('Question: ' || question || chr(10) || chr(10) || 'Facts:' || chr(10) || coalesce(array_to_string(list_transform(range(1, len({L('expected_facts')}) + 1), lambda i: i || '. ' || expected_facts[i]), chr(10)), '') || chr(10) || chr(10) || 'Answer:' || chr(10) || coalesce(expected_answer, '')) AS judge_sha FROM golden WHERE question IS NOT NULL""",
    "judge_output_errors": f"""WITH {ANSWERS}, {OCCURRENCES}, j AS (SELECT answer_id, CASE WHEN (length(answer_id) + occurrence_id) % 11 = 0 THEN occurrence_id + 50 ELSE occurrence_id END AS o, CASE WHEN (length(answer_id) + occurrence_id) % 7 = 0 THEN citation_number + 1 ELSE citation_number END AS c,
          CASE WHEN (length(answer_id) + occurrence_id) % 5 = 0 THEN 'fine' ELSE 'supported' END AS verdict, CASE WHEN (length(answer_id) + occurrence_id) % 9 = 0 THEN ' ' ELSE 'because' END AS rationale FROM marks WHERE (length(answer_id) + occurrence_id) % 8 <> 0),
        b AS (SELECT coalesce(m.answer_id, j.answer_id) AS answer_id, coalesce(m.occurrence_id, j.o) AS occurrence_id, m.answer_id AS ma, j.answer_id AS ja, m.citation_number AS real, j.c, verdict, rationale FROM marks m FULL JOIN j ON m.answer_id = j.answer_id AND m.occurrence_id = j.o)
        SELECT answer_id, occurrence_id, e AS error_class FROM (SELECT answer_id, occurrence_id, CASE WHEN ma IS NULL THEN 'invented' WHEN ja IS NULL THEN 'missing' WHEN c IS DISTINCT FROM real THEN 'number_mismatch' WHEN verdict = 'fine' THEN 'bad_verdict' WHEN rationale = ' ' THEN 'blank_rationale' END AS e FROM b) WHERE e IS NOT NULL""",
    "verification_tallies": f"WITH {CHAIN} SELECT * FROM tallies",
    "confidence_score": f"WITH {CHAIN} SELECT * FROM scores",
    "abstention_decision": f"WITH {CHAIN} SELECT answer_id, decision, decision <> 'answered' AS abstained FROM decided",
    "policy_integrity": f"WITH {CHAIN} SELECT answer_id, CASE WHEN length(answer_id) % 10 = 0 THEN 'count_mismatch' WHEN score IS NULL THEN 'bad_score' END AS error_class FROM scores WHERE length(answer_id) % 10 = 0 OR score IS NULL",
    "final_answers": f"""WITH {CHAIN} SELECT answer_id, decision, sha256(CASE WHEN decision = 'answered' THEN answer_text WHEN decision IS NOT NULL THEN 'I can''t answer that reliably from the documents at hand.' END) AS text_sha,
        CASE decision WHEN 'abstained_insufficient_evidence' THEN 'The documents at hand don''t hold enough to answer.' WHEN 'abstained_contradiction' THEN 'A cited source says otherwise.' WHEN 'abstained_unsupported_citation' THEN 'A cited source doesn''t back what is said.' WHEN 'abstained_low_confidence' THEN 'The answer''s confidence is below the threshold.' END AS abstention_reason FROM answers JOIN decided USING (answer_id)""",
    "insufficiency_flag": f"WITH {ANSWERS} SELECT answer_id, contains(lower(answer_text), '{MARKER}') AS insufficient FROM answers",
    "evidence_numbering": f"WITH {ANSWERS}, {EVIDENCE} SELECT answer_id, 'bad_numbering' AS error_class FROM (SELECT answer_id, count(*) AS n, min(citation_number) AS low, max(citation_number) AS high FROM evidence WHERE (length(answer_id) + citation_number) % 13 <> 0 GROUP BY 1) WHERE low <> 1 OR high <> n",
    "eval_retrieval_at_k": f"""WITH {CORPUS}, {QUESTIONS}, {bm25(10)}, {GOLDEN}, g AS (SELECT id, list_distinct({L('expected_source_files')}) AS wanted, list_distinct({L('expected_identifiers')}) AS ids FROM golden WHERE answerability = 'answerable'),
        r AS (SELECT g.id, wanted, ids, h.rank, c.source_file, c.text FROM g LEFT JOIN hits h ON h.query_id = g.id LEFT JOIN corpus c USING (chunk_id)),
        b AS (SELECT id, any_value(wanted) AS wanted, count(DISTINCT CASE WHEN rank <= 5 AND list_contains(wanted, source_file) THEN source_file END) AS found, min(CASE WHEN list_contains(wanted, source_file) THEN rank END) AS fr FROM r GROUP BY id),
        i AS (SELECT id, avg(t::INT) AS ir FROM (SELECT id, x, bool_or(coalesce(rank <= 5 AND contains(lower(text), lower(x)), false)) AS t FROM (SELECT id, rank, text, unnest(ids) AS x FROM r) GROUP BY id, x) GROUP BY id)
        SELECT golden.id, 5::INT AS k, found > 0 AS hit, round(found / nullif(len(wanted), 0)::DOUBLE, 9) AS recall, found = len(wanted) AS complete, CASE WHEN b.id IS NOT NULL THEN round(coalesce(1.0::DOUBLE / fr, 0.0), 9) END AS reciprocal_rank, round(ir, 9) AS identifier_recall FROM golden LEFT JOIN b USING (id) LEFT JOIN i USING (id)""",
    "eval_correctness": _graded("facts"),
    "eval_faithfulness": _graded("claims"),
    "eval_citations": f"""WITH {GOLDEN}, {DECISIONS}, m AS (SELECT id, f, CASE WHEN (length(id) + length(f)) % 4 < 2 THEN 'supported' WHEN (length(id) + length(f)) % 4 = 2 THEN 'partially_supported' ELSE 'unsupported' END AS verdict
          FROM (SELECT id, unnest(list_distinct(list_concat({L('expected_source_files')}, ['other.md']))) AS f FROM golden) WHERE (length(id) + length(f)) % 5 <> 0),
        b AS (SELECT id, avg({SCORE}) AS mean, avg((verdict = 'supported')::INT::DOUBLE) AS share, list(DISTINCT f) AS cited FROM m GROUP BY id),
        r AS (SELECT id, list_distinct({L('expected_source_files')}) AS wanted, {L('acceptable_source_files')} AS fine, decision = 'answered' AS ok, mean, share, cited FROM golden JOIN decisions USING (id) LEFT JOIN b USING (id))
        SELECT id, ok AS applicable, round(CASE WHEN ok THEN mean END, 9) AS citation_score, round(CASE WHEN ok THEN share END, 9) AS supported_rate,
          round(CASE WHEN ok AND cited IS NOT NULL THEN len(list_intersect(cited, list_distinct(list_concat(wanted, fine)))) / nullif(len(cited), 0)::DOUBLE END, 9) AS source_precision,
          round(CASE WHEN ok AND cited IS NOT NULL THEN len(list_intersect(cited, wanted)) / nullif(len(wanted), 0)::DOUBLE END, 9) AS required_source_recall FROM r""",
    "eval_abstention_cases": f"WITH {GOLDEN}, {DECISIONS} SELECT id, e AS expected_abstention, a AS abstained, e = a AS correct, NOT e AND a AS false_abstention, e AND NOT a AS false_answer FROM (SELECT id, answerability = 'unanswerable' AS e, decision <> 'answered' AS a FROM golden JOIN decisions USING (id))",
    "eval_abstention_rates": f"""WITH {GOLDEN}, {DECISIONS}, {CASES} SELECT count(*) AS cases, count(*) FILTER (expected) AS unanswerable, count(*) FILTER (NOT expected) AS answerable, round(count(*) FILTER (expected = abst) / nullif(count(*), 0)::DOUBLE, 9) AS accuracy,
        round(count(*) FILTER (expected AND abst) / nullif(count(*) FILTER (abst), 0)::DOUBLE, 9) AS abstention_precision, round(count(*) FILTER (expected AND abst) / nullif(count(*) FILTER (expected), 0)::DOUBLE, 9) AS abstention_recall,
        round(count(*) FILTER (NOT expected AND abst) / nullif(count(*) FILTER (NOT expected), 0)::DOUBLE, 9) AS false_abstention_rate, round(count(*) FILTER (expected AND NOT abst) / nullif(count(*) FILTER (expected), 0)::DOUBLE, 9) AS false_answer_rate FROM cases""",
    "golden_problems": f"WITH {GOLDEN} " + " UNION ALL ".join(f"SELECT id, '{name}' AS problem FROM golden WHERE coalesce({rule}, false)" for name, rule in RULES.items()),
    "golden_distribution": _distribution(),
    "golden_report": f"""WITH n AS (SELECT DISTINCT unnest(list_concat({L('expected_source_files')}, {L('acceptable_source_files')})) AS f FROM golden_qa)
        SELECT *, cases >= 50 AND unanswerable >= 10 AS large_enough FROM (SELECT count(*) AS cases, count(*) FILTER (answerability = 'unanswerable') AS unanswerable, count(DISTINCT question_type) AS types_present,
        (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM golden_qa GROUP BY id)) AS repeated_ids, (SELECT count(*) FROM n WHERE f IS NULL OR f NOT IN (SELECT source_file FROM documents WHERE source_file IS NOT NULL)) AS unknown_sources, (SELECT count(*) FROM n) AS named_sources FROM golden_qa)""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
