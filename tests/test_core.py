"""Edge cases of the core operators on small hand-made rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.config import Settings
from scriptorium.errors import ChunkingError, EvaluationError, GenerationError, IndexingError, IngestionError, RetrievalError, SettingsError
from scriptorium.functions import text as X
from scriptorium.functions import vectors as V
from scriptorium.operators import answers as A
from scriptorium.operators import chunking as C
from scriptorium.operators import corpus as D
from scriptorium.operators import evaluation as E
from scriptorium.operators import retrieval as R
from scriptorium.plans import pipeline, snapshot
from scriptorium.sources import files, parsers
from scriptorium.streaming.ingest import run_ingest


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("r")).first()[0]


# -- text --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [("Upgrade from v1.2.3 to v2.10.0", ["upgrade", "from", "v1.2.3", "to", "v2.10.0"]), ("ERR_DB_1042", ["err_db_1042"]), ("", []), ("Größe größer", ["größe", "größer"]), (None, None)],
)
def test_tokenize(spark, text, want):
    assert one(spark, text, X.tokenize) == want


def test_normalize_text(spark):
    assert one(spark, "\x00 a\t\r\nb \x1f\r\r\n\n\nc\n\n", X.normalize_text) == "a\nb\n\nc"
    assert one(spark, None, X.normalize_text) is None


def test_citations(spark):
    text = "A [1]. B [2]. C [1]."
    assert one(spark, text, X.citations) == [1, 2]
    rows = one(spark, text, X.citation_occurrences)
    assert [(r.occurrence_id, r.citation_number, text[r.start_offset : r.end_offset]) for r in rows] == [(1, 1, "[1]"), (2, 2, "[2]"), (3, 1, "[1]")]
    assert one(spark, text, X.annotate) == 'A <occurrence id="1">[1]</occurrence>. B <occurrence id="2">[2]</occurrence>. C <occurrence id="3">[1]</occurrence>.'
    assert one(spark, "", X.citation_occurrences) == []
    assert one(spark, "[99999999999999999999]", X.citations) == []


def test_evidence_block(spark):
    row = spark.createDataFrame([(1, "a.md", "", None, "t"), (2, "b.md", "S", 3, "u")], "n int, s string, h string, p int, t string")
    got = [r[0] for r in row.select(X.evidence_block(F.col("n"), F.col("s"), F.col("h"), F.col("p"), F.col("t"))).collect()]
    assert got == ["[1]\nSource: a.md\nContent:\nt", "[2]\nSource: b.md\nSection: S\nPage: 3\nContent:\nu"]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(F.round(V.cosine(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [0.707107, 0.0, None, None]
    valid = spark.createDataFrame([([1.0],), ([],), ([None],), ([float("nan")],), ([float("inf")],), (None,)], "a array<double>").select(V.is_valid(F.col("a")))
    assert [r[0] for r in valid.collect()] == [True, False, False, False, False, False]


# -- chunking ----------------------------------------------------------------------------------------

TEXTS = st.text(alphabet="ab .\n\tä漢", max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(4, 60))
def test_pack_reconstructs(text, size):
    pieces = C.pack(text, size)
    assert "".join(pieces) == text.strip()
    assert all(len(p) <= size for p in pieces)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.sampled_from([(60, 15), (30, 7), (20, 0)]))
def test_recursive_pieces_fit(text, shape):
    assert all(len(p) <= shape[0] for p in C.recursive_pieces(text, *shape))


def test_pack_keeps_sentences():
    assert C.pack("One two. Three four. Five.", 12) == ["One two. ", "Three four. ", "Five."]
    assert C.pack("  ", 5) == [] and C.pack(None, 5) == []


def test_fixed_windows(spark):
    assert one(spark, " abcdefghij ", lambda c: C.fixed_windows(c, 4, 1)) == ["abcd", "defg", "ghij"]
    assert one(spark, "abc", lambda c: C.fixed_windows(c, 4, 1)) == ["abc"]
    assert one(spark, " ", lambda c: C.fixed_windows(c, 4, 1)) == []
    with pytest.raises(ChunkingError):
        C.fixed_windows(F.lit("a"), 4, 4)


def test_semantic_groups():
    units = ["a", "b", "c"]
    assert C.group_units(units, [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0]], 0.5, 100) == ["a\n\nb", "c"]
    assert C.group_units(units, [[1.0], [1.0], [1.0]], 0.5, 4) == ["a\n\nb", "c"]
    assert C.semantic_pieces("x", lambda u: pytest.fail("called"), 0.5, 10) == ["x"]


def test_chunk_documents(spark):
    schema = "document_id string, source_file string, segments array<struct<text:string,section_heading:string,page_number:int>>, text string, chunk_id int"
    rows = [("d1", "a.md", [("word " * 300, "H", None), None, ("", None, 2), ("tail", None, 2)], "clash", 1), ("d2", "b.md", None, None, None), ("d3", "c.md", [], None, None)]
    documents = spark.createDataFrame(rows, schema)
    for strategy in ("fixed", "recursive", "semantic"):
        got = C.chunk_documents(documents, strategy=strategy).orderBy("chunk_index").collect()
        assert [r.chunk_index for r in got] == list(range(len(got))) and {r.document_id for r in got} == {"d1"}
        assert got[-1].text == "tail" and got[-1].page_number == 2 and all(r.character_count == len(r.text) <= 1000 for r in got)
        assert len({r.chunk_id for r in got}) == len(got)
    assert C.chunk_documents(documents.limit(0), strategy="recursive").count() == 0
    with pytest.raises(ChunkingError):
        C.chunk_documents(documents, strategy="other")


# -- duplicates --------------------------------------------------------------------------------------


def dedup(spark, rows, threshold):
    frame = spark.createDataFrame(rows, "pos bigint, text string, embedding array<double>")
    kept, duplicates = D.deduplicate(frame, threshold)
    return sorted(r.pos for r in kept.collect()), sorted((r.pos, r.target, r.duplicate_type) for r in duplicates.collect())


def angle(degrees):
    import math

    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def test_dedup_chain_keeps_the_third(spark):
    assert dedup(spark, [(0, "a", angle(0)), (1, "b", angle(20)), (2, "c", angle(40))], 0.9) == ([0, 2], [(1, 0, "near")])


def test_dedup_threshold_is_strict_and_zero_vectors_are_near_to_nothing(spark):
    same = [0.6, 0.8]
    assert dedup(spark, [(0, "a", same), (1, "b", same)], 1.0)[0] == [0, 1]
    assert dedup(spark, [(0, "a", [0.0, 0.0]), (1, "b", [0.0, 0.0])], 0.0)[0] == [0, 1]


def test_dedup_exact_and_late_copies(spark):
    rows = [(0, "a", angle(0)), (1, "a", angle(0)), (2, "b", angle(10)), (3, "c", angle(80)), (4, "b", angle(10))]
    assert dedup(spark, rows, 0.9) == ([0, 3], [(1, 0, "exact"), (2, 0, "near"), (4, 0, "near")])
    assert dedup(spark, [], 0.9) == ([], [])


def test_near_pairs_do_not_depend_on_blocks(spark):
    frame = spark.createDataFrame([(i, angle(i * 7 % 90)) for i in range(40)], "pos bigint, v array<double>")
    results = [sorted((r.a, r.b) for r in D.near_pairs(frame, 0.95, size).collect()) for size in (1_000, 7, 3)]
    assert results[0] == results[1] == results[2] and results[0]


def test_near_pairs_of_turns_are_all_pairs_and_no_row_is_copied(spark, monkeypatch):
    """Two turns and blocks of 7 give what brute force gives; rows don't go to each block (F8)."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    rows = np.vstack([base, base[:20] + rng.normal(size=(20, 32)) * 0.15, np.zeros((1, 32))])
    unit = rows / np.where(np.linalg.norm(rows, axis=1) > 0, np.linalg.norm(rows, axis=1), 1)[:, None]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "pos bigint, v array<double>")
    monkeypatch.setattr(D, "TURN_BLOCKS", 6, raising=False)
    for threshold in (0.95, 0.5):
        pairs = D.near_pairs(frame, threshold, 7)
        want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if unit[i] @ unit[j] > threshold}
        got = [(r.a, r.b) for r in pairs.collect()]
        assert want and len(got) == len(set(got)) and set(got) == want
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "FlatMapGroups" not in plan


def test_canonical_positions(spark):
    rows = [(f"c{i}", f"d{i % 3}", i, "t") for i in range(50)]
    frame = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string")
    want = {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2], r[0])))}
    assert {r.chunk_id: r.position for r in D.canonical_positions(frame).collect()} == want


# -- retrieval ---------------------------------------------------------------------------------------


def chunks_of(spark, texts):
    rows = [(f"c{i}", "d", i, t, f"f{i}.md", None, None, "recursive") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string, source_file string, section_heading string, page_number int, chunking_strategy string")


def test_bm25_fills_with_zero_scores_and_ranks_negative_last(spark):
    chunks = chunks_of(spark, ["the cat", "the dog", "the the bird", "fish"])
    queries = spark.createDataFrame([("q1", "cat"), ("q2", "unknown"), ("q3", " "), ("q4", "cat cat")], "query_id string, query string")
    got = {}
    for r in R.bm25_topk(queries, chunks, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.bm25_score))
    assert [c for c, _ in got["q1"]] == ["c0", "c1", "c2"] and got["q1"][0][1] > 0 and got["q1"][1][1] == 0
    assert got["q2"] == [("c0", 0.0), ("c1", 0.0), ("c2", 0.0)] and "q3" not in got
    assert got["q4"][0][1] == pytest.approx(2 * got["q1"][0][1], abs=1e-5)


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, rank int")


@pytest.mark.parametrize("head", [3, 50_000])
def test_bm25_fill_of_queries_that_score_nearly_all(spark, monkeypatch, head):
    """The free chunks lie at the end of the canonical order, beyond the first head and beyond the last."""
    monkeypatch.setattr(R, "MOST_HEAD", head)
    rows = [(f"c{i:03d}", "d", i, "common words here") for i in range(120)] + [(f"z{i}", "e", i, "other") for i in range(2)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string")
    queries = spark.createDataFrame([("q", "common"), ("none", "absent"), ("blank", " ")], "query_id string, query string")
    got = {}
    for r in R.bm25_topk(queries, chunks, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.bm25_score > 0))
    assert got == {"q": [("c000", True), ("c001", True), ("c002", True)], "none": [("c000", False), ("c001", False), ("c002", False)]} or [c for c, _ in got["q"]][:2] == ["z0", "z1"]
    with pytest.raises(RetrievalError):
        R.bm25_topk(queries, chunks, 0)


@pytest.mark.parametrize("block, turn", [(50_000, 100_000), (37, 20)])
def test_bm25_writes_what_is_best_only(spark, monkeypatch, block, turn):
    """Blocks and turns change nothing, scores are those of the formula in SQL, and not all of them are written."""
    import random

    from scriptorium.plans.session import materialize

    monkeypatch.setattr(R, "MOST_HEAD", block)
    monkeypatch.setattr(R, "ASKED_ROWS", turn, raising=False)
    rng, words = random.Random(4), [f"w{i}" for i in range(60)]
    texts = [" ".join(["common"] * rng.randrange(1, 4) + [words[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randrange(1, 30))]) for _ in range(400)]
    rows = [(f"c{i}", None if i % 50 == 0 else f"d{i % 7}", i % 11, t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string")
    asked = [(i, "common " + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))) for i in range(60)] + [(60, "absent"), (61, "w59 absent")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    written = []

    def counted(rows, name):
        kept = materialize(rows, name)
        written.append(kept.count())
        return kept

    monkeypatch.setattr(R, "materialize", counted)
    got = [tuple(r) for r in R.bm25_topk(queries, chunks, 5).orderBy("query_id", "rank").collect()]
    assert block < 400 or sum(written) < 10_000  # 24,000 scores at least
    chunks.createOrReplaceTempView("bm25_chunks"), queries.createOrReplaceTempView("bm25_queries")
    want = spark.sql("""
        WITH t AS (SELECT chunk_id, size(split(text, ' ')) AS dl, explode(split(text, ' ')) AS term FROM bm25_chunks), p AS (SELECT term, chunk_id, count(*) AS tf, first(dl) AS dl FROM t GROUP BY ALL),
          s AS (SELECT (SELECT count(*) FROM bm25_chunks) AS n, (SELECT sum(tf) FROM p) / (SELECT count(*) FROM bm25_chunks) AS avgdl),
          r AS (SELECT term, ln(n - count(*) + 0.5D) - ln(count(*) + 0.5D) AS raw FROM p, s GROUP BY term, n), i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25D * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
          q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, explode(split(trim(query), ' ')) AS term FROM bm25_queries) GROUP BY ALL),
          u AS (SELECT query_id, chunk_id, sum(qtf * CAST(round(idf * tf * 2.5D / (tf + 1.5D * (0.25D + 0.75D * dl / avgdl)) * 1e9D) AS BIGINT)) AS units FROM q JOIN p USING (term) JOIN i USING (term), s GROUP BY ALL),
          o AS (SELECT a.query_id, c.chunk_id, coalesce(units, 0) AS units, row_number() OVER (PARTITION BY a.query_id ORDER BY coalesce(units, 0) DESC, document_id NULLS FIRST, chunk_index, c.chunk_id) AS rank
            FROM bm25_queries a CROSS JOIN bm25_chunks c LEFT JOIN u ON u.query_id = a.query_id AND u.chunk_id = c.chunk_id)
        SELECT query_id, chunk_id, rank, round(units / 1e9D, 6) FROM o WHERE rank <= 5 ORDER BY query_id, rank""").collect()
    assert got == [tuple(r) for r in want]


def written_tables(monkeypatch):
    """The tables that the searches write, by name."""
    from scriptorium.plans.session import materialize

    kept = {}

    def noted(rows, name):
        kept.setdefault(name, []).append(materialize(rows, name))
        return kept[name][-1]

    monkeypatch.setattr(R, "materialize", noted)
    return kept


def test_bm25_writes_numbers_of_the_best_only(spark, monkeypatch):
    """What the tasks find is merged before it is written: k rows a query, without ids of chunks (F4)."""
    kept = written_tables(monkeypatch)
    chunks = chunks_of(spark, [f"word{i % 7} common text{i}" for i in range(200)]).repartition(8)
    queries = spark.createDataFrame([(i, f"word{i % 7} text{i}") for i in range(50)], "query_id int, query string")
    assert R.bm25_topk(queries, chunks, 20).count() == 1_000
    assert [t.columns for t in kept["found"]] == [["query_id", "place", "rank", "value"]] and kept["found"][0].count() == 1_000


def test_dense_search_writes_numbers_of_the_best_only(spark, monkeypatch):
    """The same of the dense search, in turns too, beside brute force (F3)."""
    import numpy as np

    kept = written_tables(monkeypatch)
    monkeypatch.setattr(R, "TURN_VALUES", 400, raising=False)
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(60, 8))
    x[100:150] = x[:50]  # ties
    vectors = spark.createDataFrame([(f"c{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id string, vector array<double>").repartition(8)
    queries = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(q)], "query_id int, vector array<double>")
    got = {}
    for r in R.dense_topk(queries, vectors, 10, 9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    sims = np.round(q @ x.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :], 12)
    assert got == {i: [f"c{j:03d}" for j in np.lexsort((np.arange(300), -sims[i]))[:10]] for i in range(60)}
    assert len(kept["found"]) > 1 and sum(t.count() for t in kept["found"]) == 600 and "chunk_id" not in kept["found"][0].columns


def test_dense_search_reduces_chunks_first(spark):
    """A chunk with many vectors takes one place; blocks, turns and ties change nothing."""
    rows = [("a", [1.0, 0.0])] * 40 + [("b", [0.9, 0.1]), ("c", [0.8, 0.2]), ("d", [0.8, 0.2]), ("z", None), ("y", [1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id bigint, vector array<double>")
    for blocks in (1, 3):
        got = [(r.query_id, r.chunk_id) for r in R.dense_topk(queries, vectors, 3, blocks).orderBy("query_id", "rank").collect()]
        assert got == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c")]
    assert {(r.query_id, r.error_class) for r in R.width_problems(queries.union(spark.createDataFrame([(4, [1.0] * 3)], queries.schema)), vectors).collect()} == {(3, "bad_vector"), (4, "width_mismatch")}


def test_hit_problems(spark):
    rows = [(1, "a", 1, 0.1, "t"), (1, " ", 2, 0.1, "t"), (1, "b", 0, 0.1, "t"), (1, "c", 4, float("nan"), "t"), (1, "d", 5, None, "t"), (1, "e", 6, -0.5, "t"), (1, "f", 7, 0.2, None)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, distance double, text string")
    assert {r.chunk_id: r.error_class for r in R.hit_problems(hits).collect()} == {" ": "no_id", "b": "bad_rank", "c": "bad_distance", "d": "bad_distance", "e": "bad_distance", "f": "no_text"}


def test_provider_answers_in_any_order():
    from scriptorium.providers import check_vectors

    assert check_vectors([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]] and check_vectors([], 0) == []
    for bad in ([(0, [1.0]), (0, [2.0])], [(0, [1.0]), (2, [2.0])], [[1.0]], [[1.0], []], [[1.0], [float("inf")]], [[1.0], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            check_vectors(bad, 2)


def test_hydration_compares_texts(spark):
    corpus = spark.createDataFrame([("a", "x", "d", 0, "f", None, None, "fixed")], "chunk_id string, text string, document_id string, chunk_index int, source_file string, section_heading string, page_number int, chunking_strategy string")
    hits = spark.createDataFrame([("q", "a", 1, "x"), ("r", "a", 1, "y"), ("s", "b", 1, "x")], "query_id string, chunk_id string, rank int, text string")
    assert {r.query_id: r.error_class for r in R.hydrate(hits, corpus).collect()} == {"q": None, "r": "text_mismatch", "s": "missing_chunk"}


def test_composites_and_their_checks(spark):
    corpus = spark.createDataFrame([(f"c{i}", t, "d", i, "f.md", None, None, "fixed") for i, t in enumerate(["Backups stay 9 days. More.", "Other words here."])], "chunk_id string, text string, document_id string, chunk_index int, source_file string, section_heading string, page_number int, chunking_strategy string")
    vectors = corpus.select("chunk_id", "text", pipeline.embedding_udf()(F.col("text")).alias("vector"))
    asked = spark.createDataFrame([("q", "how long do backups stay")], "query_id string, query string")
    done = pipeline.retrieve_generate_verify_and_score(asked, corpus, vectors)
    assert done.answers.first().answer_text.endswith("[1].") and done.verdicts.count() == 1 and done.scored.first().error_class is None
    assert pipeline.retrieve_and_generate(asked, corpus, vectors).verdicts is None
    blank = pipeline.Providers(generate=lambda question, evidence: F.lit(" "))
    invented = pipeline.Providers(judge=lambda answer, evidence: F.struct(F.lit("fine").alias("verdict"), F.lit("x").alias("rationale")))
    for providers, chain in ((blank, pipeline.retrieve_and_generate), (invented, pipeline.retrieve_generate_and_verify)):
        with pytest.raises(GenerationError):
            chain(asked, corpus, vectors, providers=providers)
    with pytest.raises(RetrievalError):  # another text beside the vectors than in the corpus
        pipeline.retrieve_hybrid(asked, corpus, vectors.withColumn("text", F.concat("text", F.lit("!"))))


def test_fusion_refuses_lists_that_disagree(spark):
    made = lambda text: spark.createDataFrame([("q", "x", 1, text)], "query_id string, chunk_id string, rank int, text string")
    assert R.rrf(made("t"), made("t")).count() == 1
    with pytest.raises(RetrievalError):
        R.rrf(made("t"), made("u"))


def test_rrf(spark):
    dense, sparse = ranking(spark, [("q", f"d{i}", i) for i in range(1, 5)] + [("q", "x", 5)]), ranking(spark, [("q", "x", 1)])
    assert R.rrf(dense, sparse).orderBy("rank").first().chunk_id == "x"
    even = Settings(rrf_dense_weight=0.5, rrf_sparse_weight=0.5)
    assert [r.chunk_id for r in R.rrf(ranking(spark, [("q", "z", 1)]), ranking(spark, [("q", "a", 1)]), even).orderBy("rank").collect()] == ["z", "a"]
    assert R.rrf(ranking(spark, []), ranking(spark, [])).count() == 0


def test_ranking_problems(spark):
    rows = [("a", "x", 1), ("a", "x", 2), ("b", "x", 1), ("b", "y", 3), ("c", "x", 1), ("c", "y", 2)]
    assert {r.query_id: r.error_class for r in R.ranking_problems(ranking(spark, rows)).collect()} == {"a": "repeated_chunk", "b": "bad_ranks"}


def test_rerank_puts_bad_scores_last(spark):
    rows = ranking(spark, [("q", "a", 1), ("q", "b", 2), ("q", "c", 3)])
    score = F.when(F.col("chunk_id") == "a", float("nan")).otherwise(1.0)
    got = R.rerank(rows, score, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "c", "a"] and got[2].rerank_error == "bad_score"


# -- answers and metrics -----------------------------------------------------------------------------


def test_policy_order(spark):
    rows = [("a", 0.1, False, True, 1, None), ("b", 0.8, False, False, 0, None), ("c", 0.79, False, False, 0, None), ("d", 0.9, False, False, 1, None), ("e", 0.0, True, False, 0, None), ("f", None, False, False, 0, "no_citation")]
    frame = spark.createDataFrame(rows, "answer_id string, score double, is_insufficient boolean, has_contradiction boolean, unsupported_count int, error_class string")
    got = {r.answer_id: r.decision for r in A.decide(frame).collect()}
    assert got == {"a": A.DECISIONS[2], "b": A.DECISIONS[0], "c": A.DECISIONS[4], "d": A.DECISIONS[3], "e": A.DECISIONS[1], "f": None}


def test_rates_without_cases_are_null(spark):
    row = E.abstention_rates(spark.createDataFrame([], "expected_abstention boolean, abstained boolean")).first()
    assert row.cases == 0 and row.accuracy is None and row.abstention_recall is None


def test_retrieval_metrics_null_rules(spark):
    cases = spark.createDataFrame([("u", "unanswerable", [], []), ("a", "answerable", ["x.md"], None)], "id string, answerability string, expected_source_files array<string>, expected_identifiers array<string>")
    results = spark.createDataFrame([("a", 3, "x.md", "t")], "query_id string, rank int, source_file string, text string")
    got = {r.id: r for r in E.retrieval_metrics(cases, results, 2).collect()}
    assert got["u"].recall is None and got["a"].hit is False and got["a"].reciprocal_rank == pytest.approx(1 / 3) and got["a"].identifier_recall is None


# -- sources -----------------------------------------------------------------------------------------


def test_parsers():
    assert parsers.parse_text(b"\xef\xbb\xbfhi\r\n") == [("hi", None, None)] and parsers.parse_text(b"") == [("", None, None)]
    md = b"intro `x`\n\n# A\n\ntext *em* [l](u) ![i](j)\nnext\n\n## B\n\n- one\n- two\n\n```\ncode  \n```\n\n# C\nend"
    assert parsers.parse_markdown(md) == [("intro x", None, None), ("text em l\nnext", "A", None), ("one\n\ntwo\n\ncode", "A > B", None), ("end", "C", None)]
    html = b"<html><head><title>t</title></head><body>x<h1>A</h1><p>one <b>two</b></p><ul><li>three<p>four</p></li></ul><script>no</script><h2>B</h2><pre>five</pre><!-- c --></body></html>"
    assert parsers.parse_html(html) == [("one two\n\nthree four", "A", None), ("five", "A > B", None)]
    assert parsers.parse("html", b"<div>only</div>") == ([], "no_text") and parsers.parse("txt", b"\xff") == ([], "extraction") and parsers.parse(None, b"x") == ([], "unsupported_type")


def tiny_pdf(pages):
    objects, kids = [], []
    for i, text in enumerate(pages):
        stream = b"BT /F1 12 Tf (" + text.encode() + b") Tj ET" if text else b""
        kids.append(f"{3 + 2 * i} 0 R")
        objects.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj" % (3 + 2 * i, 4 + 2 * i))
        objects.append(b"%d 0 obj << /Length %d >> stream\n%s\nendstream endobj" % (4 + 2 * i, len(stream), stream))
    head = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [%s] /Count %d >> endobj" % (" ".join(kids).encode(), len(pages))]
    return b"%PDF-1.4\n" + b"\n".join(head + objects) + b"\n%%EOF"


def test_pdf_pages_keep_their_numbers():
    assert parsers.parse_pdf(tiny_pdf(["one", None, "three \\(x\\)"])) == [("one", None, 1), ("three (x)", None, 3)]
    assert parsers.parse("pdf", tiny_pdf([None])) == ([], "no_text") and parsers.parse("pdf", b"nope") == ([], "extraction")


def test_ingest_and_storage(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.MD").write_bytes(b"# T\nbody")
    (tmp_path / "in" / "b.bin").write_bytes(b"x")
    documents = files.ingest(spark, str(tmp_path / "in"))
    got = {r.source_file: r for r in documents.collect()}
    assert got["A.MD"].file_type == "markdown" and got["A.MD"].segments[0].section_heading == "T" and got["b.bin"].error_class == "unsupported_type"
    files.write_processed(documents, str(tmp_path / "out"))
    assert files.read_processed(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(IngestionError):
        files.read_processed(spark, str(tmp_path / "out"), 2)
    with pytest.raises(IngestionError):
        files.raw_files(spark, str(tmp_path / "missing"))


def test_golden_lines(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text('{"id": "b", "question": "q"}\n\n{"id": "a", "tags": ["t"]}\n')
    assert [(r.line, r.id) for r in files.read_golden(spark, str(good)).orderBy("line").collect()] == [(1, "b"), (3, "a")]
    for text in ('{"id": "a"}\n{"id": "a"}', "{bad", "[1]", '{"id": "a", "other": 1}'):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(text)
        with pytest.raises(EvaluationError):
            files.read_golden(spark, str(bad))


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello there")
    for _ in range(2):  # nothing is read twice
        run_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == 1


# -- snapshots and the whole chain -------------------------------------------------------------------


def test_chain_ranks_without_texts_and_finds_other_provenance(spark, monkeypatch):
    """Candidates are written without texts (F2), and a chunk of another text in the vectors' table is an error (F3)."""
    from scriptorium.plans.session import materialize
    from scriptorium.providers import embedding_udf

    columns = {}

    def noted(rows, name):
        columns[name] = rows.columns
        return materialize(rows, name)

    monkeypatch.setattr(pipeline, "materialize", noted)
    chunks = chunks_of(spark, ["alpha beta", "gamma delta", "epsilon zeta"])
    vectors = chunks.select("chunk_id", "text", "document_id", "source_file", embedding_udf()(F.col("text")).alias("vector"))
    queries = spark.createDataFrame([("q1", "alpha"), ("q2", "gamma delta")], "query_id string, query string")
    ranked = pipeline.retrieve_reranked(queries, chunks, vectors)
    assert "text" not in columns["candidates"] and {r.chunk_id for r in ranked.where("rank = 1").collect()} == {"c0", "c1"} and "text" in ranked.columns
    with pytest.raises(RetrievalError, match="provenance_mismatch"):
        pipeline.retrieve_reranked(queries, chunks, vectors.withColumn("text", F.when(F.col("chunk_id") == "c1", "other").otherwise(F.col("text"))))


def test_snapshot_build_reuse_and_failure(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    chunks = chunks_of(spark, ["alpha beta", "gamma delta", "alpha beta", "epsilon zeta"])
    calls = spark.sparkContext.accumulator(0)

    def provider(texts):
        from scriptorium.providers import hash_embeddings

        calls.add(len(texts))
        return hash_embeddings(texts)

    first = snapshot.build(chunks, root, provider=provider)
    assert (first.chunks_before, first.chunks_after, first.exact_duplicates) == (4, 3, 1) and calls.value == 4
    assert snapshot.build(chunks, root, provider=provider) == first and calls.value == 4
    with pytest.raises(Exception):
        snapshot.build(chunks_of(spark, ["new text", "other"]), root, provider=lambda texts: [[float("nan")]] * len(texts))
    assert snapshot.load_manifest(spark, root, "recursive") == first
    with pytest.raises(IndexingError):
        snapshot.build(chunks_of(spark, ["x", " "]), root)
    with pytest.raises(RetrievalError):
        snapshot.open_snapshot(spark, root, "fixed")
    with pytest.raises(RetrievalError):
        snapshot.open_snapshot(spark, root, "recursive", Settings(embedding_model="other"))
    manifest, stored, vectors = snapshot.open_snapshot(spark, root, "recursive")
    queries = spark.createDataFrame([("q1", "alpha"), ("q2", "gamma delta")], "query_id string, query string")
    final = {r.answer_id: r for r in pipeline.answer_with_policy(queries, stored, vectors).collect()}
    assert set(final) == {"q1", "q2"} and final["q2"].answer_text.startswith("gamma delta [1]") and manifest == first
    with pytest.raises(RetrievalError):
        pipeline.retrieve_reranked(spark.createDataFrame([("q", " ")], "query_id string, query string"), stored, vectors)


def test_settings_are_checked():
    for bad in ({"chunk_overlap": 1000}, {"rerank_top_k": 30}, {"rrf_dense_weight": 0.0, "rrf_sparse_weight": 0.0}, {"confidence_threshold": 2.0}, {"chunk_strategy": "x"}, {"embedding_model": " "}):
        with pytest.raises(SettingsError):
            Settings(**bad)


def test_command_line(spark, tmp_path):
    from scriptorium import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Alpha\nThe alpha service keeps backups for nine days.\n\n## Beta\nBeta is read only.")
    (tmp_path / "in" / "b.txt").write_text("Gamma restarts every night.")
    root = f"file://{tmp_path}/index"
    assert cli.main(["index", str(tmp_path / "in"), root], spark).chunks_after == 3
    for channel in ("sparse", "dense", "hybrid", "reranked"):
        assert cli.main(["query", root, channel, "alpha backups"], spark).count() >= 1
    assert cli.main(["query", root, "sparse", "gamma night"], spark).first().rank == 1
    assert cli.main(["ask", root, "gamma restarts"], spark).count() == 1
    assert cli.main(["chunk-stats", str(tmp_path / "in")], spark).count() == 3
    golden = tmp_path / "g.jsonl"
    golden.write_text('{"id": "a", "question_type": "direct_factual", "answerability": "answerable"}\n')
    assert cli.main(["golden-summary", str(golden)], spark).where("n > 0").count() == 3
