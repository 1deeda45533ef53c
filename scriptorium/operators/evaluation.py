"""Evaluation: golden cases, retrieval, correctness, faithfulness, citation and abstention metrics.

NULL means "doesn't apply" and is never counted as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import HEX_ID, is_blank, verdict_score

ANSWERABILITY = ("answerable", "unanswerable")
QUESTION_TYPES = ("exact_identifier", "semantic_paraphrase", "direct_factual", "multi_document_reasoning", "overlap_ambiguity", "unanswerable_absent")
DIFFICULTIES = ("easy", "medium", "hard")
LISTS = ("expected_facts", "expected_source_files", "expected_identifiers", "acceptable_source_files", "tags")
FACT_VERDICTS = ("correct", "partially_correct", "missing", "contradicted")
CLAIM_VERDICTS = ("supported", "partially_supported", "unsupported", "contradicted")
LEAST_CASES, LEAST_UNANSWERABLE = 50, 10


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def golden_problems(cases: DataFrame) -> DataFrame:
    """``id, problem``: one row for each rule that a case breaks."""
    question, kind, answerable = F.col("question"), F.col("question_type"), F.col("answerability") == "answerable"
    sources, many = F.size(_list("expected_source_files")), F.coalesce("requires_multi_document_reasoning", F.lit(False))
    has_answer = ~is_blank(F.col("expected_answer"))
    rules = {
        "blank_question": is_blank(question),
        "bad_answerability": ~F.coalesce(F.col("answerability").isin(*ANSWERABILITY), F.lit(False)),
        "bad_question_type": ~F.coalesce(kind.isin(*QUESTION_TYPES), F.lit(False)),
        "bad_difficulty": ~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)),
        **{f"repeated_{n}": F.size(F.array_distinct(_list(n))) < F.size(_list(n)) for n in LISTS},
        **{f"blank_{n}": F.exists(_list(n), is_blank) for n in LISTS},
        "expected_also_acceptable": F.arrays_overlap(_list("expected_source_files"), _list("acceptable_source_files")),
        "no_answer": answerable & ~has_answer,
        "no_facts": answerable & (F.size(_list("expected_facts")) == 0),
        "no_sources": answerable & (sources == 0),
        "too_many_sources": answerable & ~many & (sources > 1),
        "too_few_sources": answerable & many & (sources < 2),
        "type_without_flag": answerable & (kind == "multi_document_reasoning") & ~many,
        "identifier_not_asked": answerable & (kind == "exact_identifier") & ~F.exists(_list("expected_identifiers"), lambda x: F.contains(F.lower(question), F.lower(x))),
        "answerable_but_absent": answerable & (kind == "unanswerable_absent"),
        "unanswerable_with_answer": ~answerable & (has_answer | (F.size(_list("expected_facts")) > 0) | (sources > 0) | (F.size(_list("expected_identifiers")) > 0)),
        "unanswerable_type": ~answerable & (kind != "unanswerable_absent"),
        "holds_hex_id": F.exists(F.concat(F.array("id", "question", "expected_answer", "notes"), *map(_list, LISTS)), lambda t: F.coalesce(t.rlike(HEX_ID), F.lit(False))),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return cases.select("id", F.explode(found).alias("problem"))


def first_cases(cases: DataFrame) -> DataFrame:
    """One row for each id: the case authored first (rows of one id that tie are the same case)."""
    order = F.struct(F.col("authored_at"), *(F.to_json(F.struct(c)).alias(f"k{i}") for i, c in enumerate(cases.columns) if c not in ("id", "authored_at")))
    rest = F.struct(*(c for c in cases.columns if c != "id"))
    return cases.where("id is not null").groupBy("id").agg(F.min_by(rest, order).alias("c")).select("id", "c.*")


def dataset_report(cases: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counts over the data set, against the ``source_file`` names of the corpus."""
    repeated = cases.groupBy("id").count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("repeated_ids"))
    named = cases.select(F.explode(F.array_union(_list("expected_source_files"), _list("acceptable_source_files"))).alias("source_file")).distinct()
    unknown = named.join(files.select("source_file").distinct(), "source_file", "left_anti").agg(F.count("*").alias("unknown_sources"))
    covered = named.agg(F.count("*").alias("named_sources"))
    whole = cases.agg(F.count("*").alias("cases"), F.count_if(F.col("answerability") == "unanswerable").alias("unanswerable"), F.count_distinct("question_type").alias("types_present"))
    row = whole.crossJoin(repeated).crossJoin(unknown).crossJoin(covered)  # rows of one
    return row.withColumn("large_enough", (F.col("cases") >= LEAST_CASES) & (F.col("unanswerable") >= LEAST_UNANSWERABLE))


def distribution(cases: DataFrame) -> DataFrame:
    """``dimension, value, n, percent`` over types, difficulties and answerability; every known value has
    a row, also with none; NULL and unknown values are under ``other``."""
    dims = {"question_type": QUESTION_TYPES, "difficulty": DIFFICULTIES, "answerability": ANSWERABILITY}
    values = [(d, v) for d, known in dims.items() for v in (*known, "other")]
    value = lambda d, known: F.when(F.col(d).isin(*known), F.col(d)).otherwise("other")
    rows = cases.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), value(d, k).alias("value")) for d, k in dims.items()))).alias("r")).select("r.*")
    counted = rows.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    total = cases.agg(F.count("*").alias("total"))
    all_values = cases.sparkSession.createDataFrame(values, "dimension string, value string")
    joined = all_values.join(counted, ["dimension", "value"], "left").crossJoin(F.broadcast(total))
    return joined.select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"), F.round(100.0 * F.coalesce("n", F.lit(0)) / F.nullif("total", F.lit(0)), 6).alias("percent"))


def retrieval_metrics(cases: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Hit, recall, completeness and reciprocal rank of the expected sources, recall of identifiers.

    ``results`` has ``query_id, rank, source_file, text``. The reciprocal rank looks at the whole list (0.0
    if nothing is found). All NULL for unanswerable cases; identifier recall NULL without identifiers.
    """
    pairs = cases.where("answerability = 'answerable'").select("id", F.array_distinct(_list("expected_source_files")).alias("wanted"), F.array_distinct(_list("expected_identifiers")).alias("ids"))
    rows = pairs.join(results.select(F.col("query_id").alias("id"), "rank", "source_file", "text"), "id", "left")
    top = F.col("rank") <= k
    expected = F.array_contains("wanted", F.col("source_file"))
    by = rows.groupBy("id").agg(
        F.first("wanted").alias("wanted"), F.count_distinct(F.when(top & expected, F.col("source_file"))).alias("found"),
        F.min(F.when(expected, F.col("rank"))).alias("first_rank"),
    )
    asked = rows.select("id", F.explode("ids").alias("identifier"), F.coalesce(top & F.contains(F.lower("text"), F.lower("identifier")), F.lit(False)).alias("there"))
    identifiers = asked.groupBy("id", "identifier").agg(F.bool_or("there").alias("there")).groupBy("id").agg(F.avg(F.col("there").cast("double")).alias("identifier_recall"))
    n = F.nullif(F.size("wanted"), F.lit(0))
    scored = by.join(identifiers, "id", "left").select(
        "id", (F.col("found") > 0).alias("hit"), F.round(F.col("found") / n, 9).alias("recall"), (F.col("found") == F.size("wanted")).alias("complete"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 9).alias("reciprocal_rank"), F.round("identifier_recall", 9).alias("identifier_recall"),
    )
    return cases.select("id").join(scored, "id", "left").select("id", F.lit(k).alias("k"), "hit", "recall", "complete", "reciprocal_rank", "identifier_recall")


def _counts(names: tuple[str, ...]) -> list[Column]:
    return [F.count_if(F.col("verdict") == n).alias(f"{n}_count") for n in names]


def correctness(cases: DataFrame, decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mean fact score and counts; applies to answerable cases that were answered. Contradictions are
    counted beside the score, without a penalty. Verdict ids must be 1..N: else ``bad_fact_ids``."""
    by = verdicts.groupBy("id").agg(F.avg(verdict_score(F.col("verdict"))).alias("score"), *_counts(FACT_VERDICTS), F.count("*").alias("n"), F.count_distinct("fact_id").alias("d"), F.min("fact_id").alias("low"), F.max("fact_id").alias("high"))
    rows = cases.select("id", "answerability", F.size(_list("expected_facts")).alias("facts")).join(decisions.select("id", "decision"), "id", "left").join(by, "id", "left")
    applies = (F.col("answerability") == "answerable") & (F.col("decision") == "answered")
    applies = F.coalesce(applies, F.lit(False))
    bad = ~F.coalesce((F.col("n") == F.col("facts")) & (F.col("d") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("facts")), F.lit(False))
    ok = applies & ~bad
    return rows.select("id", applies.alias("applicable"), F.round(F.when(ok, F.col("score")), 9).alias("score"), *(F.when(ok, F.col(f"{n}_count")).alias(f"{n}_count") for n in FACT_VERDICTS), F.when(applies & bad, "bad_fact_ids").alias("error_class"))


def faithfulness(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mean claim score and counts; applies to answered cases, which need claims 1..M (M >= 1)."""
    by = verdicts.groupBy("id").agg(F.avg(verdict_score(F.col("verdict"))).alias("score"), *_counts(CLAIM_VERDICTS), F.count("*").alias("n"), F.count_distinct("claim_id").alias("d"), F.min("claim_id").alias("low"), F.max("claim_id").alias("high"))
    rows = decisions.select("id", "decision").join(by, "id", "left")
    applies = F.coalesce(F.col("decision") == "answered", F.lit(False))
    bad = ~F.coalesce((F.col("d") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n")), F.lit(False))
    ok = applies & ~bad
    return rows.select("id", applies.alias("applicable"), F.round(F.when(ok, F.col("score")), 9).alias("score"), *(F.when(ok, F.col(f"{n}_count")).alias(f"{n}_count") for n in CLAIM_VERDICTS), F.when(applies & bad, "bad_claim_ids").alias("error_class"))


def citation_metrics(cases: DataFrame, decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Citation scores of answered cases: mean verdict, share supported, precision and recall of the
    cited sources. ``verdicts`` has ``id, verdict, source_file``. NULL where nothing is cited or required."""
    by = verdicts.groupBy("id").agg(F.avg(verdict_score(F.col("verdict"))).alias("mean"), F.avg((F.col("verdict") == "supported").cast("double")).alias("share"), F.collect_set("source_file").alias("cited"))
    rows = cases.select("id", F.array_distinct(_list("expected_source_files")).alias("wanted"), _list("acceptable_source_files").alias("fine")).join(decisions.select("id", "decision"), "id", "left").join(by, "id", "left")
    applies = F.coalesce(F.col("decision") == "answered", F.lit(False))
    good = F.size(F.array_intersect("cited", F.array_union("wanted", "fine")))
    met = F.size(F.array_intersect("cited", "wanted"))
    return rows.select(
        "id", applies.alias("applicable"), F.round(F.when(applies, F.col("mean")), 9).alias("citation_score"), F.round(F.when(applies, F.col("share")), 9).alias("supported_rate"),
        F.round(F.when(applies & F.col("cited").isNotNull(), good / F.nullif(F.size("cited"), F.lit(0))), 9).alias("source_precision"),
        F.round(F.when(applies & F.col("cited").isNotNull(), met / F.nullif(F.size("wanted"), F.lit(0))), 9).alias("required_source_recall"),
    )


def abstention_cases(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Whether each case should have been and was abstained from."""
    rows = cases.select("id", (F.col("answerability") == "unanswerable").alias("expected_abstention")).join(decisions.select("id", (F.col("decision") != "answered").alias("abstained")), "id")
    e, a = F.col("expected_abstention"), F.col("abstained")
    return rows.select("id", e, a, (e == a).alias("correct"), (~e & a).alias("false_abstention"), (e & ~a).alias("false_answer"))


def abstention_rates(rows: DataFrame) -> DataFrame:
    """One row of counts and rates; a rate without cases is NULL, also for no rows at all."""
    e, a = F.col("expected_abstention"), F.col("abstained")
    n, pos, said, hit = F.count("*"), F.count_if(e), F.count_if(a), F.count_if(e & a)
    rate = lambda x, y: F.round(x / F.nullif(y, F.lit(0)), 9)
    return rows.agg(
        n.alias("cases"), pos.alias("unanswerable"), (n - pos).alias("answerable"), rate(F.count_if(e == a), n).alias("accuracy"), rate(hit, said).alias("abstention_precision"),
        rate(hit, pos).alias("abstention_recall"), rate(F.count_if(~e & a), n - pos).alias("false_abstention_rate"), rate(F.count_if(e & ~a), pos).alias("false_answer_rate"),
    )
