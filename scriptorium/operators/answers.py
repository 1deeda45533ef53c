"""Evidence, citations, verdicts, confidence and the abstention policy, for whole tables of answers.

Answers are rows ``(answer_id, answer_text)``, evidence ``(answer_id, citation_number, chunk_id, ...)``,
verdicts ``(answer_id, occurrence_id, citation_number, verdict, rationale)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import DEFAULTS, Settings
from scriptorium.functions.text import citation_occurrences, citations, evidence_block, is_blank, is_insufficient, verdict_score

VERDICTS = ("supported", "partially_supported", "unsupported", "contradicted")
DECISIONS = ("answered", "abstained_insufficient_evidence", "abstained_contradiction", "abstained_unsupported_citation", "abstained_low_confidence")
ABSTENTION_TEXT = "I can't answer that reliably from the documents at hand."
REASONS = {
    "abstained_insufficient_evidence": "The documents at hand don't hold enough to answer.",
    "abstained_contradiction": "A cited source says otherwise.",
    "abstained_unsupported_citation": "A cited source doesn't back what is said.",
    "abstained_low_confidence": "The answer's confidence is below the threshold.",
}


def build_evidence(reranked: DataFrame, key: str = "query_id") -> DataFrame:
    """Numbered evidence: the citation number is the reranked rank; scores stay behind."""
    return reranked.select(
        F.col(key).alias("answer_id"), F.col("rank").alias("citation_number"), "chunk_id", "text", "source_file", "document_id", "chunk_index",
        "section_heading", "page_number", "chunking_strategy", F.col("rank").alias("reranked_rank"),
    )


def evidence_text(evidence: DataFrame) -> DataFrame:
    """``answer_id, evidence``: all entries of an answer, in their order (a few: top-k evidence)."""
    block = evidence_block(F.col("citation_number"), F.col("source_file"), F.col("section_heading"), F.col("page_number"), F.col("text"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("citation_number").alias("n"), block.alias("b"))))
    return evidence.groupBy("answer_id").agg(F.array_join(F.transform(entries, lambda e: e["b"]), "\n\n").alias("evidence"))


def evidence_problems(evidence: DataFrame) -> DataFrame:
    """Answers whose evidence isn't numbered 1..N."""
    by = evidence.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_distinct("citation_number").alias("d"), F.min("citation_number").alias("low"), F.max("citation_number").alias("high"))
    bad = (F.col("d") != F.col("n")) | (F.col("low") != 1) | (F.col("high") != F.col("n"))
    return by.select("answer_id", F.when(bad, "bad_numbering").alias("error_class")).where("error_class is not null")


def occurrences(answers: DataFrame) -> DataFrame:
    """One row for each citation of each answer."""
    return answers.select("answer_id", F.inline(citation_occurrences(F.col("answer_text"))))


def answer_problems(answers: DataFrame, evidence_count: Column) -> DataFrame:
    """``answer_id, error_class, offenders`` of answers that don't hold.

    Blank text: ``empty_answer``; numbers outside 1..N: ``citation_range`` with all of them; evidence
    but no citation, and not the fixed phrase: ``uncited``. Without evidence an uncited answer passes.
    """
    cited = citations(F.col("answer_text"))
    outside = F.array_sort(F.filter(cited, lambda n: (n < 1) | (n > evidence_count)))
    problem = (
        F.when(is_blank(F.col("answer_text")), "empty_answer")
        .when(F.size(outside) > 0, "citation_range")
        .when((evidence_count > 0) & (F.size(cited) == 0) & ~is_insufficient(F.col("answer_text")), "uncited")
    )
    return answers.select("answer_id", problem.alias("error_class"), F.coalesce(outside, F.array().cast("array<int>")).alias("offenders")).where("error_class is not null")


def resolve_citations(marks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Occurrences with the chunk they point to."""
    return marks.join(evidence.select("answer_id", "citation_number", "chunk_id"), ["answer_id", "citation_number"], "left")


def judge_problems(marks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What is wrong with a judge's output, one row a fault: ``duplicate``, ``invented``, ``missing``,
    ``number_mismatch``, ``bad_verdict``, ``blank_rationale``."""
    repeated = F.count("*").over(Window.partitionBy("answer_id", "occurrence_id")) > 1
    v = verdicts.select("answer_id", "occurrence_id", F.col("citation_number").alias("judged_number"), "verdict", "rationale", repeated.alias("repeated"))
    m = marks.select("answer_id", "occurrence_id", F.col("citation_number").alias("real_number"))
    both = m.join(v, ["answer_id", "occurrence_id"], "full_outer")
    fault = (
        F.when(F.col("real_number").isNull(), "invented")
        .when(F.col("judged_number").isNull() & F.col("verdict").isNull() & F.col("repeated").isNull(), "missing")
        .when(F.col("repeated"), "duplicate")
        .when(~F.col("judged_number").eqNullSafe(F.col("real_number")), "number_mismatch")
        .when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "bad_verdict")
        .when(is_blank(F.col("rationale")), "blank_rationale")
    )
    return both.select("answer_id", "occurrence_id", fault.alias("error_class")).where("error_class is not null")


def tallies(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdict counts of each answer; all supported holds (vacuously) for an answer without any."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    by = verdicts.groupBy("answer_id").agg(
        F.count("*").alias("total_occurrences"), count("supported").alias("supported_count"), count("partially_supported").alias("partially_supported_count"),
        count("unsupported").alias("unsupported_count"), count("contradicted").alias("contradicted_count"), F.bool_and(F.col("verdict") == "supported").alias("all_supported"),
    )
    zero = ("total_occurrences", "supported_count", "partially_supported_count", "unsupported_count", "contradicted_count")
    return answers.select("answer_id").join(by, "answer_id", "left").fillna(0, list(zero)).withColumn("all_supported", F.coalesce("all_supported", F.lit(True)))


def confidence(answers: DataFrame, verdicts: DataFrame, evidence: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Citation support, retrieval agreement and their weighted mean for each answer.

    ``verdicts`` carry ``chunk_id``; ``evidence`` carries ``dense_rank`` and ``sparse_rank``. An answer that
    says the evidence does not suffice and cites nothing has all scores 0. Answers without a citation
    otherwise have NULL scores and the error class ``no_citation``; cited chunks that were not
    retrieved give ``unknown_chunk``.
    """
    wc, wr = settings.confidence_citation_weight, settings.confidence_retrieval_agreement_weight
    support = verdicts.groupBy("answer_id").agg(F.avg(verdict_score(F.col("verdict"))).alias("support"), F.count("*").alias("occurrences"))
    cited = verdicts.select("answer_id", "chunk_id").distinct().join(evidence.select("answer_id", "chunk_id", "dense_rank", "sparse_rank", F.lit(True).alias("retrieved")), ["answer_id", "chunk_id"], "left")
    agreement = cited.groupBy("answer_id").agg(
        F.count("*").alias("cited_chunks"), F.count_if(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull()).alias("dual_channel_chunks"),
        F.bool_or(F.col("retrieved").isNull()).alias("unknown"),
    )
    rows = answers.select("answer_id", is_insufficient(F.col("answer_text")).alias("says_insufficient"))
    rows = rows.join(support, "answer_id", "left").join(agreement, "answer_id", "left").join(tallies(answers, verdicts), "answer_id")
    none = F.col("occurrences").isNull()
    insufficient = F.col("says_insufficient") & none
    s = F.when(insufficient, 0.0).otherwise(F.col("support"))
    a = F.when(insufficient, 0.0).otherwise(F.col("dual_channel_chunks") / F.nullif("cited_chunks", F.lit(0)))
    score = (wc * s + wr * a) / (wc + wr)
    return rows.select(
        "answer_id", F.round(s, 9).alias("citation_support"), F.round(a, 9).alias("retrieval_agreement"), F.round(score, 9).alias("score"),
        "total_occurrences", "supported_count", "partially_supported_count", "unsupported_count", "contradicted_count",
        F.coalesce("cited_chunks", F.lit(0)).alias("cited_chunks"), F.coalesce("dual_channel_chunks", F.lit(0)).alias("dual_channel_chunks"),
        insufficient.alias("is_insufficient"), (F.col("contradicted_count") > 0).alias("has_contradiction"),
        F.when(F.coalesce("unknown", F.lit(False)), "unknown_chunk").when(none & ~F.col("says_insufficient"), "no_citation").alias("error_class"),
    )


def confidence_problems(answers: DataFrame, verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``answer_id, error_class``: what a confidence must not be computed from, the first that holds.

    ``report_mismatch``: the verdicts are not one for each real citation of the answer, with its number;
    ``repeated_retrieval``: a chunk stands in the evidence twice; ``chunk_mismatch``: a verdict names
    another chunk than the evidence does; ``unknown_chunk``: a cited chunk was not retrieved.
    """
    real = occurrences(answers).select("answer_id", "occurrence_id", F.col("citation_number").alias("real_number"))
    judged = verdicts.select("answer_id", "occurrence_id", "citation_number", "chunk_id", F.count("*").over(Window.partitionBy("answer_id", "occurrence_id")).alias("times"))
    both = real.join(judged, ["answer_id", "occurrence_id"], "full_outer")
    both = both.join(evidence.groupBy("answer_id", "citation_number").agg(F.min("chunk_id").alias("held")), ["answer_id", "citation_number"], "left")
    known = evidence.groupBy("answer_id", "chunk_id").agg(F.count("*").alias("copies"))
    both = both.join(known.select("answer_id", "chunk_id", F.lit(True).alias("retrieved")), ["answer_id", "chunk_id"], "left")
    mismatch = ~F.col("citation_number").eqNullSafe(F.col("real_number")) | (F.coalesce("times", F.lit(0)) != 1)
    by = both.groupBy("answer_id").agg(
        F.bool_or(mismatch).alias("mismatch"), F.bool_or(F.col("retrieved").isNull()).alias("unknown"), F.bool_or(F.col("held").isNotNull() & ~F.col("chunk_id").eqNullSafe(F.col("held"))).alias("other"),
    )
    repeated = known.groupBy("answer_id").agg(F.bool_or(F.col("copies") > 1).alias("repeated"))
    rows = answers.select("answer_id").join(by, "answer_id", "left").join(repeated, "answer_id", "left").fillna(False, ["mismatch", "unknown", "other", "repeated"])
    problem = F.when(F.col("mismatch"), "report_mismatch").when(F.col("repeated"), "repeated_retrieval").when(F.col("other"), "chunk_mismatch").when(F.col("unknown"), "unknown_chunk")
    return rows.select("answer_id", problem.alias("error_class")).where("error_class is not null")


def decide(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``answer_id, decision, abstained, abstention_reason``; the first rule that holds decides. Rows with
    an error class, or a score outside [0, 1], have no decision."""
    decision = (
        F.when(F.col("error_class").isNotNull() | ~F.coalesce(F.col("score").between(0, 1), F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("is_insufficient"), DECISIONS[1])
        .when(F.col("has_contradiction"), DECISIONS[2])
        .when(F.col("unsupported_count") > 0, DECISIONS[3])
        .when(F.col("score") < settings.confidence_threshold, DECISIONS[4])
        .otherwise(DECISIONS[0])
    )
    reasons = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    rows = scored.withColumn("decision", decision)
    return rows.select("answer_id", "decision", (F.col("decision") != DECISIONS[0]).alias("abstained"), F.try_element_at(reasons, F.col("decision")).alias("abstention_reason"))


def policy_problems(scored: DataFrame, counted: DataFrame) -> DataFrame:
    """Confidence rows whose counts or flags don't agree with the verification report's."""
    names = ("total_occurrences", "supported_count", "partially_supported_count", "unsupported_count", "contradicted_count")
    both = scored.alias("s").join(counted.alias("c"), "answer_id", "full_outer")
    differs = F.lit(False)
    for n in names:
        differs = differs | ~F.col(f"s.{n}").eqNullSafe(F.col(f"c.{n}"))
    flag = ~((F.col("s.contradicted_count") > 0).eqNullSafe(F.col("s.has_contradiction")))
    problem = F.when(differs, "count_mismatch").when(flag, "flag_mismatch").when(~F.coalesce(F.col("s.score").between(0, 1), F.lit(False)), "bad_score")
    return both.select("answer_id", problem.alias("error_class")).where("error_class is not null")


def final_answers(answers: DataFrame, decisions: DataFrame) -> DataFrame:
    """The text that is given out: the answer as it is, or the fixed sentence."""
    rows = answers.select("answer_id", "answer_text").join(decisions, "answer_id")
    text = F.when(F.col("decision") == DECISIONS[0], F.col("answer_text")).when(F.col("decision").isNotNull(), ABSTENTION_TEXT)
    return rows.select("answer_id", text.alias("answer_text"), "decision", "abstained", "abstention_reason")
