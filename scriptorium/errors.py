"""Error families. Batch operators put the class into an ``error_class`` column and go on; strict
mode raises on the first one that occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ScriptoriumError(Exception):
    """Base of all errors of the library."""


class SettingsError(ScriptoriumError, ValueError):
    """A setting is out of its range."""


class IngestionError(ScriptoriumError):
    """not_found, unsupported_type, extraction, no_text, persistence"""


class ChunkingError(ScriptoriumError):
    """unsupported_strategy, provider"""


class DeduplicationError(ScriptoriumError):
    """invalid input of the duplicate detector"""


class IndexingError(ScriptoriumError):
    """invalid_corpus, dense, sparse, manifest, synchronization, report"""


class RetrievalError(ScriptoriumError):
    """invalid_query, index_not_ready, model_mismatch, tokenizer_mismatch, dense, sparse, fusion, hybrid, rerank"""


class GenerationError(ScriptoriumError):
    """invalid_input, provider, citation_range, uncited, judge, judge_output, confidence_input, policy_input"""


class EvaluationError(ScriptoriumError):
    """dataset, metric_input, judge, judge_output"""


FAMILIES: dict[str, type[ScriptoriumError]] = {
    "ingestion": IngestionError,
    "chunking": ChunkingError,
    "deduplication": DeduplicationError,
    "indexing": IndexingError,
    "retrieval": RetrievalError,
    "generation": GenerationError,
    "evaluation": EvaluationError,
}


def raise_for_errors(rows: DataFrame, family: str, column: str = "error_class") -> DataFrame:
    """Strict mode: raise the family's error if any row has an error class, else give the rows."""
    bad = rows.where(f"{column} is not null").select(column).limit(5).collect()
    if bad:
        raise FAMILIES[family](f"{family}: " + ", ".join(sorted({r[0] for r in bad})))
    return rows
