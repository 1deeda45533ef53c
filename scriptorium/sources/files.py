"""Sources and sinks: raw files, the processed table, golden JSON lines, discovery."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.errors import EvaluationError, IngestionError
from scriptorium.functions.text import document_id, file_type
from scriptorium.sources.parsers import parse

SEGMENTS = "array<struct<text:string,section_heading:string,page_number:int>>"
EXTENSIONS = (".txt", ".md", ".markdown", ".html", ".htm", ".pdf")
GOLDEN = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "question", "answerability", "question_type", "difficulty")]
    + [T.StructField("requires_multi_document_reasoning", T.BooleanType()), T.StructField("expected_answer", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("expected_facts", "expected_source_files", "expected_identifiers", "acceptable_source_files", "tags")]
    + [T.StructField("notes", T.StringType())]
)


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of all files below a folder (or of one file)."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise IngestionError(f"not_found: {path}") from error
        raise


def parse_files(files: DataFrame) -> DataFrame:
    """Documents of ``files (path, content)``: id, file name, type, raw path, segments and an error class.

    Unsupported, unreadable and textless files keep a row with the class and no segments.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("text", pa.string()), ("section_heading", pa.string()), ("page_number", pa.int32())]))
        for batch in batches:
            parsed = [parse(k, c) for k, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            segments = [[{"text": t, "section_heading": h, "page_number": p} for t, h, p in s] for s, _ in parsed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(segments, kind), pa.array([e for _, e in parsed], pa.string())],
                names=["path", "document_id", "file_type", "segments", "error_class"],
            )

    rows = files.select("path", document_id(F.col("content")).alias("document_id"), file_type(F.col("path")).alias("file_type"), "content")
    parsed = rows.mapInArrow(run, f"path string, document_id string, file_type string, segments {SEGMENTS}, error_class string")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return parsed.select("document_id", name.alias("source_file"), "file_type", F.col("path").alias("raw_path"), "segments", "error_class")


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """Files to normalized documents."""
    return parse_files(raw_files(spark, path))


def write_raw(files: DataFrame, folder: str) -> None:
    """Raw copies as a table by document id: byte-exact, with the base name only."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    files.select(document_id(F.col("content")).alias("document_id"), name.alias("source_file"), "content").write.mode("overwrite").parquet(folder)


def write_processed(documents: DataFrame, folder: str, schema_version: int = 1) -> None:
    """Good documents as a table, with the schema version; the committer makes it all or nothing."""
    documents.where("error_class is null").drop("error_class").withColumn("schema_version", F.lit(schema_version)).write.mode("overwrite").parquet(folder)


def read_processed(spark: SparkSession, folder: str, schema_version: int = 1) -> DataFrame:
    """Strict load: missing folder, other version and missing columns are errors."""
    try:
        rows = spark.read.parquet(folder)
    except Exception as error:
        raise IngestionError(f"persistence: {folder}") from error
    need = {"document_id", "source_file", "file_type", "raw_path", "segments", "schema_version"}
    if not need <= set(rows.columns) or not rows.where(F.col("schema_version") != schema_version).isEmpty():
        raise IngestionError(f"persistence: {folder} has another schema")
    return rows.drop("schema_version")


def discover(files: DataFrame) -> DataFrame:
    """``source_file, paths, ambiguous`` of the supported files, by base name."""
    rows = files.where(file_type(F.col("path")).isNotNull()).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), "path")
    by = rows.groupBy("source_file").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return by.withColumn("ambiguous", F.size("paths") > 1)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases of a JSON-lines file in its line order (``line``): blank lines are passed over; bad
    JSON, lines that are no object, unknown keys and repeated ids are errors that name the line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    lines = lines.select((F.col("line") + 1).alias("line"), F.trim(F.regexp_replace("value", "\r$", "")).alias("value")).where("value <> ''")
    fields = [f.name for f in GOLDEN]
    rows = lines.select("line", F.from_json("value", GOLDEN).alias("c"), F.json_object_keys("value").alias("keys"), F.try_parse_json("value").alias("v"))
    unknown = F.size(F.array_except(F.coalesce("keys", F.array().cast("array<string>")), F.array(*map(F.lit, fields)))) > 0
    problem = F.when(F.col("v").isNull(), "bad_json").when(F.col("keys").isNull(), "not_an_object").when(unknown, "unknown_key")
    repeated = F.row_number().over(Window.partitionBy("c.id").orderBy("line")) > 1
    rows = rows.withColumn("problem", F.coalesce(problem, F.when(repeated, "repeated_id")))
    bad = rows.where("problem is not null").orderBy("line").limit(5).collect()
    if bad:
        raise EvaluationError("; ".join(f"{os.path.basename(path)}:{r.line}: {r.problem}" for r in bad))
    return rows.select("line", "c.*")


def to_json_rows(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text (the exchange form of chunks, segments and reports)."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def from_json_rows(rows: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The way back; text that doesn't fit the schema is an error."""
    parsed = rows.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")

