"""Chunking: fixed windows, recursive packing and similarity groups.

Documents are rows with ``document_id``, ``source_file`` and ``segments`` (an array of text, heading
and page). Every strategy is a narrow map of a document row to its chunks; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULTS, STRATEGIES, Settings
from scriptorium.errors import ChunkingError
from scriptorium.functions.text import chunk_id, is_blank, strip

#: From the largest structure to the smallest.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of a stripped text: each starts ``size - overlap`` after the one before, and the first
    that reaches the end is the last. Blank and NULL texts give an empty array."""
    if not (size > 0 and 0 <= overlap < size):
        raise ChunkingError("need 0 <= overlap < size")
    body, step = strip(text), size - overlap
    count = F.greatest(F.ceil((F.length(body) - size) / step), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count), lambda i: F.substring(body, i * step + 1, F.lit(size)))
    return F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>")).otherwise(windows)


# -- recursive packing --------------------------------------------------------------------------


def _cut_ends(text: str, low: int, high: int, size: int, level: int, ends: list[int]) -> None:
    """Append the ends of the pieces that cover ``text[low:high]``.

    Pieces are consecutive spans, so only their ends are kept. Characters of a separator that follow
    an oversized part belong to the next piece; ``carried`` counts them, since they use up its room.
    """
    if high - low <= size:
        ends.append(high)
        return
    while level < len(SEPARATORS) and text.find(SEPARATORS[level], low, high) < 0:
        level += 1
    if level == len(SEPARATORS):
        ends.extend(range(low + size, high, size))
        ends.append(high)
        return
    separator = SEPARATORS[level]
    at = filled = body = low
    carried = 0
    while True:
        hit = text.find(separator, at, high)
        end = high if hit < 0 else hit
        following = high if hit < 0 else hit + len(separator)
        too_long = end - at > size
        if filled > body and (too_long or following - body > size - carried):
            ends.append(filled)
            carried = 0
            body = filled
        if too_long or following - at > size - carried:
            _cut_ends(text, at, end, max(1, size - carried), level + 1, ends)
            carried = following - end
            body = filled = following
        else:
            filled = following
        if hit < 0:
            break
        at = following
    if filled > body:
        ends.append(filled)


def pack(text: str | None, size: int) -> list[str]:
    """Pieces of at most ``size`` characters that joined give the stripped text."""
    text = (text or "").strip()
    if not text:
        return []
    ends: list[int] = []
    _cut_ends(text, 0, len(text), size, 0, ends)
    starts = [0, *ends[:-1]]
    return [text[a:b] for a, b in zip(starts, ends, strict=True)]


def recursive_pieces(text: str | None, size: int, overlap: int) -> list[str]:
    """Pieces packed to ``size - overlap``, each but the first led by the end of the one before;
    blank pieces are left out after that."""
    pieces = pack(text, size - overlap)
    if overlap:
        pieces = [p if not i else pieces[i - 1][-overlap:] + p for i, p in enumerate(pieces)]
    return [p for p in pieces if p.strip()]


# -- similarity groups --------------------------------------------------------------------------


def semantic_units(text: Column) -> Column:
    """Paragraphs, else lines, else the whole; trimmed, blank ones dropped."""
    tidy = lambda parts: F.filter(F.transform(parts, strip), lambda u: u != "")
    paragraphs, lines = tidy(F.split(text, "\n\n")), tidy(F.split(text, "\n"))
    return F.when(F.size(paragraphs) > 1, paragraphs).when(F.size(lines) > 1, lines).otherwise(tidy(F.array(text)))


def units_of(text: str | None) -> list[str]:
    """The same on the driver's side of a UDF."""
    text = text or ""
    for separator in ("\n\n", "\n"):
        units = [u for u in (part.strip() for part in text.split(separator)) if u]
        if len(units) > 1:
            return units
    whole = text.strip()
    return [whole] if whole else []


def group_units(units: list[str], vectors: list[list[float]], threshold: float, size: int) -> list[str]:
    """Join neighbouring units while each is similar to the one before it and the group fits."""
    if len(vectors) != len(units):
        raise ChunkingError("the provider must give one vector for each unit")
    groups: list[list[str]] = []
    length = 0
    for i, unit in enumerate(units):
        if i:
            a, b = vectors[i - 1], vectors[i]
            scale = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
            near = (sum(x * y for x, y in zip(a, b, strict=True)) / scale if scale else 0.0) >= threshold
            if near and length + 2 + len(unit) <= size:
                groups[-1].append(unit)
                length += 2 + len(unit)
                continue
        groups.append([unit])
        length = len(unit)
    joined = ["\n\n".join(g) for g in groups]
    return [p for text in joined for p in ([text] if len(text) <= size else pack(text, size))]


def semantic_pieces(text: str | None, embed: Callable[[list[str]], list[list[float]]], threshold: float, size: int) -> list[str]:
    """Stripped, non-blank groups. The provider is called once, and only for more than one unit."""
    units = units_of(text)
    if not units:
        return []
    pieces = group_units(units, embed(units) if len(units) > 1 else [[]], threshold, size) if len(units) > 1 else ([units[0]] if len(units[0]) <= size else pack(units[0], size))
    return [p.strip() for p in pieces if p.strip()]


# -- from documents to chunk rows ---------------------------------------------------------------


def segments(documents: DataFrame) -> DataFrame:
    """One row for each segment; NULL arrays and NULL segments have none but keep their index."""
    rows = documents.select("document_id", "source_file", F.posexplode("segments").alias("segment_index", "segment"))
    return rows.select("document_id", "source_file", "segment_index", F.col("segment.section_heading").alias("section_heading"), F.col("segment.page_number").alias("page_number"), F.col("segment.text").alias("text"))


def chunk_documents(documents: DataFrame, settings: Settings = DEFAULTS, strategy: str | None = None, embed: Callable | None = None) -> DataFrame:
    """Chunk rows of ``documents``: ids, ``chunk_index`` running over the segments of a document, text,
    provenance, strategy and character count.

    The chunks of one document row are numbered inside that row, so no shuffle is needed. Documents
    without text have no chunks; a repeated document row gives its chunks again (with equal ids).
    """
    strategy = strategy or settings.chunk_strategy
    if strategy not in STRATEGIES:
        raise ChunkingError(f"unsupported strategy: {strategy}")
    if strategy == "semantic" and embed is None:
        from scriptorium.providers import hash_embeddings as embed
    rows = documents.select("document_id", "source_file", "segments")
    if strategy == "fixed":
        piece = lambda s: F.transform(fixed_windows(s["text"], settings.chunk_size, settings.chunk_overlap), lambda t: F.struct(t.alias("text"), s["section_heading"].alias("section_heading"), s["page_number"].alias("page_number")))
        pieces = F.flatten(F.transform(F.coalesce("segments", F.array().cast(documents.schema["segments"].dataType)), piece))
        rows = rows.withColumn("pieces", F.filter(pieces, lambda p: ~is_blank(p["text"])))
    else:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut_one = (lambda t: recursive_pieces(t, settings.chunk_size, settings.chunk_overlap)) if strategy == "recursive" else (lambda t: semantic_pieces(t, embed, settings.chunk_semantic_similarity_threshold, settings.chunk_size))
            for batch in batches:
                done = []
                for row in batch.column(2).to_pylist():
                    done.append([{"text": t, "section_heading": s["section_heading"], "page_number": s["page_number"]} for s in row or () if s is not None for t in cut_one(s["text"])])
                kind = pa.list_(pa.struct([("text", pa.string()), ("section_heading", pa.string()), ("page_number", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, kind)], names=["document_id", "source_file", "pieces"])

        rows = rows.mapInArrow(run, "document_id string, source_file string, pieces array<struct<text:string,section_heading:string,page_number:int>>")
    rows = rows.select("document_id", "source_file", F.posexplode("pieces").alias("chunk_index", "piece"))
    text = F.col("piece.text")
    return rows.select(
        chunk_id(F.col("document_id"), F.lit(strategy), F.col("chunk_index"), text).alias("chunk_id"),
        "document_id", "chunk_index", text.alias("text"), "source_file",
        F.col("piece.section_heading").alias("section_heading"), F.col("piece.page_number").cast("int").alias("page_number"),
        F.lit(strategy).alias("chunking_strategy"), F.length(text).alias("character_count"),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Count, least, mean and largest character count of each strategy."""
    size = F.col("character_count")
    return chunks.groupBy("chunking_strategy").agg(
        F.count("*").alias("chunks"), F.min(size).alias("min_chars"), F.round(F.avg(size), 6).alias("mean_chars"), F.max(size).alias("max_chars")
    )
