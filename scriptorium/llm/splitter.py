"""Problem 5: splitting oversized items at natural boundaries.

Recursive separator hierarchy: an item is split at section starts, what is still too long at
paragraph ends, then at line ends, sentence ends, words, marks inside words and at last at
characters. The pieces are
then packed greedily, each taking as many units as fit, and each begins with the last ``overlap``
characters of the piece before. A piece is kept as a span of its item, so nothing is lost or
doubled but the overlap.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_000, 200
#: What is cut off both ends of an item before it is measured.
EDGE = " \t\r\n"
#: The hierarchy; each pattern matches a separator, and a cut lies at the match's end.
LEVELS = (
    ("section", re.compile(r"\n(?=#{1,6} )|\f|\n(?=(?:-{3,}|={3,}|\*{3,})[ \t]*\r?\n)")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\r?\n")),
    ("sentence", re.compile(r"[.!?]+[\"')\]»”]*\s+|[。！？]+")),
    ("word", re.compile(r"\s+")),
    ("mark", re.compile(r"[.!?。！？]")),
)
CHARACTER = "character"
SPAN = "array<struct<start:int,end:int,cut:string>>"
ROW = f"rid bigint, segment_index int, cut_kind string, pieces {SPAN}"


def units(text: str, room: int) -> list[tuple[int, int, str, int]]:
    """``(start, end, level of the cut at its end, longest run without a boundary)`` of each unit of
    the text; no unit is longer than ``room``."""
    found: list[tuple[int, int, str, int]] = []

    def split(start: int, end: int, level: int, ends_with: str) -> None:
        if end - start <= room:
            found.append((start, end, ends_with, 0))
            return
        if level == len(LEVELS):
            at = start
            while end - at > room:
                found.append((at, at + room, CHARACTER, end - start))
                at += room
            found.append((at, end, ends_with, end - start))
            return
        name, pattern = LEVELS[level]
        at = start
        for match in pattern.finditer(text, start, end):
            cut = match.end()
            if at < cut < end:
                split(at, cut, level + 1, name)
                at = cut
        split(at, end, level + 1, ends_with)

    split(0, len(text), 0, "end")
    return found


#: A run that the splitter can only cut by force.
def _run(limit: int) -> re.Pattern[str]:
    return re.compile(rf"[^\s.!?。！？]{{{limit + 1},}}")


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, str]]]:
    """``(cut kind, pieces)`` of one text; each piece is ``(start, end, level of the cut at its end)``.

    The kind is ``whole`` (within the limit), ``forced`` (it holds a run longer than the limit with no
    white space and no sentence mark, which only a cut between two characters can break) or
    ``natural``. Pieces have at most ``limit`` characters; each but the first starts ``overlap``
    characters before the end of the one before. A run longer than ``limit - overlap`` is cut between
    characters as well, since a piece has no more room beside its overlap. The empty text has no piece.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("need 0 <= overlap < limit")
    if len(text) <= limit:
        return "whole", [(0, len(text), "end")] if text else []
    parts = units(text, limit - overlap)
    kind = "natural"
    if any(run > limit for *_, run in parts) and _run(limit).search(text):
        kind = "forced"
    pieces: list[tuple[int, int, str]] = []
    start, end, level = 0, 0, "end"
    for _, unit_end, cut, _ in parts:
        if unit_end - start > limit:
            pieces.append((start, end, level))
            start = end - overlap
        end, level = unit_end, cut
    pieces.append((start, end, "end"))
    return kind, pieces


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGE))


def segments_of(documents: DataFrame, key: str = "delivery_id") -> DataFrame:
    """``(rid, segment_index, text, section_heading)`` of the oversized segments only: the length is
    tested in the JVM, so that no other text goes to Python. NULL segments and NULL arrays have no
    row, but NULL segments count for the index."""
    rows = documents.select(F.col(key).alias("rid"), F.posexplode("segments").alias("segment_index", "segment"))
    rows = rows.select("rid", "segment_index", _trim(F.col("segment.text")).alias("text"), F.col("segment.section_heading").alias("section_heading"))
    return rows.where(F.length("text") > LIMIT)


def split_segments(documents: DataFrame, key: str = "delivery_id", with_text: bool = False) -> DataFrame:
    """One row for each oversized segment: ``rid, segment_index, cut_kind, pieces`` (spans of the
    trimmed text), and with ``with_text`` the text and the heading. A narrow map without a shuffle.

    Segments within the limit, NULL, empty and blank ones give no row; rows that repeat are split
    again; an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            done = [split_text(t) for t in batch.column(2).to_pylist()]
            spans = [[{"start": a, "end": b, "cut": c} for a, b, c in pieces] for _, pieces in done]
            columns = [batch.column(0), batch.column(1), pa.array([k for k, _ in done], pa.string())]
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cut", pa.string())]))))
            names = ["rid", "segment_index", "cut_kind", "pieces"]
            if with_text:
                columns += [batch.column(2), batch.column(3)]
                names += ["text", "section_heading"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ROW + (", text string, section_heading string" if with_text else "")
    return segments_of(documents, key).mapInArrow(run, schema)


def found(documents: DataFrame) -> DataFrame:
    """``(delivery_id, segment_index, cut_kind)`` of the oversized segments."""
    return split_segments(documents).select(F.col("rid").alias("delivery_id"), "segment_index", "cut_kind")


def chunk_rows(documents: DataFrame) -> DataFrame:
    """The pieces as chunk rows: ``delivery_id, segment_index, piece_index, text, section_heading,
    start_offset, cut`` where ``cut`` names the separator at the piece's end."""
    rows = split_segments(documents, with_text=True)
    rows = rows.select("rid", "segment_index", "text", "section_heading", F.posexplode("pieces").alias("piece_index", "piece"))
    piece = F.substring("text", F.col("piece.start") + 1, F.col("piece.end") - F.col("piece.start"))
    return rows.select(
        F.col("rid").alias("delivery_id"), "segment_index", "piece_index", piece.alias("text"), "section_heading",
        F.col("piece.start").alias("start_offset"), F.col("piece.cut").alias("cut"),
    )
