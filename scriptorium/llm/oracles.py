"""DuckDB counterparts of the queries that SQL can express.

Encoding, mixing, defects and personal information have none: they are tested against the public
encoder, small exact cases and held-out pairs.
"""

LIKE = r"""words AS (SELECT chunk_row, batch_no, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM chunks WHERE text IS NOT NULL),
  grams AS (SELECT DISTINCT chunk_row, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT chunk_row, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
  sizes AS (SELECT chunk_row, count(*) AS n FROM grams GROUP BY 1),
  shared AS (SELECT a.chunk_row AS a, b.chunk_row AS b, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.chunk_row < b.chunk_row GROUP BY ALL),
  alike AS (SELECT a, b, s / (x.n + y.n - s)::DOUBLE AS likeness FROM shared JOIN sizes x ON a = x.chunk_row JOIN sizes y ON b = y.chunk_row WHERE s >= 0.6 * (x.n + y.n - s))"""
VECTORS = """good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM chunk_vectors WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  units AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM good),
  ranked AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_dot_product(a.v, b.v) / (a.n * b.n) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 9), b.vec_id) AS r FROM units a JOIN units b ON a.vec_id <> b.vec_id)"""


def _batches() -> str:
    parts = ["b AS (SELECT chunk_row, batch_no FROM chunks), link AS (SELECT a AS x, b AS y, likeness FROM alike UNION ALL SELECT b, a, likeness FROM alike), ok0 AS (SELECT chunk_row FROM b WHERE batch_no = 0)"]
    for i in range(1, 5):
        parts.append(f"bad{i} AS (SELECT b.chunk_row, max(likeness) AS likeness FROM b JOIN link ON b.chunk_row = x JOIN ok{i - 1} o ON o.chunk_row = y WHERE batch_no = {i} GROUP BY b.chunk_row)")
        parts.append(f"ok{i} AS (SELECT chunk_row FROM ok{i - 1} UNION ALL SELECT chunk_row FROM b WHERE batch_no = {i} AND chunk_row NOT IN (SELECT chunk_row FROM bad{i}))")
    return ", ".join(parts)


HEX = "regexp_extract(lower(document_id), '([0-9a-f]{64})[^0-9a-f]*$', 1)"
TRIMMED = "trim(segments[i].text, chr(32) || chr(9) || chr(13) || chr(10))"
ORACLES: dict[str, str] = {
    "p5_joined": f"SELECT delivery_id, CAST(i - 1 AS INT) AS segment_index, sha256(t) AS sha, true AS within, true AS overlap FROM (SELECT delivery_id, i, {TRIMMED} AS t FROM (SELECT delivery_id, segments, unnest(range(1, len(segments) + 1)) AS i FROM documents_norm)) WHERE length(t) > 1000",
    "p6_roundtrip": "SELECT doc_id, length(coalesce(text, ''))::INT AS chars, sha256(coalesce(text, '')) AS sha FROM documents",
    "p1_found": f"WITH {LIKE}, {_batches()}, h AS (SELECT delivery_id, batch_no, {HEX} AS hex FROM documents_norm WHERE document_id IS NOT NULL) "
    "SELECT 'document' AS record_kind, delivery_id AS record_key FROM h WHERE hex <> '' AND batch_no > (SELECT min(batch_no) FROM h g WHERE g.hex = h.hex) UNION ALL "
    + " UNION ALL ".join(f"SELECT 'chunk', chunk_row FROM bad{i}" for i in range(1, 5)),
    "p1_matches": f"WITH {LIKE}, {_batches()} " + " UNION ALL ".join(f"SELECT chunk_row, round(likeness, 6) AS similarity FROM bad{i}" for i in range(1, 5)),
    "p3_found": f"WITH RECURSIVE {LIKE}, link AS (SELECT a AS x, b AS y FROM alike UNION ALL SELECT b, a FROM alike), "
    "reach(x, root) AS (SELECT x, x FROM link UNION SELECT link.y, reach.root FROM reach JOIN link ON reach.x = link.x WHERE reach.root < link.y) "
    "SELECT min(root) AS canonical_row, x AS member_row FROM reach GROUP BY x HAVING min(root) < x",
    "p4_found": f"WITH {VECTORS} SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM ranked WHERE r <= 5 AND d <= 0.12",
    "p4_neighbours": f"WITH {VECTORS} SELECT a AS vec_id, b AS neighbour, CAST(r AS INT) AS rank, round(d, 6) + 0.0 AS distance FROM ranked WHERE r <= 5 AND a % 100 = 0",
    "p5_found": r"SELECT delivery_id, CAST(i - 1 AS INT) AS segment_index, CASE WHEN regexp_matches(t, '[^\s\x{B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.!?。！？]{1000}[^\s\x{B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.!?。！？]') THEN 'forced' ELSE 'natural' END AS cut_kind "
    "FROM (SELECT delivery_id, i, trim(segments[i].text, chr(32) || chr(9) || chr(13) || chr(10)) AS t FROM (SELECT delivery_id, segments, unnest(range(1, len(segments) + 1)) AS i FROM documents_norm)) WHERE length(t) > 1000",
}
