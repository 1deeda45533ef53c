"""Problem 3: groups of near-duplicate records.

Improved consistent weighted sampling over TF-IDF shingles. A record is the weighted set of its
hashed three-word shingles, the weight of a shingle is its inverse document frequency. Two records
agree in one sample with a probability equal to their weighted Jaccard similarity; records that
agree in all samples of one of the bands become candidates, and every candidate pair is verified
before it links two records. Linked records are joined into groups through other records.

A sample of a shingle depends on the shingle and its weight only, so it is drawn once for each
distinct shingle of a batch and records take minima over their shingles.

Sizes: document frequencies come from a count sketch of fixed size; band rows are ``BANDS`` for
each record, and those alone in their bucket go first. The pairs of a bucket of up to ``BUCKET``
records are pruned by an exact bound of folded shingles before anything else is read; larger
buckets are cut into parts that are paired inside, and the pairs that this leaves out are looked
for exactly, between records that are not in one group yet, by a join on their rarest shingles. Of
a band that many records of one slice share, a few are sent on and stand for the slice. Identical
texts share one node from the start, so a text that makes up a third of all rows counts once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import components
from scriptorium.llm.common import THREE_WORDS, mix64, shingles, slices, starts_of
from scriptorium.plans.session import discard, materialize, spread

SHINGLE, ALIKE = 3, 0.6
#: Sized for the lowest weighted likeness of a pair that is alike by ALIKE, see ``missed``.
BANDS, ROWS = 48, 3
#: Counters of the document-frequency sketch: two rows of a fixed width, whatever the corpus.
WIDTH, PARTS = 1 << 17, 64
#: Least weight as a share of the largest: a text whose near copies fill a good part of the corpus has
#: frequent shingles only, and these must still outweigh the few that an edit brings in.
FLOOR = 0.7
#: Records of a bucket that are all paired, and records of one slice that a band sends on.
BUCKET, SENT = 512, 64
#: Records of a shingle that one key of the exact join holds on either side.
HOT = 20_000
SLICE = 4_000
#: Bands of one place; the number of places follows from it.
PER_PLACE = 250_000
#: Stands for NULL in whole numbers; no hash of a text is likely to be it.
NONE = -(2**63)
FOLDS = ("bits0", "bits1", "bits2")


def missed(alike: float = ALIKE) -> float:
    """Greatest share of the pairs of unweighted likeness ``alike`` that no band has together: all that
    a pair shares weighs ``FLOOR`` of what it does not share."""
    return (1 - least_weighted(alike) ** ROWS) ** BANDS


def least_weighted(alike: float) -> float:
    """Lowest weighted likeness of a pair of this unweighted one."""
    return alike * FLOOR / (alike * FLOOR + 1 - alike)


# -- document frequencies ---------------------------------------------------------------------


def _slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(WIDTH - 1)
    return (codes & mask).astype(np.int64), ((codes >> np.uint64(32)) & mask).astype(np.int64) + WIDTH


def _folded(codes: np.ndarray, record: np.ndarray, records: int) -> np.ndarray:
    """All shingles of each record folded to 192 bits: the matrix record x 3 of whole numbers."""
    bits = np.zeros((records, 64 * len(FOLDS)), bool)
    bits[record, (mix64(codes) % np.uint64(64 * len(FOLDS))).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def first_pass(rows: DataFrame) -> DataFrame:
    """One pass over ``rows (id, node, text)``: counters of all shingles' document frequencies (``part,
    counts``, the last counter of the last part counts the rows) and what is kept of each row (``id, node,
    size, bits``).

    Each task sends ``2 * WIDTH`` counters, in ``PARTS`` parts.
    """

    def run(batches):
        total = np.zeros(2 * WIDTH + PARTS, np.int64)
        names = ["part", "counts", "id", "node", "size", *FOLDS]
        for batch in slices(batches, SLICE):
            total[-1] += batch.num_rows
            ids, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            doc, codes = shingles(batch.column(2).to_pylist(), SHINGLE)
            for slot in _slots(codes):
                total += np.bincount(slot, minlength=len(total))
            starts = starts_of(doc)
            if not len(starts):
                continue
            sizes = np.diff(np.r_[starts, len(doc)])
            bits = _folded(codes, np.repeat(np.arange(len(starts)), sizes), len(starts))
            columns = [pa.nulls(len(starts), pa.int32()), pa.nulls(len(starts), pa.binary()), pa.array(ids[doc[starts]]), pa.array(node[doc[starts]]), pa.array(sizes.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(bits[:, i]) for i in range(3))], names=names)
        if total[-1]:
            none = [pa.nulls(PARTS, kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([x.tobytes() for x in total.reshape(PARTS, -1)], pa.binary()), *none], names=names)

    return rows.select("id", "node", "text").mapInArrow(run, "part int, counts binary, id bigint, node bigint, size int, bits0 bigint, bits1 bigint, bits2 bigint")


def frequency_sketch(passed: DataFrame) -> tuple[np.ndarray, int]:
    """Count sketch of the document frequencies of ``first_pass``, and the number of rows; it has one
    size for any corpus."""

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "counts": [sum(np.frombuffer(x, np.int64) for x in frame["counts"]).tobytes()]})

    found = passed.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    sketch = np.zeros((PARTS, (2 * WIDTH + PARTS) // PARTS), np.int64)
    for row in found:
        sketch[row.part] = np.frombuffer(bytes(row.counts), np.int64)
    return sketch.ravel()[: 2 * WIDTH], int(sketch[-1, -1])


def inverse_frequency(sketch: np.ndarray, codes: np.ndarray, documents: int) -> np.ndarray:
    """ln(documents / frequency), with frequencies from the sketch less what its counters hold of other
    shingles on average, and at least ``FLOOR`` of ln(documents)."""
    first, second = _slots(codes)
    frequency = np.minimum(sketch[first], sketch[second]) - sketch[:WIDTH].sum() / WIDTH
    most = np.log(max(documents, 2))
    return np.maximum(most - np.log(np.maximum(frequency, 1.0)), FLOOR * most).astype(np.float32)


# -- consistent weighted samples ---------------------------------------------------------------


@lru_cache(maxsize=1)
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the midpoints of 2^12 parts, its logarithm at those of 2^16 parts."""

    def gamma(parts: int) -> np.ndarray:
        wanted = (np.arange(parts) + 0.5) / parts
        low, high = np.zeros(parts), np.full(parts, 60.0)
        for _ in range(60):
            middle = (low + high) / 2
            below = 1 - np.exp(-middle) * (1 + middle) < wanted
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        return (low + high) / 2

    return gamma(1 << 12).astype(np.float32), np.log(gamma(1 << 16)).astype(np.float32)


def samples(codes: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """Log sample values of each weighted element: the matrix element x sample.

    With r and c from Gamma(2, 1) and b from U(0, 1), all drawn from the hash of element and sample
    number: t = floor(ln w / r + b), value = ln c - r (t - b) - r.
    """
    gammas, logs = _quantiles()
    seeds = mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(codes), count), np.float32)
    log_w = np.log(weights)[:, None]
    block = 256  # so that all buffers stay in the cache
    z, w = np.empty((block, count), np.uint64), np.empty((block, count), np.uint64)
    r, t, b = (np.empty((block, count), np.float32) for _ in range(3))
    for start in range(0, len(codes), block):
        n = min(block, len(codes) - start)
        z, w, r, t, b = z[:n], w[:n], r[:n], t[:n], b[:n]
        np.bitwise_xor(codes[start : start + n, None], seeds, out=z)
        np.multiply(z, np.uint64(0xBF58476D1CE4E5B9), out=z)
        np.right_shift(z, np.uint64(32), out=w)
        np.bitwise_xor(z, w, out=z)
        np.multiply(z, np.uint64(0x94D049BB133111EB), out=z)
        np.right_shift(z, np.uint64(52), out=w)
        np.take(gammas, w.view(np.int64), out=r, mode="clip")
        half = z.view(np.uint32)[:, ::2]  # bits 16 to 31 give b, the next sixteen the place of ln c
        np.multiply(half, np.float32(2.0**-32), out=b, casting="unsafe")
        np.divide(log_w[start : start + n], r, out=t)
        np.add(t, b, out=t)
        np.floor(t, out=t)
        np.subtract(t, b, out=t)
        np.add(t, np.float32(1), out=t)
        np.multiply(t, r, out=t)
        np.right_shift(z, np.uint64(36), out=w)
        np.bitwise_and(w, np.uint64(0xFFFF), out=w)
        np.take(logs, w.view(np.int64), out=b, mode="clip")
        np.subtract(b, t, out=out[start : start + n])
    return out


def signatures(doc: np.ndarray, codes: np.ndarray, weights: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents with shingles, and their sample values (minimum over the shingles)."""
    starts = starts_of(doc)
    distinct, place = np.unique(codes, return_inverse=True)
    weight_of = np.empty(len(distinct), np.float32)
    weight_of[place] = weights
    table = samples(distinct, weight_of, count)
    result = np.empty((len(starts), count), np.float32)
    ends = np.r_[starts[1:], len(doc)]
    for first in range(0, len(starts), 64):
        last = min(first + 64, len(starts))
        a, b = starts[first], ends[last - 1]
        result[first:last] = np.minimum.reduceat(table[place[a:b]], starts[first:last] - a, axis=0)
    return doc[starts], result


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of each document's bands: the matrix document x band."""
    bits = values.view(np.uint32).reshape(len(values), -1, rows).astype(np.uint64)
    key = np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = np.broadcast_to(key, bits.shape[:2])
    for i in range(rows):
        key = mix64(key ^ bits[:, :, i])
    return key


def band_rows(nodes: DataFrame, sketch: np.ndarray, documents: int) -> DataFrame:
    """``(place, bands, nodes, heads, crowds)`` of ``nodes (node, text)``: the bands of a slice, packed for
    each of the ``places`` that bands are spread over. Texts that repeat in a batch are sampled once. Of a band that more than ``SENT`` records of a slice share, the others get a band of their own,
    the slice's first record as ``head`` and, like those sent, the band as ``crowd``."""
    shared = nodes.sparkSession.sparkContext.broadcast(sketch)
    places = np.uint64(places_for(documents))

    def run(batches):
        counts = shared.value
        for batch in slices(batches, SLICE):
            node = batch.column(0).to_numpy()
            node, first = np.unique(node, return_index=True)
            texts = batch.column(1).take(pa.array(first)).to_pylist()
            doc, codes = shingles(texts, SHINGLE)
            if not len(doc):
                continue
            which, values = signatures(doc, codes, inverse_frequency(counts, codes, documents), BANDS * ROWS)
            keys, ids = band_keys(values, ROWS).ravel(), np.repeat(node[which], BANDS)
            head, crowd = np.full(len(keys), NONE), np.full(len(keys), NONE)
            if len(which) > SENT:
                order = np.argsort(keys, kind="stable")
                starts = starts_of(keys[order])
                sizes = np.diff(np.r_[starts, len(keys)])
                if sizes.max() > SENT:
                    row = np.repeat(np.arange(len(starts)), sizes)
                    full, late = (sizes > SENT)[row], np.arange(len(keys)) - starts[row] >= SENT
                    crowd[order[full]] = keys.view(np.int64)[order[full]]
                    head[order[late]] = ids[order[starts[row[late]]]]
                    keys[order[late]] = mix64(keys[order[late]] ^ mix64(ids[order[late]].view(np.uint64)))
            place = (mix64(keys) % places).astype(np.int32)
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order])) + 1
            split = lambda values: [x.tobytes() for x in np.split(values[order], cuts)]
            columns = [split(keys.view(np.int64)), split(ids)]
            columns += [split(x) if x.max() != NONE else [None] * len(columns[0]) for x in (head, crowd)]  # hardly any slice has these
            yield pa.RecordBatch.from_arrays([pa.array(place[order[np.r_[0, cuts]]]), *(pa.array(c, pa.binary()) for c in columns)], names=["place", "bands", "nodes", "heads", "crowds"])

    return nodes.mapInArrow(run, "place int, bands binary, nodes binary, heads binary, crowds binary")


def unpacked(batches) -> list[np.ndarray]:
    """Bands, nodes, heads and crowds of all packed rows of a partition."""
    columns = [[] for _ in range(4)]
    for batch in batches:
        for bands, *others in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            for column, packed in zip(columns, (bands, *others), strict=True):
                column.append(np.frombuffer(packed, np.int64) if packed is not None else np.full(len(bands) // 8, NONE))
    return [np.concatenate([np.empty(0, np.int64), *c]) for c in columns]


def _whole(batches, kinds: tuple) -> list[np.ndarray]:
    """The columns of all batches of a partition; NULL becomes ``NONE``."""
    parts = [[(c.fill_null(NONE) if c.null_count else c).to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
    return [np.concatenate([np.empty(0, kind), *(p[i] for p in parts)]) for i, kind in enumerate(kinds)]


def places_for(documents: int) -> int:
    """Places that the bands of so many documents are spread over."""
    return max(12, documents * BANDS // PER_PLACE)


def bucketed(bands: DataFrame, places: int = 12) -> DataFrame:
    """``(band, part, node, head, crowd)`` without the records alone in their bucket; ``crowd`` is set
    where a bucket leaves pairs out. A task holds its share of the bands, which stays small however hot
    a band is, since each slice sends at most ``SENT`` of its records on."""

    def run(batches):
        band, node, head, crowd = unpacked(batches)
        for again in range(2):  # then without texts that several slices sent
            order = np.lexsort((node, band)) if again else np.argsort(band)
            starts = starts_of(band[order])
            size = np.repeat(np.diff(np.r_[starts, len(band)]), np.diff(np.r_[starts, len(band)]))
            keep = (size > 1) | (head[order] != NONE)
            if again:
                n = node[order]
                keep &= np.r_[True, (n[1:] != n[:-1]) | (band[order][1:] != band[order][:-1])][: len(n)] | (head[order] != NONE)
            order = order[keep]
            band, node, head, crowd, size = band[order], node[order], head[order], crowd[order], size[keep]
        part = (mix64(node.view(np.uint64)) % np.maximum(-(-size // BUCKET), 1).astype(np.uint64)).astype(np.int32)
        crowd = np.where((crowd == NONE) & (size > BUCKET), band, crowd)
        for start in range(0, len(band), 100_000):
            some = slice(start, start + 100_000)
            columns = [pa.array(band[some]), pa.array(part[some]), pa.array(node[some])]
            columns += [pa.array(x[some], mask=x[some] == NONE) for x in (head, crowd)]
            yield pa.RecordBatch.from_arrays(columns, names=["band", "part", "node", "head", "crowd"])

    return bands.repartitionById(places, "place").mapInArrow(run, "band bigint, part int, node bigint, head bigint, crowd bigint")


def may_be_alike(a: str = "a", b: str = "b") -> str:
    """Exact bounds of an alike pair by sizes and folded bits: folding brings two records only nearer."""
    apart = " + ".join(f"bit_count({f}_{a} ^ {f}_{b})" for f in FOLDS)
    return f"least(size_{a}, size_{b}) >= {ALIKE} * greatest(size_{a}, size_{b}) - 1e-6 and {apart} <= (size_{a} + size_{b}) * {(1 - ALIKE) / (1 + ALIKE)} + 1e-6"


def candidate_pairs(buckets: DataFrame, kept: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` with a < b, representatives of the buckets' parts that can be alike, by what is
    ``kept (node, rep, size, bits)`` of each text. No part has many more than ``BUCKET`` records."""

    def run(batches):
        band, part, node, size, *bits = _whole(batches, (np.int64, np.int32, np.int64, np.int32, np.int64, np.int64, np.int64))
        order = np.lexsort((node, part, band))
        band, part, node, size, bits = band[order], part[order], node[order], size[order].astype(np.int64), np.stack(bits, axis=1)[order]
        starts = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (part[1:] != part[:-1])][: len(band)])
        ends = np.repeat(np.r_[starts[1:], len(band)], np.diff(np.r_[starts, len(band)])) if len(band) else starts
        after = ends - np.arange(len(band)) - 1  # records of the bucket behind each one
        found = [np.empty((0, 2), np.int64)]
        cuts = np.searchsorted(np.cumsum(after), np.arange(0, int(after.sum()) + 1, 500_000), "left") if len(band) else np.empty(0, np.int64)
        for start, end in zip(cuts, np.r_[cuts[1:], len(band)], strict=True):
            count = after[start:end]
            a = np.repeat(np.arange(start, end), count)
            b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + a + 1
            near = np.flatnonzero((node[a] != node[b]) & (np.minimum(size[a], size[b]) >= ALIKE * np.maximum(size[a], size[b]) - 1e-6))
            a, b = a[near], b[near]
            # folding brings two records only nearer to each other
            apart = np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            near = apart <= (1 - ALIKE) / (1 + ALIKE) * (size[a] + size[b]) + 1e-6
            found.append(np.stack([node[a[near]], node[b[near]]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if len(band) else found[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(2)], names=["a", "b"])

    rows = buckets.select("band", "part", "node").join(kept, "node").select("band", "part", "rep", "size", *FOLDS)
    pairs = rows.repartition("band", "part").mapInArrow(run, "a bigint, b bigint")
    led = buckets.where("head is not null and head <> node").select("node", "head").distinct()
    led = led.join(kept.select("node", F.col("rep").alias("x")), "node").join(kept.select(F.col("node").alias("head"), F.col("rep").alias("y")), "head")
    return pairs.union(led.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


# -- verification -------------------------------------------------------------------------------


def packed_shingles(texts: DataFrame) -> DataFrame:
    """``(id, codes binary)`` of ``texts (id, text)``: the sorted shingle hashes of each text."""

    def run(batches):
        for batch in slices(batches, SLICE):
            ids = batch.column(0).to_numpy()
            doc, codes = shingles(batch.column(1).to_pylist(), SHINGLE)
            starts = starts_of(doc)
            parts = np.split(codes, starts[1:]) if len(starts) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc[starts]] if len(starts) else ids[:0]), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "codes"]
            )

    return texts.mapInArrow(run, "id bigint, codes binary")


def shared_and_whole(a: list[bytes], b: list[bytes], weigh) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What both shingle sets of each pair hold and what either holds: numbers, then weights."""
    sides = [np.frombuffer(b"".join(x), np.uint64) for x in (a, b)]
    pair = [np.repeat(np.arange(len(x)), [len(c) // 8 for c in x]) for x in (a, b)]
    codes, of = np.concatenate(sides), np.concatenate(pair)
    order = np.lexsort((codes, of))
    codes, of = codes[order], of[order]
    weight = weigh(codes).astype(np.float64) if len(codes) else np.empty(0)
    twice = np.zeros(len(codes), bool)
    twice[1:] = (codes[1:] == codes[:-1]) & (of[1:] == of[:-1])
    n = len(a)
    both, all_ = np.bincount(of[twice], minlength=n), np.bincount(of[~twice], minlength=n)
    return both, all_, np.bincount(of[twice], weight[twice], n), np.bincount(of[~twice], weight[~twice], n)


def verified(pairs: DataFrame, packed: DataFrame, sketch: np.ndarray, documents: int, at_least: float = ALIKE) -> DataFrame:
    """``(a, b, similarity, weighted)`` of the pairs whose likeness is at least ``at_least``. The weighted
    likeness is the first filter: it is no lower than ``least_weighted`` of an alike pair."""
    joined = pairs.join(packed.select(F.col("id").alias("a"), F.col("codes").alias("ca")), "a").join(
        packed.select(F.col("id").alias("b"), F.col("codes").alias("cb")), "b"
    )
    shared = pairs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        for batch in slices(batches, SLICE):
            both, all_, heavy, whole = shared_and_whole(batch.column(2).to_pylist(), batch.column(3).to_pylist(), lambda codes: inverse_frequency(shared.value, codes, documents))
            weighted = heavy / np.maximum(whole, 1e-300)
            keep = np.flatnonzero(weighted >= least_weighted(at_least) - 1e-6)
            likely = both[keep] / np.maximum(all_[keep], 1)
            keep, likely = keep[likely >= at_least], likely[likely >= at_least]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(likely), pa.array(weighted[keep])], names=["a", "b", "similarity", "weighted"])

    return joined.select("a", "b", "ca", "cb").mapInArrow(run, "a bigint, b bigint, similarity double, weighted double")


# -- the exact pass over crowded buckets ---------------------------------------------------------


def prefixes(rows: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``(code, id, root, size, place, bits0, bits1, bits2)`` of ``rows (id, root, codes)``: the rarest
    shingles of each record, so many that two records alike by ``ALIKE`` share at least one of them,
    and all of the record's shingles folded to 192 bits."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        for batch in slices(batches, SLICE):
            codes = [np.frombuffer(c, np.uint64) for c in batch.column(2).to_pylist()]
            sizes = np.array([len(c) for c in codes], np.int64)
            flat, record = np.concatenate([np.empty(0, np.uint64), *codes]), np.repeat(np.arange(len(codes)), sizes)
            bits = _folded(flat, record, len(codes))
            first, second = _slots(flat)
            flat = flat[np.lexsort((flat, np.minimum(shared.value[first], shared.value[second]), record))]
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = place <= sizes[record] - np.ceil(ALIKE * sizes[record] - 1e-9)
            flat, record, place = flat[keep], record[keep], place[keep]
            take = pa.array(record)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(sizes[record].astype(np.int32)), pa.array(place.astype(np.int32)), *(pa.array(bits[record, i]) for i in range(3))],
                names=["code", "id", "root", "size", "place", *FOLDS],
            )

    return rows.select("id", "root", "codes").mapInArrow(run, "code bigint, id bigint, root bigint, size int, place int, bits0 bigint, bits1 bigint, bits2 bigint")


def crowded_pairs(crowds: DataFrame, packed: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Distinct ``(a, b)`` with a < b of ``crowds (crowd, id, root)`` that can be alike and have
    different roots: an exact join on the rarest shingles of all records of buckets that hold more
    than one group. Records that share a hot shingle are cut in parts; each pair of parts is a key."""
    mixed = crowds.groupBy("crowd").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("crowd")
    ids = crowds.join(mixed, "crowd", "left_semi").select("id", "root").distinct()
    rows = materialize(prefixes(packed.join(ids, "id"), sketch), "prefixes")
    # a shingle of one group pairs nothing
    hot = rows.groupBy("code").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rows = rows.join(hot.select("code", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "code")
    own, others = F.pmod(F.xxhash64("id"), "parts").cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)

    def side(x: str, mine: str, other: str) -> DataFrame:
        names = [F.col(c).alias(f"{c}_{x}") for c in ("id", "root", "size", "place", *FOLDS)]
        return rows.select("code", *names, own.alias(mine), F.explode(others).alias(other))

    pairs = side("a", "p", "q").join(side("b", "q", "p"), ["code", "p", "q"])
    # alike records share this much; of the first shared shingle on, no more than what follows is shared
    least = F.expr(f"(size_a + size_b) * {ALIKE / (1 + ALIKE)} - 1e-6")
    pairs = pairs.where((F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & (F.expr("least(size_a - place_a, size_b - place_b)") >= least))
    pairs = pairs.where(may_be_alike())
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


# -- the operator -------------------------------------------------------------------------------


class NearDuplicates:
    """Groups of alike texts of ``rows[key, text]``.

    ``key`` must be unique. NULL texts and texts of fewer than three words are like nothing; texts
    of any length are taken as a whole; equal texts are alike; an empty table has no groups; other
    columns are ignored, whatever their names. The representative of equal texts is the row with
    the smallest key, and the canonical row of a group is its smallest key.
    """

    def __init__(self, rows: DataFrame, key: str = "chunk_row", text: str = "text"):
        rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
        self.rows = spread(rows).where(F.col("text").rlike(THREE_WORDS)).withColumn("node", F.xxhash64("text"))
        self.passed: DataFrame | None = None

    def membership(self) -> DataFrame:
        """``(id, node, rep)``: the representative row of each row's text, of texts with a shingle."""
        if self.passed is None:
            self.passed = materialize(first_pass(self.rows), "first")
        rows = self.passed.where("node is not null").select("id", "node")
        return rows.join(rows.groupBy("node").agg(F.min("id").alias("rep")), "node")

    def links(self) -> DataFrame:
        """``(a, b, similarity, weighted)`` of representatives, verified: those of all buckets, then all
        across groups of the records of buckets whose pairs were not all looked at."""
        self.passed = materialize(first_pass(self.rows), "first")
        self.sketch, self.documents = frequency_sketch(self.passed)
        kept = self.passed.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), *(F.min(c).alias(c) for c in ("size", *FOLDS)))
        buckets = materialize(bucketed(band_rows(self.rows.select("node", "text"), self.sketch, self.documents), places_for(self.documents)), "buckets")
        pairs = materialize(candidate_pairs(buckets, kept), "pairs")
        crowds = buckets.where("crowd is not null").select("crowd", "node").distinct().join(kept.select("node", F.col("rep").alias("id")), "node").select("crowd", "id")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowds.select("id")).distinct()
        packed = materialize(packed_shingles(self.rows.join(wanted, "id", "left_semi").select("id", "text")), "shingles")
        links = materialize(verified(pairs, packed, self.sketch, self.documents), "links")
        if not buckets.where("crowd is not null").isEmpty():
            roots = components.labels(links.select("a", "b"))
            crowds = materialize(crowds.join(roots, "id", "left").select("crowd", "id", F.coalesce("root", "id").alias("root")), "crowds")
            more = crowded_pairs(crowds, packed, self.sketch)
            links = links.union(materialize(verified(more, packed, self.sketch, self.documents), "crowded"))
            discard(crowds, roots)
        discard(buckets, pairs, packed)
        return links

    def groups(self, links: DataFrame | None = None) -> DataFrame:
        """``(canonical_row, member_row)`` of each group of two or more rows, canonical < member."""
        links = self.links() if links is None else links
        roots = components.labels(links.select("a", "b"))
        members = self.membership().join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
        members = members.select(F.coalesce("root", "rep").alias("canonical_row"), F.col("id").alias("member_row"))
        return members.where("canonical_row < member_row")


def found(chunks: DataFrame) -> DataFrame:
    """The groups of ``chunks``, as ``(canonical_row, member_row)``."""
    return NearDuplicates(chunks).groups()


def records(chunks: DataFrame) -> DataFrame:
    """Duplicate records: each member with its canonical row, its kind (``exact`` for an equal text,
    ``near``), its likeness to the canonical text and the likeness weighted by inverse frequency."""
    operator = NearDuplicates(chunks)
    members = materialize(operator.groups(), "members")
    ids = members.select(F.explode(F.array("canonical_row", "member_row")).alias("id")).distinct()
    packed = packed_shingles(operator.rows.join(ids, "id", "left_semi").select("id", "text"))
    pairs = members.select(F.col("canonical_row").alias("a"), F.col("member_row").alias("b"))
    scored = verified(pairs, packed, operator.sketch, operator.documents, 0.0)
    node = operator.rows.select("id", "node")
    scored = scored.join(node.select(F.col("id").alias("a"), F.col("node").alias("na")), "a").join(
        node.select(F.col("id").alias("b"), F.col("node").alias("nb")), "b"
    )
    kind = F.when(F.col("na") == F.col("nb"), "exact").otherwise("near")
    return scored.select(F.col("a").alias("canonical_row"), F.col("b").alias("member_row"), kind.alias("duplicate_type"), F.round("similarity", 6).alias("similarity"), F.round("weighted", 6).alias("weighted_similarity"))
