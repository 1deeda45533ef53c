"""Problem 1: checking new batches against everything accepted before.

A persisted inverted file of vector cells. A text is the sparse 0/1 vector of its hashed three-word
shingles; the cells are the axes of that space, each holding the accepted vectors that lie on it,
and the full vectors are kept beside them. For a query of n coordinates the cells are probed rarest
axis first. An accepted vector that was in none of the first p probed cells lacks p of the query's
coordinates, so its likeness is at most (n - p) / n; as soon as that bound is below the wanted
likeness no nearer match is possible and probing stops. The bound is exact, hence n - ceil(0.6 n) + 1
probes suffice, and vectors need to be filed only under as many of their own rarest axes. (Cells
around trained centroids were considered: random texts are all about equally far from each other,
so bounds by centroid and radius exclude nothing and every batch would scan the whole history.)
What was found is reranked exactly by the full vectors; rows that repeat nothing are appended.

Layout of the index folder: ``order`` (the fixed order of axes), ``gen=<batch>/kind=cell|ask|vec/
bucket=<k>`` (filed axes and full vectors of the batch's texts, in blocks sorted by axis or text that
carry their bounds, in small row groups) and ``rejected/gen=<batch>``. An axis that many texts share is
spread over several buckets, in all of which a text on it asks. A batch is vectorised and filed once;
the task of a bucket then opens that bucket's files and reads the row groups only, by the bounds in the
footers, that hold an axis the batch asks for. Nothing of the history is vectorised, sorted or shuffled
again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import THREE_WORDS, likeness, shingles, slices, starts_of
from scriptorium.plans.session import discard, materialize, new_dir

SHINGLE, ALIKE = 3, 0.6
#: Counters that tell common axes from rare ones (one byte each in the end), a fixed size filled once
#: from the first batch, and the parts in which they are added up.
WIDTH, WIDTH_PARTS = 1 << 20, 64
#: Filed axes that one bucket should hold at most; the number of buckets follows from it.
PER_BUCKET = 250_000
#: An axis on which more texts lie in the first batch is spread over several buckets by its texts.
HOT_AXIS = 1 << 17
#: Vectors of one cell that a query looks at in the first pass, nearest in size first; the rest is
#: looked at in the second pass unless the first found the query's own text.
FIRST_PASS = 256
SLICE = 4_000
#: Candidate pairs that one group of a bucket scores.
PART_PAIRS = 200_000
#: Stands for the texts that a query has not looked at yet.
MORE = -(2**63) + 1
#: What a cell keeps of each of its texts: hash, number of coordinates, the vector folded to 192 bits.
FOLDS = 3
HEAD = np.dtype([("node", np.int64), ("n", np.uint32), ("bits", np.uint64, (FOLDS,))])
ENTRY = np.dtype([("axis", np.uint32), ("place", np.uint16), ("text", np.uint16)])
PACKED = "gen int, kind string, bucket int, a binary, b binary, c binary"
FILED = "gen int, kind string, bucket int, lo bigint, hi bigint, a binary, b binary, c binary"
#: Entries of a block of cells and texts of a block of vectors; bytes of a row group, a few blocks.
BLOCK, TEXTS, GROUP_BYTES = 1_500, 128, 1 << 16


def _read(path: str, kind: str, bucket: int, before: int | None = None, only: int | None = None, wanted: np.ndarray | None = None) -> list[tuple[bytes, bytes, bytes]]:
    """Blocks of one bucket, of the generations before or of one; run inside tasks. With ``wanted`` (sorted
    axes or texts) only row groups are read, by the bounds in the file's footer, that may hold one."""
    system, root = fs.FileSystem.from_uri(path)
    rows = []
    for entry in system.get_file_info(fs.FileSelector(root)):
        name = entry.base_name
        if not name.startswith("gen="):
            continue
        gen = int(name[4:])
        if (only is not None and gen != only) or (before is not None and gen >= before):
            continue
        folder = f"{entry.path}/kind={kind}/bucket={bucket}"
        if system.get_file_info(folder).type == fs.FileType.NotFound:
            continue
        for file in system.get_file_info(fs.FileSelector(folder)):
            if file.base_name.endswith(".parquet"):
                with system.open_input_file(file.path) as source:
                    rows += _blocks(pq.ParquetFile(source), wanted)
    return rows


def _blocks(file: pq.ParquetFile, wanted: np.ndarray | None) -> list[tuple[bytes, bytes, bytes]]:
    """The blocks of a file that may hold one of the wanted keys."""
    groups = list(range(file.metadata.num_row_groups))
    if wanted is not None:
        if not len(wanted):
            return []
        names = file.schema_arrow.names
        at = [names.index("lo"), names.index("hi")]
        bounds = [[file.metadata.row_group(i).column(j).statistics for j in at] for i in groups]
        low = np.array([lo.min if lo is not None and lo.has_min_max else -(2**63) for lo, _ in bounds], np.int64)
        high = np.array([hi.max if hi is not None and hi.has_min_max else 2**63 - 1 for _, hi in bounds], np.int64)
        groups = np.flatnonzero(np.searchsorted(wanted, low, "left") < np.searchsorted(wanted, high, "right")).tolist()
    if not groups:
        return []
    table = file.read_row_groups(groups, columns=["lo", "hi", "a", "b", "c"])
    if wanted is not None:
        low, high = table.column("lo").to_numpy(), table.column("hi").to_numpy()
        table = table.take(pa.array(np.flatnonzero(np.searchsorted(wanted, low, "left") < np.searchsorted(wanted, high, "right"))))
    return list(zip(*(table.column(c).to_pylist() for c in ("a", "b", "c")), strict=True))


class TextHistory:
    """The index. Texts are known by the hash of their content, so copies share one entry.

    NULL texts and texts with fewer than three words are neither filed nor ever a case; long texts
    count as a whole; an empty batch changes nothing. Batches must be added in their order.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_dir(spark, "history")
        self.buckets: int | None = None
        self.order: np.ndarray | None = None

    # -- filing ----------------------------------------------------------------------------------

    def start(self, texts: DataFrame) -> None:
        """Fix the order of axes and the number of buckets by the first batch ``(node, text)``."""

        def count(batches):
            total, number = np.zeros(WIDTH, np.int64), 0
            for batch in slices(batches, SLICE):
                _, codes = shingles(batch.column(0).to_pylist(), SHINGLE)
                total += np.bincount((codes & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
                number += len(codes)
            if number:
                parts = [x.tobytes() for x in total.reshape(WIDTH_PARTS, -1)]
                yield pa.RecordBatch.from_arrays([pa.array(range(WIDTH_PARTS)), pa.array(parts, pa.binary())], names=["part", "counts"])

        def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.int64) for x in frame["counts"])
            classes = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)
            return pd.DataFrame({"part": [key[0]], "n": [int(total.sum())], "classes": [classes.tobytes()]})

        counted = texts.select("text").mapInArrow(count, "part bigint, counts binary").groupBy("part")
        rows = {r.part: r for r in counted.applyInPandas(add, "part bigint, n bigint, classes binary").collect()}  # WIDTH bytes
        none = bytes(WIDTH // WIDTH_PARTS)
        self.order = np.frombuffer(b"".join(bytes(rows[i].classes) if i in rows else none for i in range(WIDTH_PARTS)), np.uint8)
        total = sum(r.n for r in rows.values())
        self.buckets = int(max(12, -(-total * (1 - ALIKE) // PER_BUCKET)))
        self.spark.createDataFrame([(bytearray(self.order.tobytes()), self.buckets)], "axes binary, buckets int").write.mode("overwrite").parquet(f"{self.path}/order")

    def resume(self) -> TextHistory:
        """Take up an index that another session wrote."""
        row = self.spark.read.parquet(f"{self.path}/order").first()
        self.order, self.buckets = np.frombuffer(bytes(row.axes), np.uint8), int(row.buckets)
        return self

    def file(self, texts: DataFrame, gen: int) -> None:
        """Vectorise the texts ``(node, text)`` of a batch and file them as generation ``gen``."""
        shared = self.spark.sparkContext.broadcast(self.order)
        buckets = self.buckets

        def vectors(batches):
            rare = shared.value
            for batch in slices(batches, SLICE):
                node = batch.column(0).to_numpy()
                node, first = np.unique(node, return_index=True)
                doc, codes = shingles(batch.column(1).take(pa.array(first)).to_pylist(), SHINGLE)
                if not len(doc):
                    continue
                axes = codes.astype(np.uint32)  # a coordinate is the low half of a shingle's hash
                rank = rare[(codes & np.uint64(WIDTH - 1)).astype(np.int64)]
                order = np.lexsort((axes, rank, doc))
                starts = starts_of(doc)
                n = np.diff(np.r_[starts, len(doc)])
                probes = n - np.ceil(ALIKE * n - 1e-9).astype(np.int64) + 1
                place = np.arange(len(doc)) - np.repeat(starts, n)
                filed = order[place < np.repeat(probes, n)]
                ids = node[doc[starts]]
                heads = np.empty(len(starts), HEAD)
                heads["node"], heads["n"], heads["bits"] = ids, n, _bitmaps(axes, np.repeat(np.arange(len(starts)), n), len(starts))
                row = np.repeat(np.arange(len(starts)), n)[filed]
                at = np.minimum(place[place < np.repeat(probes, n)], 0xFFFF).astype(np.uint16)
                axis, spread = axes[filed], _spread(rank[filed])
                own = (ids[row] % spread).astype(np.int64)
                yield from _pack(gen, "cell", _bucket(axis, own, buckets), axis, at, row, heads)
                hot = np.flatnonzero(spread > 1)  # such a text asks in the other buckets of its axis too
                if len(hot):
                    times = spread[hot] - 1
                    again = np.repeat(hot, times)
                    step = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times) + 1
                    other = (own[again] + step) % spread[again]
                    yield from _pack(gen, "ask", _bucket(axis[again], other, buckets), axis[again], at[again], row[again], heads)
                parts = np.split(np.sort(axes.astype(np.uint64) | (doc.astype(np.uint64) << np.uint64(32))).astype(np.uint32), starts[1:])
                home = ids % buckets
                for bucket in np.unique(home):
                    mine = np.flatnonzero(home == bucket)
                    yield _row(gen, "vec", int(bucket), ids[mine], n[mine].astype(np.int32), np.concatenate([parts[i] for i in mine]))

        block, group = BLOCK, TEXTS
        rows = texts.select("node", "text").mapInArrow(vectors, PACKED).repartitionById(self.buckets, "bucket")
        rows = rows.mapInArrow(lambda batches: _sorted_blocks(batches, block, group), FILED)
        writer = rows.drop("gen").write.mode("overwrite").partitionBy("kind", "bucket")
        # small row groups, so that a batch reads what it asks for
        writer = writer.option("parquet.block.size", str(GROUP_BYTES)).option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "1")
        writer.parquet(f"{self.path}/gen={gen}")

    # -- probing ---------------------------------------------------------------------------------

    def _candidates(self, gen: int, queries: DataFrame | None) -> DataFrame:
        """``(q, x, more)``: texts of ``gen`` and earlier texts in their cells. With ``queries`` (the
        second pass) only those, and all of their candidates."""
        path, buckets = self.path, self.buckets
        limit = FIRST_PASS if queries is None else 0
        places = self.spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).repartition(buckets)

        def probe(bucket: int, wanted: np.ndarray | None) -> pd.DataFrame:
            axis, at_q, head_q = _entries(_read(path, "cell", bucket, only=gen) + _read(path, "ask", bucket, only=gen), None)
            if wanted is not None:
                keep = np.isin(head_q["node"], wanted)
                axis, at_q, head_q = axis[keep], at_q[keep], head_q[keep]
            asked = np.unique(axis)
            cells, at_x, head_x = _entries(_read(path, "cell", bucket, before=gen, wanted=asked.astype(np.int64)), asked)
            if not len(cells):
                return pd.DataFrame({"q": np.empty(0, np.int64), "x": np.empty(0, np.int64), "more": np.empty(0, bool)})
            q, filed = head_q["node"], head_x["node"]
            order = np.lexsort((head_x["n"], cells))
            cells, filed, at_x, head_x = cells[order], filed[order], at_x[order], head_x[order]
            low, high = np.searchsorted(cells, axis, "left"), np.searchsorted(cells, axis, "right")
            hit = np.flatnonzero(high > low)
            low, size, q, at_q, head_q = low[hit], (high - low)[hit], q[hit], at_q[hit].astype(np.int64), head_q[hit]
            over = size > limit if limit else np.zeros(len(size), bool)
            for i in np.flatnonzero(over):
                middle = low[i] + int(np.searchsorted(head_x["n"][low[i] : low[i] + size[i]], head_q["n"][i]))
                low[i] = min(max(low[i], middle - limit // 2), low[i] + size[i] - limit)
            size = np.where(over, limit, size) if limit else size
            found = []
            bounds = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + 1, 500_000), "left")
            for start, end in zip(bounds, np.r_[bounds[1:], len(size)], strict=True):
                if end <= start:
                    continue
                count = size[start:end]
                run = np.repeat(np.arange(start, end), count)
                at = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + low[run]
                nq, nx = head_q["n"][run].astype(np.int64), head_x["n"][at].astype(np.int64)
                # the first axis two alike vectors share leaves room for all the others they share
                need = np.ceil((ALIKE / (1 + ALIKE)) * (nq + nx) - 1e-9)
                near = np.flatnonzero(np.minimum(nq - at_q[run], nx - at_x[at].astype(np.int64)) >= need)
                run, at = run[near], at[near]
                # folding a vector to few coordinates can only bring two vectors nearer to each other
                apart = np.bitwise_count(head_q["bits"][run] ^ head_x["bits"][at]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(apart <= (1 - ALIKE) / (1 + ALIKE) * (nq + nx)[near] + 1e-9)
                run, at = run[near], at[near]
                found.append(np.stack([q[run], filed[at], over[run].astype(np.int64)], axis=1))
            got = np.concatenate([*found, np.empty((0, 3), np.int64)])
            skipped = np.unique(q[over])  # these may have more even if nothing came of the first
            got = np.concatenate([got, np.stack([skipped, np.full(len(skipped), MORE), np.ones(len(skipped), np.int64)], axis=1)])
            got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
            last = np.ones(len(got), bool)
            last[:-1] = (got[1:, 0] != got[:-1, 0]) | (got[1:, 1] != got[:-1, 1])
            got = got[last]
            return pd.DataFrame({"q": got[:, 0], "x": got[:, 1], "more": got[:, 2] > 0})

        schema = "q bigint, x bigint, more boolean"
        if queries is None:

            def run(batches):
                for frame in batches:
                    for bucket in frame["bucket"]:
                        yield probe(int(bucket), None)

            return places.mapInPandas(run, schema)

        # Each bucket needs the queries of its own cells only; they are told by the vectors' axes.
        shared = self.spark.sparkContext.broadcast(self.order)

        def axes_of(batches):
            order = shared.value
            for frame in batches:
                for bucket, part in frame.groupby("home"):
                    vectors = _vectors(path, int(bucket), np.sort(part["q"].to_numpy()), only=gen)
                    for node, axes in vectors.items():
                        spread = _spread(order[(axes & np.uint32(WIDTH - 1)).astype(np.int64)])
                        part = np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread, spread)
                        yield pd.DataFrame({"bucket": np.unique(_bucket(np.repeat(axes, spread), part, buckets)).astype(np.int32), "q": node})

        spread = queries.select("q", F.pmod("q", F.lit(buckets)).alias("home")).repartition("home").mapInPandas(axes_of, "bucket int, q bigint")
        
        def again(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return probe(int(key[0]), np.sort(frame["q"].to_numpy()))

        return spread.groupBy("bucket").applyInPandas(again, schema)

    def _score(self, pairs: DataFrame, gen: int) -> DataFrame:
        """``(q, x, similarity)`` of candidate pairs by their full vectors, read bucket by bucket; a bucket
        of many pairs is cut into parts of about ``PART_PAIRS``."""
        path, buckets = self.path, self.buckets
        pairs = materialize(pairs.select("q", "x"), "open-pairs")
        parts = max(1, -(-pairs.count() // (buckets * PART_PAIRS)))
        part = F.pmod(F.xxhash64("q", "x"), F.lit(parts)).alias("part")

        def attach(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            vectors = _vectors(path, int(key[0]), np.unique(frame["q"].to_numpy()), only=gen)
            frame = frame[frame["q"].isin(vectors.keys())]
            return pd.DataFrame({"q": frame["q"], "x": frame["x"], "vector": [vectors[q].tobytes() for q in frame["q"]]})

        def score(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            vectors = _vectors(path, int(key[0]), np.unique(frame["x"].to_numpy()), before=gen)
            frame = frame[frame["x"].isin(vectors.keys())]
            values = [likeness(np.frombuffer(v, np.uint32), vectors[x]) for v, x in zip(frame["vector"], frame["x"], strict=True)]
            return pd.DataFrame({"q": frame["q"], "x": frame["x"], "similarity": np.array(values, np.float64)})

        with_vector = pairs.select("q", "x", F.pmod("q", F.lit(buckets)).alias("hq"), part).groupBy("hq", "part").applyInPandas(attach, "q bigint, x bigint, vector binary")
        return with_vector.select("q", "x", "vector", F.pmod("x", F.lit(buckets)).alias("hx"), part).groupBy("hx", "part").applyInPandas(score, "q bigint, x bigint, similarity double")

    def rejected(self, before: int | None = None) -> DataFrame:
        """``(gen, node, x, similarity)`` of the texts turned down so far."""
        schema = "gen int, node bigint, x bigint, similarity double"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/rejected")
        except Exception as error:  # no batch has turned anything down yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)
        return rows if before is None else rows.where(F.col("gen") < before)

    def check(self, texts: DataFrame, gen: int) -> DataFrame:
        """File the batch ``(node, text)``, find its texts that repeat an accepted one, note them as
        rejected (all others are accepted by that), and return ``(node, x, similarity)``."""
        if self.order is None:
            self.start(texts)
        self.file(texts, gen)
        turned_down = self.rejected(gen)
        # a text that only repeats itself stays accepted
        no_longer = turned_down.where("node <> x").select(F.col("node").alias("x")).distinct()

        def matches(queries: DataFrame | None) -> tuple[DataFrame, DataFrame]:
            seen = materialize(self._candidates(gen, queries).groupBy("q", "x").agg(F.max("more").alias("more")), "candidates")
            same = seen.where("q = x").select("q", "x", F.lit(1.0).alias("similarity")).join(no_longer, "x", "left_anti").select("q", "x", "similarity")
            others = seen.where((F.col("q") != F.col("x")) & (F.col("x") != MORE)).join(no_longer, "x", "left_anti").join(same.select("q"), "q", "left_anti")
            hits = self._score(others, gen).where(F.col("similarity") >= ALIKE)
            return materialize(same.union(hits), "matches"), seen

        hits, seen = matches(None)
        used = [hits, seen]
        # what was skipped may be nearer than any hit but the text itself
        settled = hits.where("q = x").select("q").distinct()
        open_ = seen.where("more").select("q").distinct().join(settled, "q", "left_anti")
        if not open_.isEmpty():
            open_ = materialize(open_, "second")
            used += [open_, *(more := matches(open_))]
            hits = hits.union(more[0])  # both passes may give a pair; the best is taken below
        best = hits.groupBy(F.col("q").alias("node")).agg(F.max_by("x", F.struct("similarity", F.col("q") == F.col("x"), -F.col("x"))).alias("x"), F.max("similarity").alias("similarity"))
        best.select("node", "x", "similarity").write.mode("overwrite").parquet(f"{self.path}/rejected/gen={gen}")
        discard(*used)
        return self.rejected().where(F.col("gen") == gen).select("node", "x", "similarity")


def _row(gen: int, kind: str, bucket: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([gen], pa.int32()), pa.array([kind]), pa.array([bucket], pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in (a, b, c))], names=["gen", "kind", "bucket", "a", "b", "c"])


def _bitmaps(axes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Each row's coordinates folded to ``64 * FOLDS`` bits."""
    slot = (axes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (64 * FOLDS)
    bits = np.zeros((rows, 64 * FOLDS), bool)
    bits[row, slot] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _spread(rank: np.ndarray) -> np.ndarray:
    """Over how many buckets the texts of an axis of a frequency class are spread."""
    return np.maximum((1 << np.minimum(rank.astype(np.int64), 62)) // HOT_AXIS, 1)


def _bucket(axis: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a part of an axis; the first part lies where an axis of one part would."""
    return ((axis.astype(np.int64) + part * 0x9E3779B1) % buckets).astype(np.int64)


def _pack(gen: int, kind: str, bucket: np.ndarray, axes: np.ndarray, place: np.ndarray, row: np.ndarray, heads: np.ndarray):
    """Packed rows of the cells, one for each bucket: axis, place and text of each entry, and what is
    kept of those texts, once for each text."""
    order = np.lexsort((axes, bucket))
    bucket, axes, place, row = bucket[order], axes[order], place[order], row[order]
    starts = starts_of(bucket)
    for start, end in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
        used, local = np.unique(row[start:end], return_inverse=True)
        entries = np.empty(end - start, ENTRY)
        entries["axis"], entries["place"], entries["text"] = axes[start:end], place[start:end], local
        yield _row(gen, kind, int(bucket[start]), entries, heads[used], np.empty(0, np.uint8))


def _sorted_blocks(batches, block: int, group: int):
    """The packed rows of each bucket as blocks sorted by axis (cells) or by text (vectors), each with its
    bounds; what several slices filed is kept once."""
    held: dict[tuple[int, str, int], list[tuple[bytes, bytes, bytes]]] = {}
    for batch in batches:
        for gen, kind, bucket, *packed in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            held.setdefault((gen, kind, bucket), []).append(tuple(packed))
    for key in sorted(held):
        gen, kind, bucket = key
        rows = held.pop(key)
        if kind == "vec":
            ids = np.concatenate([np.frombuffer(a, np.int64) for a, _, _ in rows])
            n = np.concatenate([np.frombuffer(b, np.int32) for _, b, _ in rows])
            axes = np.concatenate([np.frombuffer(c, np.uint32) for _, _, c in rows])
            begins = np.cumsum(n) - n
            _, first = np.unique(ids, return_index=True)
            for start in range(0, len(first), group):
                some = first[start : start + group]
                yield _block(gen, kind, bucket, ids[some[0]], ids[some[-1]], ids[some], n[some], np.concatenate([axes[begins[i] : begins[i] + n[i]] for i in some]))
            continue
        axis, place, head = _entries(rows, None)
        order = np.lexsort((head["node"], axis))
        axis, place, head = axis[order], place[order], head[order]
        new = np.r_[True, (axis[1:] != axis[:-1]) | (head["node"][1:] != head["node"][:-1])][: len(axis)]
        axis, place, head = axis[new], place[new], head[new]
        for start in range(0, len(axis), block):
            some = slice(start, start + block)
            _, first, local = np.unique(head["node"][some], return_index=True, return_inverse=True)
            entries = np.empty(len(local), ENTRY)
            entries["axis"], entries["place"], entries["text"] = axis[some], place[some], local
            yield _block(gen, kind, bucket, int(axis[some][0]), int(axis[some][-1]), entries, head[some][first], np.empty(0, np.uint8))


def _block(gen: int, kind: str, bucket: int, low: int, high: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([gen], pa.int32()), pa.array([kind]), pa.array([bucket], pa.int32()), pa.array([low], pa.int64()), pa.array([high], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in (a, b, c))], names=["gen", "kind", "bucket", "lo", "hi", "a", "b", "c"])


def _entries(rows: list[tuple[bytes, bytes, bytes]], only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(axis, place, head)`` of the entries of packed rows, of some axes only if given."""
    axes, places, heads = [np.empty(0, np.uint32)], [np.empty(0, np.uint16)], [np.empty(0, HEAD)]
    for packed, kept, _ in rows:
        entries = np.frombuffer(packed, ENTRY)
        if only is not None:
            if not len(only):
                continue
            at = np.minimum(np.searchsorted(only, entries["axis"]), len(only) - 1)
            entries = entries[only[at] == entries["axis"]]
        axes.append(entries["axis"])
        places.append(entries["place"])
        heads.append(np.frombuffer(kept, HEAD)[entries["text"]])
    return np.concatenate(axes), np.concatenate(places), np.concatenate(heads)


def _vectors(path: str, bucket: int, wanted: np.ndarray, before: int | None = None, only: int | None = None) -> dict[int, np.ndarray]:
    """Full vectors of the wanted texts (sorted) of one bucket."""
    found: dict[int, np.ndarray] = {}
    for a, b, c in _read(path, "vec", bucket, before=before, only=only, wanted=wanted):
        ids, n, axes = np.frombuffer(a, np.int64), np.frombuffer(b, np.int32), np.frombuffer(c, np.uint32)
        ends = np.cumsum(n)
        for i in np.flatnonzero(np.isin(ids, wanted)):
            found[int(ids[i])] = axes[ends[i] - n[i] : ends[i]]
    return found


# -- the two kinds of records -------------------------------------------------------------------


def repeated_deliveries(documents: DataFrame) -> DataFrame:
    """``(delivery_id)`` of deliveries whose document was delivered in a smaller batch.

    Ids are compared by their last 64 hex digits without regard to case and to what stands before
    them; NULL ids and ids without 64 hex digits are compared with nothing.
    """
    ids = documents.select("delivery_id", "batch_no", F.regexp_extract(F.lower("document_id"), "([0-9a-f]{64})[^0-9a-f]*$", 1).alias("hex"))
    ids = ids.where("hex <> '' and batch_no is not null")
    first = ids.groupBy("hex").agg(F.min("batch_no").alias("first_batch"))
    return ids.join(first, "hex").where("batch_no > first_batch").select("delivery_id")


def repeated_chunks(chunks: DataFrame, history: TextHistory | None = None) -> DataFrame:
    """``(chunk_row, node, x, similarity)`` of the rows whose text is alike to an accepted row of a
    smaller batch; batches are added to the history one after the other, the smallest unchecked."""
    spark = chunks.sparkSession
    history = history or TextHistory(spark)
    rows = chunks.select("chunk_row", "batch_no", "text").where(F.col("text").rlike(THREE_WORDS) & F.col("batch_no").isNotNull())
    rows = rows.withColumn("node", F.xxhash64("text"))
    batches = [r.batch_no for r in rows.select("batch_no").distinct().orderBy("batch_no").collect()]  # one row a batch
    for place, batch in enumerate(batches):
        texts = rows.where(F.col("batch_no") == batch).select("node", "text")
        if place:
            history.check(texts, batch)
        else:
            history.start(texts)
            history.file(texts, batch)
    cases = history.rejected().select(F.col("gen").alias("batch_no"), "node", "x", "similarity")
    return rows.select("chunk_row", "batch_no", "node").join(cases, ["batch_no", "node"]).select("chunk_row", "node", "x", "similarity")


def found(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(record_kind, record_key)`` of both kinds of records."""
    first = repeated_deliveries(documents).select(F.lit("document").alias("record_kind"), F.col("delivery_id").alias("record_key"))
    return first.union(repeated_chunks(chunks).select(F.lit("chunk").alias("record_kind"), F.col("chunk_row").alias("record_key")))
