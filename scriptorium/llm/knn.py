"""Problem 4: the most similar vectors of every vector.

Learned partitions. On a bounded sample a neighbour graph is built and cut into balanced parts; a
small classifier (softmax over the vector) learns from each sample vector in which parts its
neighbours lie. Every vector is indexed in its most probable part and searches the several most
probable ones, where candidates are reranked by their exact distance.

Sizes: sample, classifiers and part table have fixed bounds; a part has about ``PART`` vectors, so
the work for each vector grows with the root of the number of parts only. Where the sample is too small for as many parts as the
collection needs, each part is cut once more in the same way, on a bounded sample of its own
vectors (up to ``SUBS`` parts each). A part that came out larger is split into blocks, and its
searches go to all of them; many searches of one part are split too, so no group grows with the
data. Equal vectors share one entry: the index holds one of them and the answers are spread over
their ids afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.vectors import cosine
from scriptorium.llm.common import bounded_sample
from scriptorium.plans.session import materialize

NEAREST, CLOSE, WIDTH = 5, 0.12, 64
#: Vectors of a part, rows the partitioning is learned on at most, parts at most.
PART, SAMPLE_ROWS, MOST_PARTS = 4_000, 24_000, 4_096
#: Sample rows a part is learned from at least; parts that a part is cut into at most, and rows of its
#: own that this is learned on at most.
PER_PART, SUBS, SUB_ROWS = 12, 64, 2_560
#: Searches of a part that one group answers.
ASKS = 30_000
#: A vector searches parts until they hold this share of its probability, and at most PROBES of them, or
#: SPREAD times the root of their number: what is far from everything has its neighbours all over.
MASS, PROBES, SPREAD = 0.995, 8, 1.6
GRAPH = 10


def usable(vector: Column, width: int = WIDTH) -> Column:
    """Whether a vector has ``width`` finite values that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


# -- learning the partition ---------------------------------------------------------------------


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others of each row (float32, in blocks)."""
    n, k = len(x), min(k, len(x) - 1)
    x = x.astype(np.float32)
    out = np.empty((n, k), np.int32)
    for start in range(0, n, 512):
        near = x[start : start + 512] @ x.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -9
        out[start : start + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.15, sweeps: int = 4, seed: int = 7) -> np.ndarray:
    """Part of each row: seeds by k-means, then sweeps that move rows to the part that holds most of
    their graph neighbours, never beyond ``slack`` times the even size."""
    rng = np.random.default_rng(seed)
    n = len(x)
    room = int(np.ceil(slack * n / parts))
    x = x.astype(np.float32)
    centres = x[rng.choice(n, parts, replace=False)].copy()
    for _ in range(6):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, n, 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=parts)
        filled = count > 0
        centres[filled] = total[filled]
        if (~filled).any():
            centres[~filled] = x[rng.choice(n, int((~filled).sum()))]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    label = np.full(n, -1)
    count = np.zeros(parts, np.int64)
    width = min(parts, 24)
    for start in range(0, n, 4096):  # each row takes the nearest centre that has room
        scores = x[start : start + 4096] @ centres.T
        best = np.argsort(-scores, axis=1)[:, :width]
        for i, choice in enumerate(best):
            for part in choice:
                if count[part] < room:
                    break
            else:
                part = int(count.argmin())
            label[start + i] = part
            count[part] += 1
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            around = label[graph[i]]
            parts_near, votes = np.unique(around, return_counts=True)
            best = parts_near[votes.argmax()]
            old = label[i]
            if best != old and votes.max() > (around == old).sum() and count[best] < room:
                label[i] = best
                count[best] += 1
                count[old] -= 1
                moved += 1
        if moved < n // 200:
            break
    return label


@dataclass(frozen=True)
class Router:
    """Softmax classifier over parts; for one part it needs no weights."""

    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x.astype(np.float32) @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z


def fit_router(x: np.ndarray, label: np.ndarray, graph: np.ndarray, parts: int, epochs: int = 12, seed: int = 7) -> Router:
    """Fit to soft targets: the parts of a row and of its graph neighbours, in equal shares."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    weights = np.zeros((x.shape[1], parts), np.float32)
    for part in range(parts):
        if (label == part).any():
            weights[:, part] = 12 * x[label == part].mean(axis=0)
    bias = -(np.linalg.norm(weights, axis=0) ** 2).astype(np.float32) / 24
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    around = np.concatenate([label[:, None], label[graph]], axis=1)
    batch = 512
    for epoch in range(epochs):
        rate = 4.0 * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for start in range(0, len(x), batch):
            rows = order[start : start + batch]
            error = Router(weights, bias).probabilities(x[rows])
            share = np.float32(1 / around.shape[1])
            np.subtract.at(error, (np.repeat(np.arange(len(rows)), around.shape[1]), around[rows].ravel()), share)
            speed_w = 0.8 * speed_w - rate * (x[rows].T @ error) / len(rows)
            speed_b = 0.8 * speed_b - rate * error.sum(axis=0) / len(rows)
            weights += speed_w
            bias += speed_b
    return Router(weights, bias)


def learn(sample: np.ndarray, vectors: int, per_part: int | None = None) -> tuple[Router, int]:
    """Router and number of parts for a collection of so many vectors."""
    parts = int(min(MOST_PARTS, max(1, round(vectors / PART)), max(1, len(sample) // (per_part or PER_PART))))
    if parts < 2:
        return Router(np.zeros((WIDTH, 1), np.float32), np.zeros(1, np.float32)), 1
    x = unit(sample)
    graph = neighbour_graph(x, GRAPH)
    return fit_router(x, balanced_parts(x, graph, parts), graph, parts), parts


def learn_inside(entries: DataFrame, router: Router, parts: int, vectors: int) -> dict[int, Router]:
    """Routers inside the parts, for collections that need more parts than one sample can tell; each is
    learned on at most ``SUB_ROWS`` of the part's own vectors, chosen by a hash of their id. What comes
    to the driver is bounded by ``MOST_PARTS * SUBS`` columns of weights."""
    inside = vectors / parts
    if inside <= 2 * PART:
        return {}
    shared = entries.sparkSession.sparkContext.broadcast(router)
    draw = F.xxhash64("id", F.lit("inside"))
    some = entries.where(F.shiftrightunsigned(draw, 1) < F.lit(min(2**63 - 1, int(min(1.0, 8 * SUB_ROWS / inside) * 2.0**63))))

    def place(batches):
        for batch in batches:
            x = unit(_matrix(batch.column(1))) if batch.num_rows else np.zeros((0, WIDTH))
            best = shared.value.probabilities(x).argmax(axis=1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), batch.column(0), batch.column(1)], names=["part", "id", "vector"])

    placed = some.select("id", "vector").mapInArrow(place, "part int, id bigint, vector array<float>")
    order = Window.partitionBy("part").orderBy(F.xxhash64("id", F.lit("inside")), "id")
    placed = placed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SUB_ROWS).drop("n")
    target = int(min(SUBS, round(inside / PART)))

    def cut(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["vector"].to_numpy()).astype(np.float32)
        found, n = learn(x, min(target, len(x) // PER_PART) * PART)
        return pd.DataFrame({"part": [key[0]], "n": [n], "weights": [found.weights.tobytes()], "bias": [found.bias.astype(np.float32).tobytes()]})

    rows = placed.groupBy("part").applyInPandas(cut, "part int, n int, weights binary, bias binary").where("n > 1").collect()
    return {r.part: Router(np.frombuffer(bytes(r.weights), np.float32).reshape(WIDTH, r.n), np.frombuffer(bytes(r.bias), np.float32)) for r in rows}


# -- indexing and searching ---------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def probes_for(cells: int) -> int:
    """How many of so many parts a vector searches at most."""
    return min(cells, max(PROBES, int(np.ceil(SPREAD * cells**0.5))))


def choose(x: np.ndarray, router: Router, inside: dict[int, Router]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, cell, place)`` of the cells that each row of ``x`` searches, the most probable (its home)
    first: parts, or parts inside parts, until they hold ``MASS`` of its probability, ``PROBES`` at most."""
    p = router.probabilities(x)
    width = min(PROBES, p.shape[1])
    best = np.argpartition(-p, width - 1, axis=1)[:, :width] if width < p.shape[1] else np.tile(np.arange(width), (len(p), 1))
    likely = np.take_along_axis(p, best, axis=1)
    cells, shares = best.astype(np.int64) * SUBS, likely
    if inside:
        cells = np.repeat(cells[:, :, None], SUBS, axis=2) + np.arange(SUBS)
        shares = np.zeros(cells.shape, np.float32)
        shares[:, :, 0] = likely
        for part in np.unique(best):
            if part in inside:
                row, at = np.nonzero(best == part)
                within = inside[part].probabilities(x[row])
                shares[row, at, : within.shape[1]] = likely[row, at, None] * within
        cells, shares = cells.reshape(len(x), -1), shares.reshape(len(x), -1)
        width = min(probes_for(sum(r.bias.size for r in inside.values()) + p.shape[1] - len(inside)), shares.shape[1])
    order = np.argsort(-shares, axis=1, kind="stable")[:, :width]
    shares = np.take_along_axis(shares, order, axis=1)
    goes = np.concatenate([np.ones((len(x), 1), bool), (np.cumsum(shares, axis=1)[:, :-1] < MASS) & (shares[:, 1:] > 0)], axis=1)
    row, place = np.nonzero(goes)
    return row, cells[row, order[row, place]], place


def routed(entries: DataFrame, router: Router, inside: dict[int, Router] | None = None) -> DataFrame:
    """``(part, home, id)``: each entry once in its home part and once for every other part that it
    searches."""
    shared = entries.sparkSession.sparkContext.broadcast((router, inside or {}))

    def run(batches):
        known, within = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2_048):
                some = batch.slice(start, 2_048)
                row, cell, place = choose(unit(_matrix(some.column(1))), known, within)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(place == 0), some.column(0).take(pa.array(row))], names=["part", "home", "id"])

    return entries.mapInArrow(run, "part int, home boolean, id bigint")


def packed(entries: DataFrame) -> DataFrame:
    """``(id, vector binary)``: 32-bit unit vectors."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(unit(_matrix(batch.column(1))), np.float32)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * WIDTH), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["id", "vector"])

    return entries.select("id", "vector").mapInArrow(run, "id bigint, vector binary")


def _search(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest indexed entries of each searching row, by exact distance, then id."""
    ids = frame["id"].to_numpy()
    x = np.frombuffer(b"".join(frame["vector"]), np.float32).reshape(-1, WIDTH)
    base = np.flatnonzero((frame["role"] != 1).to_numpy())
    base = base[np.argsort(ids[base], kind="stable")]
    asks = np.flatnonzero((frame["role"] != 0).to_numpy())
    b, bi = x[base], ids[base]
    width = min(k + 4, len(base))
    out = []
    if width:
        for start in range(0, len(asks), 1_024):
            rows = asks[start : start + 1_024]
            near = x[rows] @ b.T
            self_at = np.minimum(np.searchsorted(bi, ids[rows]), len(bi) - 1)
            own = np.flatnonzero(bi[self_at] == ids[rows])
            near[own, self_at[own]] = -9
            top = np.argpartition(-near, width - 1, axis=1)[:, :width]
            exact = 1.0 - np.einsum("ij,ikj->ik", x[rows].astype(np.float64), b[top].astype(np.float64))
            other = bi[top]
            exact[other == ids[rows][:, None]] = 9.0
            order = np.lexsort((other, exact))[:, :k]
            other, exact = np.take_along_axis(other, order, 1), np.take_along_axis(exact, order, 1)
            r, c = np.nonzero(exact < 3.0)
            out.append(pd.DataFrame({"q": ids[rows][r], "x": other[r, c], "distance": exact[r, c]}))
    return pd.concat(out) if out else pd.DataFrame({"q": np.empty(0, np.int64), "x": np.empty(0, np.int64), "distance": np.empty(0)})


def placed(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(part, block, turn, role, id, vector)`` of ``routed`` and ``packed``: the entries of a part in blocks, its
    searches in turns, each turn beside every block. Role 0 is indexed only, 1 searches only, 2 both."""
    sizes = rows.groupBy("part").agg(F.count_if("home").alias("homes"), F.count("*").alias("asks"))
    blocks = F.when(F.col("homes") > 3 * PART, F.ceil(F.col("homes") / (2 * PART))).otherwise(1).cast("int")
    table = sizes.select("part", blocks.alias("blocks"), F.ceil(F.col("asks") / ASKS).cast("int").alias("turns"))
    rows = rows.join(vectors, "id").join(F.broadcast(table), "part")  # a row a part: at most MOST_PARTS * SUBS
    own_block, own_turn = F.pmod(F.xxhash64("id"), "blocks").cast("int"), F.pmod(F.xxhash64("id", F.lit("turn")), "turns").cast("int")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda block, turn, role: F.struct(block.alias("block"), turn.alias("turn"), role.alias("role"))
    searches = F.transform(numbers("blocks"), lambda b: place(b, own_turn, F.when(F.col("home") & (b == own_block), 2).otherwise(1)))
    indexed = F.when(F.col("home"), F.transform(F.filter(numbers("turns"), lambda t: t != own_turn), lambda t: place(own_block, t, F.lit(0)))).otherwise(F.array().cast("array<struct<block:int,turn:int,role:int>>"))
    return rows.select("part", "id", "vector", F.explode(F.concat(searches, indexed)).alias("s")).select("part", "s.block", "s.turn", "s.role", "id", "vector")


def nearest_entries(entries: DataFrame, router: Router, inside: dict[int, Router] | None = None, k: int = NEAREST) -> DataFrame:
    """``(q, x, distance)``: the k nearest other entries of each entry of ``entries (id, vector)``."""
    rows = materialize(routed(entries, router, inside), "routed")  # without the vectors, which travel once
    # the largest group is a block of 3 * PART entries and ASKS searches
    found = placed(rows, packed(entries)).groupBy("part", "block", "turn").applyInPandas(lambda frame: _search(frame, k), "q bigint, x bigint, distance double")
    # an entry lies in one block, and a search meets each block in one turn, so no pair comes twice
    best = Window.partitionBy("q").orderBy("distance", "x")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("q", "x", "distance")


class VectorNeighbours:
    """The k nearest others of every usable vector of ``vectors[key, embedding]``.

    ``key`` must be unique. NULL, empty, all-zero and not finite vectors and those of another length
    take no part. Equal vectors under different keys do, at distance 0; among equal distances the
    smaller key comes first. A collection of one vector has no neighbours, an empty one no rows.
    """

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST):
        self.k = k
        rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
        self.rows = rows.where(usable(F.col("vector"))).withColumn("same", F.xxhash64("vector"))

    def neighbours(self) -> DataFrame:
        """``(id, neighbour, distance)``, at most k rows for each id."""
        first = Window.partitionBy("same").orderBy("id")
        kept = self.rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= self.k + 1)
        kept = materialize(kept, "entries")
        entries = kept.where("place = 1").select("id", "vector")
        sample, n = bounded_sample(entries, "id", SAMPLE_ROWS)
        sample = sample.toArrow()
        router, parts = learn(_matrix(sample.column("vector")), n) if n else (None, 0)
        if not n:
            return self.rows.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance")).limit(0)
        near = nearest_entries(entries, router, learn_inside(entries, router, parts, n), self.k)
        # what a class of equal vectors has around it: its own first members and those of the others
        member = kept.select("same", F.col("id").alias("neighbour"))
        head = kept.where("place = 1").select("same", F.col("id").alias("head"))
        around = near.join(head.select(F.col("same").alias("other"), F.col("head").alias("x")), "x").join(head.withColumnRenamed("head", "q"), "q")
        around = around.join(member.withColumnRenamed("same", "other"), "other").select("same", "neighbour", "distance")
        around = around.union(member.select("same", "neighbour", F.lit(0.0).alias("distance")))
        nearest = Window.partitionBy("same").orderBy("distance", "neighbour")
        around = around.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= 2 * self.k + 1)
        lists = around.groupBy("same").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))  # at most 2k+1
        own = self.rows.select("id", "same").join(lists, "same")
        chosen = F.slice(F.filter("near", lambda s: s["neighbour"] != F.col("id")), 1, self.k)
        return own.select("id", F.explode(chosen).alias("s")).select("id", F.col("s.neighbour").alias("neighbour"), F.col("s.distance").alias("distance"))


def found(vectors: DataFrame) -> DataFrame:
    """``(vec_a, vec_b)`` of pairs within the distance in which one is among the nearest of the other."""
    near = VectorNeighbours(vectors).neighbours().where(F.col("distance") <= CLOSE)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()


def neighbours(vectors: DataFrame) -> DataFrame:
    """``(vec_id, neighbour, rank, distance)`` of the queries: every vector whose id is divisible by 100.
    Distances are worked out anew from the vectors as they are stored."""
    operator = VectorNeighbours(vectors)
    near = operator.neighbours().where("id % 100 = 0").select("id", "neighbour", F.col("distance").alias("near"))
    exact = operator.rows.select("id", F.col("vector").cast("array<double>").alias("v"))
    near = near.join(exact, "id").join(exact.select(F.col("id").alias("neighbour"), F.col("v").alias("w")), "neighbour")
    distance = F.when(F.col("near") == 0, 0.0).otherwise(1 - cosine(F.col("v"), F.col("w")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("distance", 9), "neighbour"))
    near = near.select("id", "neighbour", distance.alias("distance"))
    return near.select(F.col("id").alias("vec_id"), "neighbour", rank.alias("rank"), (F.round("distance", 6) + 0.0).alias("distance"))
