"""Problem 7: mixing sources to target shares of tokens.

Soft-membership mixing. Each document has a membership in the sources of the target table: a
document whose source is known belongs to it, one without a source belongs to all of them with the
posteriors of a classifier that is trained on labelled documents. The rates (expected uses) of the
documents are the nonnegative, capped least-squares fit of the expected source totals to the
targets, found by projected gradient descent. All documents of one membership share the gradient
direction, so they are summed up by membership cell first (labelled: one cell for each source;
unlabelled: the most probable source and its posterior in eighths, with the exact token-weighted
posteriors as the cell's content). The cells are bounded by the target table, so the descent itself
runs on a table of fixed size, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import bpe
from scriptorium.llm.common import WORD, bounded_sample
from scriptorium.plans.session import materialize, spread

#: Width of the classifier's hashed word table, and labelled rows it is fitted on at most.
WIDTH = 1 << 13
SAMPLE_ROWS = 3_000
LEVELS = 8
#: Bins by which a cell's documents are summed before one bin is put in order.
BINS = 4_096


@dataclass(frozen=True)
class SourceModel:
    """Multinomial log-linear classifier over hashed words: sources, weights, priors."""

    sources: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray

    def posterior(self, text: str | None) -> np.ndarray:
        score = self.prior.copy()
        for slot in slots(text):
            score += self.weights[slot]
        score -= score.max()
        likely = np.exp(score)
        return likely / likely.sum()


def slots(text: str | None) -> set[int]:
    """Hashed distinct words of a text, digits folded."""
    if not text:
        return set()
    return {zlib.crc32(("0" if w.isdigit() else w).encode("utf-8", "replace")) % WIDTH for w in set(WORD.findall(text.lower()))}


def fit_sources(rows: list[tuple[str, str | None]], sources: tuple[str, ...]) -> SourceModel:
    """Naive-Bayes weights with add-half smoothing, tempered by the typical number of words."""
    place = {s: i for i, s in enumerate(sources)}
    counts = np.full((WIDTH, len(sources)), 0.5)
    seen = np.ones(len(sources))
    sizes = []
    if not sources:
        return SourceModel(sources, np.zeros((WIDTH, 0), np.float32), np.zeros(0))
    for source, text in rows:
        if source in place:
            found = slots(text)
            sizes.append(len(found))
            seen[place[source]] += 1
            counts[list(found), place[source]] += 1
    weights = np.log(counts / (seen + 1.0))
    temper = max(1.0, float(np.sqrt(np.mean(sizes)))) if sizes else 1.0
    weights = (weights - weights.mean(axis=1, keepdims=True)) / temper
    return SourceModel(sources, weights.astype(np.float32), np.log(seen / seen.sum()))


def measure(documents: DataFrame, targets: list[tuple[str, float, int]], vocabulary: bytes | None = None) -> DataFrame:
    """``(doc_id, source, tokens, cell, membership)`` of each document; a narrow map.

    ``cell`` is NULL for documents of a source outside the targets, and for empty documents.
    """
    spark = documents.sparkSession
    sources = tuple(s for s, _, _ in targets)
    labelled = documents.where(F.col("source").isin(list(sources)) & F.col("text").isNotNull())
    sample = bounded_sample(labelled, "doc_id", SAMPLE_ROWS)[0].select("source", "text").collect() if sources else []
    model = fit_sources([(r.source, r.text) for r in sample], sources)
    shared = spark.sparkContext.broadcast((vocabulary or bpe.read_vocabulary(), model))

    def run(batches):
        content, known = shared.value
        automaton = bpe.compile_vocabulary(content)
        place = {s: i for i, s in enumerate(known.sources)}
        for batch in batches:
            tokens, cells, members = [], [], []
            for source, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = automaton.count(text)
                tokens.append(n)
                if source in place:
                    cells.append(f"={source}")
                    members.append(None)
                elif source is None and n and place:
                    posterior = known.posterior(text)
                    best = int(posterior.argmax())
                    cells.append(f"~{known.sources[best]}~{int(posterior[best] * LEVELS)}")
                    members.append(posterior.tolist())
                else:
                    cells.append(None)
                    members.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(cells, pa.string()), pa.array(members, pa.list_(pa.float64()))],
                names=["doc_id", "source", "tokens", "cell", "membership"],
            )

    return spread(documents.select("doc_id", "source", "text")).mapInArrow(
        run, "doc_id bigint, source string, tokens bigint, cell string, membership array<double>"
    )


def cell_totals(measured: DataFrame, n_sources: int) -> DataFrame:
    """Tokens and expected source tokens of each cell (map-side combined; at most one row for each
    source plus ``LEVELS + 1`` for each source of the unlabelled)."""
    parts = [
        F.sum(F.col("tokens") * F.coalesce(F.try_element_at("membership", F.lit(i + 1)), F.lit(0.0))).alias(f"e{i}")
        for i in range(n_sources)
    ]
    return measured.where("cell is not null").groupBy("cell").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"), *parts)


def fit_rates(expected: np.ndarray, cap: np.ndarray, target: np.ndarray, steps: int = 4_000) -> np.ndarray:
    """Rates in ``[0, cap]`` that bring ``rates @ expected`` nearest to ``target`` (least squares in
    shares), by projected gradient descent with momentum."""
    scale = max(float(target.sum()), 1.0)
    matrix, goal = expected / scale, target / scale
    sizes = np.maximum(np.linalg.norm(matrix, axis=1), 1e-300)
    unit, limit = matrix / sizes[:, None], cap * sizes
    step = 1.0 / max(float(np.linalg.norm(unit, 2)) ** 2, 1e-12)
    x = np.zeros(len(limit))
    look, t = x.copy(), 1.0
    for _ in range(steps):
        new = np.clip(look - step * (unit @ (look @ unit - goal)), 0.0, limit)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_new * (new - x)
        done = np.abs(new - x).max() < 1e-13 if len(x) else True
        x, t = new, t_new
        if done:
            break
    return x / sizes


@dataclass(frozen=True)
class Mix:
    """A fitted mix: rate of each cell, the total that shares are of, and what each source has and wants."""

    rates: dict[str, float]
    total: int
    sources: list[tuple[str, float, float, int, float, bool]]


def fit_mix(cells: list, targets: list[tuple[str, float, int]]) -> Mix:
    """Fit the rates of the cells.

    The targets' total is the number of tokens of all documents whose source is a target. Documents of
    a known source are fitted first; unlabelled ones, used once at most, then fill what is missing, and
    both are fitted in turn until neither changes. A source is short if its own documents are at their
    cap in the fit of the known ones and exact whole numbers confirm it.
    """
    sources = [s for s, _, _ in targets]
    place = {s: i for i, s in enumerate(sources)}
    own = {c["cell"][1:]: int(c["tokens"]) for c in cells if c["cell"].startswith("=")}
    total = sum(own.values())
    target = np.array([share * total for _, share, _ in targets], float)
    names = sorted(c["cell"] for c in cells)
    by_name = {c["cell"]: c for c in cells}
    matrix, cap = np.zeros((len(names), len(sources))), np.ones(len(names))
    for i, name in enumerate(names):
        if name.startswith("="):
            matrix[i, place[name[1:]]] = by_name[name]["tokens"]
            cap[i] = targets[place[name[1:]]][2]
        else:
            matrix[i] = [by_name[name][f"e{j}"] for j in range(len(sources))]
    known = np.array([n.startswith("=") for n in names], bool)
    rates = np.zeros(len(names))
    rates[known] = fit_rates(matrix[known], cap[known], target)
    first = dict(zip(names, rates, strict=True))
    for _ in range(40 if (~known).any() else 0):
        before = rates.copy()
        rates[~known] = fit_rates(matrix[~known], cap[~known], np.maximum(target - rates[known] @ matrix[known], 0.0))
        rates[known] = fit_rates(matrix[known], cap[known], np.maximum(target - rates[~known] @ matrix[~known], 0.0))
        if np.abs(rates - before).max() < 1e-9:
            break
    rows = []
    for i, (source, share, repeats) in enumerate(targets):
        has, rate = own.get(source, 0), first.get(f"={source}", 0.0)
        at_cap = not has or rate >= repeats * (1 - 1e-9)
        rows.append((source, float(share), float(target[i]), has, float(rates[names.index(f"={source}")]) if has else 0.0, bool(at_cap and repeats * has < share * total)))
    return Mix(dict(zip(names, map(float, rates), strict=True)), total, rows)


def target_rows(mix_targets: DataFrame) -> list[tuple[str, float, int]]:
    """The target table on the driver: it names sources, so it doesn't grow with the documents.
    Rows without a source or a share are left out; of a source named twice the first by share and
    repeats counts; a NULL ``max_repeats`` means once."""
    rows = mix_targets.where("source is not null and target_share is not null").collect()
    found: dict[str, tuple[str, float, int]] = {}
    for r in sorted(rows, key=lambda r: (r.source, -r.target_share, -(r.max_repeats or 1))):
        found.setdefault(r.source, (r.source, float(r.target_share), 1 if r.max_repeats is None else int(r.max_repeats)))
    return [found[s] for s in sorted(found)]


def plan_mix(documents: DataFrame, mix_targets: DataFrame, vocabulary: bytes | None = None) -> tuple[DataFrame, Mix, list]:
    """Measure the documents and fit the mix: ``(measured, mix, targets)``.

    NULL and empty texts have no tokens; documents of sources outside the targets are never used;
    an empty document or target table gives an empty mix.
    """
    targets = target_rows(mix_targets)
    measured = materialize(measure(documents, targets, vocabulary), "measured")
    cells = [r.asDict() for r in cell_totals(measured, len(targets)).collect()]
    return measured, fit_mix(cells, targets), targets


def choose(measured: DataFrame, mix: Mix) -> DataFrame:
    """``(doc_id, source, tokens, copies, membership)`` of each document used. Every document of a cell
    is used as often as the whole part of the cell's rate; for the rest of the rate documents are used
    once more, in the order of a hash of their id, until its share of the cell's tokens is reached, to
    the document nearest to it.

    Tokens are summed by ``BINS`` bins of that order first, so only the documents of the one bin of each
    cell in which the cut falls are put in order.
    """
    spark = measured.sparkSession
    rates = spark.createDataFrame(sorted(mix.rates.items()), "cell string, rate double").select("cell", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"))
    draw = F.xxhash64("doc_id", F.lit(7))
    rows = measured.where("cell is not null").withColumns({"draw": draw, "bin": F.pmod(draw, F.lit(BINS)).cast("int")})
    sums = rows.groupBy("cell", "bin").agg(F.sum("tokens").alias("t"))
    up_to = Window.partitionBy("cell").orderBy("bin")
    sums = sums.withColumns({"after": F.sum("t").over(up_to), "all": F.sum("t").over(Window.partitionBy("cell"))}).join(F.broadcast(rates), "cell")
    # the first bin that goes beyond what is needed, one row a cell: bounded by the target table
    cut = sums.groupBy("cell").agg(F.first("whole").alias("whole"), F.first(F.col("all") * F.col("part")).alias("need"), F.min(F.when(F.col("after") > F.col("all") * F.col("part"), F.struct("bin", (F.col("after") - F.col("t")).alias("before")))).alias("cut"))
    cut = cut.select("cell", "whole", "need", F.coalesce("cut.bin", F.lit(BINS)).alias("cut"), F.col("cut.before").alias("before"))
    rows = rows.join(F.broadcast(cut), "cell")
    at_cut = rows.where(F.col("bin") == F.col("cut"))
    within = F.sum("tokens").over(Window.partitionBy("cell").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_cut = at_cut.withColumn("extra", (F.col("before") + within - F.col("tokens") / 2 <= F.col("need")).cast("int"))
    others = rows.where(F.col("bin") != F.col("cut")).withColumn("extra", (F.col("bin") < F.col("cut")).cast("int"))
    used = at_cut.unionByName(others).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))
    return used.where("copies > 0").select("doc_id", "source", "tokens", "copies", "membership")


REPORT = "source string, target_share double, target_tokens double, source_tokens bigint, rate double, short boolean"


def report(documents: DataFrame, mix_targets: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """One row for each target source: target, tokens it has, uses of each of its documents, whether its
    repeats can't reach its share, and what the selection holds: tokens of its own documents, tokens with
    the memberships of unlabelled ones, their share of the targets' total and of the selection."""
    measured, mix, targets = plan_mix(documents, mix_targets, vocabulary)
    used = choose(measured, mix)
    amount = F.col("tokens") * F.col("copies")
    sums = [F.coalesce(F.sum(F.when(F.col("source") == s, amount)), F.lit(0)).alias(f"o{i}") for i, (s, _, _) in enumerate(targets)]
    sums += [F.coalesce(F.sum(amount * F.try_element_at("membership", F.lit(i + 1))), F.lit(0.0)).alias(f"m{i}") for i in range(len(targets))]
    held = used.agg(F.coalesce(F.sum(amount), F.lit(0)).alias("whole"), *sums).first()
    rows = []
    for i, row in enumerate(mix.sources):
        own, expected = int(held[f"o{i}"]), float(held[f"o{i}"] + held[f"m{i}"])
        rows.append((*row, own, expected, expected / max(mix.total, 1), expected / max(held["whole"], 1)))
    return documents.sparkSession.createDataFrame(rows, REPORT + ", own_tokens bigint, reached_tokens double, reached_share double, selection_share double")


def short_sources(documents: DataFrame, mix_targets: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """``(source)`` of the sources whose documents the fit uses as often as they may be, and yet short of
    the target."""
    _, mix, _ = plan_mix(documents, mix_targets, vocabulary)
    return documents.sparkSession.createDataFrame([(r[0],) for r in mix.sources if r[-1]], "source string")


def select(documents: DataFrame, mix_targets: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """``(doc_id, source, tokens, copies)`` of each document used, see ``choose``."""
    measured, mix, _ = plan_mix(documents, mix_targets, vocabulary)
    return choose(measured, mix).drop("membership")


def shares(selection: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Actual token share of each source in a selection (NULL source: the unlabelled)."""
    by = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = by.agg(F.sum("tokens").alias("whole"))
    wanted = mix_targets.select("source", "target_share")
    joined = wanted.join(by, "source", "full_outer").crossJoin(F.broadcast(whole))  # one row
    return joined.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.nullif("whole", F.lit(0))).alias("actual_share"), "most_copies")
