"""Small exact cases and brute-force comparisons of the training-data operators."""

import base64
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bpe, components, history, knn, mixing, near_dups, pii, qa_defects, splitter
from scriptorium.llm.common import shingles

WORDS = [f"w{i}" for i in range(400)]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edit(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def grams(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def alike(a, b):
    a, b = grams(a), grams(b)
    return bool(a) and bool(b) and len(a & b) / len(a | b) >= 0.6


# -- 1 and 3 -------------------------------------------------------------------------------------


def made_chunks(seed=1):
    rng = random.Random(seed)
    rows = [(1, 0, None), (2, 1, ""), (3, 1, "two words"), (4, 2, "Two words"), (5, 0, "x" * 50_000), (6, 3, "x" * 50_000)]
    bases = [text_of(rng, 60) for _ in range(12)]
    for i in range(90):
        base = rng.choice(bases)
        rows.append((10 + i, rng.randrange(5), edit(rng, base, rng.choice([0, 0, 1, 2, 4, 9])) if rng.random() < 0.8 else text_of(rng, 40)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(r, b, t, "clash", 1.0) for r, b, t in rows], "chunk_row bigint, batch_no int, text string, node string, codes double")


def test_history_equals_brute_force(spark):
    rows = made_chunks()
    cases, accepted = set(), []
    for batch in range(5):
        new = [(r, t) for r, b, t in rows if b == batch]
        found = {r for r, t in new if batch and any(alike(t, a) for a in accepted)}
        cases |= found
        accepted += [t for r, t in new if r not in found]
    got = history.repeated_chunks(frame(spark, rows))
    assert {r.chunk_row for r in got.collect()} == cases
    assert history.repeated_chunks(frame(spark, rows).limit(0)).count() == 0


def test_history_second_pass(spark, monkeypatch):
    monkeypatch.setattr(history, "FIRST_PASS", 1)
    rows = made_chunks(2)
    few = {r.chunk_row for r in history.repeated_chunks(frame(spark, rows)).collect()}
    monkeypatch.undo()
    assert few == {r.chunk_row for r in history.repeated_chunks(frame(spark, rows)).collect()}


def test_history_finds_the_nearest_beyond_the_first_pass(spark, monkeypatch):
    rng = random.Random(6)
    parts = [(text_of(rng, 5), text_of(rng, 5)) for _ in range(14)]
    # a template group: every axis is shared by many texts of one size
    made = [" ".join(p[rng.random() < 0.25] for p in parts) for _ in range(60)]
    rows = [(i, 0, t) for i, t in enumerate(made)] + [(200 + i, 1, t + " end") for i, t in enumerate(made)]
    monkeypatch.setattr(history, "FIRST_PASS", 1)
    few = {(r.chunk_row, round(r.similarity, 9)) for r in history.repeated_chunks(frame(spark, rows)).collect()}
    monkeypatch.undo()
    grams_of = {r: grams(t) for r, _, t in rows}
    want = {r: max(len(grams_of[r] & grams_of[i]) / len(grams_of[r] | grams_of[i]) for i in range(60)) for r, b, _ in rows if b}
    assert few == {(r, round(v, 9)) for r, v in want.items() if v >= 0.6}


def test_history_reads_what_a_batch_asks_for(spark, monkeypatch):
    """Of blocks of 16 entries, a small batch reads about as many bytes from a history of twice the size."""
    monkeypatch.setattr(history, "BLOCK", 16)
    monkeypatch.setattr(history, "TEXTS", 2)
    monkeypatch.setattr(history, "GROUP_BYTES", 1)
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(20_000)]
    made = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [made(40) for _ in range(1_600)]
    batch = [(10_000 + i, edit(rng, texts[i], 1)) for i in range(4)]
    read, whole = [], []
    for n in (800, 1_600):
        index = history.TextHistory(spark)
        node = lambda rows: spark.createDataFrame(rows, "node bigint, text string")
        first = node(list(enumerate(texts[:n])))
        index.start(first)
        index.file(first, 0)
        assert {(r.node, r.x) for r in index.check(node(batch), 1).collect()} == {(10_000 + i, i) for i in range(4)}
        asked = {b: np.unique(history._entries(history._read(index.path, "cell", b, only=1), None)[0]) for b in range(index.buckets)}
        size = lambda wanted: sum(len(x) for b in range(index.buckets) for row in history._read(index.path, "cell", b, before=1, wanted=asked[b].astype(np.int64) if wanted else None) for x in row)
        read.append(size(True))
        whole.append(size(False))
        found = history._vectors(index.path, 0, np.array([0]), before=1)
        assert set(found) <= {0}
    assert whole[1] > 1.9 * whole[0]
    assert read[1] < 1.25 * read[0] and read[1] < 0.25 * whole[1]


def test_history_with_spread_axes(spark, monkeypatch):
    monkeypatch.setattr(history, "_spread", lambda rank: 1 + rank.astype(np.int64) % 5)
    rows = made_chunks(1)
    few = {r.chunk_row for r in history.repeated_chunks(frame(spark, rows)).collect()}
    monkeypatch.undo()
    assert few == {r.chunk_row for r in history.repeated_chunks(frame(spark, rows)).collect()}


def test_deliveries_compare_by_hex(spark):
    a, b = "ab" * 32, "cd" * 32
    rows = [(1, a, 0), (2, "sha256:" + a.upper(), 1), (3, None, 1), (4, b, 2), (5, b, 2), (6, "short", 3), (7, a, None)]
    got = history.repeated_deliveries(spark.createDataFrame(rows, "delivery_id bigint, document_id string, batch_no int"))
    assert [r.delivery_id for r in got.collect()] == [2]


def brute_groups(rows):
    parent = {r: r for r, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (r, _, t) in enumerate(rows):
        for s, _, u in rows[:i]:
            if alike(t, u):
                x, y = sorted((find(r), find(s)))
                parent[y] = x
    return {(find(r), r) for r, _, _ in rows if find(r) != r}


@pytest.mark.parametrize("seed", [1, 5])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = made_chunks(seed)
    assert {tuple(r) for r in near_dups.found(frame(spark, rows)).collect()} == brute_groups(rows)
    assert near_dups.found(frame(spark, rows).limit(0)).count() == 0


def test_hot_group_of_near_copies(spark):
    rng = random.Random(3)
    base = text_of(rng, 80)
    rows = [(i, 0, edit(rng, base, 1)) for i in range(120)] + [(1000 + i, 0, base) for i in range(200)]
    got = {tuple(r) for r in near_dups.found(frame(spark, rows)).collect()}
    assert got == {(0, r) for r, _, _ in rows if r}
    kinds = {r.duplicate_type for r in near_dups.records(frame(spark, rows)).collect()}
    assert kinds <= {"exact", "near"}


@pytest.mark.parametrize("sent", [2, 10_000])
def test_crowded_bucket_of_unlike_records(spark, monkeypatch, sent):
    """All records in one bucket: only the exact pass can find the pairs of different parts, and those
    that a slice does not send on."""
    monkeypatch.setattr(near_dups, "BUCKET", 7)
    monkeypatch.setattr(near_dups, "SENT", sent)
    monkeypatch.setattr(near_dups, "BANDS", 1)
    monkeypatch.setattr(near_dups, "band_keys", lambda values, rows: np.zeros((len(values), 1), np.uint64))
    monkeypatch.setattr(near_dups, "HOT", 7, raising=False)
    rng = random.Random(11)
    head = text_of(rng, 8)
    bases = [f"{head} {text_of(rng, 40)}" for _ in range(60)]
    rows = [(i, 0, t) for i, t in enumerate(bases)] + [(100 + i, 0, edit(rng, t, 2)) for i, t in enumerate(bases)]
    operator = near_dups.NearDuplicates(frame(spark, rows))
    sketch, documents = near_dups.frequency_sketch(near_dups.first_pass(operator.rows))
    bands = near_dups.band_rows(operator.rows.select("node", "text"), sketch, documents)
    packed = [np.concatenate([np.frombuffer(r[i] or b"", np.int64) for r in bands.collect()]) for i in range(1, 4)]
    if sent > 120:
        assert len(packed[0]) == 120 and len(set(packed[0])) == 1
    else:
        assert (packed[2] != near_dups.NONE).any()
    assert near_dups.bucketed(bands).where("crowd is null").count() == 0
    assert {tuple(r) for r in operator.groups().collect()} == brute_groups(rows)


def test_hot_group_between_slices(spark, monkeypatch):
    """A third of all rows in one hot group, which no slice sends on whole."""
    monkeypatch.setattr(near_dups, "SENT", 3)
    monkeypatch.setattr(near_dups, "BUCKET", 6)
    rng = random.Random(13)
    base = text_of(rng, 60)
    rows = [(i, 0, edit(rng, base, rng.choice([1, 3, 6]))) for i in range(80)] + [(500 + i, 0, text_of(rng, 50)) for i in range(160)]
    assert {tuple(r) for r in near_dups.found(frame(spark, rows)).collect()} == brute_groups(rows)


def test_records_state_both_likenesses(spark):
    rng = random.Random(4)
    base = text_of(rng, 60)
    rows = [(1, 0, base), (2, 0, base), (3, 0, edit(rng, base, 2))]
    got = {r.member_row: r for r in near_dups.records(frame(spark, rows)).collect()}
    a, b = grams(base), grams(rows[2][2])
    assert got[2].similarity == got[2].weighted_similarity == 1.0 and got[2].duplicate_type == "exact"
    assert got[3].similarity == pytest.approx(len(a & b) / len(a | b), abs=1e-6) and 0 < got[3].weighted_similarity < 1


def test_bands_hold_alike_pairs_of_a_hot_group():
    """Pairs of unweighted likeness 0.6 to 0.7 whose shared shingles are in a third of all rows."""
    rng = np.random.default_rng(7)
    documents, pairs, together = 280_000, 400, 0
    shared = rng.integers(0, 2**63, 100).astype(np.uint64)
    sketch = np.ones(2 * near_dups.WIDTH, np.int64)
    sketch[np.concatenate(near_dups._slots(shared))] = documents // 3
    for _ in range(pairs):
        own = rng.integers(0, 2**63, 2 * 30).astype(np.uint64)
        codes = np.r_[np.sort(np.r_[shared, own[:30]]), np.sort(np.r_[shared, own[30:]])]
        weights = near_dups.inverse_frequency(sketch, codes, documents)
        _, values = near_dups.signatures(np.repeat([0, 1], 130), codes, weights, near_dups.BANDS * near_dups.ROWS)
        a, b = near_dups.band_keys(values, near_dups.ROWS)
        together += (a == b).any()
    assert together >= 0.99 * pairs
    assert near_dups.missed() <= 0.0011


def test_weighted_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 120).astype(np.uint64)
    weights = rng.uniform(0.5, 9, 120).astype(np.float32)
    a, b = np.arange(0, 90), np.arange(30, 120)
    value = near_dups.samples(codes, weights, 4096)
    same = (value[a].min(axis=0) == value[b].min(axis=0)).mean()
    want = weights[30:90].sum() / weights.sum()
    assert same == pytest.approx(want, abs=0.03)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (4, 5), (5, 4), (7, 7), (None, 1)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    want = {(2, 1), (3, 1), (9, 1), (5, 4)}
    assert {tuple(r) for r in components.labels(frame).collect()} == want
    assert {tuple(r) for r in components.labels(frame, one_task=0).collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint").repartition(8)
    assert {r.root for r in components.labels(chain, one_task=0).collect()} == {0}
    assert components.labels(frame.limit(0)).count() == 0


def test_shingles_forget_nothing():
    doc, codes = shingles([None, "a b", "A b c", "a-b-c d", "a b c a b c"], 3)
    assert [int((doc == i).sum()) for i in range(5)] == [0, 0, 1, 2, 3]


# -- 2 -------------------------------------------------------------------------------------------


def made_cases(n=700):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        name, days, code = f"bel{rng.randrange(900)}on-store", rng.randrange(2, 99), f"ERR_DB_{rng.randrange(1000, 9999)}"
        shape = rng.randrange(4)
        if shape == 0:
            q, a, f = f"How long are the backups of {name} kept, and where?", f"Backups of {name} are kept for {days} days in a separate storage region. They are checked every night.", [f"backups are kept for {days} days"]
        elif shape == 1:
            q, a, f = f"What does `{code}` tell a caller of {name}?", f"`{code}` tells the caller that {name} has no free connection left in its pool.", ["the pool is exhausted"]
        elif shape == 2:
            q, a, f = f"Wie lange werden die Sicherungen von {name} aufbewahrt und wo?", f"Sicherungen von {name} werden {days} Tage lang in einer getrennten Region aufbewahrt.", [f"Sicherungen bleiben {days} Tage"]
        else:
            q, a, f = f"How often does {name} retry an upload?", f"{days} times", [f"{name} retries {days} times"]
        rows.append((q, a, f))
    return rows


def test_defects_on_held_out_pairs():
    rows = made_cases()
    detector = qa_defects.fit(rows[:500])
    sound = [detector.defect(*r) for r in rows[500:]]
    assert sum(d is not None for d in sound) <= 4
    q, a, f = "How long are the backups of belx-store kept, and where?", "Backups of belx-store are kept for 5 days in a separate storage region. They are checked every night.", ["backups are kept for 5 days"]
    assert detector.defect(q, None, f) == "empty" and detector.defect(q, "N/A", f) == "empty" and detector.defect(q, a, []) == "empty" and detector.defect(q, a, None) == "empty"
    assert detector.defect(q, "Backups of belx-store are kept for 5 days in a sepa", f) == "truncated"
    assert detector.defect(q, q, f) == "copied_question"
    assert detector.defect(q, "I'm sorry, but I can't help with that request.", f) == "refusal"
    assert detector.defect(q, "Sicherungen von belx-store werden 5 Tage lang in einer getrennten Region aufbewahrt.", f) == "other_language"


def test_bare_values_are_sound():
    rows = made_cases(900)
    detector = qa_defects.fit(rows[:600])
    values = [(q, re.search(r"\d+", a)[0], f) for q, a, f in rows[600:] if f and re.search(r"(?<!\S)\d+ ", f[0]) and re.search(r"(?<!\S)\d+ ", a)]
    assert len(values) > 50 and sum(detector.defect(*v) == "other_language" for v in values) == 0
    assert sum(detector.defect(*v) is not None for v in values) <= 0.1 * len(values)


@pytest.mark.parametrize("form", range(3))
def test_refusals_of_a_form_left_out_of_training(form):
    rows = made_cases(700)
    detector, rng = qa_defects.fit(rows[:500], without=form), random.Random(8)
    others = [i for i in range(3) if i != form]
    found = total = 0
    for q, _, f in rows[500:]:
        language = qa_defects.question_language(q) or "en"
        words = " ".join(rng.choice(part) for part in qa_defects.REFUSAL_PARTS[language][form]).replace("{x}", "that")
        found += detector.defect(q, words.capitalize() + ".", f) == "refusal"
        total += 1
    assert others and found >= 0.9 * total


def test_defect_edges():
    profile = qa_defects.learn_profile([])
    for q, a, f in ((None, None, None), ("", "", []), ("?", "`", [None]), ("x", "\n\n", ["", " "]), ("What is it?", "...", ["a"]), ("Was?", "()[]", ["(("]), ("x " * 3_000, "y " * 30_000, ["z"] * 50)):
        slots, values = qa_defects.features(q, a, f, profile)
        assert len(slots) == len(values) and all(np.isfinite(values))
    assert qa_defects.fit([("What is x?", "It is y.", ["y"])] * 3) is not None


def test_defects_of_bare_marks():
    """A token of marks alone, of whatever kind, is a mark: no token is empty."""
    assert qa_defects.masked("Alice & Bob § 4 + ~ | end.") == ["alice", "<mark>", "bob", "<mark>", "<number>", "<mark>", "<mark>", "<mark>", "end"]
    rows = [(f"What does step {i} & part {i} do?", f"It runs | part {i} & § stops.", [f"runs & part {i}"]) for i in range(12)]
    assert qa_defects.fit(rows) is not None
    slots, values = qa_defects.features("What & why?", "because & §", ["& this"], qa_defects.learn_profile(rows))
    assert len(slots) == len(values)


def test_defects_table(spark):
    schema = "id string, question string, answerability string, expected_answer string, expected_facts array<string>, defect string"
    rows = [(f"c{i}", q, "answerable", a, f, "clash") for i, (q, a, f) in enumerate(made_cases(300))]
    rows += [("e", "What is x?", "answerable", " ", ["f"], None), ("e", "What is x?", "answerable", " ", ["f"], None), ("u", "What?", "unanswerable", None, None, None), (None, "q", "answerable", None, None, None), ("n", None, "answerable", None, None, None)]
    got = qa_defects.found(spark.createDataFrame(rows, schema)).collect()
    found = [(r.id, r.defect) for r in got]
    assert ("e", "empty") in found and ("n", "empty") in found and len({i for i, _ in found}) == len(found) and not any(i == "u" for i, _ in found)
    assert qa_defects.found(spark.createDataFrame([], schema)).count() == 0


def test_defects_are_learned_from_all_rows(spark):
    """Counts, weights and thresholds come from every row, not from a part of them."""
    letters = [a + b for a in "bcdfg" for b in "aeiou"]
    words = [f"zu{letters[i // 25 % 25]}{letters[i % 25]}" for i in range(240)]
    rows = [(f"c{i}", q, "answerable", f"The {words[i]} holds. {a} It needs {words[i]} here.", f) for i, (q, a, f) in enumerate(made_cases(240))]
    table = spark.createDataFrame(rows, "id string, question string, answerability string, expected_answer string, expected_facts array<string>")
    detector = qa_defects.train(table.unionAll(table.withColumn("id", F.concat("id", F.lit("b")))), 60)
    assert all(w in detector.profile.rare and w in detector.profile.known for w in words)
    slots = [qa_defects._slot(f"{qa_defects.question_language(r[1])}f:{w}") for r, w in zip(rows, words, strict=True)]
    assert np.any(detector.weights[slots] != 0, axis=1).mean() > 0.9  # both copies of a row may be held out
    again = qa_defects.train(table.unionAll(table.withColumn("id", F.concat("id", F.lit("b")))).repartition(5), 60)
    assert np.array_equal(again.weights, detector.weights) and np.array_equal(again.thresholds, detector.thresholds)


def test_single_words_shared_with_another_language_are_no_refusal():
    assert qa_defects._own_words("What is the limit?", "Jeśli kolejka przed wysyłką urośnie do progu, należy odczekać pół godziny.") < qa_defects.OWN
    assert qa_defects._own_words("What is the limit?", "I cannot say anything about that.") >= qa_defects.OWN
    assert qa_defects._own_words(None, "I do") == qa_defects._own_words("What is it?", None) == 0


def test_held_out_scores_of_all_shards_set_the_thresholds():
    counts = {(2, True, step): 1 for step in range(1_000, 1_100)} | {(2, False, step): 10 for step in range(-200, -100)}
    assert -100 <= qa_defects._thresholds(counts)[2] * qa_defects.SCORE_STEPS <= 1_000
    assert not qa_defects._thresholds({(2, True, 5): 3}).any()


def test_shards_come_whole_or_in_pieces():
    batches = [pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), *(pa.array([f"{c}{x}" for x in s]) for c in "qaf")], names=["shard", "q", "a", "f"]) for s in ([0, 0, 2], [2, 2, 2], [5])]
    got = [(shard, len(rows)) for shard, rows in qa_defects._shards(batches, 3)]
    assert got == [(0, 2), (2, 3), (2, 1), (5, 1)]

# -- 4 -------------------------------------------------------------------------------------------


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(500, 64))
    x = (centres[rng.integers(0, 500, 6000)] + 0.4 * rng.normal(size=(6000, 64))) * rng.uniform(0.5, 2, (6000, 1))
    x = x.astype(np.float32)
    bad = [(9001, None), (9002, []), (9003, [1.0] * 63), (9004, [0.0] * 64), (9005, [float("nan")] + [1.0] * 63), (9006, [None] * 64)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad
    got = knn.VectorNeighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).neighbours().toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    true = {(i, int(j)) for i, row in enumerate(np.argsort(-sims, axis=1)[:, :5]) for j in row}
    assert len(true & set(zip(got.id, got.neighbour, strict=True))) / len(true) >= 0.9
    assert got.id.max() < 6000 and got.groupby("id").size().max() == 5


@pytest.mark.parametrize(
    ("constants", "least"),
    [
        ({"PART": 20, "SAMPLE_ROWS": 1_200}, 0.9),  # 100 parts of the sample, cut once more
        ({"PART": 100, "SAMPLE_ROWS": 5, "SUBS": 1, "ASKS": 500}, 1.0),  # one part in blocks and turns is exact
        ({"PART": 2, "SAMPLE_ROWS": 6_000, "PER_PART": 2}, 0.3),  # 3,000 parts: far more than are searched
    ],
)
def test_neighbours_of_many_parts(spark, monkeypatch, constants, least):
    for name, value in constants.items():
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(500, 64))
    x = (centres[rng.integers(0, 500, 6000)] + 0.4 * rng.normal(size=(6000, 64))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = knn.VectorNeighbours(table).neighbours().toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    true = {(i, int(j)) for i, row in enumerate(np.argsort(-sims, axis=1)[:, :5]) for j in row}
    assert len(true & set(zip(got.id, got.neighbour, strict=True))) / len(true) >= least
    assert got.groupby("id").size().max() <= 5 and not got.duplicated(["id", "neighbour"]).any()


def test_equal_vectors_take_part(spark):
    same = [1.0] + [0.5] * 63
    rows = [(i, same) for i in range(9)] + [(100, [0.9] + [0.5] * 63)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(r.id, r.neighbour): r.distance for r in knn.VectorNeighbours(table).neighbours().collect()}
    assert {n for i, n in got if i == 0} == {1, 2, 3, 4, 5} and {n for i, n in got if i == 8} == {0, 1, 2, 3, 4} and {n for i, n in got if i == 100} == {0, 1, 2, 3, 4}
    assert knn.found(table.limit(0)).count() == 0 and knn.found(table.limit(1)).count() == 0


# -- 5 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_split_covers_the_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "end. ", "\n", "\n\n", "# H\n", "x" * rng.randrange(1, 1500), "漢字。", "-- "]) for _ in range(60)).strip(splitter.EDGE)
    kind, pieces = splitter.split_text(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b - a <= 1000 for a, b, _ in pieces)
    assert all(nxt[0] == cur[1] - 200 for cur, nxt in zip(pieces, pieces[1:], strict=False))
    forced = bool(re.search(r"[^\s.!?。！？]{1001,}", text))
    assert kind == ("whole" if len(text) <= 1000 else "forced" if forced else "natural")


def test_split_cuts_where_the_text_pauses():
    text = "\n\n".join("Sentence number one is here. " * 20 for _ in range(4)).strip()
    _, pieces = splitter.split_text(text)
    assert all(c in ("paragraph", "sentence", "end") for *_, c in pieces)
    assert splitter.split_text("") == ("whole", [])


def test_segments_table(spark):
    schema = "delivery_id bigint, segments array<struct<text:string,section_heading:string,page_number:int>>, cut_kind string"
    rows = [(1, [None, ("a " * 700, "H", 1), ("short", None, None), (" " * 3000, None, None)], "x"), (2, None, None), (3, [("y" * 1001, None, None), (None, "H", 1)], None)]
    documents = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, splitter.found(documents).collect())) == [(1, 1, "natural"), (3, 0, "forced")]
    pieces = splitter.chunk_rows(documents).where("delivery_id = 1").orderBy("piece_index").collect()
    assert pieces[0].section_heading == "H" and pieces[1].text[:200] == pieces[0].text[-200:] and pieces[0].text + "".join(p.text[200:] for p in pieces[1:]) == ("a " * 700).strip()
    assert splitter.found(documents.limit(0)).count() == 0


# -- 6 -------------------------------------------------------------------------------------------


def test_automaton_equals_the_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    lines = (line.split() for line in open(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", "a" * 3000, "aaaa aaa aa", " <|endoftext|> x", "it's  we'll\n\n x", "\x1c \x85　é漢字🧭﻿"]
    texts += ["".join(rng.choice("aabbcee  \n\t'sréÄ漢1２²🧭.,-_") for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    automaton = bpe.compile_vocabulary(bpe.read_vocabulary())
    for text in texts:
        ids = automaton.encode(text)
        assert ids == public.encode_ordinary(text)
        assert automaton.decode(ids) == text and automaton.count(text) == len(ids)
    frame = spark.createDataFrame([(1, None, "x"), (2, "", None), (2, "hello", None), (None, "hi", None)], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_column(frame, "doc_id", "text").collect()]
    assert got[:2] == [(1, []), (2, [])] and len(got[2][1]) == 1 and got[3][0] is None
    assert bpe.encode_column(frame.limit(0), "doc_id", "text").count() == 0


# -- 7 -------------------------------------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng, 50), "big") for i in range(200)] + [(300 + i, text_of(rng, 50), "mid") for i in range(60)] + [(400, text_of(rng, 50), "small"), (500, None, "mid"), (501, "", None), (502, text_of(rng, 30), None), (503, "x", "other")]
    documents = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 3), ("small", 0.1, 2), ("gone", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.report(documents, targets).collect()}
    assert {s for s, r in report.items() if r.short} == {"small", "gone"}
    assert report["small"].rate == pytest.approx(2.0, abs=0.01) and report["mid"].rate <= 3
    assert report["big"].rate * report["big"].source_tokens == pytest.approx(report["big"].target_tokens, rel=0.05)
    chosen = mixing.select(documents, targets)
    assert chosen.agg({"copies": "max"}).first()[0] <= 3 and chosen.where("source = 'other'").count() == 0
    assert mixing.report(documents.limit(0), targets).where("short").count() == 0
    assert mixing.report(documents, targets.limit(0)).count() == 0
    assert mixing.shares(chosen, targets).where("source = 'big'").first().tokens > 0


@pytest.mark.parametrize("bins", [1, 4, 4096])
def test_selection_meets_its_targets(spark, monkeypatch, bins):
    """Every source that can is within half its longest document of its target; the fit decides."""
    monkeypatch.setattr(mixing, "BINS", bins)
    rng = random.Random(5)
    rows = [(i, text_of(rng, rng.randrange(5, 90)), rng.choice(["a", "a", "a", "a", "b", "c"])) for i in range(300)] + [(900, None, "a"), (901, " ", None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.3, 4)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.report(documents, targets).collect()}
    sizes = {r.doc_id: r.tokens for r in mixing.select(documents, targets).collect()}
    longest = max(sizes.values())
    for r in report.values():
        if r.short:
            assert r.own_tokens == r.source_tokens * {"a": 1, "b": 2, "c": 4}[r.source]
        else:
            assert abs(r.own_tokens - r.target_tokens) <= longest
    actual = {r.source: r for r in mixing.shares(mixing.select(documents, targets), targets).collect() if r.source}
    assert all(actual[s].tokens == r.own_tokens for s, r in report.items())
    assert {r.source for r in mixing.short_sources(documents, targets).collect()} == {s for s, r in report.items() if r.short}


# -- 8 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to <a.b+c@mail.x-net.test> now", [("email", "a.b+c@mail.x-net.test")]),
        ("mailto:joe[at]hq.foo.co.example; ok", [("email", "joe[at]hq.foo.co.example")]),
        ("via kel.rad at foomail dot org.test.", [("email", "kel.rad at foomail dot org.test")]),
        ("x_y (at) foo (dot) test", [("email", "x_y (at) foo (dot) test")]),
        ("ｊｏｅ＠ｆｏｏ．ｔｅｓｔ", [("email", "ｊｏｅ＠ｆｏｏ．ｔｅｓｔ")]),
        ("user@<domain> git@forge:a/b 3f2a@sha256 @oncall the recall at 22 fell", []),
        ("Call +44 (0)161 496 0298, ext. 4.", [("phone", "+44 (0)161 496 0298")]),
        ("tel. (212) 555-0104 or 415.555.0185", [("phone", "(212) 555-0104"), ("phone", "415.555.0185")]),
        ("dial zero two zero seven nine four six zero nine zero four", [("phone", "zero two zero seven nine four six zero nine zero four")]),
        ("epoch=1718000000 ports 8080-8443, 192.0.2.14-192.0.2.90, 555 0100 rows", []),
        ("His tax number (QQ 10 62 89 C) and ID 666-80-6154", [("id_number", "QQ 10 62 89 C"), ("id_number", "666-80-6154")]),
        ("insured person 957003231 on line 3; order 957003232", [("id_number", "957003231")]),
        ("Ship to: Flat 19, 13 Tuldo Mews, Rynstaburg.", [("address", "Flat 19, 13 Tuldo Mews, Rynstaburg")]),
        ("Anschrift: Am Kelhof 12, D-00679 Ostpamouth Die", [("address", "Am Kelhof 12, D-00679 Ostpamouth")]),
        ("Livrer au 22 bis, avenue de Jortilow, 00254 Mavtorbach", [("address", "22 bis, avenue de Jortilow, 00254 Mavtorbach")]),
        ("Domicilio: Avda. Kelmira 189, 2.º B, 00743 Korpaburg", [("address", "Avda. Kelmira 189, 2.º B, 00743 Korpaburg")]),
        ("Thanks to Dr. Ulise M. van der Korvaquist-Pelbasson.", [("name", "Ulise M. van der Korvaquist-Pelbasson")]),
        ("by Eldzeberg, Søren first; Frau Glendotzer", [("name", "Eldzeberg, Søren"), ("name", "Glendotzer")]),
        ("The Silver Lane cache and the North Road queue share korvik-store.", []),
    ],
)
def test_personal_information(text, want):
    found = [(s.kind, text[s.start : s.end]) for s in pii.spans(text, pii.FamilyNames(("berg", "quist", "sson", "tzer", "vik")))]
    assert found == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("(212) 555-0104 / (415) 555-0185", ["(212) 555-0104", "(415) 555-0185"]),
        ("row 212-555-0104 212-555-0185 666-80-6154 415.555.0185", ["212-555-0104", "212-555-0185", "666-80-6154", "415.555.0185"]),
        ("+442079460904 4420794609041234 x", ["+442079460904"]),
        ("joe [ at ] foo.test, ann{ at }foo.test, bo<at>foo.test, li (ät) foo.test", ["joe [ at ] foo.test", "ann{ at }foo.test", "bo<at>foo.test", "li (ät) foo.test"]),
        ("jo<dot>li<at>foo<dot>test", ["jo<dot>li<at>foo<dot>test"]),
        ("dial two one two six one six two one oh two", ["two one two six one six two one oh two"]),
        ("at 12 Kelmo Street Suite 5, Rynstaburg and 7 Kelmo Road Apt 3, Ostpam", ["12 Kelmo Street Suite 5, Rynstaburg", "7 Kelmo Road Apt 3, Ostpam"]),
        ("ul. Źrebna 12, 00-950 Kelmowo", ["ul. Źrebna 12, 00-950 Kelmowo"]),
    ],
)
def test_no_shortcut_before_the_detectors(text, want):
    assert [text[s.start : s.end] for s in pii.spans(text)] == want


def test_street_anchors_hold_all_addresses():
    streets = "Street|St|St.|Avenue|Ave|Ave.|Road|Rd.|Lane|Ln|Drive|Boulevard|Blvd.|Way|Mews|Crescent|Close|Court|Ct|Place|Square|Terrace|Parkway|Pkwy|Row|Gardens|Hill|Hollow".split("|")
    texts = [f"x 12 Kelmo {s}{tail}, Rynstaburg y" for s in streets for tail in ("", " Suite 5", ", Suite 5", " Apt. 5", " Unit 5", " Flat 5", " Floor 5", " #5")]
    texts += [f"x {t} y" for t in ("Am Kelhof 12, Ostpa", "Kelmo Str. 3, Ostpa", "22 ter rue du Kelmo, Ostpa", "3, quai Kelmo, Ostpa", "C/ Kelmo 3, Ostpa", "os. Óst 3, Ostpa", "al. Źrebna 3/4, Ostpa")]
    for text in texts:
        whole = [m[0] for m in pii._ADDRESS.finditer(text)]
        assert whole and [text[s.start : s.end] for s in pii.addresses(text)] == whole


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Smith, Frau Müller and Mme Claire Dubois met.", ["Smith", "Müller", "Claire Dubois"]),
        ("Approved by Kelmo Garcia. Kind regards,\nOrla Nowak\n", ["Kelmo Garcia", "Orla Nowak"]),
        ("asked J. R. Whitfield and Orla M. Nowak today", ["J. R. Whitfield", "Orla M. Nowak"]),
        ("with Kelmo van der Meer and James Smith there", ["Kelmo van der Meer", "James Smith"]),
        ("| owner | Garcia, Kelmo | ok; Orla Nowak signed off", ["Garcia, Kelmo", "Orla Nowak"]),
        ("Reviewed by Security Team. Plan B. Restart Silver Lane; approved by the board", []),
    ],
)
def test_names_of_any_ending(text, want):
    for endings in (("berg", "sson", "vik"), ()):
        assert [text[s.start : s.end] for s in pii.spans(text, pii.FamilyNames(endings)) if s.kind == "name"] == want


@pytest.mark.parametrize("text", ["We met John Smith today.", "Ask Maria Garcia.", "by Pierre Dupont in May", "Anna Kowalska said so", "Hans Müller ist da", "signed by Nguyen Van Anh"])
def test_ordinary_names(text):
    want = re.search(r"John Smith|Maria Garcia|Pierre Dupont|Anna Kowalska|Hans Müller|Nguyen Van Anh", text)[0]
    assert [text[s.start : s.end] for s in pii.spans(text) if s.kind == "name"] == [want]


def test_endings_are_learned_from_the_corpus():
    rng = random.Random(3)
    stems = ["Kel", "Mar", "Tor", "Bran", "Ost", "Vel", "Dra", "Pel", "Fen", "Lum"]
    family = [s + e for s in stems for e in ("grove", "dotter")]
    texts = [f"Approved by Orla {rng.choice(family)}. The lesson was long, and the reason for the season is the mission." for _ in range(60)]
    known = pii.learn_endings(texts)
    assert known.endings and all(any(f.lower().endswith(e) for e in known.endings) for f in family) and not any("lesson".endswith(e) for e in known.endings)
    text = "later Yara Bramgrove and Ulf Hindotter came by train"
    assert [text[s.start : s.end] for s in pii.spans(text, known)] == ["Yara Bramgrove", "Ulf Hindotter"] and pii.spans(text) == []
    for alone in ("The train to Bramgrove leaves.", "Zuckergrove is far from Heidelgrove."):
        assert pii.spans(alone, known) == []
    assert pii.learn_endings([]) == pii.learn_endings([None, ""]) == pii.NO_ENDINGS


def test_spans_stay_disjoint():
    rng = random.Random(9)
    for _ in range(50):
        groups = [[pii.Span("name", a := rng.randrange(200), a + rng.randrange(1, 9)) for _ in range(30)] for _ in range(3)]
        want = []
        for s in (s for g in groups for s in g):
            if not any(k.start < s.end and s.start < k.end for k in want):
                want.append(s)
        assert pii.disjoint(groups) == sorted(want, key=lambda s: s.start)


def test_identifier_across_two_rewrites():
    text = "x ｊｏｅ.b [at] foo\u200bmail dot test y"
    assert [text[s.start : s.end] for s in pii.spans(text)] == ["ｊｏｅ.b [at] foo\u200bmail dot test"] or pii.redact(text).startswith("x [EMAIL]")


def test_redaction_leaves_the_rest(spark):
    text = "A​ b@c.test x, tel. 415.555.0185\n"
    assert pii.redact(text) == "A​ [EMAIL] x, tel. [PHONE]\n" and pii.redact(None) is None and pii.redact("") == ""
    frame = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k"), (1, text, "k"), (4, "a@b.test a@b.test", "k")], "doc_id bigint, text string, kind string")
    rows = sorted(map(tuple, pii.found(frame).collect()))
    assert rows == sorted([(1, "email", "b@c.test"), (1, "phone", "415.555.0185")] * 2 + [(4, "email", "a@b.test")])
    assert [r.text for r in pii.redacted(frame).orderBy("doc_id").collect()][2:] == [None, "", "[EMAIL] [EMAIL]"]
    assert pii.found(frame.limit(0)).count() == 0


def test_endings_come_from_all_documents(spark):
    """Names of one document in four thousand count: a sample would lack some of them."""
    given = ["brovik", "solvik", "hagvik", "norvik"]
    rows = [(i, f"Step {i} opens the valve, then item {i % 7} is done.") for i in range(16_000)]
    rows = [(i, f"Contact Mrs. Anna {given[i // 4_000].title()} about step {i}." if i % 4_000 == 500 else t) for i, t in rows] + [(16_000, None)]
    known = pii.learn(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert known.endings == pii.learn_endings([t for _, t in rows]).endings == ("vik",)


def test_pii_shortcuts_find_what_the_patterns_find():
    """What spares searches drops nothing: addresses beside other signs, spelled digits, every title; and runs of digits
    are looked for only where five digits stand side by side (CPU of p8_found)."""
    for text in ("a@b.com", "@x a.b@c.org,d@e.fr;f@g", "x@y@z.com", "..q.r+s@t-u.de and -v@w.io.", "a@b.com@c.com d@e.com", "'a@b.com", "no @ sign", "ä@ö.de"):
        want = [(m.start() + len(m[0]) - len(m[0].lstrip("'-+%")), m.end()) for m in pii._EMAIL.finditer(text)]
        assert [(s.start, s.end) for s in pii.emails(text)] == want
    assert not pii._may_spell("one of the seven two-day rules, five in all") and not pii._may_spell("")
    for text in ("(five 5 5 5 1 2 3)", "call five,five,five-one-two-three-four.", "plus four nine one two three four", "zero  one, two- three four five six", "1 2 3 4 5 6 seven"):
        assert pii._DIGIT_RUN.search(text) and pii._may_spell(text)
    for title in ("Dr.", "Prof.", "Mr.", "Mrs.", "Ms", "Sr.", "Sra.", "Srta.", "Ing.", "Miss", "Frau", "Herr", "Herrn", "Mme", "Mlle", "Madame", "Monsieur", "Señor", "Señora", "Doña", "Don", "Pan", "Pani", "Sir", "Lady", "Doctor", "Docteur"):
        assert [s.kind for s in pii.names(f"met {title} Zyx")] == ["name"]
