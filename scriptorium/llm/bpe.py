"""Problem 6: whole-corpus encoding with a public byte-level BPE vocabulary.

The merge list is compiled into a deterministic automaton over token labels by adding one *merge
gadget* after the other. The automaton before the first merge accepts any sequence of bytes. The
gadget of the merge ``(u, v) -> w`` gives every state that reaches ``v`` through ``u`` an arc
labelled ``w``, and cuts ``v`` off after ``u``. So ``w`` is entered like ``u`` and left like ``v``
at that moment, and a state is fully described by its last label. Three tables hold all gadgets:
``head`` and ``tail`` (the two labels behind each label) and ``cut`` (at which merge an arc between
two labels was cut). ``arc(x, y)`` replays them for one pair, and its answers are kept as the
transition table, so only arcs that texts need are ever laid.

A word is encoded by one pass from left to right that keeps, for every prefix, the one label by
which the automaton reaches it, then reads the labels of the path from the end. Decoding emits the
bytes of the labels of the path.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
#: White_Space of Unicode, spelt out: the regex engines at hand differ in what \s means.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public pre-split of this vocabulary family (fixed form), for any text and for ASCII texts.
SPLIT_ANY = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
SPLIT_ASCII = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabulary files: printable bytes stand for
    themselves, the others follow from code point 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeAutomaton:
    """Deterministic automaton of a merge list; see the module's text."""

    word_bound = 200_000
    arc_bound = 2_000_000

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label: dict[bytes, int] = dict(vocabulary)
        self.bytes_of: dict[int, bytes] = {i: b for b, i in vocabulary.items()}
        size = max(vocabulary.values()) + 1
        self.head, self.tail, self.born = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = _Words(self)
        dead = []
        for rank, (left, right) in enumerate(merges):
            if left not in vocabulary or right not in vocabulary or left + right not in vocabulary:
                raise ValueError(f"merge {rank} uses a label that the vocabulary lacks")
            if not self._add_gadget(vocabulary[left], vocabulary[right], vocabulary[left + right], rank):
                dead.append(left + right)
        for entry in dead:  # no path carries these labels
            self.label.pop(entry, None)
        self.longest = max(map(len, self.label))

    def _add_gadget(self, u: int, v: int, w: int, rank: int) -> bool:
        """Lay the arcs of one merge; False if no path leads from ``u`` to ``v`` any more."""
        if self.born[w] >= 0 or (u, v) in self.cut:
            return True
        open_ = self._open(u, v, rank)
        self.head[w], self.tail[w], self.born[w] = u, v, rank
        self.cut[u, v] = rank
        return open_

    def _open(self, x: int, y: int, at: int) -> bool:
        """Whether label ``y`` could follow label ``x`` just before merge ``at``."""
        born, head, tail, cut = self.born, self.head, self.tail, self.cut
        while True:
            closed = cut.get((x, y))
            if closed is not None and closed < at:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if x == y:
                at, x, y = born[x], tail[x], head[y]
            elif born[y] > born[x]:
                if x == head[y] == tail[y]:  # of three equal labels the first two were merged
                    return False
                at, y = born[y], head[y]
            else:
                at, x = born[x], tail[x]

    def arc(self, x: int, y: int) -> bool:
        """Whether the finished automaton has an arc ``y`` out of the state that ``x`` leads to."""
        key = (x, y)
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= self.arc_bound:
                self.arcs.clear()
            known = self.arcs[key] = self._open(x, y, len(self.cut) + 1)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Labels of the path that spells ``word`` (one pre-split word)."""
        whole = self.label.get(word)
        if whole is not None:
            return [whole]
        n, longest, label, arc = len(word), self.longest, self.label, self.arc
        state = [-1] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                last = label.get(word[start:end])
                if last is not None and (not start or (state[start] >= 0 and arc(state[start], last))):
                    state[end] = last
                    break
        path, at = [], n
        while at:
            path.append(state[at])
            at -= len(self.bytes_of[state[at]])
        return path[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for None and for the empty text."""
        if not text:
            return []
        words = SPLIT_ASCII.findall(text) if text.isascii() else SPLIT_ANY.findall(text)
        return list(chain.from_iterable(map(self.words.__getitem__, words)))

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        words = SPLIT_ASCII.findall(text) if text.isascii() else SPLIT_ANY.findall(text)
        return sum(map(len, map(self.words.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        """Text of a path of labels."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


class _Words(dict):
    """Words met so far; starts anew at ``word_bound`` entries so that its memory is bounded."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= self.automaton.word_bound:
            self.clear()
        ids = self.automaton.encode_word(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def compile_vocabulary(content: bytes) -> MergeAutomaton:
    """Automaton of the content of a byte-level BPE vocabulary file (JSON form)."""
    model = json.loads(content)["model"]
    alphabet = byte_alphabet()
    raw = lambda entry: bytes(alphabet[c] for c in entry)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return MergeAutomaton({raw(k): v for k, v in model["vocab"].items()}, [(raw(a), raw(b)) for a, b in pairs])


def read_vocabulary(name: str = "byte_bpe_50k.json", folder: str = TOKENIZER_DIR) -> bytes:
    """Content of a vocabulary file, read on the driver; it travels to the executors as a broadcast
    of that file's fixed size."""
    with open(f"{folder}/{name}", "rb") as file:
        return file.read()


def encode_column(df: DataFrame, key: str, text: str, vocabulary: bytes | None = None) -> DataFrame:
    """``(key, ids array<int>)`` for each row of ``df``.

    A narrow map: no shuffle, rows stay where they are. NULL and empty texts give an empty list;
    blank texts are ordinary texts. Rows with a NULL or repeated key stay as they are; an empty
    table gives an empty table; other columns of ``df`` are ignored, whatever their names. Text
    that looks like a special token is ordinary text. Lone surrogates become ``?``.
    """
    content = df.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def encode(batches):
        automaton = compile_vocabulary(content.value)
        for batch in batches:
            ids = [automaton.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)), out=offsets[1:])
            values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return rows.mapInArrow(encode, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode_column(df: DataFrame, key: str, ids: str, vocabulary: bytes | None = None) -> DataFrame:
    """``(key, text)`` of encoded rows; the way back of ``encode_column``, NULL ids give the empty text."""
    content = df.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def decode(batches):
        automaton = compile_vocabulary(content.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([automaton.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["k", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(ids).alias("ids")).mapInArrow(decode, f"k {kind}, text string").withColumnRenamed("k", key)
