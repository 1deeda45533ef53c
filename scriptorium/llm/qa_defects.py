"""Problem 2: defective prompt and response pairs.

A multi-label linear classifier (one logistic output for each defect) on hashed word n-grams of every
sentence of the answer and on pair features. It is trained on all answerable cases themselves: the
rows as they are count as sound (the few that are not are found by a first fit and left out of the
next), and each of them is made defective in turn, by truncation, by copying the question, by a
refusal, by an answer of another language and by an empty answer. Sound pairs are also varied in ways
that leave them sound (without their closing mark, shortened to whole sentences, cut down to the
value that the facts name).

The pair features are learned from all cases too (``Profile``): the languages of words, how often a
sentence ends or goes on behind a word, and which answer words go with which question words. Refusals
for training are put together from a grammar of generic parts with made-up fill-ins, so the
classifier cannot learn whole sentences. Thresholds are calibrated on held-out pairs of all rows.

Rows are dealt to shards by a hash. Each pass of the training is a map over all of them: counts are
added up, weights are fitted in each shard and averaged slot by slot over the made cases that hold the
slot, and the scores of the held-out pairs are added up as counts of narrow steps.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.session import spread

DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
#: Rows of a shard on average (at most twice as many are held at a time), and the width of the hashed weight table.
SHARD_ROWS = 3_000
WIDTH = 1 << 17
DENSE = 56
#: Rounds of the training; all but the last fit the pair features alone.
TURNS = 3
#: Steps of a unit that weights (which are then summed as whole numbers) and held-out scores are told by.
WEIGHT_STEPS, SCORE_STEPS = 1 << 20, 512
#: Rows for each of which a word, part or pair must occur once more to be known, beyond the two or three times asked for.
SUPPORT = 1_000_000
#: Share of function words of the question's language that a refusal found in the rows has at least: single ones are also
#: words of other languages.
OWN = 0.15
#: Counts that a task gathers before it sends them on.
GATHERED = 400_000
#: Share of defective pairs of one kind that the thresholds are set for.
EXPECTED = 0.02
#: Share of the pairs counted as sound that may have an open defect still.
LEFT = 0.003
#: Defects whose words are open (refusals, other languages), and the times that a refusal found in the
#: rows counts more than a made one.
OPEN, NATURAL = np.array([2, 4]), 8

#: Stand-ins for a missing text (fixed values), compared without case, marks and outer blanks.
STAND_INS = frozenset(
    "n/a na none null nil nan tbd tbc todo missing empty unknown undefined blank placeholder pending "
    "keine ohne entfällt offen fehlt ausstehend aucun aucune vide néant manquant ninguna ninguno vacío pendiente".split()
) | {"to be added", "to be done", "to be determined", "to be defined", "to follow", "not available", "no answer", "no answer yet", "k. a", "keine angabe", "wird ergänzt", "wird nachgereicht", "à compléter", "à définir", "non disponible", "por completar", "por definir", "no disponible", "sin datos", "s. o", "see above", "fixme", "xxx"}

#: Function words that tell the language of a question (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to is are what which who how when why does do did for from with after before can it that this on by be long often many where list tell i me my you your we our not no an at as if there has have will would could must should these those than then so in or".split(),
    "de": "der die das und ist sind was welche welcher welches wer wie wann warum für von mit nach vor kann es den dem ein eine einen wird werden nicht auf bei lange oft viele wo bedeutet ich mir mich sie ihr wir kein keine zu im in am aus um als dass hier dazu nur oder an dies diese dieser dieses hat haben sich muss soll dafür".split(),
    "fr": "le la les et est sont que quel quelle quels quelles qui comment quand pourquoi pour de des du avec après avant peut il un une ce cette dans par combien où donner étapes je me mon vous votre nous ne pas en à au aux ou cela cet sur plus se son sa ses".split(),
    "es": "el la los las y es son qué cuál cuáles quién cómo cuándo por para de del con después antes puede un una se que en cuánto cuánta dónde significa enumerar pasos yo me mi usted su nos no a al lo o este esta esto sobre más sin hay debe".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)

#: Parts of ways to decline (fixed values): one of each group in turn, {x} a fill-in. Three forms: the
#: speaker cannot or will not do it, no answer exists, the sources give none.
REFUSAL_PARTS = {
    "en": (
        (("I", "we"), ("cannot", "can't", "could not", "am unable to", "am not able to", "am not allowed to", "won't", "will not", "refuse to", "decline to", "must decline to", "have to decline to", "would rather not", "prefer not to", "do not want to", "am not going to"), ("answer", "say anything about", "talk about", "comment on", "discuss", "disclose", "share", "help with", "respond to", "provide", "speak about", "assist with"), ("this", "that", "this question", "your request", "{x}", "details of {x}", "such things")),
        (("no answer", "no information", "no comment", "nothing", "no statement", "no details"), ("is possible", "can be given", "can be said", "is available", "is allowed", "will be given"), ("on this", "about {x}", "here", "from what is given", "for this question")),
        (("the context", "the documents", "the text", "the sources", "the given passages", "my information", "my rules", "the policy"), ("do not", "does not", "don't", "will not"), ("contain", "give", "allow", "mention", "permit", "cover", "let me give", "support"), ("an answer", "that", "a reply", "this", "enough information", "anything about {x}")),
    ),
    "de": (
        (("ich", "wir"), ("kann", "darf", "möchte", "will", "werde", "muss"), ("dazu", "darauf", "zu {x}", "hierzu", "diese Frage", "das", "darüber"), ("nicht", "leider nicht", "keinesfalls"), ("beantworten", "antworten", "helfen", "sagen", "besprechen", "kommentieren", "mitteilen", "sprechen")),
        (("keine Antwort", "keine Auskunft", "kein Kommentar", "nichts", "keine Angaben"), ("ist möglich", "kann ich geben", "liegt vor", "wird gegeben", "ist erlaubt"), ("dazu", "zu {x}", "hier", "aus dem Kontext", "auf diese Frage")),
        (("der Kontext", "die Unterlagen", "der Text", "die Quellen", "meine Vorgaben"), ("enthält", "gibt", "nennt", "erlaubt", "lässt"), ("keine Antwort", "nichts dazu", "das nicht", "keine Auskunft", "dies nicht zu")),
    ),
    "fr": (
        (("je", "nous"), ("ne peux pas", "ne veux pas", "ne suis pas en mesure de", "ne suis pas autorisé à", "refuse de", "préfère ne pas", "ne dois pas", "ne vais pas"), ("répondre à", "parler de", "aider pour", "commenter", "discuter de", "communiquer", "dire plus sur"), ("cela", "cette question", "votre demande", "{x}", "ce sujet")),
        (("aucune réponse", "aucune information", "aucun commentaire", "rien"), ("n'est possible", "ne peut être donnée", "n'est disponible", "n'est permis"), ("ici", "sur {x}", "pour cette question", "dans le contexte")),
        (("le contexte", "les documents", "le texte", "les sources", "mes règles"), ("ne permettent pas", "ne permet pas", "ne donne pas", "ne contient pas", "n'autorise pas"), ("de répondre", "de réponse", "cela", "d'en dire plus")),
    ),
    "es": (
        (("yo", ""), ("no puedo", "no quiero", "no debo", "no voy a", "me niego a", "no soy capaz de", "no se me permite", "preferiría no"), ("responder a", "hablar de", "ayudar con", "comentar", "revelar", "decir nada sobre", "tratar"), ("eso", "esta pregunta", "su petición", "{x}", "este tema")),
        (("ninguna respuesta", "ninguna información", "ningún comentario", "nada"), ("es posible", "puede darse", "está disponible", "se permite"), ("aquí", "sobre {x}", "para esta pregunta", "con el contexto")),
        (("el contexto", "los documentos", "el texto", "las fuentes", "mis reglas"), ("no permiten", "no permite", "no contiene", "no da", "no autoriza"), ("responder", "una respuesta", "eso", "decir más")),
    ),
}
#: What may stand before and behind such a sentence (fixed values).
LEADS = {
    "en": ("Sorry", "Unfortunately", "Regrettably", "Well", "Note"), "de": ("Leider", "Entschuldigung", "Nun", "Hinweis"),
    "fr": ("Désolé", "Malheureusement", "Bien", "Remarque"), "es": ("Lo siento", "Lamentablemente", "Bueno", "Nota"),
}
TAILS = {
    "en": ("Ask the {x} team", "Please try elsewhere", "See {x}", "Can I help with something else?"), "de": ("Bitte das Team {x} fragen", "Siehe {x}", "Kann ich sonst helfen?"),
    "fr": ("Demandez à l'équipe {x}", "Voir {x}", "Puis-je aider autrement ?"), "es": ("Pregunte al equipo {x}", "Vea {x}", "¿Puedo ayudar en otra cosa?"),
}
FORMS = ("speaker", "none", "sources")

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_QUOTED = re.compile(r"`[^`]*`?|\"[^\"]*\"|„[^“”]*[“”]|«[^»]*»|“[^”]*”")
_NAME = re.compile(r"\S*[-_./\d@]\S*")
_LAST = re.compile(r"\S+\s*$")
_OUTER = re.compile(r"^[\s\W_]+|[\s\W_]+$")
_CLOSED = re.compile(r"[.!?。！？…][\"'`)»”]*$")
_SENTENCE = re.compile(r"(?<=[.!?;。])\s+|\n+")
_THING = re.compile(r"`[^`\n]+`|[^\s`\"(),;:!?]*[\d_@][^\s`\"(),;:!?]*|[^\W\d_]+(?:-[^\W\d_]+)+|[^\W_]+\.[a-z]{2,8}\b")
_VALUE = re.compile(r"(?<![\w.`-])(\d+|`[^`]+`)(?: [^\W\d_]+)?(?=$|[\s,.;])")


def bare(text: str | None) -> str:
    return _OUTER.sub("", text or "").lower()


def is_missing(text: str | None) -> bool:
    """Whether a text is NULL, blank, only marks or a stand-in for a missing text."""
    core = bare(text)
    return not core or core in STAND_INS


def prose_words(text: str | None) -> list[str]:
    """Lower-case words outside quotes and names of things."""
    if not text:
        return []
    return [w.lower() for w in _WORD.findall(_NAME.sub(" ", _QUOTED.sub(" ", text))) if not w.isdigit()]


_FUNCTION_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_ALL_FUNCTION = frozenset().union(*_FUNCTION_SETS.values())


def question_language(question: str | None) -> str | None:
    words = prose_words(question)
    counts = {k: sum(w in f for w in words) for k, f in _FUNCTION_SETS.items()}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] else None


def things(text: str | None) -> list[str]:
    """Names, codes, files and numbers of a text, without marks at their ends."""
    return [_OUTER.sub("", t).lower() for t in _THING.findall(text or "")]


def _kind(token: str) -> str:
    if token.isalpha():
        return "<word>"
    if token.startswith("`") and token.rstrip(".,;:)").endswith("`") and len(token) > 2:
        return "<code>"
    core = token.strip(".,;:!?()[]\"'«»„“”")
    if not core.strip("`-–—*•>#=/\\"):
        return "<mark>"
    if core[0].isdigit() and not any(c.isalpha() for c in core):
        return "<number>"
    if any(c.isdigit() for c in core) or "_" in core:
        return "<code>"
    if "." in core:
        return "<file>"
    if "-" in core or "`" in core:
        return "<name>"
    return "<word>" if _OUTER.sub("", core) else "<mark>"  # "&", "§": marks of any other kind


def masked(sentence: str) -> list[str]:
    """Tokens of a sentence in lower case without outer marks; names, codes and numbers as their kind."""
    out = []
    for token in sentence.split():
        if token.isalpha():
            out.append(token.lower())
            continue
        kind = _kind(token)
        out.append(_OUTER.sub("", token).lower() if kind == "<word>" else kind)
    return out


def sentences(text: str | None) -> list[list[str]]:
    return [m for s in _SENTENCE.split(text or "") if (m := masked(s))]


def _own_words(question: str | None, answer: str | None) -> float:
    """The share of an answer's words that are function words of its question's language."""
    language, words = question_language(question), prose_words(answer)
    return sum(w in _FUNCTION_SETS[language] for w in words) / len(words) if language is not None and words else 0.0


# -- what the rows tell --------------------------------------------------------------------------


@dataclass(eq=False)
class Profile:
    """Statistics of all rows: ``languages`` (log shares of each known word), ``goes`` (how often
    a sentence goes on and ends behind one or two tokens), ``known`` words, ``stems`` (proper starts of
    known words and name parts), ``parts`` of names, and ``together`` (share of the pairs with a question
    word whose answer holds a word) with the weight ``rare`` of each answer word."""

    languages: dict[str, tuple[float, ...]] = field(default_factory=dict)
    goes: dict[tuple[str, ...], tuple[int, int]] = field(default_factory=dict)
    known: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    parts: frozenset[str] = frozenset()
    together: dict[tuple[str, str], float] = field(default_factory=dict)
    rare: dict[str, float] = field(default_factory=dict)
    most: float = 1.0

    def margin(self, text: str | None, language: str | None) -> tuple[float, int]:
        """(score of the best other language minus that of ``language``, number of known words)."""
        rows = [row for word in prose_words(text) if (row := self.languages.get(word)) is not None]
        if language is None or not rows:
            return 0.0, 0
        total, known = [sum(x) for x in zip(*rows, strict=True)], len(rows)
        own = LANGUAGES.index(language)
        return max(t for i, t in enumerate(total) if i != own) - total[own], known

    def ending(self, tokens: list[str]) -> tuple[float, float]:
        """Log odds that a sentence ends behind its last two tokens, and behind its last one."""
        def odds(key: tuple[str, ...]) -> float | None:
            on, end = self.goes.get(key, (0, 0))
            return math.log((end + 0.3) / (on + 0.3)) if on + end >= 2 else None

        one = odds((tokens[-1],))
        two = odds((tokens[-2] if len(tokens) > 1 else "^", tokens[-1]))
        return (two if two is not None else (one or 0.0) / 2), one or 0.0

    def fits(self, question: frozenset[str], tokens: list[str]) -> float | None:
        """How much the words of a sentence go with the question's words, from 0 to 1."""
        total = weight = 0.0
        known = _joined(self, question)
        for w in {t for t in tokens if t[0] != "<"}:
            rare = self.rare.get(w, self.most)
            weight += rare
            if w not in known:
                known[w] = min(1.0, 3 * max((self.together.get((v, w), 0.0) for v in question), default=0.0))
            total += rare * known[w]
        return total / weight if weight else None


@lru_cache(maxsize=64)
def _joined(profile: Profile, question: frozenset[str]) -> dict[str, float]:
    """How much answer words go with a question's words, as far as looked up."""
    return {}


def _whole(counts: Counter) -> tuple[frozenset[str], frozenset[str]]:
    """Words that occur on their own, and the proper starts of words. A start that is rare beside the
    words it begins comes from texts that break off."""
    begun: Counter = Counter()
    for word, n in counts.items():
        if n >= 2:
            for i in range(1, len(word)):
                begun[word[:i]] = max(begun[word[:i]], n)
    return frozenset(w for w, n in counts.items() if n >= 2 and n > 0.05 * begun[w]), frozenset(begun)


#: Kinds of counts: rows, rows of a language, languages of a word, tokens that go on or end behind one
#: token or two, words of answers and facts, parts of names, words of questions, pairs of words.
ROWS, SPOKEN, WORDS_OF, GOES_ONE, GOES_TWO, SAID, PARTS, ASKED, BOTH = range(9)


def tally(rows: Iterable[tuple]) -> Iterator[dict[tuple[int, str, str], list[int]]]:
    """Counts of ``(question, answer, facts)``, ``GATHERED`` keys or so at a time: up to four numbers for
    each ``(kind, word, other word)``. Answers and facts count for their question's language."""
    counts: dict[tuple[int, str, str], list[int]] = {}

    def add(key: tuple[int, str, str], at: int = 0) -> None:
        found = counts.get(key)
        if found is None:
            found = counts[key] = [0] * len(LANGUAGES)
        found[at] += 1

    for question, answer, facts in rows:
        add((ROWS, "", ""))
        language = question_language(question)
        texts = [answer, *(facts or ())]
        if language is not None:
            i = LANGUAGES.index(language)
            for text in (question, *texts):
                for word in set(prose_words(text)):
                    add((WORDS_OF, word, ""), i)
            add((SPOKEN, "", ""), i)
        said = set()
        for text in texts:
            if is_missing(text):
                continue
            for tokens in sentences(text):
                said.update(t for t in tokens if t[0] != "<")
                for j, token in enumerate(tokens):
                    ends = int(j == len(tokens) - 1)
                    add((GOES_ONE, token, ""), ends)
                    add((GOES_TWO, tokens[j - 1] if j else "^", token), ends)
            for part in {p for t in things(text) for p in re.split(r"[-._]", t)}:
                add((PARTS, part, ""))
        here = {t for s in sentences(question) for t in s if t[0] != "<"}
        for w in said:
            add((SAID, w, ""))
        for v in here:
            add((ASKED, v, ""))
            for w in said:
                add((BOTH, v, w))
        if len(counts) >= GATHERED:
            yield counts
            counts = {}
    yield counts


def least(rows: int) -> int:
    """How often a word, part or run of tokens occurs at least that counts; pairs one time more. It grows
    with the rows, so that what is known doesn't outgrow the memory of a task."""
    return max(2, rows // SUPPORT)


def profile_of(counts: dict[tuple[int, str, str], list[int]]) -> Profile:
    """The profile of the counts of all rows."""
    n = max(counts.get((ROWS, "", ""), [0])[0], 1)
    totals = [1 + c for c in counts.get((SPOKEN, "", ""), [0] * len(LANGUAGES))]
    enough = least(n)
    table, goes, words, parts, asked = {}, {}, Counter(), Counter(), Counter()
    for (kind, word, other), c in counts.items():
        if sum(c) < enough:
            continue
        if kind == WORDS_OF:
            share = [x / t for x, t in zip(c, totals, strict=True)]
            smooth = [s + 0.02 * sum(share) for s in share]
            table[word] = tuple(math.log(s / sum(smooth)) for s in smooth)
        elif kind in (GOES_ONE, GOES_TWO):
            goes[(word,) if kind == GOES_ONE else (word, other)] = (c[0], c[1])
        elif kind in (SAID, PARTS, ASKED):
            (words if kind == SAID else parts if kind == PARTS else asked)[word] = c[0]
    for name, listed in FUNCTION_WORDS.items():  # so that a language without cases is known too
        for word in listed:
            if word not in table:
                table[word] = tuple(math.log(0.85 if k == name else 0.05) for k in LANGUAGES)
    known, stems_w = _whole(words)
    known_parts, stems_p = _whole(parts)
    together = {(v, w): c[0] / asked[v] for (kind, v, w), c in counts.items() if kind == BOTH and c[0] > enough}
    return Profile(table, goes, known, stems_w | stems_p, known_parts, together, {w: math.log(1 + n / c) for w, c in words.items()}, math.log(1 + n))


def learn_profile(rows: list[tuple]) -> Profile:
    """Learn from ``(question, answer, facts)`` of one process."""
    total: dict[tuple[int, str, str], list[int]] = {}
    for counts in tally(rows):
        for key, c in counts.items():
            total[key] = [x + y for x, y in zip(total[key], c, strict=True)] if key in total else c
    return profile_of(total)


# -- features -----------------------------------------------------------------------------------


@lru_cache(maxsize=1 << 12)
def _asked(question: str | None) -> tuple:
    """What a question tells: language, words, pairs of words, masked words and things."""
    words = [w.lower() for w in _WORD.findall(question or "")]
    return question_language(question), words, frozenset(zip(words, words[1:], strict=False)), frozenset(t for s in sentences(question) for t in s if t[0] != "<"), frozenset(things(question))


@lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    return DENSE + zlib.crc32(name.encode("utf-8", "replace")) % (WIDTH - DENSE)


def _shares(a: list[str], b: set[str]) -> float:
    return sum(x in b for x in a) / len(a) if a else 0.0


@lru_cache(maxsize=64)
def _told(question: str | None, facts: tuple, profile: Profile) -> tuple:
    """What the facts tell: those there are, their things, words and rare words, and pair features."""
    real = [f for f in facts if not is_missing(f)]
    f_things = {t for f in real for t in things(f)}
    f_words = {w for f in real for w in prose_words(f)}
    dense: dict[int, float] = {}
    if real:
        language, _, _, asked, _ = _asked(question)
        margins = [profile.margin(f, language) for f in real]
        told = [m for m, n in margins if n]
        total = sum(told)
        dense[8] = max(-4.0, min(4.0, total / 2.0))
        dense[9] = float(bool(told) and min(told) > 0 and total > 1.5)
        dense[10] = float(bool(told) and min(told) > 0 and total > 4.0)
        fit = [x for f in real for s in sentences(f) if (x := profile.fits(asked, s)) is not None]
        dense[31] = max(fit) - 0.5 if fit else 0.0
        strange = [w for w in f_words if w not in profile.languages]
        dense[32] = len(strange) / max(len(f_words), 1)
    return real, f_things, f_words, [w for w in f_words if profile.rare.get(w, profile.most) > 2], dense


def features(question: str | None, answer: str | None, facts: list | None, profile: Profile, words_too: bool = True) -> tuple[list[int], list[float]]:
    """Slots and values of one pair; the first ``DENSE`` slots are pair features, given alone without ``words_too``."""
    dense = [0.0] * DENSE
    names: list[str] = []
    dense[0] = 1.0
    text = (answer or "").strip()
    real, f_things, f_words, f_rare, told = _told(question, tuple(facts or ()), profile)
    for slot, value in told.items():
        dense[slot] = value
    blank, no_facts = is_missing(answer), not real
    dense[1], dense[2], dense[3] = float(blank), float(no_facts), float(blank or no_facts)
    language, q, pairs_q, asked, q_things = _asked(question)
    a = [w.lower() for w in _WORD.findall(text)]
    if not blank:
        said = prose_words(text)
        margin, known = profile.margin(answer, language)
        dense[4] = max(-4.0, min(4.0, margin / 2.0))
        dense[5] = float(margin > 1.5)
        dense[6] = float(margin > 4.0)
        dense[7] = float(margin / max(known, 1) > 0.8 and known >= 1)
        parts = sentences(text)
        fit = [x for s in parts if (x := profile.fits(asked, s)) is not None]
        dense[33] = float(not fit)
        if fit:
            dense[34], dense[35], dense[36] = max(fit) - 0.5, fit[0] - 0.5, float(max(fit) < 0.35)
        own = things(text)
        dense[37] = _shares(own, q_things | f_things)
        dense[38] = float(bool(own) and not any(t in f_things for t in own))
        dense[39] = float(not own)
        dense[40] = _shares(list(f_things), set(own))
        dense[41] = _shares(f_rare, set(said))
        if real and any(bare(f) == bare(text) for f in real):
            dense[42] = 1.0
        if said:
            strange = sum(w not in profile.languages for w in said) / len(said)
            dense[28], dense[29] = strange, float(strange > 0.5)
            dense[48] = _shares(said, _FUNCTION_SETS[language]) if language else 0.0
            dense[49] = float(language is not None and not dense[48])
        words = {*said, *own}
        dense[50] = _shares([w for w in words if w not in _ALL_FUNCTION], f_words | f_things)
        dense[51] = float(len(a) <= 6 and dense[50] > 0.99)
        letters = [c for c in text if c.isalpha()]
        dense[30] = float(sum(c > "Ͱ" for c in letters) > 0.3 * max(len(letters), 1))
        if a:
            qs, pairs_a = set(q), list(zip(a, a[1:], strict=False))
            inside, covered = _shares(a, qs), _shares(q, set(a))
            new = sum(w not in qs for w in a)
            dense[11], dense[12], dense[13] = inside, covered, _shares(pairs_a, pairs_q)
            dense[14] = float(inside > 0.75 and covered > 0.7)
            dense[15] = float(new <= 2 and covered > 0.6)
            dense[16] = float(new <= 5 and covered > 0.8)
            dense[17] = float(text.endswith("?"))
            dense[18] = min(new, 12) / 12
        dense[19] = float(text.replace("```", "").count("`") % 2 or text.count("```") % 2)
        dense[20] = float(text.count("(") > text.count(")"))
        dense[21] = float(text.count('"') % 2 or text.count("«") > text.count("»") or text.count("[") > text.count("]"))
        dense[23] = float(bool(re.search(r"(?:\.\.\.|…)\W*$", text)))
        dense[27] = float(bool(re.search(r"\n\s*(?:[-*•>]|\d+[.)])\s*$", text)))
        closed = (bool(_CLOSED.search(text)) or text.endswith("```")) and not dense[23] and not dense[27]
        dense[22] = float(closed)
        dense[24] = float(bool(re.search(r"[,;:(\[{\-–—/&=]$", text)))
        dense[25] = min(len(a), 40) / 40
        dense[26] = float(0 < len(a) <= 4)
        last = _LAST.search(text)[0].strip()
        kind, core = _kind(last), _OUTER.sub("", last).lower()
        tail = parts[-1] if parts else ["<mark>"]
        if not closed:
            piece = re.split(r"[-._]", core)[-1] if kind != "<word>" else core
            cut = bool(piece) and not piece.isdigit() and piece in profile.stems and piece not in (profile.known if kind == "<word>" else profile.parts)
            two, one = (-3.0, -3.0) if cut else profile.ending(tail)
            dense[43], dense[44], dense[45] = max(-3.0, min(3.0, two)), max(-3.0, min(3.0, one)), float(two < -0.5)
            dense[46] = float(cut)
            dense[47] = float(two > 1 and one > 0)
        for place, part in enumerate(parts if words_too else ()):
            at = f"{language}{'f' if not place else 'l' if place == len(parts) - 1 else 'i'}"
            names += [f"{at}:{x}" for x in part] + [f"{language}b:{x}_{y}" for x, y in zip(part, part[1:], strict=False)]
            if not place:
                names += [f"{language}t:{x}_{y}_{z}" for x, y, z in zip(part, part[1:], part[2:], strict=False)]
        if not closed and words_too:
            names += [f"k:{kind}:{last[-1] if kind == '<mark>' or not last[-1].isalnum() else ''}", f"e:{tail[-1]}", f"ee:{'_'.join(tail[-2:])}", f"n:{len(parts)}:{min(len(tail), 3)}:{kind}"]
    slots = [i for i, v in enumerate(dense) if v]
    values = [dense[i] for i in slots]
    if not words_too:
        return slots, values
    hashed = sorted({_slot(n) for n in names})
    weight = 2.0 / max(1.0, len(hashed)) ** 0.5
    return slots + hashed, values + [weight] * len(hashed)


# -- made cases ---------------------------------------------------------------------------------


def _truncate(text: str, rng: random.Random) -> str | None:
    """The start of a text up to some place inside a sentence, or with an opened list item behind it."""
    text = text.strip()
    if len(text) < 12:
        return None
    way = rng.random()
    pauses = [m.end() for m in re.finditer(r"[,;:–—](?=\s)", text)]
    if way < 0.06 and pauses:
        return text[: rng.choice(pauses)]
    if way < 0.14:
        return text + rng.choice(["\n-", "\n*", "\n2.", "\n- ", "\n3)", "\n\n```\n" + text[: rng.randint(4, 12)]])
    at = rng.randint(max(4, len(text) // 5), len(text) - 2)
    cut = text[:at]
    if rng.random() < 0.6:
        cut = re.sub(r"\S+$", "", cut).rstrip()
        if rng.random() < 0.3:
            cut = cut.rstrip(" .") + rng.choice([" (", "…", "...", ",", " -", ":"])
    core = cut.rstrip()
    if len(core) < 3 or _CLOSED.search(core) and not core.endswith(("…", "...")) or text[at : at + 1] in ".!?\n":
        return None
    return cut


def _sound(text: str, facts: list | None, rng: random.Random) -> str | None:
    """A text that serves as well: fewer whole sentences, no closing mark, or only the value asked for."""
    way = rng.random()
    whole = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    if way < 0.15:
        named = set(things(text))
        values = [m[0] for f in facts or () for m in _VALUE.finditer(f or "") if _OUTER.sub("", m[1]).lower() in named]
        value = rng.choice(values) if values else None
        return value.split()[0] if value and rng.random() < 0.4 else value
    if "\n" in text or not whole or not all(_CLOSED.search(s) for s in whole):
        return None
    kept = whole[: rng.randint(1, len(whole))]
    return " ".join(kept) if way < 0.35 else re.sub(r"[.!?]+$", "", " ".join(kept))


def _foreign(text: str, rng: random.Random) -> str | None:
    """Made-up text of an unknown language: prose words with their letters moved on, or in another
    script, with or without spaces. None if the text has too little prose to be of a language."""
    if len(prose_words(text)) < 3:
        return None
    if rng.random() < 0.6:
        shift = str.maketrans("abcdefghijklmnopqrstuvwxyzäöüéèàñç", "eciwolszyrkpmnabtdzugwvkjxąęłóśżńć")
        return " ".join(w if _NAME.fullmatch(w) or "`" in w else w.translate(shift) for w in text.split())
    first = rng.choice([0x3042, 0x0430, 0x4E00, 0x03B1, 0x0905])
    moved = [w if "`" in w or "-" in w else "".join(chr(first + ord(c) % 40) if c.isalpha() else c for c in w) for w in text.split()]
    return rng.choice(["", " "]).join(moved)


def _graft(text: str, own: str) -> str:
    """A text with its names, codes and numbers replaced by those of another one, kind by kind."""
    stock: dict[str, list[str]] = {}
    for t in _THING.findall(own):
        stock.setdefault(_kind(t), []).append(t)
    used: Counter = Counter()

    def put(m: re.Match) -> str:
        kind = _kind(m[0])
        if kind not in stock:
            return m[0]
        used[kind] += 1
        return stock[kind][(used[kind] - 1) % len(stock[kind])]

    return _THING.sub(put, text)


def _copy(question: str, rng: random.Random) -> str:
    words = question.split()
    if len(words) > 3 and rng.random() < 0.4:
        i = rng.randrange(len(words))
        if rng.random() < 0.5:
            words.insert(i, words[i])
        else:
            del words[i]
    text = " ".join(words)
    if rng.random() < 0.15:
        text = f"{text} {text}"
    if rng.random() < 0.25:
        text = text.upper() if rng.random() < 0.5 else text.lower()
    if rng.random() < 0.3:
        text = text.rstrip(" ?.!") + rng.choice(["", ".", "…", "!"])
    lead = ["You asked", "The question is", "Question", "Q", "Die Frage lautet", "La question est", "La pregunta es", "Frage", "Pregunta", "Vous demandez", "Sie fragen", "Usted pregunta"]  # fixed values
    return (rng.choice(lead) + ": " if rng.random() < 0.4 else "") + text


def _refuse(question: str, language: str, rng: random.Random, stock: list[str], without: int | None = None) -> str:
    """A refusal of the grammar; ``without`` leaves out one of its forms. Parts and order vary, and words
    of other rows stand for what was asked about, so that only the parts' own words repeat."""
    named = [t for t in _THING.findall(question) if t]

    def fill() -> str:
        return rng.choice(named) if named and rng.random() < 0.6 else rng.choice(stock) if stock else "this"

    def one() -> str:
        form = rng.choice([f for i, f in enumerate(REFUSAL_PARTS[language]) if i != without])
        words = [rng.choice(part) for part in form]
        if rng.random() < 0.15 and len(words) > 2:
            words.pop()
        return re.sub(r"\s+", " ", " ".join(words)).strip()

    said = one()
    if rng.random() < 0.45:
        said = rng.choice(LEADS[language]) + rng.choice([", ", ": ", " - ", ". ", " "]) + said
    if rng.random() < 0.2:
        said += rng.choice([". ", "; ", ", "]) + one()
    if rng.random() < 0.35:
        said += rng.choice([". ", "; ", ", "]) + rng.choice(TAILS[language])
    said = re.sub(r"\{x\}", lambda _: fill(), said)
    said = said[0].upper() + said[1:] + rng.choice([".", ".", ".", "", "!"])
    return rng.choice([said, said, said, said.lower(), "> " + said])


def make_cases(rows: list[tuple], seed: int = 11, without: int | None = None) -> list[tuple[str, str | None, list | None, int, int]]:
    """Pairs with labels (-1 sound, else the place in ``DEFECTS``) and the row they were made of."""
    rng = random.Random(seed)
    by_language: dict[str | None, list[tuple]] = {}
    for row in rows:
        by_language.setdefault(question_language(row[0]), []).append(row)
    spoken = [k for k in by_language if k is not None]
    missing = ["", " ", "\n", "-", "?", "...", "—", "null", "N/A", "None", "TBD", "TODO", "(none)", '""', "[]", "to be added", "\xa0", None]
    cases = []
    for at, (question, answer, facts) in enumerate(rows):
        language = question_language(question) or "en"
        cases.append((question, answer, facts, -1, at))
        if is_missing(answer) or not facts or not question:
            continue
        varied = _sound(answer, facts, rng)
        if varied and varied != answer:
            cases.append((question, varied, facts, -1, at))
        for _ in range(2):
            cut = _truncate(answer, rng)
            if cut is not None:
                cases.append((question, cut, facts, 1, at))
        stock = [t for t in _THING.findall(rng.choice(rows)[1] or "") if t]
        for _ in range(2):
            said = _refuse(question, language, rng, stock, without)
            cases.append((question, said, [said] if rng.random() < 0.15 else facts, 2, at))
        cases.append((question, _copy(question, rng), facts, 3, at))
        if rng.random() < 0.3:
            if rng.random() < 0.5:
                cases.append((question, rng.choice(missing), facts, 0, at))
            else:
                cases.append((question, answer, rng.choice([None, [], [rng.choice(missing)], [rng.choice(missing)] * 2]), 0, at))
        if rng.random() < 0.35:
            strange = _foreign(answer, rng)
            if strange:
                cases.append((question, strange, facts, 4, at))
        others = [k for k in spoken if k != language]
        if others:
            other = rng.choice(by_language[rng.choice(others)])
            if not is_missing(other[1]) and other[2]:
                way = rng.random()
                # a text without words of a language is of no other one
                foreign = _graft(other[1], answer) if len(prose_words(other[1])) >= 3 else answer
                alien = [_graft(f, answer) for f in other[2] if f]
                worded = bool(alien) and all(len(prose_words(f)) >= 2 for f in alien)
                if way < 0.45 and foreign != answer:
                    cases.append((question, foreign, facts, 4, at))
                elif way < 0.75 and worded:
                    cases.append((question, foreign, alien, 4, at))
                elif worded:
                    cases.append((question, answer, alien, 4, at))
    return cases


# -- fitting ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Detector:
    """Weights slot x defect, thresholds and what the rows told."""

    weights: np.ndarray
    thresholds: np.ndarray
    profile: Profile

    def over(self, pairs: list[tuple]) -> np.ndarray:
        """Scores above the thresholds of ``(question, answer, facts)`` pairs: the matrix pair x defect."""
        return _scores([features(*p, self.profile) for p in pairs], self.weights) - self.thresholds

    def defects(self, question: str | None, answer: str | None, facts: list | None) -> list[str]:
        """All defects of a pair, the surest first."""
        over = self.over([(question, answer, facts)])[0]
        return [DEFECTS[i] for i in np.argsort(-over) if over[i] > 0]

    def defect(self, question: str | None, answer: str | None, facts: list | None) -> str | None:
        return next(iter(self.defects(question, answer, facts)), None)


def _scores(rows: list[tuple[list[int], list[float]]], weights: np.ndarray) -> np.ndarray:
    """One sparse product for many rows; every row has at least the constant slot."""
    if not rows:
        return np.zeros((0, len(DEFECTS)), np.float32)
    sizes = np.array([len(s) for s, _ in rows])
    index = np.concatenate([np.asarray(s, np.int64) for s, _ in rows])
    value = np.concatenate([np.asarray(v, np.float32) for _, v in rows])
    return np.add.reduceat(weights[index] * value[:, None], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)


def _fit_weights(rows: list[tuple[list[int], list[float]]], labels: np.ndarray, epochs: int = 6, seed: int = 5) -> np.ndarray:
    """Logistic outputs by AdaGrad over mini-batches."""
    rng = np.random.default_rng(seed)
    weights = np.zeros((WIDTH, len(DEFECTS)), np.float32)
    speed = np.full((WIDTH, len(DEFECTS)), 1e-3, np.float32)
    goal = np.zeros((len(rows), len(DEFECTS)), np.float32)
    hit = np.flatnonzero(labels >= 0)
    goal[hit, labels[hit]] = 1
    slots = [np.asarray(s, np.int64) for s, _ in rows]
    values = [np.asarray(v, np.float32) for _, v in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 256):
            some = order[start : start + 256]
            index = np.concatenate([slots[i] for i in some])
            value = np.concatenate([values[i] for i in some])[:, None]
            sizes = np.array([len(slots[i]) for i in some])
            ends = np.r_[0, np.cumsum(sizes)[:-1]]
            z = np.add.reduceat(weights[index] * value, ends, axis=0)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal[some]
            distinct, place = np.unique(index, return_inverse=True)
            order_of = np.argsort(place, kind="stable")
            runs = np.r_[0, np.flatnonzero(np.diff(place[order_of])) + 1]
            gradient = np.add.reduceat((np.repeat(error, sizes, axis=0) * value)[order_of], runs, axis=0)
            speed[distinct] += gradient**2
            weights[distinct] -= 0.3 * gradient / np.sqrt(speed[distinct])
    return weights


def _thresholds(counts: dict[tuple[int, bool, int], int]) -> np.ndarray:
    """For each defect the score with the best F1 on held-out pairs, if a share ``EXPECTED`` of the pairs
    has the defect; the middle of the best range. ``counts`` are those of the pairs by ``(defect, has it,
    step of the score)``. Of an ``OPEN`` defect the share ``LEFT`` of the sound pairs with the highest
    scores is left out, since they may have it; both rates are smoothed by half a pair."""
    out = np.zeros(len(DEFECTS), np.float32)
    for i in range(len(DEFECTS)):
        steps = {has: np.array(sorted((step, n) for (d, h, step), n in counts.items() if d == i and h == has), np.int64).reshape(-1, 2) for has in (True, False)}
        if not len(steps[True]) or not len(steps[False]):
            continue
        first = min(steps[True][0, 0], steps[False][0, 0])
        size = int(max(steps[True][-1, 0], steps[False][-1, 0]) - first) + 1
        # pairs at each step or above
        positive, rest = (np.cumsum(np.bincount(s[:, 0] - first, s[:, 1], size)[::-1])[::-1] for s in (steps[True], steps[False]))
        left = int(np.ceil(LEFT * rest[0])) if i in OPEN else 0
        wrong = (np.maximum(rest - left, 0) + 0.5) / (rest[0] - left + 1)
        recall = positive / (positive[0] + 0.5)
        f1 = 2 * EXPECTED * recall / (EXPECTED * recall + EXPECTED + (1 - EXPECTED) * wrong)
        best = np.flatnonzero(f1 >= f1.max() - 2e-3)
        out[i] = float(2 * first + best[0] + best[-1]) / 2 / SCORE_STEPS
    return out


#: Profile and weights of pair features, by which the rows of the next turn are told.
Judge = tuple[Profile, np.ndarray]


def _judged(rows: list[tuple], judge: Judge | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row whether it counts as sound, and the open defect it counts as (or -1)."""
    if judge is None or not rows:
        return np.ones(len(rows), bool), np.full(len(rows), -1)
    profile, weights = judge
    z = _scores([features(*r, profile, False) for r in rows], weights)
    own, first = np.array([_own_words(r[0], r[1]) for r in rows]), z.argmax(axis=1)
    # the words of what goes with neither question nor facts are open, so they are learned from the rows
    told = np.where((z.max(axis=1) > 0) & ((first == OPEN[0]) & (own >= OWN) | (first == OPEN[1]) & (own == 0)), first, -1)
    return (told < 0) & (z.max(axis=1) < 0.5), told


def _sound_rows(rows: Iterable[tuple], judge: Judge | None, at_once: int = 1_000) -> Iterator[tuple]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == at_once:
            yield from (r for r, s in zip(some, _judged(some, judge)[0], strict=True) if s)
            some = []
    yield from (r for r, s in zip(some, _judged(some, judge)[0], strict=True) if s)


def _labelled(rows: list[tuple], shard: int, judge: Judge | None, held: bool, without: int | None) -> tuple[list[tuple], np.ndarray]:
    """The made cases of a shard that weights are fitted on, or that are held out, with labels."""
    sound, told = _judged(rows, judge)
    cases = make_cases(rows, 11 + shard, without)
    random.Random(3).shuffle(cases)
    labels, source = np.array([c[3] for c in cases]), np.array([c[4] for c in cases])
    natural = np.array([c[3] == -1 and c[1] is rows[c[4]][1] for c in cases]) & (told[source] >= 0)
    labels[natural] = told[source[natural]]
    use = np.flatnonzero(sound[source] | natural)
    use = np.r_[use, np.repeat(np.flatnonzero(natural & (labels == OPEN[0])), NATURAL)]
    use = use[(source[use] % 5 == 0) == held]
    return [cases[i] for i in use], labels[use]


def _featured(cases: list[tuple], profile: Profile, words_too: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    out = [features(q, a, f, profile, words_too) for q, a, f, _, _ in cases]
    return [(np.asarray(s, np.int32), np.asarray(v, np.float32)) for s, v in out]


def _shard_weights(rows: list[tuple], shard: int, profile: Profile, judge: Judge | None, last: bool, without: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``(sums, cases)`` of a shard: how many training cases hold each slot, and the weights fitted on
    them times that number, in whole steps. The last turn alone has n-grams, since these would learn
    the defective rows as sound ones."""
    cases, labels = _labelled(rows, shard, judge, False, without)
    held = np.zeros(WIDTH, np.int64)
    if not cases:
        return np.zeros((WIDTH, len(DEFECTS)), np.int64), held
    x = _featured(cases, profile, last)
    weights = _fit_weights(x, labels, epochs=6 if last else 3)
    held += np.bincount(np.concatenate([s for s, _ in x]), minlength=WIDTH)
    return np.rint(weights.astype(np.float64) * WEIGHT_STEPS).astype(np.int64) * held[:, None], held


def _shard_scores(rows: list[tuple], shard: int, profile: Profile, judge: Judge | None, weights: np.ndarray, without: int | None) -> Counter:
    """Held-out pairs of a shard by ``(defect, has it, step of the score)``; a pair with a defect counts
    for this one, a sound one for all."""
    cases, labels = _labelled(rows, shard, judge, True, without)
    steps = np.floor(np.clip(_scores(_featured(cases, profile, True), weights), -60, 60) * SCORE_STEPS).astype(np.int64)
    out: Counter = Counter()
    for i in range(len(DEFECTS)):
        out.update((i, True, int(s)) for s in steps[labels == i, i])
        out.update((i, False, int(s)) for s in steps[labels == -1, i])
    return out


def _mean(sums: np.ndarray, held: np.ndarray) -> np.ndarray:
    return (sums / np.maximum(held, 1)[:, None] / WEIGHT_STEPS).astype(np.float32)


def _learn(profile_by: Callable, weights_by: Callable, scores_by: Callable) -> Detector:
    """Fit again and again without the rows that the last fit found defective, since they had been
    counted as sound."""
    judge = None
    for turn in range(TURNS):
        last = turn == TURNS - 1
        profile = profile_by(judge)
        weights = weights_by(profile, judge, last)
        if not last:
            judge = profile, weights
    return Detector(weights, _thresholds(scores_by(profile, judge, weights)), profile)


def fit(rows: list[tuple], without: int | None = None) -> Detector:
    """Fit on ``(question, answer, facts)`` rows of one process, as one shard. ``without`` leaves one form
    of refusals out of training, to measure how well unseen forms are found."""
    return _learn(
        lambda judge: learn_profile(list(_sound_rows(rows, judge))),
        lambda profile, judge, last: _mean(*_shard_weights(rows, 0, profile, judge, last, without)),
        lambda profile, judge, weights: _shard_scores(rows, 0, profile, judge, weights, without),
    )


def _rows_of(batch: pa.RecordBatch, first: int = 0) -> list[tuple]:
    return list(zip(*(batch.column(first + i).to_pylist() for i in range(3)), strict=True))


def _shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[tuple]]]:
    """Shards of batches that come sorted by them; one of more than ``most`` rows comes in pieces."""
    now, rows = None, []
    for batch in batches:
        for shard, row in zip(batch.column(0).to_pylist(), _rows_of(batch, 1), strict=True):
            if rows and (shard != now or len(rows) >= most):
                yield now, rows
                rows = []
            now = shard
            rows.append(row)
    if rows:
        yield now, rows


def train(cases: DataFrame, shard_rows: int = SHARD_ROWS) -> Detector | None:
    """Fit on all answerable cases, in shards of some ``shard_rows`` rows by a hash of the case. What comes
    to the driver are the counts of known words and pairs, one row for each slot and one for each step of
    the scores, whatever the number of cases."""
    rows = cases.where("answerability = 'answerable' and question is not null").select("id", "question", "expected_answer", "expected_facts")
    count = rows.count()
    if not count:
        return None
    context = cases.sparkSession.sparkContext
    shards = -(-count // shard_rows)
    parts = min(shards, 4 * context.defaultParallelism)
    columns, most = ("question", "expected_answer", "expected_facts"), 2 * shard_rows
    plain = spread(rows.select(*columns))
    dealt = rows.select(F.pmod(F.xxhash64("id", *columns), F.lit(shards)).cast("int").alias("shard"), "id", *columns)
    dealt = dealt.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", F.xxhash64("id", *columns), "id", *columns).select("shard", *columns)
    enough = least(count)

    def profile_by(judge: Judge | None) -> Profile:
        shared = context.broadcast(judge)

        def run(batches):
            for counts in tally(_sound_rows((r for b in batches for r in _rows_of(b)), shared.value)):
                keys, numbers = list(counts), list(counts.values())
                for start in range(0, len(keys), 50_000):
                    some, n = keys[start : start + 50_000], numbers[start : start + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in some], pa.int32()), *(pa.array([k[i] for k in some], pa.string()) for i in (1, 2)), *(pa.array([c[i] for c in n], pa.int64()) for i in range(len(LANGUAGES)))], names=["kind", "word", "other", *LANGUAGES])

        counts = plain.mapInArrow(run, "kind int, word string, other string, " + ", ".join(f"{k} bigint" for k in LANGUAGES))
        counts = counts.groupBy("kind", "word", "other").agg(*(F.sum(k).alias(k) for k in LANGUAGES))
        known = counts.where((F.col("kind") <= SPOKEN) | (sum(F.col(k) for k in LANGUAGES) >= F.when(F.col("kind") == BOTH, enough + 1).otherwise(enough)))
        got = known.toArrow().to_pydict()
        shared.unpersist()
        return profile_of(dict(zip(zip(got["kind"], got["word"], got["other"], strict=True), zip(*(got[k] for k in LANGUAGES), strict=True), strict=True)))

    def weights_by(profile: Profile, judge: Judge | None, last: bool) -> np.ndarray:
        shared = context.broadcast((profile, judge))

        def run(batches):
            sums, held = np.zeros((WIDTH, len(DEFECTS)), np.int64), np.zeros(WIDTH, np.int64)
            for shard, some in _shards(batches, most):
                more = _shard_weights(some, shard, *shared.value, last, None)
                sums += more[0]
                held += more[1]
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at]), *(pa.array(sums[at, i]) for i in range(len(DEFECTS)))], names=["slot", "held", *DEFECTS])

        fitted = dealt.mapInArrow(run, "slot int, held bigint, " + ", ".join(f"{d} bigint" for d in DEFECTS))
        got = fitted.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("held", *DEFECTS))).toArrow()
        shared.unpersist()
        sums, held = np.zeros((WIDTH, len(DEFECTS)), np.int64), np.zeros(WIDTH, np.int64)
        slots = got["slot"].to_numpy()
        held[slots] = got["held"].to_numpy()
        for i, d in enumerate(DEFECTS):
            sums[slots, i] = got[d].to_numpy()
        return _mean(sums, held)

    def scores_by(profile: Profile, judge: Judge | None, weights: np.ndarray) -> dict[tuple[int, bool, int], int]:
        shared = context.broadcast((profile, judge, weights))

        def run(batches):
            counts: Counter = Counter()
            for shard, some in _shards(batches, most):
                counts += _shard_scores(some, shard, *shared.value, None)
            yield pa.RecordBatch.from_pylist([{"defect": d, "has": h, "step": s, "n": n} for (d, h, s), n in counts.items()], pa.schema([("defect", pa.int32()), ("has", pa.bool_()), ("step", pa.int32()), ("n", pa.int64())]))

        scored = dealt.mapInArrow(run, "defect int, has boolean, step int, n bigint").groupBy("defect", "has", "step").agg(F.sum("n").alias("n"))
        got = scored.toArrow().to_pylist()
        shared.unpersist()
        return {(r["defect"], r["has"], r["step"]): r["n"] for r in got}

    return _learn(profile_by, weights_by, scores_by)


def found(cases: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``(id, defect)`` of the defective answerable cases, one row for each id.

    Cases that are not answerable are left out (also with a NULL answerability). NULL questions are
    compared with nothing, so their answers can only be empty, truncated or refusals; NULL and empty
    fact lists count as no facts, texts of any length are read whole. Of an id that occurs with
    several defects the first in the order of ``DEFECTS`` is given. An empty table has no cases.
    """
    spark = cases.sparkSession
    detector = detector or train(cases)
    if detector is None:
        return spark.createDataFrame([], "id string, defect string")
    shared = spark.sparkContext.broadcast(detector)

    def run(batches):
        known = shared.value
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, 4)]
            over = known.over(list(zip(*columns, strict=True)))
            keep = np.flatnonzero((over > 0).any(axis=1)) if len(over) else np.empty(0, np.int64)
            places = pa.array(over[keep].argmax(axis=1).astype(np.int32) if len(keep) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), places], names=["id", "place"])

    rows = spread(cases.where("answerability = 'answerable' and id is not null").select("id", "question", "expected_answer", "expected_facts"))
    marked = rows.mapInArrow(run, "id string, place int").groupBy("id").agg(F.min("place").alias("place"))
    return marked.select("id", F.element_at(F.array(*(F.lit(d) for d in DEFECTS)), F.col("place") + 1).alias("defect"))
