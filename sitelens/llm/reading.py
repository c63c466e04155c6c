"""Reading level by language-model surprisal and isotonic regression.

An interpolated n-gram model is trained on easy prose: fixed sentences and the
plainest quarter of the corpus, or of texts at hand. Every English text is
scored to its end; the whole distribution of its sentences' surprisal in bits a
word is what speaks for its difficulty: its mean, median and upper quantile,
all weighted by words, in one score whose weights fit these texts best. Isotonic regression, fitted on them,
maps the text's score monotonically to a school grade.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np

from sitelens.llm.ngrams import CharModels, line_codes

#: Grades below which a text is basic and standard: whole years of school up to five and up to eleven, once rounded.
BASIC, STANDARD = 5.5, 11.5
#: Easy sentences.
EASY = [
    "The cat sat on the mat.", "I see a red ball.", "The dog is big and the cat is small.", "She has two pens and one book.", "We go to the park on warm days.", "He can run fast.", "Put the cup on the shelf and wash it.", "There is a bird in the tree.", "Why is the sky so blue?", "My coat is old and soft.",
    "The boy and the girl play with a kite.", "It is cold in the yard.", "Mom said the milk was too hot.", "Do not sit on the wet bench.", "You can find the key in the box.", "We eat bread and jam at noon.", "The man has a long rope.", "This book costs five and that pen costs two.", "If you hold the door, I will bring the bag.", "First fold the paper, then cut it.",
    "The sun is up and the day is long.", "It took ten days to fix the boat.", "Ask Tom to clean the shoe for you.", "At night the street is dark.", "I like the green hat.", "No one will sell a pan as good as this.", "The lake is deep and the hill is steep.", "Her room is clean.", "They feed the goat by hand.", "He saw a ship near the shore.",
]
#: Frequent words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is a it that for with as on be at by this was or are we you your our no so if my she he will said which from have has not but they an can do".split(),
    "de": "der die das und ist es zu den dem mit nicht wer auf ein eine einen im von für auch nur wird sich nach als aus bei man oder wie seit ohne".split(),
    "es": "el los las que y por se en es un una para con del al como más pero su sus no hay muchos sobre la lo desde sin".split(),
    "fr": "le les des et dans un une du sur pour est que qui au aux avec ce cette sont plus pas peu ne se la on il par depuis sans".split(),
}
#: What the mean, the median and the upper quartile of a text's surprisal may count in its score; the sample decides. The mean has half or more, so the score rises with every sentence.
WEIGHTS = tuple((a / 10, b / 10, (10 - a - b) / 10) for a in range(5, 9) for b in range(1, 10 - a))
#: Words a sentence, in the grade of the sample.
USUAL_LENGTH = 15.6
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…;])\s+|\n")
#: Capitalised words; those that are met in fewer texts of the sample than ``NAMED`` are names.
_CAPITAL = re.compile(r"\b[A-ZÄÖÜÉ][^\W\d_]+(?: [A-ZÄÖÜÉ][^\W\d_]+)*")
NAMED = 5
#: Of more texts than this a word must be met in the same share, and all together count as so many against the fixed sentences.
USUAL_TEXTS = 800
_VOWELS = re.compile(r"[aeiouy]{1,2}")


def language(text: str) -> str:
    """The language with most function words, '' if there are none."""
    words = _WORD.findall(text.lower())
    best, most = "", 0.0
    for name, known in _KNOWN.items():
        share = sum(map(known.__contains__, words))
        if share > most:
            best, most = name, share
    return best


_KNOWN = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
#: Words that are no names, whatever the texts.
FIXED_WORDS = frozenset(w for t in EASY for w in _WORD.findall(t.lower())) | _KNOWN["en"]


def vocabulary(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def least_met(texts: int) -> float:
    """Of so many texts the least that must hold a word for it to be no name."""
    return NAMED * max(1.0, texts / USUAL_TEXTS)


def syllables(word: str) -> int:
    """Vowel groups of at most two letters, less a silent final e; at least one."""
    if len(word) <= 3:
        return 1
    n = len(_VOWELS.findall(word))
    return max(1, n - (word.endswith("e") and not word.endswith("le") and n > 1))


def weak_grade(text: str) -> float:
    """A grade for the sample: that of Flesch and Kincaid at a usual sentence length, so that cut or joined sentences count alike."""
    words = _WORD.findall(text.lower())
    return 0.39 * USUAL_LENGTH + 11.8 * sum(map(syllables, words)) / max(1, len(words)) - 15.59


def isotonic(x: Sequence[float], y: Sequence[float], n: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing least-squares fit by pooling adjacent violators, as points for interpolation; ``n`` has the weights, else one each."""
    order = np.argsort(x, kind="stable")
    xs, level, weight, first = np.asarray(x, float)[order], [], [], []
    weights = np.ones(len(xs)) if n is None else np.asarray(n, float)[order]
    for i, value in enumerate(np.asarray(y, float)[order]):
        level.append(value)
        weight.append(weights[i])
        first.append(i)
        while len(level) > 1 and level[-2] >= level[-1]:
            total = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / total]
            weight[-2:] = [total]
            first.pop()
    ends = [*first[1:], len(xs)]
    points = [(xs[a], v) for a, b, v in zip(first, ends, level)] + [(xs[b - 1], v) for a, b, v in zip(first, ends, level)]
    points.sort()
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def _sentences(text: str, known: frozenset[str]) -> tuple[list[str], list[int]]:
    """The sentences that hold words, and their numbers of words.

    A name says nothing about the reading level: capitalised words that are not ``known`` count as the same short one.
    """

    def named(match: re.Match) -> str:
        words = match.group().split(" ")
        return match.group() if words[0].lower() in known and len(words) == 1 else " ".join([words[0], "Tom"] if words[0].lower() in known else ["Tom"])

    parts, counts = [], []
    for s in _SENTENCE.split(_CAPITAL.sub(named, text)):
        if n := len(_WORD.findall(s)):
            parts.append(s)
            counts.append(n)
    return parts, counts


def sentences(text: str, known: frozenset[str]) -> list[str]:
    return _sentences(text, known)[0]


class ReadingModel:
    def __init__(self, texts: Sequence[str]):
        """Fitted on English texts of at least a few words; with few of them the fixed sentences carry more weight."""
        texts = [t for t in texts if language(t) == "en"]
        grades = [weak_grade(t) for t in texts]
        easy = sorted(range(len(texts)), key=grades.__getitem__)[: max(1, len(texts) // 4)] if texts else []
        met = Counter(w for t in texts for w in vocabulary(t))
        self.known = frozenset(w for w, n in met.items() if n >= NAMED) | FIXED_WORDS
        self.model = CharModels([[*EASY * 3, *(s for k in easy for s in _sentences(texts[k], self.known)[0])]])
        held = sorted(set(range(len(texts))) - set(easy[::2]))
        found = np.array(self.surprisals([*(texts[k] for k in held), " ".join(EASY)]))
        y = np.array([*(grades[k] for k in held), 1.0])
        best = np.inf
        for weights in WEIGHTS:
            x = found @ weights
            fit = isotonic(x, y)
            error = np.square(np.log1p(np.maximum(np.interp(x, *fit), 0)) - np.log1p(np.maximum(y, 0))).sum()
            if error < best - 1e-9:
                best, self.weights, (self.x, self.y) = error, np.array(weights), fit

    @classmethod
    def counted(cls, known: frozenset[str], easy: np.ndarray) -> ReadingModel:
        """A model of these known words and counts of easy sentences; :meth:`settle` fits its grades."""
        self = cls.__new__(cls)
        self.known, self.model = known, CharModels([EASY * 3])
        self.model.add(0, easy)
        return self

    def settle(self, sums: Sequence[tuple[int, float, int, float, float, float]]) -> None:
        """Weights and grades that fit texts best, from (k, x, n, y, l, ll): for the k-th of ``WEIGHTS`` and each score x the number of texts, and the sums of their grades, of the logarithms of these plus one and of their squares."""
        fixed = np.array(self.surprisal(" ".join(EASY)))
        best = np.inf
        for k, weights in enumerate(WEIGHTS):
            own = sorted(r[1:] for r in sums if r[0] == k)
            x, n, y, log, square = np.array([*own, (float(fixed @ weights), 1, 1.0, np.log(2), np.log(2) ** 2)], float).T
            fit = isotonic(x, y / n, n)
            at = np.log1p(np.maximum(np.interp(x, *fit), 0))
            error = (n * at * at - 2 * at * log + square).sum()
            if error < best - 1e-9:
                best, self.weights, (self.x, self.y) = error, np.array(weights), fit

    def surprisals(self, texts: Sequence[str]) -> list[tuple[float, float, float]]:
        """For each text the mean (of square roots, so that a menu glued to a sentence does not decide), the median and the upper quartile of the bits a word of all of its sentences, which count by their words.

        The sentences of all texts are scored in one array. A text without words has 0 everywhere.
        """
        cut = [_sentences(t, self.known) for t in texts]
        lines = [s for parts, _ in cut for s in parts]
        if not lines:
            return [(0.0, 0.0, 0.0)] * len(texts)
        code, starts, ends = line_codes(lines)
        sums = np.concatenate([[0.0], np.cumsum(self.model.log_probabilities(code)[:, 0], dtype=np.float64)])
        bits = (sums[starts] - sums[ends]) / np.log(2)
        out, at = [], 0
        for parts, counts in cut:
            if not parts:
                out.append((0.0, 0.0, 0.0))
                continue
            words = np.array(counts, float)
            own = bits[at : at + len(parts)]
            at += len(parts)
            each = own / words
            order = np.argsort(each, kind="stable")
            total = words.sum()
            middle = (np.cumsum(words[order]) - words[order] / 2) / total
            median, upper = np.interp([0.5, 0.75], middle, each[order])
            out.append((float(((np.sqrt(each) * words).sum() / total) ** 2), float(median), float(upper)))
        return out

    def surprisal(self, text: str) -> tuple[float, float, float]:
        return self.surprisals([text])[0]

    def scores(self, texts: Sequence[str]) -> list[float]:
        """One number for the whole distribution of each text; it rises with the surprisal of every sentence."""
        return (np.array(self.surprisals(texts)).reshape(-1, 3) @ self.weights).tolist()

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def grades(self, texts: Sequence[str]) -> list[float]:
        return np.interp(self.scores(texts), self.x, self.y).tolist() if len(texts) else []

    def grade(self, text: str) -> float:
        return self.grades([text])[0]


def band(grade: float) -> str:
    return "basic" if grade < BASIC else "standard" if grade < STANDARD else "advanced"
