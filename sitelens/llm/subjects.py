"""Subject areas of documents by classifier chains.

Terms are weighed by subject on labelled documents: a sentence is given to the
subject its terms speak for most, and the weights are refined on the
sentences so given, of the labelled documents and of a bounded sample of
the others. A document's features are the share of its sentences that each
subject gets (its term features), its source and its structure. A chain of
logistic classifiers, one for each subject, reads these and the labels before
it in the chain, so subjects that occur together are modelled. The chain and its
calibration are fitted on features that come from term weights of other labelled documents,
so nothing is scored by weights that have seen its labels. Beam search finds the likeliest
combination of at most ``MOST`` subjects, for all documents of a batch at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.reading import language
from sitelens.tables import latest

#: Most labelled documents and most unlabelled documents that are fitted on, chosen by a hash of their id.
TRAIN_LABELLED = 6000
TRAIN_OTHERS = 3000
#: Longer texts are classified like all others, but not trained on: it bounds what the driver receives.
TRAIN_CHARS = 20_000
BUCKETS = 1 << 16
BEAM = 6
MOST = 2
#: The labelled documents are cut into this many parts; each is scored by weights, and calibrated by a chain, of the others.
FOLDS = 8
#: Share of a document's sentences from which a subject counts.
LEAST_SHARE = 1 / 6
#: Least lead of a sentence's subject, in nats, over having none.
LEAD = 2.5
#: Most sources with a feature of their own: the most frequent of the labelled documents.
MOST_SOURCES = 16
LANGUAGES = ["", "en", "de", "es", "fr"]
_WORD = re.compile(r"[^\W\d_]{3,}(?:-[^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_MISREAD = re.compile("[Â-Å][\u0080-¿‐-›ŒœŠšŸŽžƒˆ˜€™]")


class _Buckets(dict):
    """The hash bucket of each word met; cleared when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word) % BUCKETS
        return h


_BUCKET = _Buckets()


def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte code page, set right letter by letter."""

    def right(match: re.Match) -> str:
        for page in ("cp1252", "latin-1"):
            try:
                return match.group().encode(page).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
        return match.group()

    return _MISREAD.sub(right, text)


@dataclass
class Flat:
    """The sentences of several texts in one row: the term buckets (each once a sentence), how many each sentence has, how many sentences each text."""

    terms: np.ndarray
    size: np.ndarray
    count: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    @property
    def text(self) -> np.ndarray:
        """The text that each sentence is of."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def of(self, texts: np.ndarray) -> Flat:
        """The sentences of the chosen texts."""
        kept = np.isin(self.text, texts)
        return Flat(self.terms[np.repeat(kept, self.size)], self.size[kept], self.count[texts])


def flat(texts: Sequence[str]) -> Flat:
    terms: list[int] = []
    size, count = [], []
    for text in texts:
        n = 0
        for sentence in _SENTENCE.split(repaired(text).lower()):
            ids = set(map(_BUCKET.__getitem__, _WORD.findall(sentence)))
            if ids:
                terms.extend(ids)
                size.append(len(ids))
                n += 1
        count.append(n)
    return Flat(np.array(terms, np.int64), np.array(size, np.int64), np.array(count, np.int64))


def structure(texts: Sequence[str], counts: np.ndarray, sources: Sequence[str | None], known: Sequence[str]) -> np.ndarray:
    """Source and structure features of each text."""
    lines = np.array([t.count("\n") + 1 for t in texts], float)
    length = np.array([len(t) for t in texts], float)
    headed = np.array([":" in t[:40] for t in texts], float)
    by = np.array([[s == k for k in known] for s in sources], float).reshape(len(texts), len(known))
    return np.hstack([by, np.stack([np.log1p(counts) / 3, np.log1p(length) / 8, np.minimum(lines, 20) / 20, headed], axis=1).reshape(len(texts), 4)])


class TermWeights:
    """Log odds of each term bucket for each subject."""

    def __init__(self, k: int):
        self.w = np.zeros((BUCKETS, k), np.float32)

    def set(self, counts: np.ndarray, mass: np.ndarray, overall: np.ndarray, total: np.ndarray) -> TermWeights:
        """From (subjects, terms) counts, (languages, subjects) sums, and (languages, terms) and languages of all sentences.

        A term's odds of a subject are held against the odds of its languages, so
        that the common words of a language speak for no subject.
        """
        seen = overall.sum(0)
        base = (mass + 0.5) / (np.maximum(total[:, None] - mass, 0) + 6.0)
        prior = (base.T @ overall) / np.maximum(seen, 1)
        rest = np.maximum(seen - counts, 0)
        w = (np.log((counts + 0.3) / (rest + 0.3)) - np.log(np.maximum(prior, 1e-6))).astype(np.float32)
        w[:, seen < 3] = 0
        np.clip(w, -1.0, 5.0, out=w)
        w[np.abs(w) < 0.9] = 0
        self.w = np.ascontiguousarray(w.T)
        return self

    def given(self, texts: Flat, among: np.ndarray | None = None) -> np.ndarray:
        """Each sentence's best subject, -1 where none leads; of those marked for its text in ``among`` (texts, subjects) if given."""
        if not len(texts.size):
            return np.zeros(0, np.int64)
        score = np.add.reduceat(self.w[texts.terms], texts.starts, axis=0)
        if among is not None:
            score = np.where(among[texts.text] > 0, score, -np.inf)
        return np.where(score.max(axis=1) >= LEAD, score.argmax(axis=1), -1)

    def shares(self, texts: Flat) -> np.ndarray:
        """(texts, subjects): the share of sentences each subject gets."""
        k, best = self.w.shape[1], self.given(texts)
        got = np.bincount(texts.text[best >= 0] * k + best[best >= 0], minlength=len(texts.count) * k).reshape(-1, k)
        return got / np.maximum(1, texts.count)[:, None]


def fit_terms(docs: Flat, langs: np.ndarray, labels: np.ndarray, others: Flat, other_langs: np.ndarray, rounds: int = 4) -> TermWeights:
    """First by the documents' labels, then by the sentences given: of these documents to one of their labels, of the others to any subject."""
    k, n = labels.shape[1], len(docs.count)

    def weighed(texts: Flat, lang: np.ndarray, part: np.ndarray) -> tuple:
        """Counts where each sentence has ``part`` (sentences, subjects) of itself in each subject."""
        at = np.repeat(np.arange(len(texts.size)), texts.size)
        spoken = lang[texts.text]
        counts = np.stack([np.bincount(texts.terms, weights=part[at, s], minlength=BUCKETS) for s in range(k)])
        overall = np.bincount(spoken[at] * BUCKETS + texts.terms, minlength=len(LANGUAGES) * BUCKETS).reshape(len(LANGUAGES), BUCKETS).astype(float)
        mass = np.stack([np.bincount(spoken, weights=part[:, s], minlength=len(LANGUAGES)) for s in range(k)], axis=1)
        return counts, mass, overall, np.bincount(spoken, minlength=len(LANGUAGES)).astype(float)

    weights = TermWeights(k)
    if not n:
        return weights
    weights.set(*weighed(docs, langs, (labels / np.maximum(1, labels.sum(1, keepdims=True)))[docs.text]))
    both = Flat(np.concatenate([docs.terms, others.terms]), np.concatenate([docs.size, others.size]), np.concatenate([docs.count, others.count]))
    lang = np.concatenate([langs, other_langs])
    for _ in range(rounds):
        best = np.concatenate([weights.given(docs, labels), weights.given(others)])
        part = (best[:, None] == np.arange(k)).astype(np.float32)
        weights = TermWeights(k).set(*weighed(both, lang, part))
    return weights


def _logistic(x: np.ndarray, y: np.ndarray, center: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Logistic regression by damped Newton steps, held near ``center`` where labels are few; the last weight is the constant."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * (w - center)
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-5:
            break
    return w


def _expected(n: int) -> np.ndarray:
    """The chain's weights before any label is seen: a subject counts from ``LEAST_SHARE`` of the sentences, whatever else holds."""
    center = np.zeros(n + 1)
    center[0], center[-1] = 2.0, -5.0
    return center


#: What the source and structure features, and the labels before in the chain, are multiplied with: their ridge is that much weaker.
STRUCTURE_SCALE, CHAIN_SCALE = 0.1, 0.3


class SubjectModel:
    """Term weights, the chain, and a calibration for each of its links. ``chained=False`` leaves the labels before out, to see what they add."""

    def __init__(self, subjects: Sequence[str], texts: Sequence[str], sources: Sequence[str | None], labels: np.ndarray, others: Sequence[str] = (), seed: int = 9, chained: bool = True):
        self.subjects, self.chained = list(subjects), chained
        k, n = len(self.subjects), len(texts)
        rng = np.random.default_rng(seed)
        docs, rest = flat(texts), flat(others)
        langs, rest_langs = (np.array([LANGUAGES.index(language(t)) for t in part], np.int64) for part in (texts, others))
        fold = rng.permutation(n) % FOLDS
        labels = labels.astype(float).reshape(n, k)
        self.sources = [s for s, _ in Counter(s for s in sources if s).most_common(MOST_SOURCES)]
        self.terms = fit_terms(docs, langs, labels, rest, rest_langs)
        shares = np.zeros((n, k))
        for f in np.unique(fold):
            seen, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            shares[held] = fit_terms(docs.of(seen), langs[seen], labels[seen], rest, rest_langs).shares(docs.of(held))
        shape = structure(texts, docs.count, sources, self.sources)
        self.order = np.argsort(-labels.sum(0), kind="stable")
        self.chain, self.calibration = [], []
        for at, s in enumerate(self.order):
            if not n:
                self.chain.append(None)
                self.calibration.append((1.0, 0.0))
                continue
            x = np.hstack([self._features(shares, shape, s), labels[:, self.order[:at]] * CHAIN_SCALE * chained])
            score = np.zeros(n)
            for f in np.unique(fold):
                w = _logistic(x[fold != f], labels[fold != f, s], _expected(x.shape[1]))
                score[fold == f] = np.hstack([x[fold == f], np.ones(((fold == f).sum(), 1))]) @ w
            self.chain.append(_logistic(x, labels[:, s], _expected(x.shape[1])))
            slope, shift = _logistic(score[:, None], labels[:, s], np.array([1.0, 0.0]), ridge=3.0)
            self.calibration.append((max(0.2, slope), shift))

    @staticmethod
    def _features(shares: np.ndarray, shape: np.ndarray, s: int) -> np.ndarray:
        own = shares[:, [s]]
        other = np.delete(shares, s, axis=1).max(axis=1, keepdims=True) if shares.shape[1] > 1 else np.zeros_like(own)
        step = 1 / (1 + np.exp(-(own - LEAST_SHARE) * 50))
        return np.hstack([step * 5, np.minimum(own, 0.3) * 10, other, shares.sum(axis=1, keepdims=True), shape * STRUCTURE_SCALE])

    def decode_all(self, texts: Sequence[str], sources: Sequence[str | None]) -> tuple[list[list[str]], np.ndarray]:
        """For each text the subjects of the likeliest combination, and (texts, subjects) the shares of sentences.

        All beams of all texts are grown together, one link of the chain after the other.
        """
        docs = flat(texts)
        shares = self.terms.shares(docs)
        n, k = shares.shape
        if not n or not k or self.chain[0] is None:
            return [[] for _ in texts], shares
        shape = structure(texts, docs.count, sources, self.sources)
        log = np.full((n, BEAM), -np.inf)
        log[:, 0] = 0.0
        taken = np.zeros((n, BEAM, k), bool)
        for at, s in enumerate(self.order):
            w, (slope, shift) = self.chain[at], self.calibration[at]
            x = self._features(shares, shape, s)
            width = x.shape[1]
            z = x @ w[:width] + w[-1]
            z = z[:, None] + taken[:, :, self.order[:at]] @ (w[width:-1] * CHAIN_SCALE * self.chained)
            z = slope * z + shift
            without, with_ = log - np.logaddexp(0, z), log - np.logaddexp(0, -z)
            with_[(taken.sum(axis=2) >= MOST) | (shares[:, s] <= 0)[:, None]] = -np.inf
            both = np.concatenate([without, with_], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
            log = np.take_along_axis(both, best, axis=1)
            taken = np.take_along_axis(taken, (best % BEAM)[:, :, None], axis=1)
            taken[:, :, s] = best >= BEAM
        first = taken[:, 0]
        return [[self.subjects[s] for s in np.flatnonzero(row)] for row in first], shares

    def decode(self, text: str, source: str | None) -> tuple[list[str], np.ndarray]:
        found, shares = self.decode_all([text], [source])
        return found[0], shares[0]


_OUT = pa.schema([("doc_id", pa.int64()), ("subjects", pa.list_(pa.string())), ("shares", pa.list_(pa.float32()))])


def fit(docs: DataFrame, doc_labels: DataFrame, subjects: DataFrame, labelled: int = TRAIN_LABELLED, others: int = TRAIN_OTHERS) -> SubjectModel:
    """A model from at most ``labelled`` labelled documents and ``others`` more; labels of unknown subjects are ignored.

    ``docs`` may hold rows delivered again: the labelled ones are told apart
    after the join with the chosen labels, so that only they are shuffled.
    """
    names = sorted(r.subject for r in subjects.select("subject").where("subject is not null").distinct().collect())
    marked = doc_labels.where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("marked"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    fits = f"length(text) between 1 and {TRAIN_CHARS}"
    rows = latest(docs.join(F.broadcast(chosen), "doc_id"), "doc_id").where(fits).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "source", "marked").collect()
    # only ids are ranked: what the driver receives does not grow with the number of partitions
    ids = docs.where(f"doc_id is not null and {fits}").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(others).distinct()
    more = latest(docs.join(F.broadcast(ids), "doc_id", "left_semi"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("text").collect()
    y = np.array([[float(n in r.marked) for n in names] for r in rows]).reshape(len(rows), len(names))
    return SubjectModel(names, [r.text for r in rows], [r.source for r in rows], y, [r.text for r in more if r.text])


def classify(docs: DataFrame, model: SubjectModel) -> DataFrame:
    """Rows (doc_id, subjects, shares) for every document; a null or empty text has no subjects. Other columns are ignored."""
    state = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found, shares = state.value.decode_all([t or "" for t in part.column(1).to_pylist()], part.column(2).to_pylist())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * shares.shape[1]), pa.array(shares.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found, pa.list_(pa.string())), rows], schema=_OUT)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source").mapInArrow(run, "doc_id bigint, subjects array<string>, shares array<float>")
