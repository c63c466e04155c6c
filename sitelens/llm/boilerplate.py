"""Own content of pages by a recurrent block labeller.

A page is the sequence of its lines (a page of one line: of its sentences).
Each block is read as a tag path and a bag of hashed words. The text has
lost its mark-up, so the tag path is rebuilt from the block's form: separators,
glued words, final marks, case, length, place in the page, share of title
words. A bidirectional LSTM reads all blocks of a page and labels each as site
furniture or own content, so that a bare line is judged by what stands
around it, as far as the whole page.

The labeller is trained on at most ``TRAIN_PAGES`` pages of the corpus, without
knowing what any site's furniture says: a line is furniture if many pages of its
host repeat it, counted over all pages, or by its form (a trail of links, the list after "see also").
The network learns from these lines what furniture looks like where nothing is repeated.
Lines of other hosts are moved into training pages, so that it does not depend on one host's ways.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import xxhash

from sitelens.llm.phrases import NOTICES

#: Most pages the labeller is trained on, chosen by a hash of their id.
TRAIN_PAGES = 1200
#: Batches of pages it is trained for, however many pages there are.
STEPS = 260
BATCH = 48
BUCKETS = 4096
EMBED = 20
HIDDEN = 24

#: Words that open a list of teasers, in English, German, Spanish and French.
TEASERS = r"^(?:read next|read also|related(?: \w+)?|recommended|see also|more like this|you may also|you might also|weiterlesen|lesen sie auch|ähnliche \w+|siehe auch|das könnte|mehr zum thema|siga leyendo|relacionado|ver también|también te|también puede|à lire aussi|à lire également|sur le même|voir aussi|lire la suite)\b(?: \w+)? ?:?"
#: Words that speak for furniture in a line that is no prose.
KEYWORDS = r"©|\bcookies?\b|\bnewsletter\b|rights reserved|rechte vorbehalten|derechos reservados|droits réservés|privacy policy|\bsubscribe\b|\bsitemap\b|^skip to|back to top|^share (?:this|on)\b|^follow us"

_TEASER = re.compile(TEASERS)
_KEYWORD = re.compile(KEYWORDS)
_SEPARATED = re.compile(r" [|>·/»›] |[|·»›]")
_WORD = re.compile(r"[^\W\d_]+|\d+")
#: Where two words are glued together.
_GLUED = re.compile(r"(?<=[a-zäöüéàáíñó])(?=[A-ZÄÖÜÁÉ])")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")


def blocks(text: str) -> tuple[list[str], bool]:
    """The page's lines and True; of a page of one line its sentences and False."""
    lines = text.split("\n")
    return (lines, True) if len(lines) > 1 else (_SENTENCE_END.split(text), False)


def _clean(line: str) -> str:
    return " ".join(line.split())


#: Features of a line by itself, and of its place in a page.
OWN, PLACED = 25, 6
SHAPES = OWN + PLACED


@dataclass(slots=True)
class Line:
    """What is known of a line whatever page it stands in."""

    ids: np.ndarray
    own: np.ndarray
    words: list
    count: int


class _Buckets(dict):
    """The hash bucket of each word met, all numbers in one; cleared when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest("0" if word.isdigit() else word) % BUCKETS
        return h


_BUCKETS = _Buckets()
_LINES: dict[str, Line] = {}
_FIRST = itemgetter(0)


def analysed(line: str) -> Line:
    """The rebuilt tag path and the word buckets of a cleaned line; numbers count as one word, glued words as several."""
    if (known := _LINES.get(line)) is not None:
        return known
    open_, glued = _GLUED.subn(" ", line)
    words = _WORD.findall(open_)
    count = len(words)
    low = " ".join(words).lower().split(" ") if words else []
    digits = sum(map(str.isdigit, words))
    caps = sum(map(str.isupper, map(_FIRST, words)))
    seps = len(_SEPARATED.findall(line))
    last = line[-1:]
    letters = sum(map(len, words))
    own = np.array((
        min(count, 80) / 20, float(count == 0), float(count == 1), float(count == 2), float(count == 3), float(4 <= count <= 8), float(count > 25), caps / count if count else 0.0,
        float(last in ".!?" and last != ""), float(last == ":"), float(last == ","), min(seps, 6) / 3, float(" > " in line or " » " in line), float(" | " in line), float(" · " in line), float(" / " in line),
        min(glued, 6) / 3, float(":" in line), float(digits > 0), float(count > 0 and words[-1].isdigit()), float("," in line), min(line.count(". ") + line.count("! ") + line.count("? "), 6) / 3,
        letters / count / 10 if count else 0.0, float(count > 0 and words[-1][0].isupper()), float("©" in line),
    ), np.float32)
    ids = np.fromiter(map(_BUCKETS.__getitem__, low), np.int64, count)
    if len(_LINES) > 10_000:
        _LINES.clear()
    out = Line(ids, own, low, count)
    if len(line) < 2000:
        _LINES[line] = out
    return out


@dataclass
class Page:
    ids: list[np.ndarray]
    shapes: np.ndarray


def encode(lines: Sequence[str], title: str | None) -> Page:
    title_words = {w.lower() for w in _WORD.findall(title or "")}
    known = [analysed(_clean(x)) for x in lines]
    n = len(known)
    shapes = np.empty((n, SHAPES), np.float32)
    if n:
        shapes[:, :OWN] = np.stack([x.own for x in known])
        at = np.arange(n, dtype=np.float32)
        shapes[:, OWN] = [sum(map(title_words.__contains__, x.words)) / x.count if x.count and title_words else 0.0 for x in known]
        shapes[:, OWN + 1], shapes[:, OWN + 2], shapes[:, OWN + 3] = at / max(1, n - 1), at == 0, at == n - 1
        shapes[:, OWN + 4], shapes[:, OWN + 5] = 1 / (1 + at), 1 / (n - at)
    return Page([x.ids for x in known], shapes)


def _is_prose(line: str, words: int) -> bool:
    return words > 8 and line[-1:] in ".!?"


def weak_labels(lines: Sequence[str], repeated: set[str]) -> np.ndarray:
    """1 for furniture, 0 for content, from repetition on the host and from form.

    By form a line is furniture if it is a trail or row of links (two separators or three
    glued words), if it opens a list of teasers or stands in one, if it is no prose and holds one
    of a few words of cookie and copyright lines, or if it is one capitalised word next to a short line of furniture.
    """
    cleaned = [_clean(x) for x in lines]
    out = np.zeros(len(cleaned), np.float32)
    teasing = False
    for i, line in enumerate(cleaned):
        low = line.lower()
        words = _WORD.findall(line)
        prose = _is_prose(line, len(words))
        if _TEASER.match(low) and not prose:
            out[i], teasing = 1, True
            continue
        title_like = 2 <= len(words) <= 5 and line[-1:] not in ".!?:" and "," not in line and words[-1][0].isupper() and not any(w.isdigit() for w in words)
        if teasing and title_like:
            out[i] = 1
            continue
        teasing = False
        trail = len(_SEPARATED.findall(line)) >= 2 or len(_GLUED.findall(line)) >= 3 and len(words) <= 12
        out[i] = float(line in repeated or not prose and (trail or bool(_KEYWORD.search(low))))
    for i, line in enumerate(cleaned):  # a bare name next to menu entries
        if not out[i] and len(_WORD.findall(line)) == 1 and line[:1].isupper() and line[-1:].isalpha():
            around = [j for j in (i - 1, i - 2, i + 1) if 0 <= j < len(cleaned)]
            if any(out[j] and len(_WORD.findall(cleaned[j])) <= 2 for j in around):
                out[i] = 1
    return out


#: A line is repeated if it is on this share of its host's pages and on this many of them; prose needs the larger share, as copied pages repeat it too.
REPEATED_SHARE, PROSE_SHARE, REPEATED_LEAST = 0.1, 0.2, 4
#: On a host of fewer pages a line that is not repeated may be furniture all the same: it counts this much in training.
FEW_PAGES, UNSURE = 12, 0.2


def line_hashes(text: str) -> dict[int, str]:
    """The page's different lines by a 64-bit hash."""
    return {xxhash.xxh64_intdigest(x) - (1 << 63): x for x in {_clean(x) for x in text.split("\n")}}


def is_repeated(line: str, n: int, pages: int) -> bool:
    """Whether a line on ``n`` of its host's ``pages`` pages counts as repeated."""
    share = PROSE_SHARE if _is_prose(line, len(_WORD.findall(line))) else REPEATED_SHARE
    return n >= max(REPEATED_LEAST, share * pages) and bool(line)


def repeated_lines(pages: Sequence[tuple[str, str]]) -> dict[str, set[str]]:
    """For each host its repeated lines, counted in the given (host, text)."""
    seen: dict[str, Counter] = defaultdict(Counter)
    count: Counter = Counter()
    for host, text in pages:
        count[host] += 1
        seen[host].update({_clean(x) for x in text.split("\n")})
    return {h: {x for x, n in lines.items() if is_repeated(x, n, count[h])} for h, lines in seen.items()}


def _name(rng: np.random.Generator) -> str:
    return ("".join(rng.choice(["b", "kl", "st", "r", "m", "gr", "v", "d"]) + rng.choice(["a", "e", "o", "ai", "ou"]) for _ in range(2)) + rng.choice(["n", "sk", "lt", "x", "d"])).capitalize()


def entries(line: str) -> list[str]:
    """The entries of a row of links."""
    parts = [p.strip() for p in _SEPARATED.split(line)]
    return [p for p in (parts if len(parts) > 2 else _GLUED.sub("\n", line).split("\n")) if p]


def augment(lines: list[str], labels: np.ndarray, sure: np.ndarray, rng: np.random.Generator, pool: Sequence[str], menus: Sequence[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The page with furniture of other pages (``pool``, ``menus``) put in at random, so that any site's forms are met in any place."""
    lines, labels, sure = list(lines), list(labels), list(sure)

    def put(at: int, new: Sequence[str], label: float) -> None:
        lines[at:at] = new
        labels[at:at] = [label] * len(new)
        sure[at:at] = [1.0] * len(new)

    if pool:
        for _ in range(rng.integers(1, 4)):
            put(int(rng.integers(0, len(lines) + 1)), [str(pool[rng.integers(len(pool))])], 1)
    if rng.random() < 0.3:  # a page whose own content is a notice
        own = [i for i, y in enumerate(labels) if not y]
        for i in reversed(own if rng.integers(2) else []):
            del lines[i], labels[i], sure[i]
        put(int(rng.integers(0, len(lines) + 1)), [" ".join(str(n) for n in rng.choice(NOTICES, rng.integers(1, 4)))], 0)
    if rng.random() < 0.3:  # a short heading of the page's own words
        longest = max((x for x, y in zip(lines, labels) if not y), key=len, default="")
        if len(own := _WORD.findall(longest)) > 4:
            first = next((i for i, y in enumerate(labels) if not y), 0)
            put(first, [" ".join(str(w) for w in rng.choice(own, 2))], 0)
    if menus and rng.random() < 0.6:
        chosen = list(menus[rng.integers(len(menus))])
        rng.shuffle(chosen)
        chosen = chosen[: rng.integers(3, 9)] + [_name(rng) for _ in range(rng.integers(0, 3))]
        put(int(rng.integers(0, 3)), chosen if rng.integers(2) else [str(rng.choice([" | ", " > ", " · ", " / ", " ", ""])).join(chosen)], 1)
    return lines, np.array(labels, np.float32), np.array(sure, np.float32)


class Labeller:
    """A numpy bidirectional LSTM over the blocks of a page."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = EMBED + SHAPES
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"embed": (rng.standard_normal((BUCKETS, EMBED)) * 0.1).astype(np.float32), "out": draw(2 * HIDDEN + size, 1), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": draw(size, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _batch(self, pages: Sequence[Page]):
        longest = max(len(p.ids) for p in pages)
        x = np.zeros((longest, len(pages), EMBED + SHAPES), np.float32)
        size = np.array([len(p.ids) for p in pages])
        t = np.concatenate([np.arange(n) for n in size]) if len(size) else np.zeros(0, np.int64)
        b = np.repeat(np.arange(len(pages)), size)
        mask = np.zeros((longest, len(pages)), np.float32)
        mask[t, b] = 1
        x[t, b, EMBED:] = np.concatenate([p.shapes for p in pages])
        each = [ids for p in pages for ids in p.ids]
        n = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.concatenate(each).astype(np.int64) if n.sum() else np.zeros(0, np.int64)
        at = np.stack([t[n > 0], b[n > 0], n[n > 0]], axis=1)
        if len(at):
            starts = np.concatenate([[0], np.cumsum(at[:-1, 2])])
            x[at[:, 0], at[:, 1], :EMBED] = np.add.reduceat(self.w["embed"][ids], starts, axis=0) / np.sqrt(at[:, 2:3])
        return x, mask, at, ids

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        gates_x = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        saved = []
        for t in steps:
            a = gates_x[t] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                saved.append((t, h, c, i, f, o, g, tc, m))
            c = m * c_new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out, saved

    def forward(self, pages: Sequence[Page], keep: bool = False):
        x, mask, at, ids = self._batch(pages)
        of, sf = self._run("f", x, mask, keep)
        ob, sb = self._run("b", x, mask, keep)
        z = np.concatenate([of, ob, x], axis=2)
        p = 1 / (1 + np.exp(-(z @ self.w["out"] + self.w["out_b"])[:, :, 0]))
        return (p, x, mask, at, ids, z, sf, sb) if keep else p

    def _back(self, d: str, x, saved, dout, grads):
        dh = np.zeros((x.shape[1], HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        dx = np.zeros_like(x)
        for t, h, c, i, f, o, g, tc, m in reversed(saved):
            total = dh + dout[t]
            into = total * m
            dc_new = (dc + 0) * m + into * o * (1 - tc * tc)
            da = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), into * tc * o * (1 - o), dc_new * i * (1 - g * g)], axis=1)
            grads[f"x{d}"] += x[t].T @ da
            grads[f"h{d}"] += h.T @ da
            grads[f"b{d}"] += da.sum(0)
            dx[t] = da @ self.w[f"x{d}"].T
            dh = da @ self.w[f"h{d}"].T + total * (1 - m)
            dc = dc_new * f + dc * (1 - m)
        return dx

    def fit(self, pages: Sequence[Page], labels: Sequence[np.ndarray], sure: Sequence[np.ndarray] | None = None, steps: int = STEPS, rate: float = 0.015, batch: int = BATCH, seed: int = 11) -> Labeller:
        """Adam on the cross-entropy of all blocks, weighted by ``sure``, for ``steps`` batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = sorted(range(len(pages)), key=lambda k: len(pages[k].ids))
        chunks = [order[k : k + batch] for k in range(0, len(order), batch)]
        turns = np.concatenate([rng.permutation(len(chunks)) for _ in range(-(-steps // max(1, len(chunks))))])[:steps] if chunks else []
        for step, k in enumerate(turns, 1):
            chosen = [pages[j] for j in chunks[k]]
            p, x, mask, at, ids, z, sf, sb = self.forward(chosen, keep=True)
            y, weight = np.zeros_like(p), mask.copy()
            for b, j in enumerate(chunks[k]):
                y[: len(labels[j]), b] = labels[j]
                if sure is not None:
                    weight[: len(labels[j]), b] = sure[j]
            grads = {n: np.zeros_like(v) for n, v in self.w.items()}
            dz = ((p - y) * weight / max(1, weight.sum()))[:, :, None]
            grads["out"] += np.einsum("tbi,tbo->io", z, dz)
            grads["out_b"] += dz.sum((0, 1))
            dall = dz @ self.w["out"].T
            dx = dall[:, :, 2 * HIDDEN :] + self._back("f", x, sf, dall[:, :, :HIDDEN], grads) + self._back("b", x, sb, dall[:, :, HIDDEN : 2 * HIDDEN], grads)
            if len(at):
                each = np.repeat(dx[at[:, 0], at[:, 1], :EMBED] / np.sqrt(at[:, 2:3]), at[:, 2], axis=0)
                by = np.argsort(ids, kind="stable")
                seen, first_at = np.unique(ids[by], return_index=True)
                grads["embed"][seen] = np.add.reduceat(each[by], first_at, axis=0)
            lr = rate * (1 - 0.9 * step / steps)
            for n, grad in grads.items():
                first[n] += 0.1 * (grad - first[n])
                second[n] += 0.001 * (grad * grad - second[n])
                self.w[n] -= lr * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, pages: Sequence[Page], batch: int = 256) -> list[np.ndarray]:
        """The probability of furniture for each block of each page; a page without blocks gets an empty array."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k].ids), key=lambda k: len(pages[k].ids))
        for start in range(0, len(order), batch):
            chunk = order[start : start + batch]
            p = self.forward([pages[k] for k in chunk])
            for b, k in enumerate(chunk):
                out[k] = p[: len(pages[k].ids), b]
        return out


def train(sample: Sequence[tuple], seed: int = 5, repeated: dict[str, set[str]] | None = None, counted: dict[str, int] | None = None) -> Labeller:
    """A labeller from rows (host, title, text, ...); any number of rows, also none.

    ``repeated`` has the lines that are repeated on each host and ``counted`` the
    host's pages of several lines; without them they are counted in the sample.
    """
    rng = np.random.default_rng(seed)
    rows = [r[:3] for r in sample if r[2] and "\n" in r[2]]
    if repeated is None:
        repeated = repeated_lines([(h, t) for h, _, t in rows])
        counted = Counter(h for h, _, _ in rows)
    if not rows:
        rows = [("", "", "A short page\nIt has one line of text, and this is it.")]
    cut = [blocks(text)[0] for _, _, text in rows]
    marked = [weak_labels(lines, repeated.get(host, set())) for lines, (host, _, _) in zip(cut, rows)]
    unsure = [UNSURE if (counted or {}).get(host, 0) < FEW_PAGES else 1.0 for host, _, _ in rows]
    furniture = [_clean(x) for lines, y in zip(cut, marked) for x, label in zip(lines, y) if label and x.strip()]
    menus = [e for x in furniture if len(e := entries(x)) > 2]
    pool = [x for x in furniture if len(entries(x)) <= 2]
    pages, labels, sure = [], [], []

    def add(lines: Sequence[str], title: str | None, y: np.ndarray, s: np.ndarray) -> None:
        pages.append(encode(lines, title))
        labels.append(y)
        sure.append(s)

    for lines, y, (_, title, _), low in zip(cut, marked, rows, unsure):
        s = np.where(y > 0, 1.0, low).astype(np.float32)
        add(lines, title, y, s)
        add(*(lambda m: (m[0], title, m[1], m[2]))(augment(lines, y, s, rng, pool, menus)))
        if rng.random() < 0.25:  # the same page as one line, cut at sentences
            pieces = [_SENTENCE_END.split(line) for line in lines]
            n = [len(x) for x in pieces]
            add([x for part in pieces for x in part], title, np.repeat(y, n), np.repeat(s, n))
    return Labeller().fit(pages, labels, sure)
