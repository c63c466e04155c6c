"""Interpolated character n-gram models over hashed counts, scored in whole arrays."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

ORDER = 5
BITS = 18
#: Weight of the shorter context against the counts of the longer one.
BACK = 2.0
_ALPHABET = 400
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def codes(text: str) -> np.ndarray:
    """Lower-case code points; every digit is 0 and white space one space."""
    raw = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return np.where((raw >= 48) & (raw <= 57), np.uint64(48), raw)


def grams(code: np.ndarray, order: int = ORDER) -> np.ndarray:
    """(order, n) table slots of the n-grams that end at each character; text starts count as spaces."""
    out = np.empty((order, len(code)), np.int64)
    rolled = np.zeros(len(code), np.uint64)
    for k in range(order):
        if k:
            rolled = np.concatenate([[np.uint64(32)], rolled[:-1]]) if len(code) else rolled
        rolled = (rolled * _A) ^ (code + np.uint64(k + 1))
        if k == 0:
            rolled = code * _A
        out[k] = ((rolled * _C) >> np.uint64(64 - BITS)).astype(np.int64)
    return out


#: Characters that are scored at a time.
STRETCH = 16_384
#: Lines are scored together with this between them, so that no n-gram spans two of them.
GAP = "\n" * (ORDER - 1)


def line_codes(lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all lines in one array with gaps around them, and where each line starts and ends."""
    clean = [" ".join(x.lower().split()) for x in lines]
    raw = np.frombuffer((GAP + GAP.join(clean) + GAP).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, clean), np.int64, len(clean))
    ends = np.cumsum(size + len(GAP))
    return np.where((raw >= 48) & (raw <= 57), 48, raw).astype(np.uint64), ends - size, ends


class CharModel:
    """P(character | up to four before it), each order interpolated with the next shorter."""

    def __init__(self, texts: Iterable[str], order: int = ORDER):
        self.order = order
        self.counts = np.zeros((order, 1 << BITS), np.float32)
        each = [grams(codes(text), order) for text in texts]
        slots = np.concatenate(each, axis=1) if each else np.empty((order, 0), np.int64)
        self.total = slots.shape[1]
        for k in range(order):
            self.counts[k] = np.bincount(slots[k], minlength=1 << BITS)

    def log_probabilities(self, slots: np.ndarray) -> np.ndarray:
        """Natural logarithm of each character's probability."""
        if not slots.shape[1]:
            return np.zeros(0, np.float32)
        p = (self.counts[0][slots[0]] + 0.2) / (self.total + 0.2 * _ALPHABET)
        for k in range(1, self.order):
            context = np.empty(slots.shape[1], np.float32)
            context[0] = 0
            context[1:] = self.counts[k - 1][slots[k - 1][:-1]]
            seen = np.minimum(self.counts[k][slots[k]], context)
            p = (seen + BACK * p) / (context + BACK)
        return np.log(p)


class CharModels:
    """Several such models whose counts stand side by side, so that one look-up serves all of them."""

    def __init__(self, kinds: Sequence[Sequence[str]]):
        self.counts = np.zeros((ORDER, 1 << BITS, len(kinds)), np.float32)
        self.total = np.zeros(len(kinds), np.float32)
        for m, lines in enumerate(kinds):
            code, starts, ends = line_codes(lines)
            inside = code != 10
            self.total[m] = inside.sum()
            for k, slots in enumerate(grams(code)):
                # what ends in a gap is the context of a line's first characters
                self.counts[k, :, m] = np.bincount(slots if k < ORDER - 1 else slots[inside], minlength=1 << BITS)

    def add(self, model: int, counts: np.ndarray) -> None:
        """Add counts of :class:`Tally`, (ORDER, slots), perhaps of a weight other than one a character, to those of a model."""
        self.counts[:, :, model] += counts
        self.total[model] += counts[ORDER - 1].sum()

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """(characters, models) natural logarithms for the characters of :func:`line_codes`."""
        slots = grams(code)
        out = np.empty((len(code), len(self.total)), np.float32)
        least = self.total + np.float32(0.2 * _ALPHABET)
        for lo in range(0, len(code), STRETCH):  # what is worked on stays in the processor's cache
            hi = min(lo + STRETCH, len(code))
            first = max(0, lo - 1)
            here = self.counts[0].take(slots[0, first:hi], axis=0)
            p = (here[lo - first :] + np.float32(0.2)) / least
            for k in range(1, ORDER):
                context = here[: hi - lo] if lo else np.concatenate([np.zeros((1, here.shape[1]), np.float32), here[:-1]])
                here = self.counts[k].take(slots[k, first:hi], axis=0)
                p *= np.float32(BACK)
                p += np.minimum(here[lo - first :], context)
                p /= context + np.float32(BACK)
            np.log(p, out=out[lo:hi])
        return out


class Tally:
    """Whole counts of n-grams of several groups of lines, as :class:`CharModels` counts them; tallies of parts of a corpus add up."""

    def __init__(self, groups: int):
        self.counts = np.zeros((groups, ORDER, 1 << BITS), np.int64)

    def add(self, group: int, lines: Sequence[str]) -> None:
        if not lines:
            return
        code, _, _ = line_codes(lines)
        inside = code[len(GAP) :] != 10
        for k, slots in enumerate(grams(code)[:, len(GAP) :]):  # each line with the gap after it, so that parts add up
            self.counts[group, k] += np.bincount(slots if k < ORDER - 1 else slots[inside], minlength=1 << BITS)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, n) of what was met; :meth:`of` puts the sums of such rows in their places."""
        flat = self.counts.reshape(-1)
        at = np.flatnonzero(flat)
        return at, flat[at]

    @classmethod
    def of(cls, groups: int, places: np.ndarray, n: np.ndarray) -> Tally:
        out = cls(groups)
        out.counts.reshape(-1)[places] = n
        return out
