"""Template residue, filler, error pages and script notices by character n-gram models.

Five character models are fitted: natural prose and site furniture on the
corpus (as the block labeller tells them apart), filler, error notices and
template marks on fixed sentences and on what the corpus itself shows of them. A text is scored
by all of them in windows, which localise the residue. A page is excluded if windows of filler and
notices cover at least half of its own content, or if it holds a template
mark that is in use. A mark that prose explains or quotes is told from one in
use by two more models, of what stands around it.

All different lines of a batch of pages are scored in one array.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

from sitelens.llm.ngrams import GAP, CharModel, CharModels, codes, grams, line_codes
from sitelens.llm.phrases import IN_USE, LOREM, NOTICES, OPENERS, SPOKEN_OF, SPOKEN_OF_NOTICES, STAND_INS

WINDOW = 32
COVERAGE = 0.5
FEW_WORDS = 40
#: Mean log-probability of a character below which a window of filler or notice is strange even to these models.
UNKNOWN = -4.2
#: Least gain in nats of the mark model over prose and furniture at a mark.
LEAST_GAIN = 2.0

#: The forms of template marks the mark model is fitted on (o and f stand for two parts of a name) and values of unset variables.
MARKS = [
    "{{o_f}}", "{{ o.f }}", "{{oF}}", "<%= o.f %>", "<% o_f %>", "${o.f}", "#{o_f}", "@@o-f@@", "[[o_f]]", "[your o.f here]", "[INSERT o-f]", "{$o_f}", "{o-f}", "%oF%", "%o_f%", "{%o%}", "__O_F__",
    "*|OF|*", "*|O_F|*", "[o f]", "[O_F]", "<O_F>", "<OF>", "%(of)s", "%(o_f)s", "%s", "%d", "{0}", "{1}", "$of$", "$o_f$", "«of»", "«o_f»", "<?php echo $o_f; ?>", "<?= $of ?>", ":o_f", ":of", "TODO", "TODO: add the of",
]
VALUES = ["[object Object]", "undefined", "NaN", "Invalid Date", "null"]
#: Names that merge fields in plain brackets have.
FIELD_NAMES = "name|first ?name|last ?name|full ?name|user ?name|company|firm|title|address|street|city|town|country|state|zip(?: code)?|e-?mail|phone|date|time|year|price|amount|total|number|id|url|link|product|order|item|subject|signature|nom|prénom|ville|vorname|nachname|stadt|datum|preis|nombre|apellido|ciudad|fecha|precio"
#: What a candidate must look like: a name between signs in one of the usual forms, after an opening that was never closed or before a closing never opened, or an unset value.
FORM = re.compile(
    r"\{\{.*?\}\}|<%.*?%>|\{%.*?%\}|<\?.*?\?>|\*\|.*?\|\*|\$\{[^}]*\}|#\{[^}]*\}|@@[\w.\- ]+?@@|\[\[[^\]]*\]\]|\[your\b[^\]]*\]|\[insert\b[^\]]*\]|\{\$?[A-Za-z_][\w.\- ]*\}|\{\d\}|__[A-Z][A-Z_]+__"
    r"|%[A-Za-z][A-Za-z0-9]*(?:[._\-]?[A-Za-z0-9]+)*%|%\([A-Za-z_]\w*\)[sd]|(?<![\w%])%[sd](?!\w)|\$[A-Za-z_]\w*\$|(?<![\w:]):[a-z]+(?:_[a-z]+)+\b"
    r"|(?-i:\bTODO\b)|\[object Object\]|(?-i:\bundefined\b|\bNaN\b|\bInvalid Date\b|(?<![\w'])null(?![\w']))"
    rf"|[\[<«] ?(?:{FIELD_NAMES}) ?[\]>»]"
    r"|[\[<«](?-i:[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)+|[A-Z][A-Z0-9]*(?:[_\- ][A-Z0-9]+)+|[A-Z]{5,})[\]>»]"
    r"|(?=[!-/:-@\[-^`{-~]*[{\[<|%$#@])[!-/:-@\[-^`{-~]{2,6} ?[$\w][\w.\-]{0,60} ?(?=[!-/:-@\[-^`{-~]*[}\]>|%$#@])[!-/:-@\[-^`{-~]{2,6}"
    r"|(?:\{\{|\{%|<%|<\?|\$\{|#\{|\*\||@@|\[\[)[ =]{0,2}[A-Za-z_$][\w.\-]*|[A-Za-z_$][\w.\-]* ?(?:\}\}|%\}|%>|\?>|\|\*|\]\])",
    re.IGNORECASE,
)
#: What every such form holds; it spares the others the search.
_HINT = re.compile(r"[{}<>\[\]%$@#*«»]|__|:[A-Za-z]+_|TODO|undefined|NaN|null|Invalid Date|object Object")
_VALUE = re.compile(r"\[object object\]|undefined|nan|invalid date|null", re.IGNORECASE)

_OBJECTS = ["user", "order", "page", "item", "cart", "shop", "post", "product", "meta", "author", "first", "last", "customer", "company"]
_FIELDS = ["name", "title", "price", "city", "date", "total", "url", "sku", "id", "excerpt", "email", "address", "count"]
_PART = re.compile(r"(?<![A-Za-z])(?:o([._ \-]?)f|O([._ \-]?)F|oF|O|o)(?![a-z])")


def mark_texts(n: int, rng: np.random.Generator) -> list[str]:
    """Marks of every form with invented names, and the values of unset variables."""
    out = []
    for k in range(n):
        o, f = str(rng.choice(_OBJECTS)), str(rng.choice(_FIELDS))

        def named(m: re.Match) -> str:
            part = m.group()
            both = {"oF": o + f.capitalize(), "o": o, "O": o.upper(), "of": o + f, "OF": o.upper() + f.upper(), "o f": f"{o} {f}".title()}
            return both.get(part) or (f"{o}{part[1]}{f}" if part[0] == "o" else f"{o}{part[1]}{f}".upper())

        form = MARKS[k % len(MARKS)]
        out.append(form if form.startswith("TODO") or form in ("%s", "%d") else _PART.sub(named, form, count=1))
    return out + VALUES * (n // 4)


def lorem_texts(n: int, rng: np.random.Generator) -> list[str]:
    return ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", *(" ".join(rng.choice(LOREM, rng.integers(5, 14))).capitalize() + "." for _ in range(n))]


class Scored:
    """Distinct lines with what the models say of them.

    ``cover`` has for each line the characters in windows that read as natural,
    furniture, filler and notice, and of those that read as one of the last two but are strange to it; ``reads`` the kind of the whole line; ``marked`` whether it holds a mark in use.
    """

    def __init__(self, size: int):
        self.cover = np.zeros((size, 5))
        self.reads = np.zeros(size, np.int64)
        self.marked = np.zeros(size, bool)


class ResidueModel:
    """The fitted models. ``natural`` and ``furniture`` are blocks of the corpus, any number of them; ``filler`` and ``notices`` what of these the corpus is known to hold.

    ``counted`` has counts of these four (see :class:`sitelens.llm.ngrams.Tally`) where the blocks are too many to be at hand.
    """

    KINDS = ("natural", "furniture", "filler", "notice", "mark")

    def __init__(self, natural: Sequence[str], furniture: Sequence[str], filler: Sequence[str] = (), notices: Sequence[str] = (), seed: int = 3, counted: Sequence[np.ndarray] = ()):
        rng = np.random.default_rng(seed)
        said = [o + (n[0].lower() + n[1:] if o.endswith(", ") or o.endswith("but ") or o == "Leider " else n) for n in NOTICES for o in ["", *rng.choice(OPENERS, 3)]]
        fillers = lorem_texts(400, rng) + STAND_INS * 12
        self.models = CharModels([[*natural, *[s for s in SPOKEN_OF + SPOKEN_OF_NOTICES for _ in range(8)]], [*furniture] or ["Back to top"], [*fillers, *filler], [*said, *said, *notices], mark_texts(1200, rng)])
        for kind, counts in enumerate(counted):
            self.models.add(kind, counts)
        self.in_use, self.spoken_of = CharModel(IN_USE * 4), CharModel(SPOKEN_OF * 4)

    def score(self, lines: Sequence[str]) -> Scored:
        """All lines at once; the windows of a line have 32 characters and overlap by half."""
        out = Scored(len(lines))
        if not lines:
            return out
        code, starts, ends = line_codes(lines)
        per = self.models.log_probabilities(code)
        sums = np.zeros((len(per) + 1, per.shape[1]))
        np.cumsum(per, axis=0, dtype=np.float64, out=sums[1:])
        size = ends - starts
        whole = sums[ends] - sums[starts]
        out.reads = whole[:, :4].argmax(axis=1)
        n = np.where(size > 0, np.maximum(1, -(-(size - WINDOW // 2) // (WINDOW // 2))), 0)
        line = np.repeat(np.arange(len(lines)), n)
        first = starts[line] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * (WINDOW // 2)
        last = np.minimum(first + WINDOW, ends[line])
        inside = (sums[last] - sums[first])[:, :4]
        best = inside.argmax(axis=1)
        best[(best >= 2) & (inside.max(axis=1) < UNKNOWN * (last - first))] = 4
        out.cover = np.bincount(line * 5 + best, weights=last - first, minlength=5 * len(lines)).reshape(-1, 5)
        # Of all windows that end at a character the best gains the sum up to it less the least sum before; none spans a gap.
        gain = per[:, 4] - np.maximum(per[:, 0], per[:, 1])
        gain[code == 10] = -40.0 / len(GAP)
        run = np.cumsum(gain, dtype=np.float64)
        over = run - np.minimum.accumulate(np.concatenate([[0.0], run[:-1]])) >= LEAST_GAIN
        over[code == 10] = False
        hits = np.flatnonzero(over)
        at = np.searchsorted(starts, hits, side="right") - 1
        for k in np.unique(at):
            out.marked[k] = self._in_use(" ".join(lines[k].split()), hits[at == k] - starts[k])
        return out

    def _in_use(self, line: str, hits: np.ndarray) -> bool:
        """Whether one of the candidates at ``hits`` has the form of a mark and is in use, as what stands around it in its sentence decides."""
        for match in FORM.finditer(line) if _HINT.search(line) else ():
            k = np.searchsorted(hits, match.start() - 8)
            if k == len(hits) or hits[k] >= match.end() + 8:
                continue
            before = re.split(r"[.!?]\s", line[max(0, match.start() - 80) : match.start()])[-1]
            after = re.split(r"(?<=[.!?])\s", line[match.end() : match.end() + 80])[0]
            around = FORM.sub("◊", before) + "◊" + FORM.sub("◊", after)
            used, spoken = (float(m.log_probabilities(grams(codes(around))).sum()) for m in (self.in_use, self.spoken_of))
            if spoken > used and len(around.split()) > 4:
                continue
            if _VALUE.fullmatch(match.group()) and len(around.split()) > 4 and float(self.models.log_probabilities(line_codes([around])[0])[len(GAP) : -len(GAP), 0].sum()) > used:
                continue
            return True
        return False

    def marks(self, text: str) -> bool:
        """Whether the text holds a template mark or an unset value in use.

        Windows in which the mark model beats prose and furniture give the candidates; then the
        form of each is checked, and what stands around it decides.
        """
        return bool(self.score(text.split("\n")).marked.any())

    @staticmethod
    def kind(scored: Scored, title: int | None, text: Sequence[int], own: Sequence[int], furniture: Sequence[int], words: int) -> str:
        """'mark', 'filler', 'notice' or '' for a page, given the places of its title, its lines, its own lines and its furniture among the scored.

        ``words`` are those of the own content. Where they are fewer than ``FEW_WORDS``, furniture blocks that read
        as a notice or filler rather than as furniture are judged with it: on a page without content they may be all there is.
        """
        if (title is not None and scored.marked[title]) or scored.marked[list(text)].any():
            return "mark"
        judged = list(own)
        if words < FEW_WORDS:
            judged += [k for k in furniture if scored.reads[k] >= 2]
        by = scored.cover[judged].sum(axis=0) if judged else np.zeros(5)
        known, residue, natural = by[2] + by[3], by[2:].sum(), by[0]
        if not residue or residue / (residue + natural) < COVERAGE:
            return ""
        if known < residue / 2:  # prose in a language that the sample lacks is strange to all models alike
            return ""
        return "filler" if by[2] > by[3] else "notice"

    def judge(self, title: str | None, text: str, content: str, furniture: Sequence[str] = ()) -> str:
        """The kind of one page, given its whole text, its own content and its furniture."""
        lines = [title or "", *text.split("\n"), *content.split("\n"), *furniture]
        a, b = 1 + text.count("\n") + 1, 2 + text.count("\n") + 1 + content.count("\n")
        return self.kind(self.score(lines), 0, range(1, a), range(a, b), range(b, len(lines)), len(content.split()))
