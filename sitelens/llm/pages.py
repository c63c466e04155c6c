"""One pass over crawled pages: own content, furniture lines and residue.

The labeller is trained on a bounded sample, whose lines are counted on their hosts over all pages. It labels
every page once, in Arrow batches; the residue models are counted over the labelled lines of all pages, and the
reading model over all own content. A page's text is read to its end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import boilerplate, near_dup, reading
from sitelens.llm.common import WORD, small
from sitelens.llm.ngrams import Tally
from sitelens.llm.residue import FEW_WORDS, ResidueModel
from sitelens.session import cut
from sitelens.tables import latest, load

#: Longer texts are read and counted like all others, but the labeller is not trained on them: it bounds what the driver receives.
TRAIN_CHARS = 20_000
#: Own content below this many words is no sample of natural prose.
NATURAL_WORDS = 60
_PAGE = pa.schema([("page_id", pa.int64()), ("n_lines", pa.int32()), ("furniture", pa.list_(pa.int32())), ("residue", pa.string()), ("content", pa.string()), ("content_words", pa.int32())])
_PAGE_DDL = "page_id bigint, n_lines int, furniture array<int>, residue string, content string, content_words int"
_TEXT = pa.field("body_text", pa.string())
_BAND = pa.schema([("page_id", pa.int64()), ("grade", pa.float64()), ("band", pa.string())])
_BAND_DDL = "page_id bigint, grade double, band string"
#: Own content of fewer words has no reading band.
BAND_WORDS = 60


#: All pages are counted, and count in the residue models as much as so many pages do against the fixed sentences.
RESIDUE_PAGES = boilerplate.TRAIN_PAGES
#: Pages with a failure's status, whose own content, if it is short, shows what notices say, count as much as so many more.
FAILED_PAGES = 400
_LABELLED = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("body_text", pa.string()), ("failed", pa.bool_()), ("side", pa.binary())])
_LABELLED_DDL = "page_id bigint, title string, body_text string, failed boolean, side binary"
#: The groups that are counted: natural prose, filler and notices of pages without and with a failure's status, and furniture.
_GROUPS = ("natural", "filler", "notice")


class PageModel:
    """The fitted labeller and residue models, from a sample at hand; :func:`fit` has the residue models counted over all pages.

    ``sample`` has rows (host, title, text); ``failed`` rows (title, text) of pages that came with an error
    status. The residue models are fitted twice: what the first finds in the sample and in the failed pages is
    taken out of natural prose and shows the second how this corpus words its notices and fillers.
    """

    def __init__(self, sample: Sequence[tuple], repeated: dict[str, set[str]] | None = None, counted: dict[str, int] | None = None, failed: Sequence[tuple[str | None, str]] = ()):
        self.labeller = boilerplate.train(sample, repeated=repeated, counted=counted)
        pages = [(title, text) for _, title, text, *_ in sample if text] + [(t, x) for t, x in failed if x]
        own: list[list[str]] = []
        furniture: list[str] = []
        for start in range(0, len(pages), 256):
            part = pages[start : start + 256]
            cut = [boilerplate.blocks(text) for _, text in part]
            for (lines, whole), p in zip(cut, self.labeller.predict([boilerplate.encode(lines, t) for (lines, _), (t, _) in zip(cut, part)])):
                own.append([x for x, q in zip(lines, p) if q < 0.5])
                if whole and len(own) <= len(sample):
                    furniture += [x for x, q in zip(lines, p) if q >= 0.5]
        words = [sum(len(WORD.findall(x)) for x in lines) for lines in own]
        natural = [k for k in range(len(own)) if words[k] >= NATURAL_WORDS]
        first = ResidueModel([x for k in natural for x in own[k]], furniture, notices=[x for k in range(len(sample), len(own)) if words[k] < NATURAL_WORDS for x in own[k]])
        kinds = [r[2] for start in range(0, len(pages), 256) for r in read(self.labeller, first, pages[start : start + 256])]
        natural = [k for k in natural if not kinds[k]]
        self.residue = ResidueModel([x for k in natural for x in own[k]], furniture, *([x for k, found in enumerate(kinds) if found == kind for x in own[k]] for kind in ("filler", "notice")))
        self.contents = ["\n".join(own[k]) for k in natural if "\n" in pages[k][1]]


def predicted(labeller: boilerplate.Labeller, rows: Sequence[tuple[str | None, str]]) -> list[np.ndarray]:
    """For each (title, text) whether its blocks are furniture."""
    return [p >= 0.5 for p in labeller.predict([boilerplate.encode(boilerplate.blocks(text)[0], t) for t, text in rows])]


def read(labeller: boilerplate.Labeller | None, residue: ResidueModel, rows: Sequence[tuple[str | None, str]], sides: Sequence[np.ndarray] | None = None) -> list[tuple]:
    """(n_lines, furniture line numbers, residue kind, own content, its words) for each (title, text); ``sides`` are those of :func:`predicted` where they are known."""
    sides = predicted(labeller, rows) if sides is None else sides
    cut = [boilerplate.blocks(text) for _, text in rows]
    places: dict[str, int] = {}
    titles = [places.setdefault(t, len(places)) if t else None for t, _ in rows]
    lines = [[places.setdefault(x, len(places)) for x in part] for part, _ in cut]
    scored = residue.score(list(places))
    out = []
    for title, at, (part, whole), side in zip(titles, lines, cut, sides):
        own = [k for k, (x, q) in enumerate(zip(part, side)) if not q and x.strip()]
        furniture = [k for k, (x, q) in enumerate(zip(part, side)) if q and x.strip()]
        content = ("\n" if whole else " ").join([part[k] for k in own])
        words = len(WORD.findall(content.lower()))
        # of a page of one line all sentences are judged, as furniture is glued to them
        kind = residue.kind(scored, title, at, [at[k] for k in own] if whole else at, [at[k] for k in furniture], words if whole else FEW_WORDS)
        out.append((len(part) if whole else 1, [k + 1 for k in furniture] if whole else [], kind, content, words))
    return out


def host(url: str | None) -> str:
    return (url or "").partition("//")[2].partition("/")[0].lower()


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(url, "^[^/]*//([^/]*)", 1))


def _line_hashes() -> Column:
    """The hashes of a text's different lines, white space put in order."""
    return F.array_distinct(F.transform(F.split("body_text", "\n"), _line_hash))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(line, r"[\s\u00a0\u2000-\u200a\u202f\u3000]+", " ")))


#: More different lines of the sample than this are joined by shuffling.
BROADCAST_LINES = 4_000_000


def repeated_on_hosts(pages: DataFrame, sample: DataFrame) -> tuple[dict[str, set[str]], dict[str, int]]:
    """For each host of ``sample`` (page_id, url, body_text) its lines that are repeated on the host, and the host's pages of several lines.

    Both are counted over all of ``pages``, a page once however often it was
    delivered. Only hashes of lines that the sample holds are shuffled.
    """
    several = lambda df: df.where("page_id is not null and url is not null and instr(body_text, '\n') > 0").withColumn("host", _host("url"))
    own = several(sample).select("host", F.explode(F.split("body_text", "\n")).alias("line")).select("host", "line", _line_hash(F.col("line")).alias("h")).distinct()
    own = cut(own)
    hosts, _ = small(own.select("host").distinct(), BROADCAST_LINES)
    wanted, _ = small(own.select("host", "h").distinct(), BROADCAST_LINES)
    every = several(pages).join(hosts, "host", "left_semi")
    sizes = every.groupBy("host").agg(F.countDistinct("page_id").alias("pages"))
    counts = every.select("host", "page_id", F.explode(_line_hashes()).alias("h")).join(wanted, ["host", "h"], "left_semi").groupBy("host", "h").agg(F.countDistinct("page_id").alias("n"))
    counted = {r.host: r.pages for r in sizes.collect()}
    repeated: dict[str, set[str]] = {h: set() for h in counted}
    for r in counts.where(f"n >= {boilerplate.REPEATED_LEAST}").join(own.hint("merge"), ["host", "h"]).select("host", "line", "n").collect():
        line = " ".join(r.line.split())
        if boilerplate.is_repeated(line, r.n, counted[r.host]):
            repeated[r.host].add(line)
    return repeated, counted


def sampled(pages: DataFrame, limit: int, where: str, seed: int = 0) -> DataFrame:
    """The counting rows of at most ``limit`` pages that meet ``where``, chosen by a hash of their id.

    The ids are chosen first, in the executors; texts are read only of the
    chosen, so that what the driver receives does not grow with the number of partitions.
    """
    ids = pages.where(f"page_id is not null and ({where})").select("page_id").orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id").limit(limit).distinct()
    rows = pages.join(F.broadcast(ids), "page_id", "left_semi")
    return latest(rows, "page_id") if "ingested_at" in rows.columns else rows.dropDuplicates(["page_id"])


def label(pages: DataFrame, labeller: boilerplate.Labeller) -> DataFrame:
    """(page_id, title, body_text, failed, side): each page with a text, and a byte for each of its blocks, 1 for furniture."""
    state = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sides = predicted(state.value, list(zip(part.column(1).to_pylist(), part.column(2).to_pylist())))
                kept = [part.column(k).cast(f.type) for k, f in enumerate(_LABELLED) if k < 4]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([x.astype(np.uint8).tobytes() for x in sides], pa.binary())], schema=_LABELLED)

    failed = F.coalesce(F.col("status_code") >= 400, F.lit(False)) if "status_code" in pages.columns else F.lit(False)
    rows = pages.where("page_id is not null and length(body_text) > 0").select("page_id", "title", "body_text", failed.alias("failed"))
    return rows.mapInArrow(run, _LABELLED_DDL)


def _sides(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) > 0 for x in column.to_pylist()]


def tallied(df: DataFrame, groups: int, lines: Callable[[pa.RecordBatch], Iterable[tuple[int, list[str]]]]) -> np.ndarray:
    """(groups, ORDER, slots): the n-grams of all lines that ``lines`` gives with their group for the batches of ``df``.

    Each task counts its own rows and what they hold is added up in the executors; what the driver receives is bounded by the slots.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(groups)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                for group, found in lines(batch.slice(start, 512)):
                    tally.add(group, found)
        at, n = tally.rows()
        for start in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[start : start + 100_000]), pa.array(n[start : start + 100_000])], names=["at", "n"])

    found = df.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    return Tally.of(groups, found["at"].to_numpy(), found["n"].to_numpy()).counts


def residue_model(labelled: DataFrame) -> ResidueModel:
    """The residue models, counted over all pages of :func:`label`.

    They are fitted twice, as those of :class:`PageModel`. Whole counts are added up; against the fixed sentences
    all pages weigh as ``RESIDUE_PAGES`` do, and those with a failure's status as ``FAILED_PAGES`` more.
    """
    n, bad = labelled.agg(F.count("*"), F.count_if("failed")).first()
    usual, more = min(1.0, RESIDUE_PAGES / max(1, n)), min(1.0, FAILED_PAGES / max(1, bad))
    weigh = lambda good, failed: (good * usual + failed * (usual + more)).astype(np.float32)

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[str], bool, bool]]:
        for text, failed, side in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), _sides(batch.column(4))):
            lines, whole = boilerplate.blocks(text)
            own = [x for x, q in zip(lines, side) if not q]
            yield sum(len(WORD.findall(x)) for x in own), own, [x for x, q in zip(lines, side) if q], whole, failed

    def first_lines(batch: pa.RecordBatch) -> Iterable[tuple[int, list[str]]]:
        out: list[list[str]] = [[] for _ in range(4)]
        for words, own, furniture, whole, failed in parts(batch):
            if whole:
                out[2] += furniture
            if words >= NATURAL_WORDS:
                out[int(failed)] += own
            elif failed:
                out[3] += own
        return enumerate(out)

    a, b, furniture, notices = tallied(labelled, 4, first_lines)
    furniture = (furniture * usual).astype(np.float32)
    none = np.zeros_like(furniture)
    first = ResidueModel([], [], counted=[weigh(a, b), furniture, none, (notices * more).astype(np.float32)])
    state = labelled.sparkSession.sparkContext.broadcast(first)

    def second_lines(batch: pa.RecordBatch) -> Iterable[tuple[int, list[str]]]:
        out: list[list[str]] = [[] for _ in range(6)]
        kinds = [r[2] for r in read(None, state.value, list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())), _sides(batch.column(4)))]
        for kind, (words, own, _, _, failed) in zip(kinds, parts(batch)):
            if kind in _GROUPS[1:] or not kind and words >= NATURAL_WORDS:
                out[2 * _GROUPS.index(kind or "natural") + int(failed)] += own
        return enumerate(out)

    found = tallied(labelled, 6, second_lines)
    natural, filler, notice = (weigh(found[2 * k], found[2 * k + 1]) for k in range(3))
    return ResidueModel([], [], counted=[natural, furniture, filler, notice])


def fit(pages: DataFrame, limit: int = boilerplate.TRAIN_PAGES) -> PageModel:
    """The labeller from at most ``limit`` rows with a text of at most ``TRAIN_CHARS`` characters, and residue models from all pages.

    Rows delivered again may be given as they are: they are told apart after
    the choice. The lines of the chosen rows are counted on all pages. The model's ``labelled`` has all pages
    with their labels, to be given to :func:`analyse`.
    """
    names = [c for c in ("page_id", "url", "title", "body_text", "status_code", "ingested_at") if c in pages.columns]
    pages, fits = pages.select(*names), f"length(body_text) between 1 and {TRAIN_CHARS}"
    chosen = cut(sampled(pages, limit, fits))
    sample = [(host(r.url), r.title, r.body_text) for r in chosen.orderBy(F.xxhash64("page_id"), "page_id").collect()]
    repeated, counted = repeated_on_hosts(pages, chosen)
    model = PageModel.__new__(PageModel)
    model.labeller = boilerplate.train(sample, repeated=repeated, counted=counted)
    rows = pages.drop("url")
    model.labelled = cut(label(latest(rows, "page_id") if "ingested_at" in names else rows.dropDuplicates(["page_id"]), model.labeller))
    model.residue = residue_model(model.labelled)
    return model


def analyse(pages: DataFrame, model: PageModel, keep_text: bool = False) -> DataFrame:
    """One row for each page with a text: number of lines, furniture lines (from 1), residue kind or '', own content and its words.

    Pages with a null id or a null or empty text give no row. A page of one
    line has no furniture lines, its own content is made of sentences. Pages of :func:`label` are not labelled again; other
    columns are ignored; ``keep_text`` adds the page's text to its row.
    """
    known = "side" in pages.columns
    state = pages.sparkSession.sparkContext.broadcast((None if known else model.labeller, model.residue))
    schema = _PAGE.append(_TEXT) if keep_text else _PAGE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, residue = state.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = read(labeller, residue, list(zip(part.column(1).to_pylist(), part.column(2).to_pylist())), _sides(part.column(3)) if known else None)
                columns = [part.column(0).to_pylist(), *([r[k] for r in rows] for k in range(5))]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, _PAGE)]
                yield pa.RecordBatch.from_arrays([*arrays, part.column(2).cast(pa.string())] if keep_text else arrays, schema=schema)

    return pages.select("page_id", "title", "body_text", *["side"] * known).where("page_id is not null and length(body_text) > 0").mapInArrow(run, _PAGE_DDL + (", body_text string" if keep_text else ""))


def bands(contents: DataFrame, model: reading.ReadingModel) -> DataFrame:
    """Rows (page_id, grade, band) of the English rows of (page_id, content); other languages and null contents give no row."""
    state = contents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [(page, content) for page, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if content and reading.language(content) == "en"]
                grades = state.value.grades([content for _, content in rows])
                columns = [page for page, _ in rows], grades, [reading.band(g) for g in grades]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BAND)], schema=_BAND)

    return contents.select("page_id", "content").mapInArrow(run, _BAND_DDL)


_GRADED = pa.schema([("page_id", pa.int64()), ("content", pa.string()), ("several", pa.bool_()), ("grade", pa.float64())])
_GRADED_DDL = "page_id bigint, content string, several boolean, grade double"


def graded(pages: DataFrame) -> DataFrame:
    """(page_id, content, several, grade): the English rows of :func:`analyse`, whether the page has several lines, and the grade of their words to three places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page, x, n > 1) for page, x, n in zip(*(c.to_pylist() for c in batch.columns)) if x and reading.language(x) == "en"]
            columns = [[r[k] for r in rows] for k in range(3)] + [[round(reading.weak_grade(r[1]), 3) for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _GRADED)], schema=_GRADED)

    return pages.select("page_id", "content", "n_lines").mapInArrow(run, _GRADED_DDL)


def reading_model(contents: DataFrame) -> reading.ReadingModel:
    """The reading model counted over all rows of :func:`graded`: known words, the plainest quarter, its n-grams and the fit.

    What the driver receives is bounded: a row for each grade to three places, the words that a share of the texts hold,
    the slots of the n-grams, and sums for each score to three places.
    """
    by_grade = sorted((r.grade, r.n) for r in contents.groupBy("grade").agg(F.count("*").alias("n")).collect())
    size = sum(n for _, n in by_grade)
    upto = np.cumsum([n for _, n in by_grade])
    bar = by_grade[int(np.searchsorted(upto, max(1, size // 4)))][0] if size else -np.inf

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                met.update(reading.vocabulary(x))
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], names=["word", "n"])

    often = contents.select("content").mapInArrow(words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= reading.least_met(size))
    known = frozenset(r.word for r in often.select("word").collect()) | reading.FIXED_WORDS
    easy = contents.where(F.col("grade") <= bar).select("content")
    counts = tallied(easy, 1, lambda batch: [(0, [s for x in batch.column(0).to_pylist() for s in reading.sentences(x, known)])])[0]
    model = reading.ReadingModel.counted(known, counts * min(1.0, reading.USUAL_TEXTS / max(1, size)))
    state = contents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = np.array(state.value.surprisals(part.column(0).to_pylist())).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(3)), part.column(1).cast(pa.float64())], names=["mean", "median", "upper", "grade"])

    # half of the plainest quarter, which the model is counted on, is left out
    held = contents.where((F.col("grade") > bar) | (F.pmod(F.xxhash64("page_id"), F.lit(2)) == 0)).select("content", "grade")
    scores = held.mapInArrow(score, "mean double, median double, upper double, grade double")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(sum(w * F.col(c) for w, c in zip(weights, ("mean", "median", "upper"))), 3).alias("x")) for k, weights in enumerate(reading.WEIGHTS)])).alias("s")
    log = F.log1p(F.greatest("grade", F.lit(0.0)))
    fixed = lambda c: F.sum(c.cast("decimal(20,9)")).cast("double")  # sums in any order are the same
    sums = scores.select("grade", each).groupBy("s.k", "s.x").agg(F.count("*").alias("n"), fixed(F.col("grade")).alias("y"), fixed(log).alias("l"), fixed(log * log).alias("ll"))
    model.settle([tuple(r) for r in sums.collect()])
    return model


def analysed(spark: SparkSession, folder: str, keep_text: bool = False) -> DataFrame:
    model = fit(load(spark, folder, "crawled_pages"))
    return analyse(model.labelled, model, keep_text)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Furniture lines of pages of several lines without residue."""
    return analysed(spark, folder).where("n_lines > 1 and residue = ''").select("page_id", F.explode("furniture").alias("line_no"))


def p3_content(spark: SparkSession, folder: str) -> DataFrame:
    """Own content of each page without residue, with its recomputed word count."""
    return analysed(spark, folder).where("residue = ''").select("page_id", "content", F.col("content_words").alias("word_count"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return analysed(spark, folder).where("residue <> ''").select("page_id")


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of residue of each excluded page."""
    return analysed(spark, folder).where("residue <> ''").select("page_id", F.col("residue").alias("kind"))


def banded(spark: SparkSession, folder: str) -> DataFrame:
    model = fit(load(spark, folder, "crawled_pages"))
    contents = cut(graded(analyse(model.labelled, model).where(f"residue = '' and content_words >= {BAND_WORDS}")))
    return bands(contents, reading_model(contents.where("several")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return banded(spark, folder).select("page_id", "band")


def p5_grades(spark: SparkSession, folder: str) -> DataFrame:
    return banded(spark, folder)


def _near(spark: SparkSession, folder: str, size: int, threshold: float, strict: bool, short: bool) -> tuple[DataFrame, DataFrame]:
    clean = analysed(spark, folder, keep_text=True).where("residue = ''").select("page_id", "body_text")
    return near_dup.classes_and_links(clean, "page_id", "body_text", size, threshold, strict, short)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of pages that share more than 55 % of their three-word runs; texts of fewer than three words have none."""
    return near_dup.pairs(*_near(spark, folder, 3, 0.55, True, False)).toDF("page_id_a", "page_id_b")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each page: its class of equal texts, its group and the number of its class's links, on five-word runs at 0.8."""
    return near_dup.groups(*_near(spark, folder, 5, 0.8, False, True)).withColumnRenamed("id", "page_id")


QUERIES = {
    "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_content": p3_content,
    "p4_found": p4_found, "p4_kinds": p4_kinds, "p5_found": p5_found, "p5_grades": p5_grades,
}
