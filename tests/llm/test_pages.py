import numpy as np
import pytest

from sitelens.llm import boilerplate as B
from sitelens.llm import pages as P
from sitelens.llm import reading as R
from sitelens.llm.ngrams import GAP, CharModel, CharModels, codes, grams, line_codes
from sitelens.llm.residue import ResidueModel

HARD = "Notwithstanding considerable methodological limitations, the comprehensive institutionalisation presupposes administrative interoperability across participating organisations."
PLAIN = ["Our team will repair every window before it leaves the building for the first time.", "Most people replace the carpet after several weeks, so you should plan your order a little earlier.", "Some visitors ask whether the engine can be used with a different cable from another store."]
EASY = ["The cat is fast and the dog is slow.", "Put the cup on the shelf and wash it.", "We fold each shirt by hand.", "I saw a red kite near the hill.", "At noon the men pull the boat."]


def page(rng, kind, n=9):
    pool = {"easy": EASY, "plain": PLAIN, "hard": [HARD, HARD.replace("methodological", "epistemological").replace("administrative", "intergovernmental")]}[kind]
    # a line of a page's own is not met on other pages: each sentence ends in some name
    return [" ".join(f"{str(s)[:-1]} near {B._name(rng)}." for s in rng.choice(pool, 3)) for _ in range(n)]


def site(n=80, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        host = f"h{i % 6}.example"
        own = page(rng, ["easy", "plain", "hard"][i % 3])
        top = ["Home | About us | Blog | Contact", f"We use cookies to measure visits on {host}. Accept all or manage choices."]
        end = ["© 2024 Name. All rights reserved.", "Back to top", "Read next:", "Common garden Stosk", "Modern engine Vaird"]
        text = "\n".join([*top, f"{rng.choice(["Green", "Old", "Small", "Warm"])} {rng.choice(["gate", "lamp", "boat", "field"])} of page {i}", *own, *end])
        rows.append((host, f"Title {i}", text, [1, 2, *range(len(own) + 4, len(own) + 9)]))
    return rows


@pytest.fixture(scope="module")
def model():
    return P.PageModel([r[:3] for r in site()])


def test_held_out_furniture(model):
    test = site(40, 5)
    got = P.read(model.labeller, model.residue, [(t, text) for _, t, text, _ in test])
    right = sum(len(set(g[1]) & set(e[3])) for g, e in zip(got, test))
    assert right / sum(len(g[1]) for g in got) > 0.97 and right / sum(len(e[3]) for e in test) > 0.97
    assert all(g[2] == "" for g in got)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    labeller = B.Labeller(1)
    pages = [B.encode([f"word{rng.integers(9)} x{k}" for k in range(n)], "t") for n in (3, 5)]
    labels = [rng.integers(0, 2, n).astype(np.float32) for n in (3, 5)]
    labeller.w = {k: v.astype(np.float64) for k, v in labeller.w.items()}

    def loss():
        p = labeller.forward(pages)
        return -sum(np.log(np.where(y == 1, p[: len(y), b], 1 - p[: len(y), b])).sum() for b, y in enumerate(labels)) / 8

    p, x, mask, at, ids, z, sf, sb = labeller.forward(pages, keep=True)
    y = np.zeros_like(p)
    for b, own in enumerate(labels):
        y[: len(own), b] = own
    grads = {n: np.zeros_like(v) for n, v in labeller.w.items()}
    dz = ((p - y) * mask / mask.sum())[:, :, None]
    dall = dz @ labeller.w["out"].T
    labeller._back("f", x, sf, dall[:, :, : B.HIDDEN], grads)
    labeller._back("b", x, sb, dall[:, :, B.HIDDEN : 2 * B.HIDDEN], grads)
    for name in ("xf", "hf", "bf", "xb", "hb"):
        w = labeller.w[name].reshape(-1)
        k = int(np.argmax(np.abs(grads[name])))
        old = w[k]
        w[k] = old + 1e-3
        up = loss()
        w[k] = old - 1e-3
        down = loss()
        w[k] = old
        assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[k]) < 2e-3 * max(1, abs(grads[name]).max() * 50)


RESIDUE = [
    ("Buy {{ product.name }} online", "Some text of a page\nthat goes on", "mark"), ("A title", "Welcome back, <%= user_name %>, your last order was sent on %orderDate%.", "mark"), ("undefined | Shop", "Some text of a page\nthat goes on", "mark"), ("T", "Hello undefined, your basket holds NaN items.", "mark"), ("Midund: null", "Some text of a page\nthat goes on", "mark"),
    ("T", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.\nSed do eiusmod tempor incididunt ut labore.", "filler"), ("T", "Your headline goes here\nPut your own text here, this block is only an example.", "filler"), ("T", "Not found\nSorry, that link leads nowhere. Try the search box above.", "notice"),
    ("App", "Notice: you need to turn on JavaScript to use this app.\nLoading...", "notice"), ("T", "Die Seite wurde nicht gefunden.", "notice"), ("T", "Acceso denegado. Inténtelo de nuevo más tarde.", "notice"),
    ("T", "\n".join([*PLAIN, "A mark such as {{ user.name }} in a live title tells you that the survey was never filled in."]), ""), ("T", "\n".join([*PLAIN, *EASY, "Designers put lorem ipsum into a draft as long as the real words are missing."]), ""),
    ("T", "\n".join([*PLAIN, *EASY, "The log said error 500 and access denied, so we asked the host to look into it."]), ""), ("Page title", "\n".join(PLAIN), ""), ("T", "\n".join([*PLAIN, "This site works best with scripts turned on."]), ""), (None, "Alle akzeptieren\nTodo lo que hay que saber", ""),
]


@pytest.mark.parametrize(("title", "text", "kind"), RESIDUE)
def test_residue(title, text, kind):
    fitted = ResidueModel([*PLAIN, *EASY, HARD] * 8 + ["Todo lo que hay que saber sobre el tema."] * 4, ["This site works best with scripts turned on.", "Back to top", "Alle akzeptieren"] * 4)
    assert fitted.judge(title, text, text) == kind


@pytest.mark.parametrize("text", ["Hello *|FNAME|*, your basket holds 3 items.", "Posted by <?php echo $x ?> in our shop.", "Dear [FIRST_NAME], thank you for your visit.", "Welcome back, {{ user.name", "Hello ~{user_name}~, welcome."])
def test_marks_of_forms_the_model_was_not_fitted_on(text):
    fitted = ResidueModel([*PLAIN, *EASY, HARD] * 8, ["Back to top", "Home | About us | Blog"] * 4)
    assert fitted.marks(text) and fitted.marks("\n".join([*PLAIN, "  İ  " + text, *EASY]))
    assert not fitted.marks("\n".join([*PLAIN, *EASY, "Home | About us | Blog", "Read [Chapter two] (page 5), then go on."]))


@pytest.mark.parametrize("mark", ["*|FNAME|*", "[First Name]", "%s", "%(name)s", "{0}", "<FIRSTNAME>", "$total$", "«Name»", "<?php echo $title; ?>", ":user_name"])
def test_marks_of_many_template_languages(mark):
    fitted = ResidueModel([*PLAIN, *EASY, HARD] * 8, ["Back to top", "Home | About us | Blog"] * 4)
    assert fitted.marks("\n".join([*PLAIN, f"Welcome back, {mark}, your basket is waiting.", *EASY]))
    assert not fitted.marks("\n".join([*PLAIN, f"A placeholder like {mark} in a mail is replaced by the name of the reader.", *EASY]))


def test_lines_of_a_batch_are_scored_as_they_are_alone():
    m = CharModels([["abab abab abab", "the cat"], ["xyz"]])
    lines = ["abab the", "", "  İx \u2003 Y12 ", "cat"]
    code, starts, ends = line_codes(lines)
    whole = m.log_probabilities(code)
    assert (whole <= 0).all() and len(code) == sum(ends - starts) + len(GAP) * (len(lines) + 1)
    for line, a, b in zip(lines, starts, ends):
        own, first, last = line_codes([line])
        assert np.allclose(m.log_probabilities(own)[first[0] : last[0]], whole[a:b]) and last[0] - first[0] == len(" ".join(line.lower().split()))


def test_char_models_are_probabilities():
    m = CharModel(["abab abab abab", "the cat"])
    p = np.exp(m.log_probabilities(grams(codes("abab the"))))
    assert (p > 0).all() and (p <= 1).all() and m.log_probabilities(grams(codes(""))).shape == (0,)
    assert m.log_probabilities(grams(codes("abab"))).sum() > m.log_probabilities(grams(codes("qzqz"))).sum()


def test_isotonic_is_the_least_squares_monotone_fit():
    x, y = R.isotonic([3, 1, 2, 4], [2.0, 1.0, 4.0, 5.0])
    assert list(np.interp([1, 2, 3, 4], x, y)) == [1, 3, 3, 5] and (np.diff(y) >= 0).all()


def test_reading_bands_ignore_how_sentences_are_joined():
    rng = np.random.default_rng(2)
    texts = ["\n".join(page(rng, k)) for k in ["easy", "plain", "hard"] * 30]
    m = R.ReadingModel(texts)
    held = {k: "\n".join(page(rng, k, 6)) for k in ("easy", "plain", "hard")}
    assert [R.band(m.grade(held[k])) for k in ("easy", "plain", "hard")] == ["basic", "standard", "advanced"]
    assert R.band(m.grade(held["easy"].replace(". ", ", and "))) == "basic"
    assert R.language("Der Hund ist im Haus und die Katze auch.") == "de" and R.language("123") == "" and R.language("El perro y los gatos que hay en casa") == "es"


def test_every_sentence_counts_for_the_reading_level():
    m = R.ReadingModel(["\n".join(page(np.random.default_rng(k), kind)) for k, kind in enumerate(["easy", "plain", "hard"] * 20)])
    easy, plain = EASY * 4, PLAIN * 2
    base = m.score("\n".join([*easy, *plain]))
    harder = m.score("\n".join([*easy, *plain[1:], HARD]))  # one sentence in twenty-six
    hardest = m.score("\n".join([*easy, *plain[2:], HARD, HARD]))
    assert base < harder < hardest and m.score("\n".join([*plain, *easy[1:], PLAIN[0]])) > base
    tail = [HARD] * 3 + PLAIN * 5  # under a quarter of the words
    assert m.grade("\n".join(tail)) > m.grade("\n".join(PLAIN * 6)) and m.surprisal("") == (0.0, 0.0, 0.0)


def test_analyse_in_spark_with_odd_rows(spark, model):
    rows = [(i, r[1], r[2], "x") for i, r in enumerate(site(20, 9))] + [(100, None, "", "x"), (101, None, None, "x"), (None, "t", "text", "x"), (102, None, "one line only", "x"), (103, "t", "\n\n \n", "x"), (104, "t", "line\n" * 5000, "x"), (105, "t", "w " * 30_000, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, title string, body_text string, content string")
    got = {r.page_id: r for r in P.analyse(df, model, keep_text=True).collect()}
    assert set(got) == {*range(20), 102, 103, 104, 105} and got[102].n_lines == 1 and got[102].furniture == [] and got[103].furniture == [] and got[104].n_lines == 5001
    assert got[0].body_text == rows[0][2] and got[0].content_words > 60
    shuffled = {r.page_id: r.furniture for r in P.analyse(df.repartition(5), model).collect()}
    assert shuffled == {k: r.furniture for k, r in got.items()}
    found = {r.page_id: r.band for r in P.bands(P.analyse(df, model), R.ReadingModel(model.contents)).collect()}
    assert found[0] == "basic" and found[1] == "standard" and found[2] == "advanced"
    assert P.analyse(df.limit(0), model).count() == 0


def test_lines_are_counted_over_all_pages(spark):
    side = "Green   pages of Stosk"
    rows = [(i, f"https://Tail{i % 3}.example/{i}", "t", "\n".join([f"Own line {i}", side if i < 12 else "Other", *(["Rare one"] if i < 9 else [])]), i) for i in range(60)]
    rows += [(200 + k, f"https://tail0.example/{k}", "t", "One line", 0) for k in range(90)] + [(0, "https://tail0.example/0", "t", rows[0][3], k) for k in range(70, 80)] + [(300, None, None, None, 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, title string, body_text string, ingested_at bigint")
    sample = df.where("page_id = 0 and ingested_at = 0 or page_id = 40")
    # of the sample's two pages no line is repeated; of all pages of their hosts two are, the rare one on three of twenty
    assert P.repeated_on_hosts(df, sample) == ({"tail0.example": {"Green pages of Stosk"}, "tail1.example": {"Other"}}, {"tail0.example": 20, "tail1.example": 20})
    whole = df.where("page_id < 60 and ingested_at < 60")
    assert P.repeated_on_hosts(whole.drop("ingested_at"), whole)[0] == B.repeated_lines([(f"tail{i % 3}.example", r[3]) for i, r in enumerate(rows[:60])])
    assert P.repeated_on_hosts(df, df.limit(0)) == ({}, {})


def test_the_sample_is_chosen_in_the_executors(spark):
    """What reaches the driver is the chosen rows, however many partitions there are."""
    df = spark.range(4000).selectExpr("id as page_id", "repeat('text ', 200) as body_text", "id as ingested_at")
    few, many = (P.sampled(df.repartition(n), 50, "length(body_text) > 0") for n in (3, 60))
    assert {r.page_id for r in few.collect()} == {r.page_id for r in many.collect()} and few.count() == 50
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" in plan and "LeftSemi" in plan and plan.index("LeftSemi") < plan.index("GlobalLimit")  # the limit is below the join, on ids alone


def test_hosts_of_other_sites_are_labelled_as_well():
    """Trained on the pages of some hosts, the labeller finds the furniture of a host it has never met."""
    rows = site(160, 1)
    known = [r for r in rows if r[0] not in ("h4.example", "h5.example")]
    fitted = P.PageModel([r[:3] for r in known])
    new = [r for r in rows if r[0] in ("h4.example", "h5.example")]
    got = P.read(fitted.labeller, fitted.residue, [(t, text) for _, t, text, _ in new])
    right = sum(len(set(g[1]) & set(e[3])) for g, e in zip(got, new))
    assert right / sum(len(g[1]) for g in got) > 0.95 and right / sum(len(e[3]) for e in new) > 0.95


def test_models_fit_on_nothing(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, title string, body_text string")
    fitted = P.fit(empty)
    one = spark.createDataFrame([(1, "A page", "First line of a text.\nBack to top")], "page_id bigint, title string, body_text string")
    assert P.analyse(one, fitted).count() == 1
    assert R.ReadingModel([]).grade("The cat sat on the mat.") >= 0


def test_prose_in_a_language_the_sample_lacks_is_no_notice():
    fitted = ResidueModel([*PLAIN, *EASY, HARD] * 8, ["Back to top"] * 4)
    foreign = "Pieni kissa istuu ikkunalla ja katselee lintuja pihalla.\nIllalla perhe syö keittoa ja leipää keittiön pöydän ääressä.\nTalvella järvi jäätyy, ja lapset luistelevat aamusta iltaan."
    assert fitted.judge("Kissa", foreign, foreign) == ""


def corpus(spark, rows):
    return spark.createDataFrame([(i, f"https://{r[0]}/{i}", r[1], r[2], 404 if len(r[2]) < 60 else 200) for i, r in enumerate(rows)], "page_id bigint, url string, title string, body_text string, status_code int")


def test_residue_models_are_counted_over_all_pages(spark, monkeypatch):
    """Six pages train the labeller, but the lines of every page are in the models, weighed as the usual number of pages."""
    rows = [*site(60, 4), *(("h0.example", "T", f"Sorry, the shelf {k} is bare.\nCome back later.") for k in range(8))]
    fitted = P.fit(corpus(spark, rows).repartition(5), limit=6)
    fixed = ResidueModel([], []).models.total
    own = [[x for x, q in zip(B.blocks(r[2])[0], side) if not q] for r, side in zip(rows, P.predicted(fitted.labeller, [(r[1], r[2]) for r in rows]))]
    signs = lambda lines: sum(len(" ".join(x.split())) for x in lines)
    assert fitted.residue.models.total[0] - fixed[0] == pytest.approx(sum(signs(x) for x in own[:60]), rel=1e-3)
    # pages of a failure's status that read as notices count once for all and once for the failed
    assert fitted.residue.models.total[3] - fixed[3] in [pytest.approx(2 * k * signs(own[60]), rel=1e-3) for k in range(9)]
    monkeypatch.setattr(P, "RESIDUE_PAGES", 34)
    half = P.residue_model(fitted.labelled).models.total
    assert half[0] - fixed[0] == pytest.approx((fitted.residue.models.total[0] - fixed[0]) / 2, rel=1e-3)
    again = P.residue_model(fitted.labelled.repartition(9)).models.counts
    assert np.array_equal(again, P.residue_model(fitted.labelled).models.counts)


def test_the_reading_model_is_counted_over_all_texts(spark, monkeypatch):
    texts = ["\n".join(page(np.random.default_rng(k), kind)) for k, kind in enumerate(["easy", "plain", "hard"] * 40)]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "page_id bigint, content string, n_lines int")
    fitted, here = P.reading_model(P.graded(df.repartition(4))), R.ReadingModel(texts)
    assert fitted.known == here.known and np.array_equal(fitted.model.total, here.model.total) and np.array_equal(fitted.model.counts, here.model.counts)
    assert np.abs(np.array(fitted.grades(texts)) - here.grades(texts)).max() < 0.7
    again = P.reading_model(P.graded(df.repartition(7)))
    assert np.array_equal(again.y, fitted.y) and np.array_equal(again.weights, fitted.weights)
    monkeypatch.setattr(R, "USUAL_TEXTS", 60)
    half = P.reading_model(P.graded(df))
    fixed = CharModels([R.EASY * 3]).total[0]
    assert half.known <= here.known and half.model.total[0] - fixed == pytest.approx((here.model.total[0] - fixed) / 2, rel=1e-3)
    assert P.reading_model(P.graded(df.limit(0))).grade("The cat sat on the mat.") >= 0
