import numpy as np

from sitelens.llm import subjects as S

TERMS = {"sport": ["referee", "striker", "stadium", "goalkeeper", "medal", "relay", "coach"], "law": ["verdict", "plaintiff", "statute", "lawsuit", "bail", "judge", "clause"], "food": ["garlic", "broth", "dough", "spice", "stew", "noodle", "vinegar"]}
NAMES = sorted(TERMS)


def sentence(rng, subject=None):
    if subject is None:
        return str(rng.choice(["There is more to say, but that can wait.", "A short summary is given at the end.", "This text was last changed long ago.", "Thanks to all for the pictures."]))
    a, b = rng.choice(TERMS[subject], 2)
    return str(rng.choice(["Without the {0}, there would be no {1} and no reason for it.", "This page explains the {0} and the {1} of the day.", "Once you have a {0}, the {1} becomes easier to understand."])).format(a, b)


def document(rng, subjects):
    n = int(rng.integers(10, 20))
    parts = [sentence(rng) for _ in range(n // 4)]
    for k in range(n - len(parts)):
        parts.append(sentence(rng, subjects[k % len(subjects)]) if subjects else sentence(rng))
    if rng.random() < 0.3:
        parts.append(sentence(rng, str(rng.choice(NAMES))))
    rng.shuffle(parts)
    return " ".join(parts)


def made(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        k = int(rng.choice([0, 1, 1, 1, 2]))
        labels = sorted(str(s) for s in rng.choice(NAMES, k, replace=False))
        out.append((document(rng, labels), labels))
    return out


def trained(n=300, wrong=0.05):
    rng = np.random.default_rng(8)
    rows = [r for r in made(n, 1) if r[1]]
    labels = [[str(rng.choice(NAMES))] if rng.random() < wrong else y for _, y in rows]
    return S.SubjectModel(NAMES, [t for t, _ in rows], ["blog"] * len(rows), np.array([[float(n in y) for n in NAMES] for y in labels]), [t for t, _ in made(100, 2)])


def test_held_out_accuracy():
    model = trained()
    test = made(300, 3)
    assert np.mean([model.decode(t, "blog")[0] == y for t, y in test]) > 0.93


def test_misread_letters_and_odd_texts():
    assert S.repaired("FuÃŸball fÃ¼r alle, Â© Ã©tÃ©") == "Fußball für alle, © été"
    assert S.repaired("Ärger bleibt, 100 %") == "Ärger bleibt, 100 %"
    model = trained(60)
    for text in ("", "...", "12 34", "x" * 100_000, "word. " * 20_000):
        assert model.decode(text, None)[0] == []


def test_without_labels_nothing_is_claimed():
    model = S.SubjectModel(NAMES, [], [], np.zeros((0, 3)), [])
    assert model.decode("This page explains the referee.", "blog")[0] == []


def test_classify_and_fit_in_spark(spark):
    rows = made(150, 4)
    docs = spark.createDataFrame([(i, t, "blog", "other") for i, (t, _) in enumerate(rows)] + [(999, None, None, None), (1000, "", None, None)], "doc_id bigint, text string, source string, subjects string")
    labels = spark.createDataFrame([(i, y, "ann") for i, (_, ys) in enumerate(rows) for y in ys] + [(0, "unknown", "ann"), (None, "law", "ann")], "doc_id bigint, subject string, annotator string")
    subjects = spark.createDataFrame([(n, "") for n in NAMES], "subject string, about string")
    got = {r.doc_id: r.subjects for r in S.classify(docs, S.fit(docs, labels, subjects)).collect()}
    assert len(got) == 152 and got[999] == got[1000] == []
    assert np.mean([got[i] == y for i, (_, y) in enumerate(rows)]) > 0.9
    assert S.classify(docs.limit(0), S.fit(docs, labels.limit(0), subjects)).count() == 0


def test_texts_of_a_batch_are_decoded_as_they_are_alone():
    model = trained(120)
    test = [t for t, _ in made(40, 6)] + ["", "no term of any subject"]
    together, shares = model.decode_all(test, ["blog", None] * 21)
    for k, text in enumerate(test):
        alone, share = model.decode(text, ["blog", None][k % 2])
        assert alone == together[k] and np.allclose(share, shares[k]) and len(alone) <= S.MOST
    assert model.decode_all([], [])[0] == []


def test_a_sentence_of_a_part_of_the_texts_is_the_same_sentence():
    whole = S.flat(["one two. three four five.", "", "six seven."])
    part = whole.of(np.array([0, 2]))
    assert part.count.tolist() == [2, 1] and part.size.tolist() == whole.size.tolist() and part.terms.tolist() == whole.terms.tolist()
    assert whole.text.tolist() == [0, 0, 2] and whole.of(np.array([1])).terms.size == 0


def test_beam_equals_all_combinations():
    """With two labels at most and a beam of six over three subjects the beam finds the likeliest of all combinations."""
    import itertools

    model = trained(200)
    test = [t for t, _ in made(30, 12)]
    docs = S.flat(test)
    shares = model.terms.shares(docs)
    shape = S.structure(test, docs.count, ["blog"] * len(test), model.sources)
    got, _ = model.decode_all(test, ["blog"] * len(test))
    for i in range(len(test)):
        best = (-np.inf, ())
        for combo in itertools.chain.from_iterable(itertools.combinations(range(3), n) for n in range(3)):
            if any(shares[i, s] <= 0 for s in combo):
                continue
            log = 0.0
            for at, s in enumerate(model.order):
                before = np.array([float(t in combo) for t in model.order[:at]]) * S.CHAIN_SCALE
                x = np.concatenate([model._features(shares[[i]], shape[[i]], s)[0], before, [1.0]])
                slope, shift = model.calibration[at]
                z = slope * (x @ model.chain[at]) + shift
                log -= np.logaddexp(0, -z if s in combo else z)
            best = max(best, (log, combo))
        assert got[i] == sorted(model.subjects[s] for s in best[1])
