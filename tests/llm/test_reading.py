import random

import numpy as np

import pytest

pytest.importorskip("tidelog.llm")
from tidelog.llm import reading  # noqa: E402

EASY = ["it is red", "we like it", "it came in may", "my son has one", "it is quick and fine"]
HARD = ["notwithstanding the ambiguities of the accompanying specification it demonstrates a disproportionate improvement", "contemporary evaluations insofar as they differentiate presuppose elevated humidity", "were one to grant as the maker would have us do that the strap failed"]
LEICHT = ["es ist rot", "wir mögen es", "es kam im mai", "es ist gut"]
SCHWER = ["ungeachtet der enthaltenen zusicherungen offenbart die konstruktion eine abweichung", "sofern man die entwicklung nicht als nachrangig betrachtet ergibt sich eine anfälligkeit"]


def corpus(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(["en", "en", "de"])
        easy, hard = (EASY, HARD) if lang == "en" else (LEICHT, SCHWER)
        is_hard = rng.random() < 0.4
        k = rng.randrange(3, 7)
        ss = [rng.choice(hard if (is_hard and j < k - 1) else easy) for j in range(k)]
        rng.shuffle(ss)
        yield i, ". ".join(ss) + ".", lang, is_hard


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = list(corpus(1, 240))
    docs = spark.createDataFrame([(i, t, rng.choice([la, la, la.upper(), f"{la}-XX"])) for i, t, la, _ in rows], "doc_id long, text string, lang string")
    labels = [(i, g, min(5, max(1, (4 if h else 2) + rng.choice([0, 0, 1, -1]) * (rng.random() < 0.3)))) for i, _, _, h in rows for g in ("g1", "g2")]
    labels += [labels[0], (1, None, None), (None, "g1", 3), (2, "g3", 9), (99999, "g1", 3)]
    return reading.fit(docs, spark.createDataFrame(labels, "doc_id long, grader string, grade_level int"))


def test_held_out_texts(spark, model):
    rows = list(corpus(2, 200))
    right = sum((model.level(t)[0] >= 4) == h for _, t, _, h in rows)
    assert right >= 196
    assert sum(model.level(t)[2] == la for _, t, la, _ in rows) >= 198


def test_dirty_texts(spark, model):
    texts = [(1, None), (2, ""), (3, "とても使いやすいです。また買いたいと思います。"), (4, "qqq www xxx"), (5, HARD[0].upper() + ";" + HARD[1]), (5, EASY[0]), (6, ". ".join(EASY * 3 + HARD[:1])), (7, "<br>".join(HARD))]
    df = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, level int")
    got = reading.reading_levels(df, model).collect()
    assert len(got) == len(texts)
    assert {r.doc_id for r in got if r.level is None} == {1, 2, 3, 4}
    assert {r.doc_id for r in got if r.level and r.level >= 4} == {5, 7}
    assert sorted(r.level < 4 for r in got if r.doc_id == 5) == [False, True]


def test_nothing_to_fit_on(spark):
    docs = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    empty = reading.fit(docs, spark.createDataFrame([], "doc_id long, grader string, grade_level int"))
    assert [r.level for r in reading.reading_levels(docs, empty).collect()] == [None]
    assert reading.reading_levels(docs.limit(0), empty).count() == 0


def test_acquisition_and_calibration():
    texts = {g: 10 for g in reading.GRADES}
    assert reading.acquisition_grade({1: 10, 2: 10, 3: 10, 4: 10, 5: 10}, texts) == pytest.approx(3.0)
    assert reading.acquisition_grade({5: 3}, texts) == pytest.approx(5.0)
    assert reading.acquisition_grade({1: 4}, texts) == pytest.approx(1.0)
    cuts = reading.calibrate([(1.0, 1), (2.0, 2), (3.0, 3), (4.0, 4), (5.0, 5)])
    assert cuts == [1.5, 2.5, 3.5, 4.5]
    noisy = reading.calibrate([(2.8, 3), (2.9, 4), (3.0, 3), (3.1, 3), (4.4, 4), (4.5, 3), (4.6, 5), (4.7, 5)])
    assert 3.1 < noisy[2] < 4.4


def test_texts_together_and_alone_have_the_same_level(model, monkeypatch):
    texts = [t for _, t, _, _ in corpus(4, 60)] + [None, "", "qqq", "とても使いやすいです。"]
    alone = [model.level(t) for t in texts]
    assert model.levels(texts) == alone
    monkeypatch.setattr(reading, "PIECE", 40)
    assert model.levels(texts) == alone


def test_no_known_word_is_left_out():
    """Sentences with few known words are read together with their neighbours, within their text."""
    joined = reading.ReadingModel._joined
    texts = [0, 0, 0, 0, 1, 2, 2, 2]
    assert joined(np.array([9, 1, 2, 5, 1, 6, 7, 2]), np.array(texts)).tolist() == [0, 1, 1, 1, 2, 3, 4, 4]
    assert joined(np.array([1, 1, 1]), np.array([0, 0, 0])).tolist() == [0, 0, 0]
    assert joined(np.array([5, 1, 1, 4]), np.array([0, 0, 0, 1])).tolist() == [0, 0, 0, 1]


def test_short_hard_sentences_count(model):
    rare = HARD[0].split()
    assert model.level(". ".join(rare))[0] >= 4  # a word a sentence


@pytest.mark.parametrize("seed", range(10))
def test_quantiles_equal_numpy(seed):
    rng = np.random.default_rng(seed)
    group, values = rng.integers(0, 9, 60), rng.random(60).round(1)
    got = reading._quantiles(values, group, 10, reading.QUANTILES)
    for g in range(10):
        want = np.quantile(values[group == g], reading.QUANTILES) if (group == g).any() else [np.nan] * len(reading.QUANTILES)
        assert got[g] == pytest.approx(want, nan_ok=True)


def test_each_level_takes_the_quantile_that_tells_it():
    rng = random.Random(5)
    scored = [([1.0 + (g >= 3) + rng.random() * 0.1, 3.0 * rng.random()], g) for g in rng.choices([1, 2, 3, 4, 5], k=300)]
    assert reading.calibrate_quantiles(scored, (0.4, 0.9))[1][0] == 0.4
    assert 1.1 <= reading.calibrate_quantiles(scored, (0.4, 0.9))[1][1] <= 2.0
