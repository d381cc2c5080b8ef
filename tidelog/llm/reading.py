"""Reading level of texts, from the grades at which words are acquired."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.text import mostly_cjk, sentence_bytes
from tidelog.session import parallelism, small_side, spread_out

GRADES = (1, 2, 3, 4, 5)
#: Graded texts that the model is fitted on at most (picked by hash of the id), their length at most in characters, and texts a word must
#: stand in. The two bounds bound what is counted and broadcast; every text of any length is scored.
FIT_DOCS, FIT_CHARS, SUPPORT = 20_000, 5_000, 3
#: Part of a word's graded occurrences at which it counts as acquired. Quantiles of a sentence's known-word grades of which the fit picks one for each level.
ACQUIRED, QUANTILES = 0.5, (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: A sentence with fewer known words than this is read together with the next one (the last one with that before it).
KNOWN_WORDS = 4
#: Graded texts of other languages that stand in for missing ones, in texts.
PRIOR = 5.0
#: Words of texts that are scored together.
PIECE = 500_000

# Names of the languages in the column lang.
_LANGUAGES = {"eng": "en", "deu": "de", "ger": "de", "spa": "es", "fra": "fr", "fre": "fr", "jpn": "ja"}


def language_name(lang: str | None) -> str:
    """Two letters: en for EN, en-GB, eng. Unknown or null: the empty text."""
    name = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    return _LANGUAGES.get(name, name if len(name) == 2 else "")


def units(sentence: list[bytes]) -> set[bytes]:
    """Words of a sentence, alone and with the word after them (nesting shows in how plain words follow each other)."""
    return {*sentence, *(b"%b %b" % pair for pair in zip(sentence, sentence[1:]))}


def acquisition_grade(by_grade: dict[int, float], texts: dict[int, float], at: float = ACQUIRED) -> float:
    """Grade by which the share `at` of a word's occurrences has come, each grade weighing the same."""
    rates = [by_grade.get(g, 0) / texts[g] if texts.get(g) else 0.0 for g in GRADES]
    total, before = sum(rates), 0.0
    if not total:
        return float(GRADES[0])
    for g, r in zip(GRADES, rates):
        if r and before + r >= at * total:
            return g - 0.5 + (at * total - before) / r
        before += r
    return GRADES[-1] + 0.5


def _quantiles(values: np.ndarray, group: np.ndarray, groups: int, at: tuple[float, ...]) -> np.ndarray:
    """Quantiles (a column each) of the values of each group, between neighbours in proportion; nan for groups without values."""
    order = np.lexsort((values, group))
    v = values[order]
    n = np.bincount(group, minlength=groups)
    first = np.cumsum(n) - n
    out = np.full((groups, len(at)), np.nan)
    some = np.flatnonzero(n)
    for k, q in enumerate(at):
        place = q * (n[some] - 1)
        low = np.floor(place).astype(np.int64)
        x, y = v[first[some] + low], v[first[some] + np.minimum(low + 1, n[some] - 1)]
        out[some, k] = x + (y - x) * (place - low)
    return out


@dataclass
class ReadingModel:
    """What is known about words, by numbers. A grade is nan where a language does not know the word or pair.

    languages: their names; numbers: word -> number (from 1); votes: by word and language, share; grades: by language and word; pairs: numbers of
    two words in succession, in one, sorted; pair_grades: by language and pair; cuts: of levels 2 to 5, quantile of a sentence and score at which it begins.
    """

    languages: list[str] = field(default_factory=list)
    numbers: dict[bytes, int] = field(default_factory=dict)
    votes: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    grades: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_grades: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    cuts: list[tuple[float, float]] = field(default_factory=lambda: [(0.5, g - 0.5) for g in GRADES[1:]])

    def scores(self, texts: Iterable[str | None], at: tuple[float, ...] = (0.5,)) -> tuple[np.ndarray, list[str]]:
        """By text, the median over its sentences of a quantile of a sentence's known-word grades (a column for each of `at`), and its language.

        nan and the empty text for null, empty, Chinese and Japanese texts and ones without known words.
        """
        texts = list(texts)
        out, named = np.full((len(texts), len(at)), np.nan), [""] * len(texts)
        places: list[int] = []
        split: list[list[list[bytes]]] = []
        held = 0
        for place, t in enumerate(texts):
            if t and not mostly_cjk(t) and (found := sentence_bytes(t)):
                places.append(place)
                split.append(found)
                held += sum(map(len, found))
            if split and (held >= PIECE or place + 1 == len(texts)):
                self._score(places, split, at, out, named)
                places, split, held = [], [], 0
        if split:
            self._score(places, split, at, out, named)
        return out, named

    def _score(self, places: list[int], split: list[list[list[bytes]]], at: tuple[float, ...], out: np.ndarray, named: list[str]) -> None:
        if not self.languages:
            return
        of_text = np.repeat(np.arange(len(split)), [len(d) for d in split])
        sizes = np.array([len(s) for d in split for s in d])
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        word = np.fromiter((n for d in split for s in d for n in map(self.numbers.get, s, repeat(0))), np.int64, len(sentence))
        text = of_text[sentence]
        first = np.searchsorted(text, np.arange(len(split)))
        votes = np.add.reduceat(self.votes[word], first, axis=0)
        language = votes.shape[1] - 1 - votes[:, ::-1].argmax(axis=1)  # of equal ones the last by name
        here = language[text]
        follows = np.flatnonzero((sentence[1:] == sentence[:-1]) & (word[1:] > 0) & (word[:-1] > 0))
        pair = word[follows] * len(self.votes) + word[follows + 1]
        spot = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        known = self.pairs[spot] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        grade = np.concatenate([self.grades[here, word], self.pair_grades[here[follows[known]], spot[known]]])
        owner = np.concatenate([sentence, sentence[follows[known]]])
        real = ~np.isnan(grade)
        grade, owner = grade[real], owner[real]
        joined = self._joined(np.bincount(owner, minlength=len(sizes)), of_text)
        groups = int(joined[-1]) + 1
        text_of_group = np.zeros(groups, np.int64)
        text_of_group[joined] = of_text
        by_sentence = _quantiles(grade, joined[owner], groups, at)
        some = ~np.isnan(by_sentence[:, 0])
        for k in range(len(at)):
            out[places, k] = _quantiles(by_sentence[some, k], text_of_group[some], len(split), (0.5,))[:, 0]
        for n, place in enumerate(places):
            named[place] = self.languages[language[n]] if votes[n].any() else ""

    @staticmethod
    def _joined(known: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        """Number of the group in which each sentence is read: those with too few known words with the next ones, a text's last with the one before."""
        group, out, words, begun = -1, [], KNOWN_WORDS, -1
        for n, t in zip(known.tolist(), of_text.tolist()):
            if t != begun:
                if begun >= 0 and words < KNOWN_WORDS and group > first:  # the last group of the text before
                    out[len(out) - open_ :] = [group - 1] * open_
                    group -= 1
                begun, words, first, open_ = t, KNOWN_WORDS, group + 1, 0
            if words >= KNOWN_WORDS:
                group, words, open_ = group + 1, 0, 0
            out.append(group)
            words += n
            open_ += 1
        if begun >= 0 and words < KNOWN_WORDS and group > first:
            out[len(out) - open_ :] = [group - 1] * open_
        return np.array(out, np.int64)

    def levels(self, texts: Iterable[str | None]) -> list[tuple[int | None, float | None, str | None]]:
        """Level (the highest whose score is reached), score by the median and language of each text; all null if it has no known words."""
        at = tuple(dict.fromkeys([0.5, *(q for q, _ in self.cuts)]))
        scores, named = self.scores(texts, at)
        level = np.ones(len(scores), np.int64)
        for g, (q, cut) in zip(GRADES[1:], self.cuts):
            level[scores[:, at.index(q)] >= cut] = g
        return [(None, None, None) if np.isnan(s) else (int(n), float(s), name) for n, s, name in zip(level, scores[:, 0], named)]

    def level(self, text: str | None) -> tuple[int | None, float | None, str | None]:
        return self.levels([text])[0]


def _places(scored: list[tuple[float, int]], level: int) -> Iterator[tuple[int, float, float]]:
    """(graded texts on the wrong side, gap's ends) of every gap between scores in which a level may begin."""
    ordered = sorted(scored)
    wrong = sum(g < level for _, g in ordered)
    yield wrong, float(GRADES[0]) - 0.5, ordered[0][0] if ordered else 1.0
    for n, (s, g) in enumerate(ordered):
        wrong += 1 if g >= level else -1
        after = ordered[n + 1][0] if n + 1 < len(ordered) else GRADES[-1] + 0.5
        if after > s:
            yield wrong, s, after


def _chosen(places: list[tuple]) -> tuple:
    """The widest gap among those with few graded texts on the wrong side: as many as the best has, or more by one standard error (the root of
    that number), as graders err."""
    best = min(p[0] for p in places)
    return max((p for p in places if p[0] <= best + best**0.5), key=lambda p: (p[2] - p[1], -p[0]))


def calibrate(scored: list[tuple[float, int]]) -> list[float]:
    """Scores at which each level begins, never falling."""
    cuts: list[float] = []
    for level in GRADES[1:]:
        _, low, high = _chosen([*_places(scored, level)])
        cuts.append(max([float(low + high) / 2, *cuts[-1:]]))
    return cuts


def calibrate_quantiles(scored: list[tuple[list[float], int]], quantiles: tuple[float, ...]) -> list[tuple[float, float]]:
    """Of each level, the quantile that tells it best, and the score by that quantile at which the level begins."""
    found = []
    for level in GRADES[1:]:
        _, low, high, _, q = _chosen([(*p, -abs(q - 0.5), q) for k, q in enumerate(quantiles) for p in _places([(s[k], g) for s, g in scored], level)])
        found.append((q, float(low + high) / 2))
    return found


def build_model(counts: Iterable[tuple[bytes, str, int, int]], texts: dict[tuple[str, int], int]) -> ReadingModel:
    """counts: (word or pair, language, grade, texts it stands in); texts: (language, grade) -> graded texts. Cuts are not set yet."""
    by_unit: dict = defaultdict(lambda: defaultdict(dict))
    for w, lang, g, n in counts:
        by_unit[w][lang][g] = n
    every = {g: sum(n for (_, h), n in texts.items() if h == g) for g in GRADES}
    total = max(1, sum(every.values()))
    languages = sorted({x for x, _ in texts})
    weight = {lang: {g: texts.get((lang, g), 0) + PRIOR * every[g] / total for g in GRADES} for lang in languages}
    sizes = {lang: max(1, sum(n for (x, _), n in texts.items() if x == lang)) for lang in languages}
    numbers = {w: n + 1 for n, w in enumerate(sorted(w for w in by_unit if b" " not in w))}
    votes, grades = np.zeros((len(numbers) + 1, len(languages))), np.full((len(languages), len(numbers) + 1), np.nan)
    pairs: dict[int, np.ndarray] = {}
    for w, langs in by_unit.items():
        ends = w.split(b" ")
        found = np.full(len(languages), np.nan)
        for k, lang in enumerate(languages):
            c = langs.get(lang, {})
            if sum(c.values()) >= SUPPORT:
                found[k] = acquisition_grade(c, weight[lang])
        if len(ends) == 1:
            grades[:, numbers[w]] = found
            rate = np.array([sum(langs.get(lang, {}).values()) / sizes[lang] for lang in languages])
            votes[numbers[w]] = rate / (rate.sum() or 1)
        elif all(e in numbers for e in ends):
            pairs[numbers[ends[0]] * len(votes) + numbers[ends[1]]] = found
    keys = sorted(pairs)
    return ReadingModel(languages, numbers, votes, grades, np.array(keys, np.int64), np.array([pairs[k] for k in keys]).T.reshape(len(languages), len(keys)))


def text_grades(labels: DataFrame, doc_id: str, grader: str, grade: str) -> DataFrame:
    """(doc_id, grade): mean of the graders, each counted once with the mean of what they gave, rounded half up. Nulls are ignored."""
    each = labels.filter(F.col(doc_id).isNotNull() & F.col(grade).between(GRADES[0], GRADES[-1])).groupBy(doc_id, grader).agg(F.avg(grade).alias("g"))
    return each.groupBy(doc_id).agg(F.floor(F.avg("g") + 0.5).cast("int").alias("grade"))


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", grader: str = "grader", grade: str = "grade_level", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> ReadingModel:
    """Fit on at most fit_docs graded texts of at most fit_chars characters. Words are counted by tasks; the driver gets counts of words in SUPPORT texts or more.

    Texts without a known language, and Chinese and Japanese ones, do not take part. Without graded texts the model knows no word.
    """
    graded = text_grades(labels, doc_id, grader, grade).orderBy(F.xxhash64(doc_id), doc_id).limit(fit_docs)
    sample = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).alias("l")).join(small_side(graded.select(F.col(doc_id).alias("d"), "grade"), fit_docs), "d")
    sample = sample.filter(F.length("t").between(1, fit_chars)).select("t", "l", "grade").repartition(parallelism(documents.sparkSession))

    def occurrences(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: Counter = Counter()
            for t, la, g in zip(f["t"], f["l"], f["grade"]):
                name = language_name(la if isinstance(la, str) else None)
                if name and not mostly_cjk(t):
                    seen.update((u, name, int(g)) for u in {b"", *(u for s in sentence_bytes(t) for u in units(s))})  # the empty word counts texts
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["word", "lang", "grade", "n"])

    counted = sample.mapInPandas(occurrences, "word binary, lang string, grade int, n bigint").groupBy("word", "lang", "grade").agg(F.sum("n").alias("n"))
    common = counted.groupBy("word").agg(F.collect_list(F.struct("lang", "grade", "n")).alias("c"), F.sum("n").alias("total")).filter((F.col("total") >= SUPPORT) | (F.octet_length("word") == 0))
    rows = common.select("word", "c").collect()  # bounded by fit_docs and fit_chars
    texts = {(x.lang, x.grade): x.n for r in rows if not r.word for x in r.c}
    model = build_model(((bytes(r.word), x.lang, x.grade, x.n) for r in rows if r.word for x in r.c), texts)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scores(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = shared.value.scores(f["t"], QUANTILES)[0]
            yield pd.DataFrame({"scores": list(found), "grade": f["grade"]})[~np.isnan(found[:, 0])]

    scored = sample.mapInPandas(scores, "scores array<double>, grade int").collect()  # at most fit_docs rows
    model.cuts = calibrate_quantiles([(r.scores, r.grade) for r in scored], QUANTILES)
    return model


def reading_levels(documents: DataFrame, model: ReadingModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, level 1 to 5, score, language) of every whole text. Null, empty, Chinese and Japanese texts, and texts without known words, have null level.

    Repeated rows give repeated results; other columns are ignored. The texts are not shuffled; what is broadcast is bounded by the fit.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = shared.value.levels(t if isinstance(t, str) else None for t in f["t"])
            level, score, language = ([x[i] for x in found] for i in range(3))
            yield pd.DataFrame({"d": f["d"], "level": pd.array(level, dtype="Int32"), "score": pd.array(score, dtype="Float64"), "language": language})

    lean = spread_out(documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")))
    return lean.mapInPandas(run, f"d {dict(documents.dtypes)[doc_id]}, level int, score double, language string").withColumnRenamed("d", doc_id)
