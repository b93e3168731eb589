"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

One weight vector over hashed text features serves every grade; ordered thresholds cut its score:
P(grade >= k) = 1 / (1 + exp(threshold_k - score)).  A document's score is the mean over its words of what
each word's features weigh, so words once met are looked up, and texts of any length are read whole.  With
``marking``, one more feature is not divided by the length: whether the words that mark middle grades and occur
in the text are evidence enough together, each by the log odds of its rated texts.
The model is fitted on the driver from a bounded sample of ratings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm._common import text_or_empty
from binloom.llm._tokens import forget

#: Hashed features: the words', the shapes' and the repetition's share one table.
DIMENSIONS = 1 << 15
#: Ratings that the model is fitted on at most: those with the least hash of their doc_id.
SAMPLE_RATINGS = 4096
#: Words that a Python worker remembers.
REMEMBERED_WORDS = 250_000
#: A word marks middle grades if at least so many of their rated texts have it, and at least this share of the texts with
#: it, poor ones aside, are of middle grades.  A text is marked if the log odds of its distinct marking words sum up to this.
MARK_TEXTS, MARK_SHARE, MARK_EVIDENCE = 4, 0.8, 3.5
#: A document is kept if its grade is at least this one with at least this probability.
LEAST_GRADE, LEAST_TAIL = 1, 0.5
STEPS, RATE, RIDGE = 250, 0.1, 1e-4
SEED = 20240601

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_REPEATED = xxhash.xxh3_64_intdigest(b"repeated") % DIMENSIONS
_MARKED, _WIDTH = DIMENSIONS, DIMENSIONS + 1  # a place of its own after the hashed ones


def _shape(word: str) -> str:
    """Runs of letters become a, A or Aa, runs of digits 0; other characters stay."""
    named = _LETTERS.sub(lambda m: "a" if m[0].islower() else "A" if m[0].isupper() and len(m[0]) > 1 else "Aa", word)
    return _DIGITS.sub("0", named)


def word_features(word: str) -> tuple[int, int]:
    digest = xxhash.xxh3_64_intdigest
    return digest(b"w" + word.lower().encode()) % DIMENSIONS, digest(b"s" + _shape(word).encode()) % DIMENSIONS


def word_key(word: str) -> int:
    """A signed 64-bit hash of a word's letters and digits in lower case."""
    return xxhash.xxh3_64_intdigest("".join(filter(str.isalnum, word.lower())).encode()) - (1 << 63)


_NO_WORD = word_key("")


def marking_words(keys: list[np.ndarray], grades: np.ndarray, top: int) -> dict[int, float]:
    """Keys of the words that mark middle grades and their log odds, from the distinct keys of each rated text."""
    middle = [k for k, g in zip(keys, grades, strict=True) if 0 < g < top]
    if not middle:
        return {}
    found, n = np.unique(np.concatenate(middle), return_counts=True)
    often = (n >= MARK_TEXTS) & (found != _NO_WORD)
    found, n = found[often], n[often]
    good = [k for k, g in zip(keys, grades, strict=True) if g == top]
    every = np.concatenate([*good, found[:0]])
    others = np.bincount(np.searchsorted(found, every[np.isin(every, found)]), minlength=len(found))
    marks = n >= MARK_SHARE * (n + others)
    return dict(zip(found[marks].tolist(), np.log((n[marks] + 0.5) / (others[marks] + 0.5)).tolist(), strict=True))


def is_marked(keys: set[int], marks: dict[int, float]) -> bool:
    return sum(marks[k] for k in sorted(keys)) >= MARK_EVIDENCE


class _Features(dict):
    def __missing__(self, word: str):
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = word_features(word)
        return value


def text_features(text: str, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text: counts for each of its words; none for a text without words."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    found = np.array([known[w] for w in words], dtype=np.int32).ravel()
    repeats = sum(map(str.__eq__, words, words[1:]))
    numbers, counts = np.unique(np.concatenate([found, np.full(repeats, _REPEATED, np.int32)]), return_counts=True)
    return numbers, (counts / len(words)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # rising; number k is the least grade k + 1's
    marks: dict[int, float] = field(default_factory=dict)  # keys of the words that mark middle grades, and their log odds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -50, 50)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int, marks: dict[int, float] | None = None) -> Model:
    """Maximum likelihood with a ridge, by Adam on all rows; the gaps between thresholds are exponentials."""
    grades = np.asarray(grades, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(n) for n, _ in rows])
    numbers, values = np.concatenate([n for n, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
    shares = np.array([(np.sum(grades >= k) + 0.5) / (len(grades) + 1) for k in range(1, top + 1)])
    start = -np.log(shares / (1 - shares))
    theta = np.concatenate([np.zeros(_WIDTH), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, cuts = theta[:_WIDTH], np.cumsum(np.concatenate([theta[_WIDTH : _WIDTH + 1], np.exp(theta[_WIDTH + 1 :])]))
        score = np.bincount(owner, values * w[numbers], minlength=len(rows))
        bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
        # P(grade) = s(score - low) - s(score - high); its log's derivative by low and by high
        low, high = bounds[grades], bounds[grades + 1]
        a, b = np.where(np.isinf(low), 1.0, _sigmoid(score - low)), np.where(np.isinf(high), 0.0, _sigmoid(score - high))
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        by_score = -(da - db) / len(rows)
        grad = np.empty_like(theta)
        grad[:_WIDTH] = np.bincount(numbers, values * by_score[owner], minlength=_WIDTH) + RIDGE * w
        by_cut = np.zeros(top + 2)
        np.add.at(by_cut, grades, da / len(rows))
        np.add.at(by_cut, grades + 1, -db / len(rows))
        later = np.cumsum(by_cut[1 : top + 1][::-1])[::-1]
        grad[_WIDTH:] = later * np.concatenate([[1.0], np.exp(theta[_WIDTH + 1 :])])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:_WIDTH].astype(np.float32), np.cumsum(np.concatenate([theta[_WIDTH : _WIDTH + 1], np.exp(theta[_WIDTH + 1 :])])), marks or {})


def _featured(marking: bool):
    def run(batches):
        known = _Features()
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            found = [text_features(x, known) for x in texts]
            keys = [sorted({word_key(w) for w in {*x.split()}}) if marking else [] for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.array([n for n, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32())), pa.array(keys, pa.list_(pa.int64()))],
                ["grade", "numbers", "values", "keys"],
            )

    return run


def fit(docs: DataFrame, ratings: DataFrame, top: int, sample: int = SAMPLE_RATINGS, marking: bool = False) -> Model | None:
    """The model for ratings (doc_id, grade 0 to ``top``) of ``docs``; None where no rating meets a text.

    Rows without doc_id or grade are left out; of rows that share a rated doc_id the last by text counts, once.
    At most ``sample`` ratings are used, so the table that is broadcast and the features that come to the
    driver are bounded whatever the size of the corpus.  With
    ``marking`` the words that mark middle grades are sought among them, however rare they are in a text.
    """
    usable = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").select("doc_id", F.col("grade").cast("int").alias("grade"))
    chosen = usable.withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).orderBy("h", "doc_id", "grade").limit(sample)
    met = docs.select("doc_id", text_or_empty().alias("_text")).join(F.broadcast(chosen), "doc_id")
    texts = met.groupBy("doc_id", "h", "grade").agg(F.max("_text").alias("_text")).select("grade", "_text")  # copies of a rated row are one
    table = texts.mapInArrow(_featured(marking), "grade int, numbers array<int>, values array<float>, keys array<long>").toArrow()
    rows = [(np.asarray(n.values), np.asarray(v.values)) for n, v in zip(table.column("numbers"), table.column("values"), strict=True)]
    order = sorted((i for i, r in enumerate(rows) if len(r[0])), key=lambda i: (len(rows[i][0]), rows[i][0].tobytes(), rows[i][1].tobytes(), table.column("grade")[i].as_py()))
    if not order:
        return None
    grades = np.clip([table.column("grade")[i].as_py() for i in order], 0, top)
    if not marking:
        return fit_rows([rows[i] for i in order], grades, top)
    keys = [np.asarray(table.column("keys")[i].values) for i in order]
    marks = marking_words(keys, grades, top)
    marked = [is_marked(marks.keys() & k.tolist(), marks) for k in keys]
    rows = [(np.append(rows[i][0], _MARKED), np.append(rows[i][1], 1.0)) if m else rows[i] for i, m in zip(order, marked, strict=True)]
    return fit_rows(rows, grades, top, marks)


class _Scorer:
    """Scores of texts, with the weights of words met before at hand."""

    def __init__(self, model: Model | None, top: int):
        forget()
        self.model, self.top = model, top
        self.weights = model.weights.astype(np.float64).tolist() if model else []
        self.known: dict[str, float] = {}
        self.marking: dict[str, int] = {}  # those of the known words that mark middle grades, and their keys

    def __call__(self, texts: list[str]) -> tuple[list[float], np.ndarray]:
        """The score of each text, and its tail probabilities."""
        scores, blank = [], []
        for text in texts:
            words = text.split()
            blank.append(not words)
            if not words or self.model is None:
                scores.append(0.0)
                continue
            known, weights = self.known, self.weights
            fresh = {w for w in words if w not in known}
            if len(known) + len(fresh) > REMEMBERED_WORDS:
                known.clear()
                self.marking.clear()
                fresh = set(words)
            for w in fresh:
                a, b = word_features(w)
                known[w] = weights[a] + weights[b]
            if self.model.marks:
                keyed = ((w, word_key(w)) for w in fresh)
                self.marking.update((w, k) for w, k in keyed if k in self.model.marks)
            found = {self.marking[w] for w in self.marking.keys() & words}
            marked = weights[_MARKED] if is_marked(found, self.model.marks) else 0.0
            repeats = sum(map(str.__eq__, words, words[1:]))
            scores.append((sum(map(known.__getitem__, words)) + repeats * weights[_REPEATED]) / len(words) + marked)
        tails = self.model.tails(np.array(scores)) if self.model else np.ones((len(scores), self.top))
        tails[np.array(blank, dtype=bool)] = 0.0
        return scores, tails


def _scored(model: Model | None, top: int):
    def run(batches):
        scorer = _Scorer(model, top)
        for batch in batches:
            scores, tails = scorer(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(tails.sum(axis=1), pa.float64()), pa.array(list(tails), pa.list_(pa.float64()))],
                ["doc_id", "score", "expected_grade", "tails"],
            )

    return run


def _accepted(model: Model | None, top: int, grade: int, tail: float):
    def run(batches):
        scorer = _Scorer(model, top)
        for batch in batches:
            _, tails = scorer([x or "" for x in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(tails[:, grade - 1] >= tail, pa.bool_()))

    return run


def score(docs: DataFrame, model: Model | None, top: int) -> DataFrame:
    """Rows doc_id, score, expected_grade, tails (P(grade >= 1), ...), one for each row of ``docs``.

    A null, empty or blank text has nothing to judge: all its tails are 0.  Without a model all others are
    1.  Null doc_ids and repeated rows are scored like any; an empty table gives no rows.
    """
    texts = docs.select("doc_id", text_or_empty().alias("_text"))
    return texts.mapInArrow(_scored(model, top), "doc_id long, score double, expected_grade double, tails array<double>")


def selected(scores: DataFrame, grade: int = LEAST_GRADE, tail: float = LEAST_TAIL) -> DataFrame:
    """Adds accepted: whether P(grade >= ``grade``) is at least ``tail``."""
    return scores.withColumn("accepted", F.element_at("tails", grade) >= tail)


def accepted(docs: DataFrame, model: Model | None, top: int, grade: int = LEAST_GRADE, tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of ``docs``, all columns, that ``selected`` would accept; one pass, nothing is joined."""
    return docs.mapInArrow(_accepted(model, top, grade, tail), docs.schema)


def document_grades(labels: DataFrame) -> DataFrame:
    """Grades of documents from their two labels: 0 poor, 1 fair text but toxic, 2 good; a null toxic is 0."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
