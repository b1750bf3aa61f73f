"""Toxicity by a counterfactual-regularised classifier.

A linear classifier over the words of a sentence and their beginnings, fitted to document labels as a
multiple-instance problem: in each round the worst sentence of a document stands for it. The score of a document
weighs its worst sentence against the evidence of all its words and its length; these few weights are fitted to
scores of documents that the word weights had not seen. For every labelled sentence with an identity term there are counterfactuals in which
the term is swapped for others of its kind, and the squared change of the score is part of the loss; so a
group's name alone cannot make a sentence toxic, even where the labels are biased against it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from assaylake.llm._common import slices, with_columns

THRESHOLD = 0.7
#: Labelled documents of each class from which the classifier is fitted, about; the bound of the sample.
DOCS_PER_CLASS = 1600
#: How far a sample may exceed what is asked for, where rows repeat.
SAMPLE_SLACK = 2
#: The fit keeps the features that differ most between the classes, so many at most, from so many documents each at least.
MAX_FEATURES, LEAST_DOCS, LEAST_Z = 20_000, 3, 3.5
PREFIXES = (4, 5, 6, 7, 8)
COUNTERFACTUAL, RIDGE = 4.0, 3e-5
ROUNDS, STEPS = 6, 100
CACHE_WORDS = 150_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

#: Terms that name groups of people, by kind; the last one of each kind names no group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "females", "males", "transgender", "people"),
    ("woman", "man", "girl", "boy", "female", "male", "person"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists", "catholics", "people"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist", "catholic", "religious"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "single"),
    ("black", "white", "asian", "latino", "african", "arab", "european", "local"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens", "people"),
    ("disabled", "deaf", "blind", "elderly", "young", "old", "people"),
    ("femmes", "hommes", "filles", "gens"),
    ("musulmans", "juifs", "chrétiens", "immigrés", "gens"),
    ("frauen", "männer", "mädchen", "leute"),
    ("muslime", "juden", "christen", "ausländer", "leute"),
    ("mujeres", "hombres", "niñas", "gente"),
    ("musulmanes", "judíos", "cristianos", "inmigrantes", "gente"),
)


def sentences(text: str | None, known: dict[str, str] | None = None) -> list[tuple[str, ...]]:
    """The distinct words of each sentence in lower case; ``known`` lets texts share their strings."""
    same = {} if known is None else known
    return [tuple(same.setdefault(w, w) for w in found) for s in SENTENCE.split((text or "").lower()) if (found := sorted(set(WORD.findall(s))))]


def features(word: str) -> list[str]:
    """The word itself, and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


@dataclass
class ToxicityModel:
    """Feature weights and a bias of sentences, and the weights of the measures of a document."""

    weights: dict[str, float]
    bias: float
    document: tuple[float, ...] = (0.0, 1.0)

    def word_scores(self) -> WordScores:
        return WordScores(self.weights)


class WordScores(dict):
    """The summed weights of the features of words."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        get = self.weights.get
        value = self[word] = sum(get(f, 0.0) for f in features(word))
        return value


def measures(text: str | None, scores: WordScores, bias: float) -> list[float]:
    """1; the logit of the worst sentence; the positive word scores of the whole text, as a logarithm and for each
    root of its length; the length as a logarithm."""
    worst, total, words = 0.0, 0.0, 0
    for sentence in SENTENCE.split((text or "").lower()):
        found = WORD.findall(sentence)
        if found:
            words += len(found)
            worst = max(worst, sum(map(scores.__getitem__, set(found))))
            total += sum(s for s in map(scores.__getitem__, found) if s > 1.0)
    return [1.0, bias + worst, float(np.log1p(total)), total / (words + 20) ** 0.5, float(np.log1p(words))]


def score(text: str | None, scores: WordScores, model: ToxicityModel) -> float:
    """The score of a whole text, 0 to 1."""
    logit = sum(w * x for w, x in zip(model.document, measures(text, scores, model.bias), strict=False))
    return 1.0 / (1.0 + float(np.exp(-min(40.0, max(-40.0, logit)))))


def _select(docs: list[list[tuple[str, ...]]], labels: np.ndarray) -> list[str]:
    """Features whose document frequency differs between the classes beyond chance, and all identity terms."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for doc, label in zip(docs, labels, strict=True):
        seen[int(label)].update({f for w in set().union(*doc) for f in features(w)} if doc else ())
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    ranked = []
    for f in set(seen[0]) | set(seen[1]):
        a, b = seen[1][f], seen[0][f]
        if a + b < LEAST_DOCS:
            continue
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        # of few documents no z can be large; a feature of one class alone needs fewer
        if abs(z) >= LEAST_Z or a >= LEAST_DOCS and not b and n0 >= 2 * n1 and odds > 2:
            ranked.append((-abs(z), f))
    chosen = [f for _, f in sorted(ranked)[:MAX_FEATURES]]
    return list(dict.fromkeys([*chosen, *(t for kind in IDENTITY_TERMS for t in kind)]))


def _rows(groups: list[tuple[str, ...]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The sentences as a sparse matrix: row and column of each feature."""
    rows, columns = [], []
    known: dict[str, list[int]] = {}
    for i, words in enumerate(groups):
        for w in words:
            if w not in known:
                known[w] = [index[f] for f in features(w) if f in index]
            for column in known[w]:
                rows.append(i)
                columns.append(column)
    return np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64)


def train(texts: list[str | None], labels: list[int], counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    """Fit to labelled texts; with labels of one class alone the bias says so and no word has a weight."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, (3.0 if len(y) and y[0] else -3.0))
    known: dict[str, str] = {}
    docs = [sentences(t, known) for t in texts]
    del known
    fold = np.zeros(len(docs), dtype=np.int64)  # both folds have their share of either class
    for label in (0, 1):
        fold[y == label] = np.arange(int((y == label).sum())) % 2
    seen = np.zeros((len(docs), 5))
    for k in (0, 1):
        part = _train_sentences([d for d, f in zip(docs, fold, strict=True) if f != k], y[fold != k], counterfactual)
        scores = part.word_scores()
        seen[fold == k] = np.array([measures(t, scores, part.bias) for t, f in zip(texts, fold, strict=True) if f == k]).reshape(-1, 5)
    model = _train_sentences(docs, y, counterfactual)
    return ToxicityModel(model.weights, model.bias, _logistic(seen, y))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton steps, both classes with the same weight in all."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    scale = np.append(1.0, x[:, 1:].std(axis=0) + 1e-6)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hessian, z.T @ (weight * (p - y)) / len(y) + ridge * w), -2, 2)
    return tuple(float(v) for v in w / scale)


def _train_sentences(docs: list[list[tuple[str, ...]]], y: np.ndarray, counterfactual: float) -> ToxicityModel:
    """Weights of words, fitted to the worst sentences of documents."""
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, -1.0)
    names = _select(docs, y)
    index = {f: i for i, f in enumerate(names)}
    flat = [s for d in docs for s in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    row, column = _rows(flat, index)
    kinds: dict[str, list[str]] = {}
    for kind in IDENTITY_TERMS:
        for term in kind:
            kinds.setdefault(term, []).extend(t for t in kind if t != term)
    # a swap changes the features of one word; sentences that differ in the same swap share a row with its count
    swaps = Counter((term, other) for s in flat for term in kinds.keys() & set(s) for other in kinds[term])
    pairs = list(swaps)
    out_row, out_column = _rows([(a,) for a, _ in pairs], index)
    in_row, in_column = _rows([(b,) for _, b in pairs], index)
    share = np.array([swaps[p] for p in pairs], dtype=float) / max(1, sum(swaps.values()))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, bias = np.zeros(len(names)), -1.0
    speed_w, speed_b, square_w, square_b, step = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0, 0
    has = np.zeros(len(docs), bool)
    has[owner] = True
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    of_row = np.argsort(row, kind="stable")
    row, column = row[of_row], column[of_row]
    for _ in range(ROUNDS):
        logits = np.bincount(row, weights=w[column], minlength=len(flat)) if len(flat) else np.zeros(0)
        size = np.bincount(row, minlength=len(flat)) if len(flat) else np.zeros(0)
        worst = np.full(len(docs), -1)
        if len(flat):  # the last of (document, logit, number of features) within each document
            order = np.lexsort((np.arange(len(flat)), size, logits, owner))
            worst[owner[starts]] = order[np.append(starts[1:], len(flat)) - 1]
        place = np.full(len(flat), -1)
        place[worst[has]] = np.flatnonzero(has)
        used = place[row] >= 0
        r, c = place[row[used]], column[used]
        for _ in range(STEPS):
            step += 1
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r, weights=w[c], minlength=len(docs)), -40, 40)))
            error = weight * (p - y)
            grad = np.bincount(c, weights=error[r], minlength=len(w)) + RIDGE * w
            if pairs:
                change = share * (np.bincount(out_row, weights=w[out_column], minlength=len(pairs)) - np.bincount(in_row, weights=w[in_column], minlength=len(pairs)))
                grad += counterfactual * (np.bincount(out_column, weights=change[out_row], minlength=len(w)) - np.bincount(in_column, weights=change[in_row], minlength=len(w)))
            grad_b = error.sum()
            speed_w, square_w = 0.9 * speed_w + 0.1 * grad, 0.99 * square_w + 0.01 * grad * grad
            speed_b, square_b = 0.9 * speed_b + 0.1 * grad_b, 0.99 * square_b + 0.01 * grad_b * grad_b
            fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
            w -= 0.05 * (speed_w / fix) / (np.sqrt(square_w / fix2) + 1e-8)
            bias -= 0.05 * (speed_b / fix) / (np.sqrt(square_b / fix2) + 1e-8)
    return ToxicityModel({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-4}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_class: int = DOCS_PER_CLASS) -> ToxicityModel:
    """Fit on a sample of the labelled documents for which ``learn`` (over the label rows) holds.

    Of each class the sample takes about ``docs_per_class`` documents, those with the least hashes of their ids, and in no case more
    than ``SAMPLE_SLACK`` times as many rows.
    Labels other than 0 and 1 do not count; of several labels of a document the highest counts.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.lit(True) if learn is None else learn))
    rows = rows.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(31), F.col("label_id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*(F.when(F.col("label") == k, F.lit(min(1.0, docs_per_class / n))) for k, n in sorted(counts.items())), F.lit(0.0))
    chosen = rows.where(draw <= share).select("label_id", "label", draw.alias("draw"))  # bounded: about two classes of docs_per_class rows
    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("text_id") == F.col("label_id"))
    # an id may stand in many rows; no more of them come to the driver than of two classes of single rows
    found = texts.select("draw", "label", "text", F.xxhash64("text").alias("tie")).orderBy("draw", "tie").limit(SAMPLE_SLACK * 2 * docs_per_class).collect()
    found = sorted((r["draw"], r["label"], r["text"] or "") for r in found)
    return train([t for _, _, t in found], [k for _, k, _ in found])


def classify(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """The columns of ``docs`` and ``toxicity``, the score of each whole text, 0 to 1; a column of that name is replaced.

    Null and empty texts score as a text without words. A score depends on the text alone, so repeated rows agree.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(score_col)
    place = rows.columns.index(text_col)
    kept: dict[str, WordScores] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, model = kept.setdefault("scores", shared.value.word_scores()), shared.value
        for batch in slices(batches):
            found = pa.array([score(t, scores, model) for t in batch.column(place).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], schema=pa.schema([*batch.schema, (score_col, pa.float64())]))

    return rows.mapInArrow(run, with_columns(rows, {score_col: DoubleType()}))
