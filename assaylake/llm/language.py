"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of character n-grams. The models share sorted arrays of n-gram hashes, one for each
order, with a column of log probabilities for each language; a jump table over the leading hash bits narrows
the search. The language with the lowest cross-entropy per character wins. How far the cross-entropy of a text
may lie above that of its language is calibrated on labelled texts that the counts do not contain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from assaylake.llm._common import slices, with_columns

ORDER = 4
#: Labelled documents of each language from which its model is fitted, about; the bound of the sample.
DOCS_PER_LANGUAGE = 240
#: A calibration text may lie so many deviations above the mean of its language at least before texts are rejected.
LEAST_LIMIT = 12.0
#: No language counts as more even than this, in nats per letter: texts that mix languages stay.
LEAST_SPREAD = 0.15
#: How far a sample may exceed what is asked for, where rows repeat.
SAMPLE_SLACK = 2
UNDETERMINED = "und"
#: Positions that are scored at once.
CHUNK = 1 << 17
_MULTIPLIER, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


def _letter_table() -> np.ndarray:
    """What each code point of the basic plane counts as: its lower-case letter, or a space."""
    out = np.full(1 << 16, _SPACE, dtype=np.uint32)
    for point in range(1 << 16):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


_LETTERS = _letter_table()


def letters(text: str | None) -> np.ndarray:
    """The text as lower-case letters, with one space for each run of anything else, and none at either end."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = _LETTERS[points & 0xFFFF]
    for point in np.unique(points[points >= (1 << 16)]):  # beyond the basic plane letters are rare
        char = chr(point)
        out[points == point] = ord(char.lower()) if char.isalpha() and len(char.lower()) == 1 else _SPACE
    if not len(out):
        return out
    space = out == _SPACE
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    out = out[keep]
    return out[: len(out) - int(len(out) > 0 and out[-1] == _SPACE)]


def _hashes(points: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each place of ``points``, from place ``order - 1`` on."""
    n = len(points) - order + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(order):
        out = out * _MULTIPLIER + (points[k : k + n].astype(np.uint64) + np.uint64(1))
    return out * _MIX


@dataclass
class HashArray:
    """A sorted array of hashes with one row of values for each."""

    keys: np.ndarray
    values: np.ndarray
    bits: int = 0
    jump: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        self.bits = max(1, int(np.ceil(np.log2(max(2, 2 * len(self.keys))))))
        cells = (self.keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.jump = np.searchsorted(cells, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.jump).max()) if len(self.keys) else 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        place = self.jump[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        todo = None  # all
        for _ in range(self.depth):
            at = np.minimum(place, len(self.keys) - 1)
            key, want = self.keys[at], hashes if todo is None else hashes[todo]
            hit = key == want
            if todo is None:
                out[hit] = at[hit]
            else:
                out[todo[hit]] = at[hit]
            more = np.flatnonzero(key < want)
            todo = more if todo is None else todo[more]
            place = place[more] + 1
            if not len(todo):
                break
        return out


def _counts(texts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of padded texts: hash, count, hash of the context, hash of the n-gram without its first letter."""
    pad = np.full(order - 1, _SPACE, dtype=np.uint32)
    grams, contexts, suffixes = [], [], []
    for t in texts:
        padded = np.concatenate([pad, t])
        if not len(t):
            continue
        grams.append(_hashes(padded, order))
        contexts.append(_hashes(padded[:-1], order - 1) if order > 1 else np.zeros(len(t), np.uint64))
        suffixes.append(_hashes(padded[1:], order - 1) if order > 1 else np.zeros(len(t), np.uint64))
    if not grams:
        return tuple(np.zeros(0, np.uint64) for _ in range(4))
    g, c, s = (np.concatenate(x) for x in (grams, contexts, suffixes))
    keys, first, count = np.unique(g, return_index=True, return_counts=True)
    return keys, count.astype(np.uint64), c[first], s[first]


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(keys, return_inverse=True)
    return names, np.bincount(at, weights=values, minlength=len(names))


def _look(names: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    if not len(names):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, values[at], default)


def _kneser_ney(texts: list[np.ndarray], order: int, alphabet: int) -> list[dict[str, np.ndarray]]:
    """For each order, n-grams with their probability and contexts with the weight that they give to the lower order.

    The highest order uses counts, the lower ones the number of different letters before an n-gram; an order
    discounts by n1 / (n1 + 2 n2), and the lowest one is interpolated with the uniform distribution.
    """
    tables = [_counts(texts, n) for n in range(1, order + 1)]
    levels: list[dict[str, np.ndarray]] = []
    for n in range(1, order + 1):
        keys, count, context, suffix = tables[n - 1]
        if n < order:
            above = tables[n]
            names, kinds = np.unique(above[3], return_counts=True)  # each distinct longer n-gram adds one
            value = np.maximum(_look(names, kinds.astype(float), keys, 0.0), 1.0)
        else:
            value = count.astype(float)
        n1, n2 = float((value == 1).sum()), float((value == 2).sum())
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        names, total = _sum_by(context, value)
        _, kinds = _sum_by(context, np.ones(len(value)))
        weight = discount * kinds / total if len(total) else total
        if n == 1:
            lower = np.full(len(keys), 1.0 / alphabet)
        else:
            lower = _look(levels[-1]["keys"], levels[-1]["p"], suffix, 0.0)
            missing = lower == 0
            lower[missing] = 1.0 / alphabet
        p = np.maximum(value - discount, 0) / _look(names, total, context, 1.0) + _look(names, weight, context, 1.0) * lower
        levels.append({"keys": keys, "p": p, "contexts": names, "weights": weight})
    return levels


class LanguageModels:
    """The models of several languages over common hash arrays."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        points = {lang: [letters(t) for t in samples[lang]] for lang in self.languages}
        # every fourth text is kept out of the counts, if there are enough, and calibrates the rejection
        held = {lang: [t for i, t in enumerate(points[lang]) if i % 4 == 3] for lang in self.languages}
        counted = {lang: [t for i, t in enumerate(points[lang]) if i % 4 != 3] for lang in self.languages}
        alphabet = len(np.unique(np.concatenate([np.zeros(1, np.uint32), *(t for ts in points.values() for t in ts)]))) + 1
        per_language = [_kneser_ney(counted[lang], order, alphabet) for lang in self.languages]
        self.floor = np.log(1.0 / alphabet)
        self.grams: list[HashArray] = []
        self.contexts: list[HashArray] = []
        for n in range(order):
            self.contexts.append(self._join([(m[n]["contexts"], np.log(np.maximum(m[n]["weights"], 1e-12))) for m in per_language], lambda rows, column: 0.0))
            levels = [(m[n]["keys"], np.log(m[n]["p"])) for m in per_language]
            self.grams.append(self._join(levels, lambda rows, column: np.nan))
        for n in range(order):
            self._fill(n, _counts([t for ts in counted.values() for t in ts], n + 1))
        self._calibrate(held if all(len(h) >= 5 for h in held.values()) else points)

    @staticmethod
    def _join(columns: list[tuple[np.ndarray, np.ndarray]], default) -> HashArray:
        keys = np.unique(np.concatenate([k for k, _ in columns])) if columns else np.zeros(0, np.uint64)
        values = np.full((len(keys), len(columns)), 0.0)
        for i, (k, v) in enumerate(columns):
            values[:, i] = default(keys, i)
            values[np.searchsorted(keys, k), i] = v
        return HashArray(keys, values.astype(np.float32))

    def _fill(self, n: int, table: tuple[np.ndarray, ...]) -> None:
        """Give languages that lack an n-gram of another language the value that they back off to; lower orders first."""
        keys, _, context, suffix = table
        grams = self.grams[n]
        at = np.searchsorted(grams.keys, keys)
        back = self.contexts[n].find(context)
        weight = np.where(back[:, None] >= 0, self.contexts[n].values[back], 0.0)
        if n == 0:
            low = np.full((len(keys), len(self.languages)), self.floor)
        else:
            place = self.grams[n - 1].find(suffix)
            low = np.where(place[:, None] >= 0, self.grams[n - 1].values[place], self.floor)
        now = grams.values[at]
        grams.values[at] = np.where(np.isnan(now), weight + low, now)

    def _logs(self, padded: np.ndarray) -> np.ndarray:
        """Log probabilities of the letters of ``padded`` from place ``order - 1`` on, in each language."""
        size = len(padded) - self.order + 1
        out = np.zeros((size, len(self.languages)), dtype=np.float32)
        todo = np.arange(size)
        for n in range(self.order, 0, -1):
            hashes = _hashes(padded[self.order - n :], n)
            full = len(todo) == size
            place = self.grams[n - 1].find(hashes if full else hashes[todo])
            hit = place >= 0
            if full and hit.all():
                return out + self.grams[n - 1].values[place]
            found = todo[hit]
            out[found] += self.grams[n - 1].values[place[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            context = _hashes(padded[self.order - n : -1], n - 1)[todo] if n > 1 else np.zeros(len(todo), np.uint64)
            back = self.contexts[n - 1].find(context)
            out[todo[back >= 0]] += self.contexts[n - 1].values[back[back >= 0]]
        out[todo] += np.float32(self.floor)
        return out

    def entropies(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter in nats of each text in each language, and the numbers of letters."""
        gap = self.order - 1
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        sums = np.zeros((len(texts), len(self.languages)))
        pad = np.full(gap, _SPACE, dtype=np.uint32)
        first = 0
        while first < len(texts):  # texts together up to a chunk, or a long one in parts
            last = first + 1
            while last < len(texts) and sizes[first : last + 1].sum() <= CHUNK:
                last += 1
            flat = np.concatenate([x for t in texts[first:last] for x in (pad, t)])
            owner = np.repeat(np.arange(first, last), sizes[first:last] + gap)
            own = np.concatenate([x for n in sizes[first:last] for x in (np.zeros(gap, bool), np.ones(n, bool))])
            for at in range(gap, len(flat), CHUNK):
                logs = self._logs(flat[at - gap : at + CHUNK])
                who, real = owner[at : at + CHUNK], own[at : at + CHUNK]
                starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                logs[~real] = 0
                sums[who[starts]] += np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
            first = last
        return -sums / np.maximum(sizes, 1)[:, None], sizes

    def _calibrate(self, held: dict[str, list[np.ndarray]]) -> None:
        """Mean cross-entropy of each language, its spread over texts and over letters, and the limit of rejection."""
        count = len(self.languages)
        self.mean, self.between, self.within, self.limit = np.zeros(count), np.full(count, LEAST_SPREAD), np.full(count, 1.0), LEAST_LIMIT
        for i, lang in enumerate(self.languages):
            texts = [t for t in held[lang] if len(t)]
            if not texts:
                self.mean[i] = -self.floor
                continue
            entropy, sizes = self.entropies(texts)
            h = entropy[:, i]
            self.mean[i] = np.average(h, weights=np.minimum(sizes, 2000))
            large = h[sizes >= np.median(sizes)]
            self.between[i] = max(LEAST_SPREAD, float(np.std(large)))
            self.within[i] = max(0.5, float(np.sqrt(np.mean((h - self.mean[i]) ** 2 * np.minimum(sizes, 200)))))
            self.limit = max(self.limit, 1.5 * float(self.excess(h, sizes, i).max()))

    def excess(self, entropy: np.ndarray, sizes: np.ndarray, i: np.ndarray | int) -> np.ndarray:
        """Deviations by which a cross-entropy lies above the mean of its language."""
        return (entropy - self.mean[i]) / np.sqrt(self.between[i] ** 2 + self.within[i] ** 2 / np.maximum(sizes, 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy in bits, and whether the text is rejected."""
        points = [letters(t) for t in texts]
        entropy, sizes = self.entropies(points)
        if not self.languages:
            nothing = np.zeros(len(texts))
            return [UNDETERMINED] * len(texts), nothing, nothing, np.ones(len(texts), bool)
        best = np.argmin(entropy, axis=1)
        low = entropy[np.arange(len(texts)), best]
        score = 1.0 / np.exp(-(entropy - low[:, None]) * np.minimum(sizes, 64)[:, None]).sum(axis=1)
        none = sizes == 0
        rejected = none | (self.excess(low, sizes, best) > self.limit)
        return [UNDETERMINED if x else self.languages[i] for i, x in zip(best, none, strict=True)], np.where(none, 0.0, score), np.where(none, 0.0, low / np.log(2)), rejected


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER) -> LanguageModels:
    """Fit models on a sample of the labelled rows for which ``learn`` holds.

    The sample takes about ``docs_per_language`` rows of each language, those with the least hashes of their
    ids and texts, and in no case more than ``SAMPLE_SLACK`` times as many, so the fit costs the same at every size of the input.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if learn is None else learn))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return LanguageModels({})
    draw = F.pmod(F.xxhash64(F.lit(29), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*(F.when(F.col(lang_col) == lang, F.lit(min(1.0, docs_per_language / n))) for lang, n in sorted(counts.items())))
    texts: dict[str, list[tuple]] = {lang: [] for lang in counts}
    # rows that are equal throughout have one draw; no more of them come to the driver than of single rows
    chosen = rows.where(draw <= share).select(lang_col, text_col, draw.alias("draw")).orderBy("draw", lang_col).limit(SAMPLE_SLACK * docs_per_language * len(counts))
    found = chosen.collect()
    for lang in sorted(counts.keys() - {row[0] for row in found}):  # of a language with few different rows none may be drawn
        found += rows.where(F.col(lang_col) == lang).select(lang_col, text_col, draw.alias("draw")).orderBy("draw").limit(docs_per_language).collect()
    for row in found:
        texts[row[0]].append((row[2], row[1]))
    return LanguageModels({lang: [t for _, t in sorted(found)] for lang, found in texts.items() if found}, order)


def identify(docs: DataFrame, models: LanguageModels, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """The columns of ``docs`` and ``lang_pred``, ``lang_score`` (0 to 1), ``lang_bits`` (cross-entropy per letter),
    ``lang_rejected``; columns of these names are replaced. Another prefix gives other names.

    A null text or one without a letter is ``und`` with score 0 and rejected. Ties go to the first language in
    code-point order. Texts are scored whole and independently, so repeated rows agree. Without a labelled
    row there is no model, and every text is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = [f"{prefix}{n}" for n in ("pred", "score", "bits", "rejected")]
    rows = docs.drop(*names)
    place = rows.columns.index(text_col)
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = shared.value.predict(batch.column(place).to_pylist())
            new = [pa.array(x, k) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema([*batch.schema, *zip(names, kinds, strict=True)]))

    return rows.mapInArrow(run, with_columns(rows, dict(zip(names, (StringType(), DoubleType(), DoubleType(), BooleanType()), strict=True))))
