"""Stretches of text that repeat with a period.

A run is a stretch of words with smallest period q, at least ``repeats`` times q and ``least`` words long, that no word
beside it extends. For every period p a grid of points is laid over a text, so close together that each run of the
period holds a point whose partner p words further on lies in the run too. The numbers of (period, grid point) pairs form a
harmonic sum, n log n for n words. From all pairs at once, whichever texts they lie in, numpy searches by halving how
far the words agree to both sides, by differences of prefix hashes. The words of each run found are then compared;
where hashes were wrong, the text is searched by its words alone. Multiples of a period give the same stretch, of which the least period stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from assaylake.llm._common import slices, with_columns

#: A run has at least so many periods, and so many words.
REPEATS, LEAST = 4, 6
#: Words of texts that are searched together, and pairs at a time.
BLOCK_WORDS = 1 << 17
BLOCK_PAIRS = 1 << 19
RUNS = ArrayType(StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")]), False)
_ARROW_RUNS = pa.list_(pa.field("element", pa.struct([pa.field(n, pa.int64(), nullable=False) for n in ("start", "length", "period")]), nullable=False))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word's number."""
    x = codes.astype(np.uint64) * _BASE + np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts[i]`` items of i, i and the item's number from 0."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Hashes:
    """Prefix hashes of words laid end to end, modulo 2 ** 64."""

    def __init__(self, codes: np.ndarray):
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), _BASE)]))
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(_values(codes) * self.powers[:-1])])

    def agree(self, i: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The number of words, at most ``most``, that agree from i and i + p on, or before them."""
        low, high = np.zeros_like(most), most.copy()
        shift, here, there = self.powers[p], self.prefix[i], self.prefix[i + p]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) >> 1
            at = i[open_] - middle if back else i[open_] + middle
            same = (self.prefix[at] - here[open_]) * shift[open_] == self.prefix[at + p[open_]] - there[open_]
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)


def _least_periods(first: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its least period, by start and period."""
    order = np.lexsort((period, stop, first))
    first, stop, period = first[order], stop[order], period[order]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (stop[1:] != stop[:-1])
    first, stop, period = first[new], stop[new], period[new]
    order = np.lexsort((period, first))
    return first[order], stop[order], period[order]


def _by_words(codes: np.ndarray, repeats: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of one text by comparing its words period by period: exact, and quadratic in the words."""
    found = []
    for p in range(1, len(codes) // repeats + 1):
        edges = np.diff(np.concatenate([[0], (codes[:-p] == codes[p:]).astype(np.int8), [0]]))
        first, stop = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0) + p
        enough = stop - first >= max(least, repeats * p)
        found += [(s, e, p) for s, e in zip(first[enough], stop[enough], strict=True)]
    return _least_periods(*np.array(found, dtype=np.int64).reshape(-1, 3).T)


def runs_of(codes: np.ndarray, lengths: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of texts whose words' numbers lie end to end in ``codes``.

    :param repeats: at least 2; with fewer than so many periods a stretch is no run.
    :return: for each text starts, stops and periods, by start and period.
    """
    if repeats < 2:
        raise ValueError("a run has at least two periods")
    begins = np.cumsum(lengths) - lengths
    hashes = _Hashes(codes)
    doc, period = _counted(np.where(lengths >= least, lengths // repeats, 0))
    period += 1
    spacing = np.maximum((repeats - 1) * period, least - period)  # the words of a run that have a partner in it
    points = -(-(lengths[doc] - period) // spacing)
    cuts = np.searchsorted(np.cumsum(points), np.arange(0, points.sum() + BLOCK_PAIRS, BLOCK_PAIRS), side="right")
    found: list[tuple[np.ndarray, ...]] = []
    for start, stop in zip(cuts[:-1], np.maximum(cuts[1:], cuts[:-1]), strict=True):
        owner, number = _counted(points[start:stop])
        owner += start
        i = begins[doc[owner]] + number * spacing[owner]
        some = np.flatnonzero(codes[i] == codes[i + period[owner]])  # most pairs end with their first word
        owner, i = owner[some], i[some]
        p, begin = period[owner], begins[doc[owner]]
        first = i - hashes.agree(i, p, i - begin, back=True)
        end = i + p + hashes.agree(i, p, begin + lengths[doc[owner]] - i - p, back=False)
        enough = end - first >= np.maximum(least, repeats * p)
        found.append(_least_periods(first[enough], end[enough], p[enough]))
    first, end, p = _least_periods(*(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)))
    owner = np.searchsorted(begins + lengths, first, side="right")
    wrong = {int(d) for d, s, e, q in zip(owner, first, end, p, strict=True) if not np.array_equal(codes[s : e - q], codes[s + q : e])}
    bounds = np.searchsorted(owner, np.arange(len(lengths) + 1))
    out = []
    for d, begin in enumerate(begins):
        here = slice(bounds[d], bounds[d + 1])
        out.append(_by_words(codes[begin : begin + lengths[d]], repeats, least) if d in wrong else (first[here] - begin, end[here] - begin, p[here]))
    return out


def _collapsed(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> str:
    """The words but those that a run holds after its first period, joined by spaces."""
    if len(runs[0]):
        kept = np.ones(len(words), dtype=bool)
        for s, e, q in zip(*runs, strict=True):
            kept[s + q : e] = False
        words = [words[k] for k in np.flatnonzero(kept)]
    return b" ".join(words).decode()


def _search(texts: list[str | None], repeats: int, least: int) -> Iterator[tuple[list[dict[str, int]], str]]:
    """The runs of each text and what is left when repetitions are taken out."""

    def told(block: list[list[bytes]]) -> Iterator[tuple[list[dict[str, int]], str]]:
        numbers: dict[bytes, int] = {}
        codes = np.fromiter((numbers.setdefault(w, len(numbers)) for words in block for w in words), dtype=np.int64)
        lengths = np.array([len(words) for words in block], dtype=np.int64)
        for words, runs in zip(block, runs_of(codes, lengths, repeats, least), strict=True):
            yield [{"start": int(s), "length": int(e - s), "period": int(q)} for s, e, q in zip(*runs, strict=True)], _collapsed(words, runs)

    block: list[list[bytes]] = []
    size = 0
    for text in texts:
        block.append((text or "").encode().split())  # bytes are split at the six ASCII kinds of white space
        size += len(block[-1])
        if size >= BLOCK_WORDS:
            yield from told(block)
            block, size = [], 0
    yield from told(block)


def find_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """``docs`` with the runs of each text and its words without the repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs_col`` holds (start, length, period) by start and period, ``collapsed_col`` the words
    that no run holds after its first period, joined by one space.

    A null or empty text, or one of white space, has no run and collapses to the empty text. A text is read whole by one
    task, whatever its length; n words take memory in proportion to n. Repeated rows are rows of their own, each with the same result; nothing is shuffled.
    Columns of ``docs`` with the two result names are replaced, all others stay. An empty table stays empty.
    """
    kept = docs.drop(runs_col, collapsed_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(_search(batch.column(batch.schema.names.index(text_col)).to_pylist(), repeats, least))
            added = [pa.array([f[0] for f in found], type=_ARROW_RUNS), pa.array([f[1] for f in found], type=pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, runs_col, collapsed_col])

    return kept.mapInArrow(run, with_columns(kept, {runs_col: RUNS, collapsed_col: StringType()}))
