"""Spelling variants of words: words at one edit from a much more frequent one.

One inserted, deleted or replaced letter leaves the first or the second half of a word as it is, so of two words that
are near the longer one, or either of two equally long ones, begins or ends with a half of the other. Shards hold words'
two halves in Aho-Corasick automata; all words are scanned by them, an occurrence counts if it lies at the begin or the end
and the lengths fit, and the words it stands for are then compared with the one scanned. A half that is a word's begin
lies in the shard of the word's first three letters, one that is its end in that of its last three, and a word is scanned there alone. Where
many words share these letters they are dealt into groups, and each group's automaton scans each group.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm._common import partitions, stash

#: Words have at least so many letters, so each half has three, which choose the shard.
LEAST_LETTERS = 6
KEY_LETTERS = 3
#: Words of a group, about, where many share a shard's letters; rows of a task, about.
GROUP_WORDS = 1024
TASK_ROWS = 1 << 16
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)


def _one_removed(word: str) -> set[str]:
    """The word without one of its letters; within a stretch of equal letters all choices are the same."""
    return {word[:k] + word[k + 1 :] for k in range(len(word)) if not k or word[k] != word[k - 1]}


def _eight(rest: str) -> int | None:
    """Up to eight letters below U+0100 as a number, a byte each."""
    data = rest.encode("latin-1", "replace") if max(rest, default="") < "Ā" else None
    return None if data is None or len(data) > 8 else int.from_bytes(data, "little")


def _replaced(rests: Iterable[tuple[str, int]], rest: str) -> list[tuple[int, str]]:
    return [(w, r) for r, w in rests if sum(a != b for a, b in zip(r, rest, strict=True)) == 1]


class _Group:
    """The words of a shard that share a half, told apart by their other half."""

    def __init__(self) -> None:
        self.rests: dict[str, int] = {}
        self.packed: np.ndarray | None = None

    def near(self, rest: str, longer: bool) -> list[tuple[int, str]]:
        """The words whose other half is at one edit from ``rest``, and those halves.

        :param longer: ``rest`` has one letter more than theirs, not as many.
        """
        if longer:
            return [(self.rests[r], r) for r in _one_removed(rest) if r in self.rests]
        own = _eight(rest)
        if own is None or len(self.rests) < 16:
            return _replaced(self.rests.items(), rest)
        if self.packed is None:
            numbers = {r: _eight(r) for r in self.rests}
            self.short = [(w, r) for r, w in self.rests.items() if numbers[r] is not None]
            self.packed = np.array([x for x in numbers.values() if x is not None], dtype=np.uint64)
            self.others = {r: w for r, w in self.rests.items() if numbers[r] is None}
        differ = self.packed ^ np.uint64(own)
        marks = (((differ & _LOW) + _LOW) | differ) & _HIGH  # the high bit of each byte that differs
        found = np.flatnonzero((marks != 0) & (marks & (marks - np.uint64(1)) == 0))
        return [self.short[k] for k in found] + _replaced(self.others.items(), rest)


class Shard:
    """Automaton over the halves of words.

    ``add`` takes words and the cells they lie in, a cell being a kind of half (0 a begin, 1 an end), its letters and a pair of groups.
    """

    def __init__(self) -> None:
        self.halves: dict[str, dict[tuple, _Group]] = defaultdict(lambda: defaultdict(_Group))
        self.automaton = None

    def add(self, name: int, word: str, cell: tuple) -> None:
        middle = len(word) // 2
        half, rest = (word[:middle], word[middle:]) if cell[0] == 0 else (word[middle:], word[:middle])
        self.halves[half][(*cell, len(word))].rests[rest] = name

    def close(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for half, groups in self.halves.items():
            self.automaton.add_word(half, (half, dict(groups)))
        if self.halves:
            self.automaton.make_automaton()

    def scan(self, word: str, cell: tuple) -> Iterator[tuple[int, bool]]:
        """The words of the cell near to ``word`` and not longer, each once over all shards, and whether it is shorter."""
        if not self.halves:
            return
        for last, (half, groups) in self.automaton.iter(word):
            at_begin, at_end = last + 1 == len(half), last + 1 == len(word)
            if not (at_begin if cell[0] == 0 else at_end):
                continue
            rest = word[len(half) :] if cell[0] == 0 else word[: -len(half)]
            for shorter in (False, True):
                length = len(word) - shorter
                group = groups.get((*cell, length))
                if group is None:
                    continue
                for name, other in group.near(rest, shorter):
                    # a word that is also found by its begin is told there
                    if cell[0] == 0 or not word.startswith((other + half)[: length // 2]):
                        yield name, shorter


def _cells(words: DataFrame) -> DataFrame:
    """A row for each word, kind of half and cell: ``role`` 0 in the automaton, 1 scanned."""
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.substring("word", 1, KEY_LETTERS).alias("letters")),
        F.struct(F.lit(1).alias("kind"), F.expr(f"right(word, {KEY_LETTERS})").alias("letters")),
    )
    keyed = words.select("word", "n", F.inline(kinds))
    crowded = keyed.groupBy("kind", "letters").count().where(F.col("count") > GROUP_WORDS).select("kind", "letters", F.ceil(F.col("count") / GROUP_WORDS).cast("int").alias("groups"))
    dealt = keyed.join(crowded, ["kind", "letters"], "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("groups")).cast("int"))

    def roles(role: int) -> Column:
        own, other = ("held", "scanned") if role == 0 else ("scanned", "held")
        return F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda i: F.struct(F.lit(role).alias("role"), *((F.col("own") if name == own else i).alias(name) for name in ("held", "scanned"))))

    return dealt.select("word", "n", "kind", "letters", F.inline(F.concat(roles(0), roles(1))))


_NEAR = "word string, near long, best struct<n:long,word:string>"


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and best of the near words that this shard finds for each word."""
    shard = Shard()
    names: dict[str, int] = {}
    words: list[tuple[int, str]] = []
    found: dict[int, list] = {}

    def meet(one: int, other: int) -> None:
        n, word = words[other]
        entry = found.get(one)
        if entry is None:
            found[one] = [1, n, word]
            return
        entry[0] += 1
        if n > entry[1] or (n == entry[1] and word < entry[2]):
            entry[1:] = n, word

    for batch in batches:
        for word, n, kind, letters, role, held, scanned in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            name = names.setdefault(word, len(names))
            if name == len(words):
                words.append((n, word))
            cell = (kind, letters, held, scanned)
            if role == 0:
                shard.add(name, word, cell)
                continue
            if shard.automaton is None:
                shard.close()
            for other, shorter in shard.scan(word, cell):
                meet(name, other)
                if shorter:
                    meet(other, name)
    if found:
        rows = [{"word": words[k][1], "near": near, "best": {"n": n, "word": word}} for k, (near, n, word) in found.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.struct([("n", pa.int64()), ("word", pa.string())]))]))


def near_words(words: DataFrame) -> DataFrame:
    """The number of near words and the one of largest ``n`` (ties: the smallest in code-point order) of each word that has one.

    :param words: distinct ``word`` of at least ``LEAST_LETTERS`` letters with ``n``.
    """
    cells = stash(_cells(words))
    tasks = max(partitions(words.sparkSession), -(-cells.count() // TASK_ROWS))
    met = cells.repartition(tasks, "kind", "letters", "held", "scanned").sortWithinPartitions("role")
    found = met.select("word", "n", "kind", "letters", "role", "held", "scanned").mapInArrow(_near_words, _NEAR)
    best = F.min(F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of rows (``word``, ``form``): the form's form's form and so on, to the last.

    :param forms: a word once, none with itself as a later form. Chains are halved in each round, so their length costs its logarithm.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        reached = stash(reached)
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if reached.join(further, "root", "left_semi").limit(1).count() == 0:
            return reached
        reached = reached.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Each word with its form, the near word of largest ``n`` if that is at least ``ratio`` times its own, and its root.

    :param words: ``word``, ``n``; rows of one word are added up.
    :param ratio: at least 2, so that no chain of forms returns.
    :return: ``word``, ``form``, ``root`` (the word itself if it has no form), ``n``, ``n_near``, ``form_n`` (null without a form).

    Two words are near if they differ by exactly one inserted, deleted or replaced letter. Rows with a null word or n, and
    words of fewer than six letters, take no part. Other columns are ignored. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent")
    known = words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.sum("n").cast("long").alias("n")).where("n is not null")
    known = stash(known)
    told = known.join(near_words(known), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    told = stash(
        told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    )
    found = told.join(roots(told.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Words of the contract's alphabet; only A-Z is lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"


def word_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, with a row for each maximal run of letters as ``word``, only A-Z lower-cased; a null text has none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    others = [c for c in docs.columns if c.lower() not in (text_col.lower(), "word")]
    return docs.select(*others, F.explode(F.regexp_extract_all(F.translate(F.col(text_col), upper, upper.lower()), F.lit(RUN), F.lit(0))).alias("word"))
