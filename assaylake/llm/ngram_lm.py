"""Scoring of texts by a trigram language model whose n-grams lie in sharded Elias-Fano tries.

Training and scoring take one round trip. Documents are read in blocks. A block sends every shard one message:
its distinct words, pairs and triples there with their training counts. The shard adds up the messages of all
blocks, builds the trie of the pairs and triples that occur often enough (once, if all are asked for), maps its levels into memory, looks
up every n-gram of the messages, and answers with exact word counts and quantised probabilities. The block then
scores its documents from the answers. So the model grows with the corpus, no node ever holds all of it, and what
moves is the distinct n-grams of blocks.

A pair lies in the shard of its first word together with its followers; the pairs of frequent words, which are known
beforehand from exact counts, are spread by their second word.

Smoothing is by interpolated absolute discounts: p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1));
p2(w|v) = (c(vw) - D) / c(v) + b(v) p1(w); p3(w|uv) = (c(uvw) - D) / c(uv) + b(uv) p2(w|v). D is smaller for
a count of one than for others; b is what the kept pairs and triples leave of their context's probability. Before the
first word of a text stands the end of the one before.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm._common import bucketed, partitions, slices
from assaylake.llm.elias_fano import NgramTrie, dequantise, quantise

#: Tokens of a block, about, and tokens of the corpus for each shard, about.
BLOCK_TOKENS, SHARD_TOKENS = 1_000_000, 1_000_000
#: The least count of the pairs and triples that are kept, unless told otherwise.
LEAST_COUNT = 2
#: What is taken off counts above one, and off a count of one.
DISCOUNT, DISCOUNT_OF_ONE = 1.3, 0.7
ADD = 0.1
END_HASH = xxhash.xxh64_intdigest(b"\n")
#: A word is frequent if its training count is over N / (FREQUENT * shards).
FREQUENT = 4
CACHE_WORDS = 400_000
_U = np.uint64


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _zip(array: np.ndarray) -> bytes:
    """Bytes of an array, its bytes of equal rank together, compressed."""
    if not len(array):
        return b""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unzip(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_BLOCK_DDL = "block long, doc_ids array<bigint>, held binary, sizes binary, ranks binary, words binary, counts binary, n_train long"


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, learnt from or not) as blocks of word hashes: each document's words as ranks among the
    block's words, which are sorted by how often they occur."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 24
    known = _Hashes()
    ids: list[int | None] = []
    held: list[bool] = []
    sizes: list[int] = []
    parts: list[np.ndarray] = []
    count = 0

    def flush() -> pa.RecordBatch:
        nonlocal block, count
        flat = np.concatenate([*parts, np.array([END_HASH], dtype=_U)])
        words, at, often = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        ranks = rank[at[:-1]]
        learnt = ~np.array(held, dtype=bool)
        counts = np.bincount(ranks[np.repeat(learnt, sizes)], minlength=len(words)).astype("<u4")
        end = rank[np.searchsorted(words, _U(END_HASH))]
        counts[end] += int(learnt.sum())
        row = {"block": block, "doc_ids": list(ids), "held": np.array(held, dtype=np.uint8).tobytes(), "sizes": np.array(sizes, dtype="<u4").tobytes(), "ranks": _zip(ranks.astype("<u4")), "words": words[order].astype("<u8").tobytes(), "counts": _zip(counts), "n_train": int(counts.sum())}
        schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("held", "sizes", "ranks", "words", "counts")), ("n_train", pa.int64())])
        for x in (ids, held, sizes, parts):
            x.clear()
        block, count = block + 1, 0
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in slices(batches):
        for doc, text, learn in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = tokens(text)
            parts.append(np.fromiter(map(known.__getitem__, words), dtype=_U, count=len(words)))
            ids.append(doc)
            held.append(not learn)
            sizes.append(len(words))
            count += len(words) + 1
            if count >= BLOCK_TOKENS:
                yield flush()
    if ids:
        yield flush()


@dataclass
class _Plan:
    """The n-grams of a block by shard. A place in an array of n-grams belongs to shard s between starts[s] and
    starts[s + 1]; ``*_at`` give the place of each token's n-gram."""

    words: np.ndarray  # hashes by (shard, hash)
    word_starts: np.ndarray
    word_counts: np.ndarray
    word_at: np.ndarray
    firsts: np.ndarray  # 32-bit codes of pairs by (shard, first, second)
    seconds: np.ndarray
    pair_starts: np.ndarray
    pair_counts: np.ndarray
    pair_at: np.ndarray
    parents: np.ndarray  # places of pairs, of triples by (shard, pair, third)
    thirds: np.ndarray
    triple_starts: np.ndarray
    triple_counts: np.ndarray
    triple_at: np.ndarray  # -1: no triple ends at this token
    before: np.ndarray  # place of the word before each token
    doc_starts: np.ndarray  # places in the tokens


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes * _U(0x9E3779B97F4A7C15)) >> _U(33)).astype(np.int64) % shards


def _plan(row: dict, frequent: np.ndarray, shards: int) -> _Plan:
    hashes, ranks = np.frombuffer(row["words"], dtype="<u8"), _unzip(row["ranks"], "<u4").astype(np.int64)
    sizes, held = np.frombuffer(row["sizes"], dtype="<u4").astype(np.int64), np.frombuffer(row["held"], dtype=np.uint8) > 0
    own = _shard_of(hashes, shards)
    order = np.lexsort((hashes, own))
    place = np.empty(len(hashes), dtype=np.int64)
    place[order] = np.arange(len(hashes))
    words, own = hashes[order], own[order]
    bounds = np.arange(shards + 1)
    n = len(words)
    end = int(place[np.flatnonzero(hashes == _U(END_HASH))[0]])
    # documents with the end before and after them; a token is every place but the first of its document
    with_ends = np.full(len(ranks) + 2 * len(sizes), end, dtype=np.int64)
    first = np.cumsum(sizes + 2) - (sizes + 2)
    inner = np.ones(len(with_ends), dtype=bool)
    inner[first] = inner[first + sizes + 1] = False
    with_ends[inner] = place[ranks]
    token = np.ones(len(with_ends), dtype=bool)
    token[first] = False
    at = np.flatnonzero(token)
    learnt = np.repeat(~held, sizes + 2)[at]
    w, v = with_ends[at], with_ends[at - 1]
    by_code = np.argsort(np.argsort(words >> _U(32), kind="stable"), kind="stable")  # codes are compared below
    sorted_code = np.sort(words >> _U(32))
    # pairs by (first, second) code order, then by shard
    key = by_code[v] * n + by_code[w]
    pairs, pair_at = np.unique(key, return_inverse=True)
    a, b = pairs // n, pairs % n
    of_code = np.argsort(by_code)
    place_a, place_b = of_code[a], of_code[b]
    heavy = np.isin(words, frequent)
    shard = np.where(heavy[place_a], (own[place_a] + 1 + own[place_b]) % shards, own[place_a])
    pair_order = np.argsort(shard, kind="stable")
    moved = np.empty(len(pairs), dtype=np.int64)
    moved[pair_order] = np.arange(len(pairs))
    pair_at, shard = moved[pair_at], shard[pair_order]
    pair_counts = np.bincount(pair_at[learnt], minlength=len(pairs))
    # triples: the pair that ends at the token before, and the token
    has = np.ones(len(at), dtype=bool)
    has[first - np.arange(len(first))] = False  # the first token of a document
    where = np.flatnonzero(has)
    triples, triple_in = np.unique(pair_at[where - 1] * n + by_code[w[where]], return_inverse=True)
    parents = triples // n
    triple_at = np.full(len(at), -1, dtype=np.int64)
    triple_at[where] = triple_in
    triple_counts = np.bincount(triple_in[learnt[where]], minlength=len(triples))
    counts = np.zeros(n, dtype=np.int64)
    counts[place] = _unzip(row["counts"], "<u4")
    return _Plan(
        words, np.searchsorted(own, bounds), counts, w,
        sorted_code[a[pair_order]].astype("<u4"), sorted_code[b[pair_order]].astype("<u4"), np.searchsorted(shard, bounds), pair_counts, pair_at,
        parents, sorted_code[triples % n].astype("<u4"), np.searchsorted(shard[parents], bounds), triple_counts, triple_at,
        v, first - np.arange(len(first)),
    )


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of runs of equal ones, and their lengths."""
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[starts], np.diff(np.append(starts, len(values)))


_MESSAGE = ("words", "word_counts", "firsts", "first_runs", "seconds", "pair_counts", "followers", "thirds", "triple_counts")
_MESSAGE_DDL = "shard int, block long, " + ", ".join(f"{n} binary" for n in _MESSAGE)


def _messages(plan: _Plan, block: int, shards: int) -> Iterator[dict]:
    """What a block tells each shard; codes as they are, counts compressed."""
    follow = np.bincount(plan.parents, minlength=len(plan.firsts))
    for s in range(shards):
        w, p, t = (slice(x[s], x[s + 1]) for x in (plan.word_starts, plan.pair_starts, plan.triple_starts))
        if w.start == w.stop and p.start == p.stop:
            continue
        firsts, runs = _runs(plan.firsts[p])
        yield {
            "shard": s, "block": block, "words": plan.words[w].astype("<u8").tobytes(), "word_counts": _zip(plan.word_counts[w].astype("<u4")),
            "firsts": firsts.tobytes(), "first_runs": _zip(runs.astype("<u4")), "seconds": plan.seconds[p].tobytes(), "pair_counts": _zip(plan.pair_counts[p].astype("<u4")),
            "followers": _zip(follow[p].astype("<u4")), "thirds": plan.thirds[t].tobytes(), "triple_counts": _zip(plan.triple_counts[t].astype("<u4")),
        }


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, at = np.unique(keys, return_inverse=True)
    return names, at, np.bincount(at, weights=counts, minlength=len(names)).astype(np.int64)


_ANSWER = ("word_counts", "word_backs", "pairs", "backs", "triples")
_ANSWER_DDL = "block long, shard int, vocabulary long, masses binary, " + ", ".join(f"{n} binary" for n in _ANSWER)


def _discounted(counts: np.ndarray) -> np.ndarray:
    return counts - np.where(counts == 1, DISCOUNT_OF_ONE, DISCOUNT)


def _answer(messages: list[dict], frequent: dict[int, int], shard: int, least_count: int) -> Iterator[dict]:
    """Build the trie of a shard from the messages of all blocks, and answer each of them from it."""
    words = [np.frombuffer(m["words"], dtype="<u8") for m in messages]
    names, word_at, counts = _add_up(np.concatenate(words), np.concatenate([_unzip(m["word_counts"], "<u4") for m in messages]))
    runs = [_unzip(m["first_runs"], "<u4") for m in messages]
    firsts = np.concatenate([np.repeat(np.frombuffer(m["firsts"], dtype="<u4"), r) for m, r in zip(messages, runs, strict=True)]).astype(_U)
    seconds = np.concatenate([np.frombuffer(m["seconds"], dtype="<u4") for m in messages]).astype(_U)
    pair_sizes = [len(m["seconds"]) // 4 for m in messages]
    pairs, pair_at, pair_counts = _add_up((firsts << _U(32)) | seconds, np.concatenate([_unzip(m["pair_counts"], "<u4") for m in messages]))
    del firsts, seconds
    followers = np.concatenate([_unzip(m["followers"], "<u4") for m in messages]).astype(np.int64)
    thirds = np.concatenate([np.frombuffer(m["thirds"], dtype="<u4") for m in messages]).astype(_U)
    triple_sizes = [len(m["thirds"]) // 4 for m in messages]
    triples, triple_at, triple_counts = _add_up((np.repeat(pair_at, followers).astype(_U) << _U(32)) | thirds, np.concatenate([_unzip(m["triple_counts"], "<u4") for m in messages]))
    del thirds, followers
    # training counts of the contexts: words of this shard, and frequent words, whose pairs come from everywhere
    codes = np.concatenate([names >> _U(32), np.array([h >> 32 for h in frequent], dtype=_U)])
    totals = np.concatenate([counts, np.array(list(frequent.values()), dtype=np.int64)])
    codes, pick = np.unique(codes, return_index=True)
    context = totals[pick]
    kept = np.flatnonzero(pair_counts >= least_count)
    heads = np.searchsorted(codes, pairs[kept] >> _U(32))
    c1 = np.maximum(context[np.minimum(heads, len(codes) - 1)], pair_counts[kept])
    new_place = np.full(len(pairs), -1, dtype=np.int64)
    new_place[kept] = np.arange(len(kept))
    kept3 = np.flatnonzero(triple_counts >= least_count)
    parent3 = new_place[(triples[kept3] >> _U(32)).astype(np.int64)]
    c2, c3 = _discounted(pair_counts[kept]), _discounted(triple_counts[kept3])
    back = 1 - np.bincount(parent3, weights=c3, minlength=len(kept)) / np.maximum(pair_counts[kept], 1)
    trie = NgramTrie.build(pairs[kept], c2 / c1, np.maximum(back, 1e-9), (parent3.astype(_U) << _U(32)) | (triples[kept3] & _U(0xFFFFFFFF)), c3 / pair_counts[kept][parent3])
    mass = np.bincount(heads, weights=c2, minlength=len(codes))
    own = np.searchsorted(codes, names >> _U(32))
    word_back = quantise(np.maximum(1 - mass[own] / np.maximum(context[own], 1), 1e-9))
    # of a frequent word each shard has a part of the pairs; the parts are added up outside
    hot = np.array(list(frequent), dtype=_U)
    masses = np.concatenate([hot.view(np.uint8).reshape(-1, 8), mass[np.searchsorted(codes, hot >> _U(32))].view(np.uint8).reshape(-1, 8)], axis=1).tobytes() if len(hot) else b""
    with tempfile.TemporaryDirectory() as folder:
        trie.save(folder)
        trie = NgramTrie.open(folder)
        found = trie.find_pairs(pairs)
        found3 = trie.find_triples(found[(triples >> _U(32)).astype(np.int64)], triples & _U(0xFFFFFFFF))
        none = np.zeros(1, dtype=np.uint8)
        code2, back, code3 = (np.concatenate([np.asarray(x), none]) for x in (trie.p2, trie.back, trie.p3))
        del trie
    code2, back, code3 = code2[found], back[found], code3[found3]  # place -1 is the last one, which is absent
    vocabulary = int((counts > 0).sum())
    ends = [np.cumsum([0, *x]) for x in (map(len, words), pair_sizes, triple_sizes)]
    for i, m in enumerate(messages):
        w, p, t = (at[e[i] : e[i + 1]] for at, e in zip((word_at, pair_at, triple_at), ends, strict=True))
        yield {"block": m["block"], "shard": shard, "vocabulary": vocabulary if not i else 0, "masses": masses if not i else b"", "word_counts": _zip(counts[w].astype("<u8")), "word_backs": _zip(word_back[w]), "pairs": _zip(code2[p]), "backs": _zip(back[p]), "triples": _zip(code3[t])}


def _score(row: dict, answers: list[dict], frequent: dict[int, float], shards: int, n_train: int, vocabulary: int) -> dict[str, list]:
    """The scores of the documents of a block; ``frequent`` has the weights that frequent words give to the lower order."""
    hot = np.array(sorted(frequent), dtype=_U)
    plan = _plan(row, hot, shards)
    word_back = np.ones(len(plan.words))
    count = np.zeros(len(plan.words), dtype=np.int64)
    code2, back, code3 = np.zeros(len(plan.firsts), np.uint8), np.zeros(len(plan.firsts), np.uint8), np.zeros(len(plan.thirds), np.uint8)
    for a in answers:
        s = a["shard"]
        count[plan.word_starts[s] : plan.word_starts[s + 1]] = _unzip(a["word_counts"], "<u8")
        word_back[plan.word_starts[s] : plan.word_starts[s + 1]] = dequantise(_unzip(a["word_backs"], "u1"))
        code2[plan.pair_starts[s] : plan.pair_starts[s + 1]] = _unzip(a["pairs"], "u1")
        back[plan.pair_starts[s] : plan.pair_starts[s + 1]] = _unzip(a["backs"], "u1")
        code3[plan.triple_starts[s] : plan.triple_starts[s + 1]] = _unzip(a["triples"], "u1")
    c = count[plan.word_at]
    p1 = (c + ADD) / (n_train + ADD * (vocabulary + 1))
    if len(hot):
        weights, at = np.array([frequent[h] for h in hot.tolist()]), np.minimum(np.searchsorted(hot, plan.words), len(hot) - 1)
        word_back = np.where(hot[at] == plan.words, weights[at], word_back)
    p2 = dequantise(code2)[plan.pair_at] + word_back[plan.before] * p1
    ended = np.append(-1, plan.pair_at[:-1])  # the pair before each token
    own_back = np.where((plan.triple_at >= 0) & (back[ended] > 0), dequantise(back)[ended], 1.0)
    p3 = own_back * p2
    has = plan.triple_at >= 0
    p3[has] += dequantise(code3)[plan.triple_at[has]]
    starts = plan.doc_starts
    total = lambda x: np.add.reduceat(x, starts)
    return {"doc_id": row["doc_ids"], "held_out": (np.frombuffer(row["held"], dtype=np.uint8) > 0).tolist(), "n_tokens": (np.frombuffer(row["sizes"], dtype="<u4").astype(np.int64) + 1).tolist(), "n_known": total((c > 0).astype(np.int64)).tolist(), "train_tokens": [n_train] * len(starts), "base_score": total(np.log10(p1)).tolist(), "score": total(np.log10(p3)).tolist()}


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """Train on the rows for which ``learn`` holds, and score all rows.

    :param least_count: pairs and triples that occur less often in training are left out; 1 keeps all.
    :return: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``
        (log10 probabilities).

    A token is a word or the end of the text. Null and empty texts have the end alone. Repeated rows count and
    are scored each; null ids stay null. A row for which ``learn`` is null is held out. Without a training row
    all counts are 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = bucketed(rows.mapInArrow(_read_blocks, _BLOCK_DDL), "block", parts)
    n_train = blocks.agg(F.sum("n_train")).first()[0] or 0
    shards = max(parts, -(-n_train // SHARD_TOKENS))
    least = n_train // (FREQUENT * shards) + 1

    def nominate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = _unzip(counts, "<u4").astype(np.int64)
                some = np.flatnonzero(c * 2 * FREQUENT * shards >= max(1, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, dtype="<i8")[some]), pa.array(c[some])], names=["word", "n"])

    # A word over the share in the corpus has half of that share in the blocks where it is over half the share itself, for
    # the other blocks hold less. So fewer than 2 * FREQUENT * shards words come to be counted in all blocks.
    over = blocks.select("words", "counts", "n_train").mapInArrow(nominate, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    nominated = np.array([r[0] for r in over.where(F.col("n") * (2 * FREQUENT * shards) >= n_train).select("word").collect()], dtype=np.int64)
    named = spark.sparkContext.broadcast(np.sort(nominated))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                h, c = np.frombuffer(words, dtype="<i8"), _unzip(counts, "<u4").astype(np.int64)
                some = np.flatnonzero(np.isin(h, named.value))
                yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(c[some])], names=["word", "n"])

    counted = blocks.select("words", "counts").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    frequent = {r["word"] % (1 << 64): r["n"] for r in counted.collect()}  # fewer than FREQUENT * shards words
    hot = spark.sparkContext.broadcast(frequent)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in _MESSAGE)])
        keys = np.array(list(hot.value), dtype=_U)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist(list(_messages(_plan(row, keys, shards), row["block"], shards)), schema=schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("vocabulary", pa.int64()), ("masses", pa.binary()), *((n, pa.binary()) for n in _ANSWER)])
        waiting: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                message = batch.slice(i, 1).to_pylist()[0]
                if waiting and waiting[0]["shard"] != message["shard"]:
                    yield pa.RecordBatch.from_pylist(list(_answer(waiting, hot.value, waiting[0]["shard"], least_count)), schema=schema)
                    waiting.clear()
                waiting.append(message)
        if waiting:
            yield pa.RecordBatch.from_pylist(list(_answer(waiting, hot.value, waiting[0]["shard"], least_count)), schema=schema)

    asked = blocks.select("block", "doc_ids", "held", "sizes", "ranks", "words", "counts").mapInArrow(ask, _MESSAGE_DDL)
    answers = bucketed(asked.repartition(parts, "shard").sortWithinPartitions("shard", "block").mapInArrow(answer, _ANSWER_DDL), "block", parts)
    vocabulary = answers.agg(F.sum("vocabulary")).first()[0] or 0

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for masses in batch.column(0).to_pylist():
                found = np.frombuffer(masses, dtype=[("word", "<i8"), ("mass", "<f8")])
                yield pa.RecordBatch.from_arrays([pa.array(found["word"]), pa.array(found["mass"])], names=["word", "mass"])

    summed = answers.where(F.length("masses") > 0).select("masses").mapInArrow(split, "word long, mass double").groupBy("word").agg(F.sum(F.round("mass", 6).cast("decimal(30,6)")).alias("mass"))
    masses = {r["word"] % (1 << 64): float(r["mass"]) for r in summed.collect()}  # one for each frequent word
    backs = {h: max(1e-9, 1 - masses.get(h, 0.0) / n) for h, n in frequent.items()}
    weights = spark.sparkContext.broadcast(backs)
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("shard", *_ANSWER)).alias("answers"))  # at most one for each shard, together no longer than the block
    joined = blocks.join(gathered, "block").select("doc_ids", "held", "sizes", "ranks", "words", "counts", "answers")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pydict(_score(row, row["answers"], weights.value, shards, n_train, vocabulary), schema=schema)

    return joined.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
