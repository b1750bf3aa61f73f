"""Exact top-k inner products by aggregation of sorted lists without random access.

Vectors lie in blocks. A block holds, for each component, a list of its vectors sorted by that component. A query reads
all lists of a block in step, round by round, in sequence from the end that its own component's sign favours. Of every vector it keeps the
sum of the products read so far and which lists have shown it. The last values read bound what the other lists still hold from above,
their last entries from below, so each vector has a lower and an upper bound, renewed after each round. The k-th best lower bound is the
bar; vectors whose upper bound lies below it are out. Once the vectors left have all been read in every list, reading stops, and their
scores are final. A first block gives every query a bar to begin with in all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm._common import partitions, slices, stash

#: Vectors of a block, about, and queries that travel together.
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 512
#: The shares of each list after which bounds are formed anew.
DEPTHS = (1 / 16, 3 / 4, 1)
#: The bar of a query that has none.
NO_BAR = -(1 << 62)


def quantise(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))


class Block:
    """Distinct vectors of a block as sorted lists: ``names`` and ``values`` of each component from its least value on.

    Of the ids that share a vector only the k + 1 least can be among the k best of a query that is one of them. ``read`` counts the
    entries of lists that queries have read, ``unread`` those that they have not.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        rows = np.ascontiguousarray(values).view(np.dtype((np.void, values.dtype.itemsize * max(1, values.shape[1])))).ravel() if values.shape[1] else np.zeros(len(ids), "V1")
        _, first, owner = np.unique(rows, return_index=True, return_inverse=True)
        by_owner = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[by_owner], np.arange(len(first)))
        counts = np.diff(np.append(starts, len(ids)))
        self.ids = [ids[by_owner[s : s + min(c, k + 1)]].tolist() for s, c in zip(starts, counts, strict=True)]
        self.own: dict[int, list[int]] = {}
        for name, some in enumerate(self.ids):
            if len(some) == 1:  # a vector that is nobody else's
                self.own.setdefault(some[0], []).append(name)
        self.size, self.width = len(first), values.shape[1]
        lists = np.ascontiguousarray(values[first].T)
        self.names = np.argsort(lists, axis=1, kind="stable")
        self.values = np.take_along_axis(lists, self.names, axis=1)
        self.doubles = self.values.astype(float)
        # the place of each vector in each list, which tells whether a list has shown it yet
        self.places = np.empty(self.names.shape, dtype=np.int16 if self.size < 1 << 15 else np.int32)
        np.put_along_axis(self.places, self.names, np.arange(self.size, dtype=self.places.dtype)[None, :], axis=1)
        self.largest = int(np.abs(lists).max(initial=0))
        self.read = self.unread = 0

    def _bar(self, lower: np.ndarray, alive: np.ndarray, query_id: int, k: int) -> int:
        """The k-th best lower bound, counting different ids but the query's own; none with fewer."""
        take = 2 * k
        while True:
            top = alive[np.argpartition(lower, len(alive) - take)[len(alive) - take :]] if take < len(alive) else alive
            bounds = dict(zip(top.tolist(), (lower[np.searchsorted(alive, top)]).tolist(), strict=True))
            seen: set[int] = set()
            for name in sorted(bounds, key=bounds.get, reverse=True):
                seen.update(i for i in self.ids[name] if i != query_id)
                if len(seen) >= k:
                    return bounds[name]
            if take >= len(alive):
                return NO_BAR
            take *= 4

    def best(self, query: np.ndarray, query_id: int, k: int, bar: int = NO_BAR) -> list[tuple[int, int]]:
        """The k best (score, id) of the block but the query's own id, an id once with its highest score.

        :param bar: ids that score less may be left out.
        """
        n = self.size
        lists = np.flatnonzero(query[: self.width])  # the others add nothing
        weights = query[lists]
        exact = int(np.abs(weights).max(initial=0)) * self.largest * max(1, len(lists)) < 1 << 53  # of sums in doubles
        total = np.zeros(n, dtype=float if exact else np.int64)
        alive = np.setdiff1d(np.arange(n), self.own.get(query_id, ()), assume_unique=True)
        last, ends = np.zeros((2, self.width))
        sides = [(up, lists[(weights < 0) == up]) for up in (False, True)]
        for up, some in sides:
            ends[some] = self.values[some, -1 if up else 0] * query[some].astype(float) if n else 0
        place = 0
        for depth in DEPTHS if len(lists) else ():
            stop = min(n, max(place + 1, int(n * depth)))
            if place >= n or not len(alive):
                break
            wanted = None
            if len(alive) < n // 2:  # what is out of the race is passed over
                wanted = np.zeros(n, dtype=bool)
                wanted[alive] = True
            for up, some in sides:
                part = np.s_[place:stop] if up else np.s_[n - stop : n - place]
                names = self.names[some, part].ravel()
                worth = self.doubles[some, part] * query[some, None].astype(float) if exact else self.values[some, part] * query[some, None]
                self.read += names.size
                last[some] = worth[:, -1 if up else 0]
                worth = worth.ravel()
                if wanted is not None:
                    here = np.flatnonzero(wanted[names])
                    names, worth = names[here], worth[here]
                if exact:
                    total += np.bincount(names, weights=worth, minlength=n)
                else:
                    np.add.at(total, names, worth)
            place = stop
            if place < n:
                slack = 1e-5 * (1 + np.abs(last).sum() + np.abs(ends).sum())  # of sums in single precision
                most = least = left = 0
                for up, some in sides:
                    there = self.places[some] if wanted is None else self.places[some[:, None], alive]
                    unseen = (there >= place if up else there < n - place).astype(np.float32)
                    sums = np.array([last[some], ends[some], np.ones(len(some))], dtype=np.float32) @ unseen
                    most, least, left = (x + y for x, y in zip((most, least, left), (sums if wanted is not None else sums[:, alive]).astype(float), strict=True))
                known = total[alive].astype(float)
                bar = max(bar, self._bar(known + least - slack, alive, query_id, k))
                stay = known + most + slack >= bar
                alive = alive[stay]
                if not left[stay].any():
                    break
        self.unread += len(lists) * (n - place)
        scores: dict[int, int] = {}
        for name in self._reach(total, alive, query_id, k):
            for i in self.ids[name]:
                if i != query_id:
                    scores[i] = max(scores.get(i, NO_BAR), int(total[name]))
        return sorted(((s, i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]

    def _reach(self, total: np.ndarray, alive: np.ndarray, query_id: int, k: int) -> list[int]:
        """Of vectors with final scores those that reach the k-th best."""
        scores = total[alive]
        return alive[scores >= self._bar(scores, alive, query_id, k)].tolist()


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    """Vectors side by side, shorter ones padded with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), dtype="<i8")
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


_ASKED = pa.schema([("q_ids", pa.binary()), ("q_bars", pa.binary()), ("q_bytes", pa.int32()), ("q_data", pa.binary())])


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector, bar) as blocks of ids, bars and components, in 16 bits where they fit."""
    for batch in slices(batches, BLOCK_QUERIES):
        data = _matrix(batch.column(1).to_pylist())
        kind = "<i2" if np.abs(data).max(initial=0) < 32_000 else "<i8"
        ids, bars = (np.array(batch.column(c).to_pylist(), dtype="<i8").tobytes() for c in (0, 2))
        yield pa.RecordBatch.from_pylist([{"q_ids": ids, "q_bars": bars, "q_bytes": int(kind[2]), "q_data": data.astype(kind).tobytes()}], schema=_ASKED)


def _queries(ids: bytes, bars: bytes, size: int, data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    names = np.frombuffer(ids, dtype="<i8")
    return zip(names.tolist(), np.frombuffer(bars, dtype="<i8").tolist(), np.frombuffer(data, dtype=f"<i{size}").reshape(len(names), -1).astype(np.int64), strict=True)


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best of each block for each query: a block's vectors come first, then blocks of queries."""
    part: int | None = None
    ids: list[int] = []
    values: list[list[int]] = []
    block: Block | None = None
    for batch in batches:
        for p, kind, i, v, *asked in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
            if p != part:
                part, block = p, None
                ids.clear()
                values.clear()
            if kind == 0:
                ids.append(i)
                values.append(v)
                continue
            if block is None:
                block = Block(np.array(ids, dtype=np.int64), _matrix(values), k)
            found = [(q, i, s) for q, bar, vector in _queries(*asked) for s, i in block.best(vector, q, k, bar)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])


def _search(held: DataFrame, asked: DataFrame, first: int, stop: int, k: int) -> DataFrame:
    """The best of the blocks from ``first`` to before ``stop`` for all queries."""
    empty = lambda kind: F.lit(None).cast(kind)
    vectors = held.where((F.col("part") >= first) & (F.col("part") < stop)).select("part", F.lit(0).alias("kind"), "id", "v", empty("binary").alias("q_ids"), empty("binary").alias("q_bars"), empty("int").alias("q_bytes"), empty("binary").alias("q_data"))
    sent = asked.mapInArrow(_query_blocks, "q_ids binary, q_bars binary, q_bytes int, q_data binary")
    sent = sent.select(F.explode(F.sequence(F.lit(first), F.lit(stop - 1))).alias("part"), F.lit(1).alias("kind"), empty("long").alias("id"), empty("array<long>").alias("v"), "q_ids", "q_bars", "q_bytes", "q_data")
    met = vectors.union(sent).repartition(max(partitions(held.sparkSession), stop - first), "part").sortWithinPartitions("part", "kind", "id")
    return met.mapInArrow(lambda batches: _meet(batches, k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k highest inner products of each query with all other rows, ties to the smaller id.

    :param queries: which rows are queries.
    :return: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Rows whose id or vector is null, or whose vector holds a null or a number that is not finite, take no part.
    A shorter vector counts as padded with zeros. Repeated rows count once. Where an id has several vectors, its score for a query is the highest
    product of any two of theirs, and a query excludes every row of its own id. With fewer than k others all are returned. An empty table gives
    an empty result. Vectors are dealt into blocks once; blocks of queries go to each of them and are read as a stream. The first block is searched
    before the others, and a query's k-th score there is its bar in them.
    """
    read = vectors.select(F.col(id_col).cast("long").alias("id"), quantise(vector_col, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")).where("id is not null and v is not null")
    rows = stash(read.groupBy("id", "v").agg(F.max("is_query").alias("is_query")))
    blocks = max(1, -(-rows.count() // BLOCK_VECTORS))
    held = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("part"), "id", "v")
    asked = rows.where("is_query").select("id", "v")
    found = _search(held, asked.withColumn("bar", F.lit(NO_BAR)), 0, 1, k)
    if blocks > 1:
        found = stash(found)
        scores = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
        bars = scores.where(F.size("scores") >= k).select(F.col("query_id").alias("id"), F.col("scores")[k - 1].alias("bar"))
        barred = asked.join(bars, "id", "left").select("id", "v", F.coalesce("bar", F.lit(NO_BAR)).alias("bar"))
        found = found.union(_search(held, barred, 1, blocks, k))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The search in SQL, over the table ``embeddings``.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, max(CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT)) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
  GROUP BY q.vec_id, d.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
