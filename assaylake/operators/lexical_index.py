"""A stored BM25 index: postings in blocks with score bounds, so that a search opens only blocks that can hold one of its best.

Chunks of a scope are numbered by length, then id, and cut into blocks of equal number; a row of the index is a term in a block, with the
postings of its chunks and the greatest weight among them. Chunks of a block are of like length, which keeps that bound close.

``search_index`` moves the postings of the queries' terms once, a group of blocks to a task, which scores all queries against them and lets
only the best k of each leave: what is moved grows with the postings, never with postings times queries. ``search_bounded`` reads the
bounds alone, scores the few most promising blocks of each query, and then only blocks whose bound reaches the k-th best score; it
pays where lengths and words are skewed. Nothing is estimated by either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from assaylake.operators.numbering import numbered
from assaylake.operators.retrieval import B, K1, query_terms, tokenised
from assaylake.sources.tables import stash

#: Chunks in a block, and blocks of each query that are scored before any is left out.
BLOCK_CHUNKS, FIRST_BLOCKS = 128, 16
#: Blocks that are scored together.
GROUP_BLOCKS = 128


@dataclass(frozen=True)
class LexicalIndex:
    """``blocks``: scope, term, block, bound, n, postings (chunk_id, weight). ``terms``: scope, term, df, idf."""

    blocks: DataFrame
    terms: DataFrame
    scope: tuple[str, ...]


def write_index(corpus: DataFrame, path: str, *scope: str, text: str = "text", block_chunks: int = BLOCK_CHUNKS) -> LexicalIndex:
    """Build the index of a corpus (``chunk_id``, the scope, ``text``) under a path. The corpus is read and tokenised once.

    Rows of one id in one scope are one chunk. Rows with a null id or scope take no part; null texts are empty; empty chunks count in
    the statistics. A frequent term is as many rows as there are blocks that hold it, dealt over ranges of (scope, term, block), so no
    task holds a term; a row holds at most ``block_chunks`` postings.
    """
    keys = [*scope, "chunk_id"]
    sized = tokenised(corpus.dropna(subset=keys), *scope, text=text)
    chunks = sized.groupBy(*keys).agg(F.sum("length").alias("length"))
    stats = chunks.groupBy(*scope).agg(F.count("*").alias("n_chunks"), F.avg("length").alias("mean_length"))
    with_stats = lambda df: df.join(stats, list(scope)) if scope else df.crossJoin(stats)  # noqa: E731  one row of totals
    placed = numbered(chunks, list(scope), ["length", "chunk_id"]).withColumn("block", F.floor((F.col("number") - 1) / block_chunks))
    own = placed.select(*keys, F.col("length").alias("size"), "block")
    by_block = sized.join(own, keys).repartition(*scope, "block")  # tokens are moved to their block, and counted and gathered there
    words = by_block.select(*keys, "size", "block", F.explode("tokens").alias("term"))
    tf = words.groupBy(*keys, "size", "block", "term").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_length")))
    weighed = with_stats(tf).withColumn("weight", weight)
    blocks = weighed.groupBy(*scope, "term", "block").agg(F.max("weight").alias("bound"), F.count("*").alias("n"), F.collect_list(F.struct("chunk_id", "weight")).alias("postings"))
    order = [*scope, "term", "block"]
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/blocks")
    counted = corpus.sparkSession.read.parquet(f"{path}/blocks").groupBy(*scope, "term").agg(F.sum("n").alias("df"))
    idf = F.ln(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    with_stats(counted).select(*scope, "term", "df", idf.alias("idf")).write.mode("overwrite").parquet(f"{path}/terms")
    return read_index(corpus.sparkSession, path, *scope)


def read_index(spark: SparkSession, path: str, *scope: str) -> LexicalIndex:
    """The index that ``write_index`` left under a path."""
    return LexicalIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"), scope)


def block_bounds(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """The terms of queries in the blocks that have them: ``query_id``, scope, term, block, ``idf`` times repeats as ``factor``, bound.
    No posting is read."""
    keys = [*index.scope, "term"]
    asked = query_terms(queries, *index.scope).join(index.terms, keys).select("query_id", *keys, (F.col("qtf") * F.col("idf")).alias("factor"))
    return asked.join(index.blocks.select(*keys, "block", "bound"), keys)


def score_blocks(index: LexicalIndex, met: DataFrame, pairs: DataFrame) -> DataFrame:
    """The scores of all chunks of the blocks in ``pairs`` (query_id, scope, block) that share a term with the query."""
    place = [*index.scope, "block"]
    opened = met.drop("bound").join(pairs.select("query_id", *place), ["query_id", *place], "left_semi").join(index.blocks.drop("bound", "n"), [*place, "term"])
    each = opened.select("query_id", *place, "factor", F.inline("postings"))
    return each.groupBy("query_id", *place, "chunk_id").agg(F.sum(F.col("factor") * F.col("weight")).alias("score"))


def candidate_blocks(index: LexicalIndex, met: DataFrame, k: int, digits: int | None = None, first_blocks: int = FIRST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The scored chunks of the first blocks of each query, and the other blocks that can hold one of its k best."""
    place = [*index.scope, "block"]
    bounds = met.groupBy("query_id", *place).agg(F.sum(F.col("factor") * F.col("bound")).alias("bound"))
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= first_blocks)
    scored = stash(score_blocks(index, met, first))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kept = scored.select("query_id", "score", F.row_number().over(by_score).alias("place")).where(F.col("place") <= k)
    bars = kept.groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "bar")
    slack = 1e-9 + (10.0**-digits if digits is not None else 0.0)  # scores that are equal when rounded are ties
    done = scored.select("query_id", *place).distinct()
    rest = bounds.join(bars, "query_id", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - slack)).join(done, ["query_id", *place], "left_anti")
    return scored, rest


def search_bounded(index: LexicalIndex, queries: DataFrame, k: int, digits: int | None = None, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """What ``search_index`` gives, without opening blocks that cannot hold one of the k best. Each query costs a row for every block
    of each of its terms, and a row for every posting opened."""
    met = stash(block_bounds(index, queries))
    scored, rest = candidate_blocks(index, met, k, digits, first_blocks)
    return scored.unionByName(score_blocks(index, met, rest)).select("query_id", "chunk_id", "score")


def _candidates(scores: np.ndarray, k: int, digits: int | None) -> np.ndarray:
    """The places of scores above 0 among which are the k best, ties to the smaller place, in whatever way a score is rounded that
    lies between two values of ``digits``."""
    some = np.flatnonzero(scores > 0)
    if len(some) <= k:
        return some
    exact = scores[some] if digits is None else scores[some] * 10.0**digits
    low, high = (exact, exact) if digits is None else (np.floor(exact + 0.5 - 1e-4), np.floor(exact + 0.5 + 1e-4))
    bar = np.partition(low, len(low) - k)[len(low) - k]
    level = np.flatnonzero((low == bar) & (high == bar))
    return some[np.concatenate([np.flatnonzero((high > bar) | ((high == bar) & (low < bar))), level[:k]])]


def _score_groups(batches: Iterator[pa.RecordBatch], k: int, digits: int | None) -> Iterator[pa.RecordBatch]:
    """The best of each group for each query. Rows are sorted: a group's postings by term come before its queries' terms by query."""
    current = query = None
    held: dict[str, list[pa.StructArray]] = {}
    at: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    ids, scores, done = None, np.zeros(0), []

    def close() -> None:
        best = _candidates(scores, k, digits)
        if len(best):
            done.append((query, ids.take(pa.array(best)), scores[best]))
        scores[:] = 0

    for batch in batches:
        told = {c: batch.column(c).to_pylist() for c in ("scope", "group", "kind", "term", "query_id", "factor")}
        rows = list(zip(told["scope"], told["group"], told["kind"], told["term"], strict=True))
        i = 0
        while i < len(rows):
            *place, kind, term = rows[i]
            if place != current:
                if query is not None:
                    close()
                current, query, held, at = place, None, {}, {}
            if kind == 0:
                end = i + 1
                while end < len(rows) and rows[end] == rows[i]:
                    end += 1
                held.setdefault(term, []).append(batch.column("postings").slice(i, end - i).flatten())
                i = end
                continue
            if held:  # the first query of the group: places are in the order of ids
                chunks = pa.concat_arrays([part.field("chunk_id") for parts in held.values() for part in parts])
                ids = chunks.unique()
                ids = ids.take(pc.sort_indices(ids))
                places, first = pc.index_in(chunks, ids).to_numpy(), 0
                for name, parts in held.items():
                    weights = np.concatenate([part.field("weight").to_numpy(zero_copy_only=False) for part in parts])
                    at[name] = places[first : first + len(weights)], weights
                    first += len(weights)
                scores, held = np.zeros(len(ids)), {}
            if at:
                if told["query_id"][i] != query:
                    if query is not None:
                        close()
                    query = told["query_id"][i]
                if term in at:
                    where, weights = at[term]
                    scores[where] += told["factor"][i] * weights
            i += 1
        if done:
            yield _found(done, batch.schema.field("query_id").type)
            done.clear()
    if query is not None:
        close()
    if done:
        yield _found(done, batch.schema.field("query_id").type)


def _found(done: list[tuple[object, pa.Array, np.ndarray]], query_type: pa.DataType) -> pa.RecordBatch:
    owners = pa.array([q for q, _, _ in done], type=query_type).take(pa.array(np.repeat(np.arange(len(done)), [len(s) for _, _, s in done])))
    return pa.RecordBatch.from_arrays([owners, pa.concat_arrays([c for _, c, _ in done]), pa.array(np.concatenate([s for _, _, s in done]))], names=["query_id", "chunk_id", "score"])


def search_index(index: LexicalIndex, queries: DataFrame, k: int, digits: int | None = None, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """``query_id``, ``chunk_id``, ``score`` of chunks among which are the k best of each query, ties and rounding to ``digits``
    included; ``top_k`` makes them the k best. A query has one scope and meets the chunks of its own; one whose scope is null meets none.
    Repeated terms of a query count each time. Queries are a stated set: their terms are copied to each group of blocks of their scope,
    whose postings they meet in one task, and at most some 2 k rows of each query leave it.
    """
    keys = [*index.scope, "term"]
    asked = stash(query_terms(queries, *index.scope).join(index.terms, keys).select("query_id", *keys, (F.col("qtf") * F.col("idf")).alias("factor")))
    name = F.to_json(F.struct(*index.scope)) if index.scope else F.lit("")
    group = F.floor(F.col("block") / group_blocks).cast("long")
    opened = index.blocks.join(asked.select(*keys).distinct(), keys, "left_semi")
    query, chunk = asked.schema["query_id"], StructField("chunk_id", index.blocks.schema["postings"].dataType.elementType["chunk_id"].dataType)
    held = opened.select(name.alias("scope"), group.alias("group"), F.lit(0).alias("kind"), F.lit(None).cast(query.dataType).alias("query_id"), "term", F.lit(None).cast("double").alias("factor"), "postings")
    groups = index.blocks.groupBy(name.alias("scope")).agg((F.floor(F.max("block") / group_blocks).cast("long")).alias("last"))
    copied = asked.select(name.alias("scope"), "query_id", "term", "factor").join(groups, "scope").select("scope", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("group"), F.lit(1).alias("kind"), "query_id", "term", "factor", F.lit(None).cast(index.blocks.schema["postings"].dataType).alias("postings"))
    met = held.unionByName(copied).repartition("scope", "group").sortWithinPartitions("scope", "group", "kind", "query_id", "term")
    return met.mapInArrow(lambda batches: _score_groups(batches, k, digits), StructType([query, chunk, StructField("score", DoubleType())]))
