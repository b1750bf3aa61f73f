"""Lexical, vector and fused retrieval, and its measures.

Queries are (query_id, text) and never see what is relevant. BM25 goes through an inverted index: only postings of
query terms are joined, query terms keep their repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from assaylake.functions.text import tokenize
from assaylake.sources.tables import stash

K1, B, RRF_K = 1.5, 0.75, 60


def tokenised(corpus: DataFrame, *scope: str, text: str = "text") -> DataFrame:
    """The tokens of chunks and their number, written once: whatever is counted afterwards reads no text."""
    return stash(corpus.select(*scope, "chunk_id", tokenize(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens")))


def postings(sized: DataFrame, *scope: str, queries: DataFrame | None = None) -> DataFrame:
    """Term frequencies of chunks, with the chunk's length and, within each scope, the number of chunks, their mean length
    and the chunks that have the term. Empty chunks count in the statistics.

    :param sized: chunks as ``tokenised`` gives them.
    :param queries: only their terms are indexed, each in the query's scope: all other tokens leave before anything is counted.
    """
    stats = sized.groupBy(*scope).agg(F.count("*").alias("n_chunks"), F.avg("length").alias("mean_length"))
    words = sized.select(*scope, "chunk_id", "length", F.explode("tokens").alias("term"))
    if queries is not None:
        words = words.join(query_terms(queries, *scope).select(*scope, "term").distinct(), [*scope, "term"], "left_semi")
    tf = stash(words.groupBy(*scope, "chunk_id", "length", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    out = tf.join(df, [*scope, "term"])
    return out.join(stats, list(scope)) if scope else out.crossJoin(stats)  # one row of totals


def query_terms(queries: DataFrame, *scope: str, text: str = "text") -> DataFrame:
    """The terms of queries with their repeats as ``qtf``."""
    return queries.select("query_id", *scope, F.explode(tokenize(F.col(text))).alias("term")).groupBy("query_id", *scope, "term").agg(F.count("*").alias("qtf"))


def bm25(queries: DataFrame, index: DataFrame, *scope: str) -> DataFrame:
    """The BM25 score of each query and chunk that share a term; a scoped query sees its own scope alone."""
    idf = F.ln(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return query_terms(queries, *scope).join(index, [*scope, "term"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * idf * weight).alias("score"))


def search(queries: DataFrame, corpus: DataFrame, scope: str | None = None, sized: DataFrame | None = None) -> DataFrame:
    """BM25 of queries over a corpus; with a scope a query sees the chunks of its own scope, and one whose scope is null sees all.

    :param sized: the corpus as ``tokenised`` gives it, where it is there already.
    """
    sized = tokenised(corpus, *([scope] if scope else [])) if sized is None else sized
    if scope is None:
        return bm25(queries, postings(sized, queries=queries))
    own, free = queries.where(F.col(scope).isNotNull()), queries.where(F.col(scope).isNull())
    return bm25(own, postings(sized, scope, queries=own), scope).unionByName(bm25(free, postings(sized, queries=free)))


def containing(passages: DataFrame, corpus: DataFrame, passage: str = "text", text: str = "text") -> DataFrame:
    """Pairs ``query_id``, ``chunk_id`` of passages and the chunks that contain their whole text.

    A passage's inner words stand as whole words in every chunk that contains it, so the longest of them finds the chunks
    in which the passage is then looked for; passages of fewer than three words are looked for in all chunks.
    """
    words = F.split(F.col(passage), r"\s+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    wanted = passages.select("query_id", F.col(passage).alias("wanted"), F.when(F.size(inner) > 0, longest).alias("word"))
    by_word = corpus.select("chunk_id", F.explode(F.array_distinct(F.split(F.col(text), r"\s+"))).alias("word"))
    met = by_word.join(wanted.where("word is not null"), "word").select("chunk_id", "query_id", "wanted").distinct()
    found = met.join(corpus.select("chunk_id", text), "chunk_id").where(F.contains(F.col(text), F.col("wanted"))).select("query_id", "chunk_id")
    short = wanted.where("word is null").select("query_id", "wanted")
    return found.unionByName(corpus.join(short, F.contains(F.col(text), F.col("wanted"))).select("query_id", "chunk_id"))


def top_k(scored: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k best chunks of each query, ties to the smaller id, ranked from 1; ``digits`` rounds the score first."""
    rows = scored.withColumn("score", F.round("score", digits)) if digits is not None else scored
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Vectors that are multiplied with queries at a time, and queries.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 256


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Unit vectors side by side, shorter ones padded with zeros; one without length stays zero."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy(zero_copy_only=False)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def _best(scores: np.ndarray, k: int, digits: int | None) -> np.ndarray:
    """The places of the k best scores, ties to the smaller place; ``digits`` rounds them first."""
    scores = scores if digits is None else np.sign(scores) * np.floor(np.abs(scores) * 10.0**digits + 0.5)
    if k >= len(scores):
        return np.arange(len(scores))
    bar = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, level = np.flatnonzero(scores > bar), np.flatnonzero(scores == bar)
    return np.concatenate([above, level[: k - len(above)]])


def _multiply(batches: Iterator[pa.RecordBatch], k: int, digits: int | None) -> Iterator[pa.RecordBatch]:
    """The best of each block for each query. Rows are sorted by block, a block's vectors by id before its queries."""
    held: list[tuple[pa.Array, np.ndarray]] = []
    block: tuple[pa.Array, np.ndarray] | None = None
    current = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if start == stop:
                continue
            *name, kind = keys[start]
            if name != current:
                current, held, block = name, [], None
            part = batch.slice(start, stop - start)
            vectors = pa.ListArray.from_arrays(*_rebased(part.column(5)))
            if kind == 0:
                held.append((part.column(3), _matrix(vectors)))
                continue
            if not held:
                continue
            if block is None:
                width = max(m.shape[1] for _, m in held)
                block = pa.concat_arrays([ids for ids, _ in held]), np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in held])
            ids, values = block
            for at in range(0, len(part), BLOCK_QUERIES):
                asked = _matrix(vectors.slice(at, BLOCK_QUERIES)) if len(part) > BLOCK_QUERIES else _matrix(vectors)
                width = min(asked.shape[1], values.shape[1])
                scores = asked[:, :width] @ values[:, :width].T
                found = [_best(row, k, digits) for row in scores]
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                places = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([part.column(4).take(pa.array(owner + at)), ids.take(pa.array(places)), pa.array(scores[owner, places])], names=["query_id", "chunk_id", "score"])


def _rebased(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """The offsets from 0 and the values of a slice of lists."""
    offsets = lists.offsets.to_numpy()
    return pa.array(offsets - offsets[0], type=pa.int32()), lists.flatten()


def dense(queries: DataFrame, vectors: DataFrame, k: int, digits: int | None = None, scope: str | None = None) -> DataFrame:
    """The k best cosines of each query vector with the vectors, ties to the smaller ``chunk_id``; a vector without length scores 0.
    With a scope a query meets the vectors of its own.

    Vectors lie in blocks; queries, a stated set, are copied to each block of theirs and multiplied with all of it at once. Of a
    block only the k best leave the task, so no pair is a row. A shorter vector counts as padded with zeros; rows whose vector is
    null or holds a null or no number, or whose scope is null, take no part.

    :param digits: scores are compared as they are when rounded to so many.
    :return: ``query_id``, ``chunk_id``, ``score``: at most k rows for each query and block; ``top_k`` makes them the k best of all.
    """
    known = lambda df: df.where("vector is not null").where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    name = F.lit("") if scope is None else F.col(scope).cast("string")
    v = known(vectors).select(name.alias("scope"), "chunk_id", F.col("vector").cast("array<double>").alias("vector")).where("scope is not null")
    q = known(queries).select(name.alias("scope"), "query_id", F.col("vector").cast("array<double>").alias("vector")).where("scope is not null")
    sizes = v.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))
    held = v.join(sizes, "scope").select("scope", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "chunk_id", F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), "vector")
    asked = q.join(sizes, "scope").select("scope", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.lit(None).cast(v.schema["chunk_id"].dataType).alias("chunk_id"), "query_id", "vector")
    met = held.unionByName(asked).repartition("scope", "block").sortWithinPartitions("scope", "block", "kind", "chunk_id")
    schema = StructType([q.schema["query_id"], v.schema["chunk_id"], StructField("score", DoubleType())])
    return met.mapInArrow(lambda batches: _multiply(batches, k, digits), schema)


def fuse(*ranked: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of ranked results."""
    parts = [r.select("query_id", "chunk_id", (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("part")) for r in ranked]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


def hybrid(lexical: DataFrame, vector: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The top k of the fusion of two top 2k."""
    return top_k(fuse(top_k(lexical, 2 * k, digits), top_k(vector, 2 * k, digits)), k, 12)


def relevance_measures(hits: DataFrame, gold: DataFrame, ks: list[int], *by: str) -> DataFrame:
    """For each query and depth: hits, precision, recall, F1, reciprocal rank, the rank of the first hit and nDCG.

    Only queries with something relevant count. Deeper results are cut for smaller depths, never searched again.

    :param hits: ``by``, ``query_id``, ``chunk_id``, ``document_id``, ``rank``. :param gold: ``query_id``, ``chunk_id``, ``document_id``.
    """
    wanted = gold.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_gold"))
    marked = hits.join(gold.select("query_id", "chunk_id", F.lit(1).alias("page")).distinct(), ["query_id", "chunk_id"], "left")
    marked = marked.join(gold.select("query_id", "document_id", F.lit(1).alias("doc")).distinct(), ["query_id", "document_id"], "left")
    deep = marked.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where(F.col("rank") <= F.col("k"))
    found = deep.groupBy(*by, "query_id", "k").agg(
        F.count("*").alias("n_found"), F.coalesce(F.sum("page"), F.lit(0)).alias("n_hit"), F.coalesce(F.max("doc"), F.lit(0)).alias("document_hit"),
        F.min(F.when(F.col("page") == 1, F.col("rank"))).alias("first_rank"), F.coalesce(F.sum(F.when(F.col("page") == 1, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    arms = hits.select(*by).distinct() if by else None
    depths = F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")
    frame = (wanted.crossJoin(F.broadcast(arms)) if arms is not None else wanted).select("*", depths)  # an arm is one of a few settings
    rows = frame.join(found, [*by, "query_id", "k"], "left").fillna(0, ["n_found", "n_hit", "document_hit", "dcg"])
    precision, recall = F.coalesce(F.try_divide("n_hit", "n_found"), F.lit(0.0)), F.col("n_hit") / F.col("n_gold")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_gold", "n_found")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return rows.select(
        *by, "query_id", "k", F.col("document_hit").cast("double").alias("document_hit"), (F.col("n_hit") > 0).cast("double").alias("page_hit"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        F.col("first_rank").cast("double").alias("first_rank"), F.when(F.col("n_found") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def ablation(measures: DataFrame, *by: str) -> DataFrame:
    """Means of the measures for each arm and depth; the mean rank is over hits alone."""
    names = ("document_hit", "page_hit", "precision", "recall", "f1", "mrr", "ndcg")
    return measures.groupBy(*by, "k").agg(F.count("*").alias("n"), *(F.avg(n).alias(n) for n in names), F.avg("first_rank").alias("mean_rank"))


def normalise_page(text: Column) -> Column:
    """Page text with plain blanks: no-break spaces and runs of blanks become one blank, three or more newlines two."""
    blanks = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(blanks, r"\n{3,}", "\n\n"))
