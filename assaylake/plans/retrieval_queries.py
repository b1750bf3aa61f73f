"""Retrieval over documents as a page corpus: benchmark passages are queries, documents that contain one are relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.text import STOPWORDS, tokenize
from assaylake.operators import lexical_index
from assaylake.operators import retrieval as R
from assaylake.plans.derived import relation
from assaylake.plans.registry import query
from assaylake.sources.tables import lasting_path, stash, version

K, DEEP = 5, 20
DEPTHS = (1, 3, 5, 10, 20)
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

#: Tokens of the corpus and the queries, for the oracles.
_TOKENS = f"""
corpus AS (SELECT doc_id AS chunk_id, source AS document_id, text FROM documents),
queries AS (SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS document_id, text FROM benchmark),
ctok AS (SELECT chunk_id, document_id, t AS term FROM (SELECT chunk_id, document_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|[0-9][0-9,.]*')) AS r FROM corpus),
  LATERAL (SELECT CASE WHEN regexp_matches(r, '^[0-9]') THEN replace(regexp_replace(r, '[.,]+$', ''), ',', '') ELSE r END AS t) WHERE t <> '' AND t NOT IN ({_STOP})),
qtok AS (SELECT query_id, document_id, t AS term, count(*) AS qtf FROM (SELECT query_id, document_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|[0-9][0-9,.]*')) AS r FROM queries),
  LATERAL (SELECT CASE WHEN regexp_matches(r, '^[0-9]') THEN replace(regexp_replace(r, '[.,]+$', ''), ',', '') ELSE r END AS t) WHERE t <> '' AND t NOT IN ({_STOP}) GROUP BY ALL),
lengths AS (SELECT c.chunk_id, c.document_id, count(t.term) AS length FROM corpus c LEFT JOIN ctok t USING (chunk_id) GROUP BY c.chunk_id, c.document_id),
tf AS (SELECT chunk_id, document_id, term, count(*) AS tf FROM ctok GROUP BY ALL)
"""
_WEIGHT = "sum(q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * (tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * l.length / s.mean))))"
_BM25 = f"""bm25 AS (SELECT q.query_id, tf.chunk_id, round({_WEIGHT}, 6) AS score FROM qtok q JOIN tf USING (term) JOIN lengths l ON l.chunk_id = tf.chunk_id
  JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) d ON d.term = tf.term, (SELECT count(*) AS n, avg(length) AS mean FROM lengths) s GROUP BY q.query_id, tf.chunk_id)"""
_SCOPED = f"""bm25 AS (SELECT q.query_id, tf.chunk_id, round({_WEIGHT}, 6) AS score FROM qtok q JOIN tf ON tf.term = q.term AND tf.document_id = q.document_id JOIN lengths l ON l.chunk_id = tf.chunk_id
  JOIN (SELECT document_id, term, count(*) AS df FROM tf GROUP BY ALL) d ON d.term = tf.term AND d.document_id = tf.document_id JOIN (SELECT document_id, count(*) AS n, avg(length) AS mean FROM lengths GROUP BY document_id) s ON s.document_id = tf.document_id
  GROUP BY q.query_id, tf.chunk_id)"""
_UNIT = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS size FROM embeddings)"""
_DENSE = """dense AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, round(CASE WHEN q.size * d.size = 0 THEN 0 ELSE list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) / (q.size * d.size) END, 6) AS score FROM v q JOIN v d ON q.vec_id % 100 = 0)"""


def _ranked(source: str, k: int = K) -> str:
    return f"(SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k})"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("document_id"), "text")


def stored_index(spark: SparkSession, sf_dir: str) -> lexical_index.LexicalIndex:
    """The index of the documents, built at its first use and kept in the shared folder; changed documents get a new one."""
    name = f"lexical-{version(spark, f'{sf_dir}/documents.parquet')}"
    path, _ = lasting_path(spark, name)
    _, complete = lasting_path(spark, f"{name}/terms/_SUCCESS")  # the part that is written last
    return lexical_index.read_index(spark, path) if complete else lexical_index.write_index(corpus(spark, sf_dir), path)


def lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Chunks among which are the k best of each question."""
    return lexical_index.search_index(stored_index(spark, sf_dir), questions(spark, sf_dir), k, 6)


def lexical_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each question's own document; one search does not repay a second index."""
    return R.search(questions(spark, sf_dir), corpus(spark, sf_dir), "document_id")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors whose id is divisible by 100 as queries, and all vectors."""
    e = relation(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label"))
    return e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), e


@query("token_counts", f"WITH {_TOKENS} SELECT document_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM ctok GROUP BY document_id")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = corpus(spark, sf_dir).select("document_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("document_id", "term").count().groupBy("document_id").agg(F.sum("count").alias("n_tokens"), F.count("*").alias("n_terms"))


@query(
    "bm25_index",
    f"""WITH {_TOKENS}, placed AS (SELECT chunk_id, length, (row_number() OVER (ORDER BY length, chunk_id) - 1) // {lexical_index.BLOCK_CHUNKS} AS block FROM lengths), s AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths)
      SELECT term, count(*) AS df, count(DISTINCT block) AS n_blocks, round(any_value(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5))), 6) AS idf, round(max(tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * p.length / s.mean))), 6) AS bound
      FROM tf JOIN placed p USING (chunk_id) JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) d USING (term), s GROUP BY term""",
)
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of the stored index with the blocks that hold them and their greatest weight."""
    index = stored_index(spark, sf_dir)
    held = index.blocks.groupBy("term").agg(F.count("*").alias("n_blocks"), F.round(F.max("bound"), 6).alias("bound"))
    return index.terms.join(held, "term").select("term", "df", "n_blocks", F.round("idf", 6).alias("idf"), "bound")


@query("bm25_topk", f"WITH {_TOKENS}, {_BM25} SELECT * FROM {_ranked('bm25')}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(lexical(spark, sf_dir, K), K, 6)


@query("bm25_scoped_topk", f"WITH {_TOKENS}, {_SCOPED} SELECT * FROM {_ranked('bm25')}")
def bm25_scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(lexical_scoped(spark, sf_dir), K, 6)


@query("dense_topk", f"WITH {_UNIT}, {_DENSE} SELECT * FROM {_ranked('dense')}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, all_vectors = vectors(spark, sf_dir)
    return R.top_k(R.dense(asked, all_vectors, K, 6), K, 6)


#: Vectors stand in for the embeddings of documents with the same number.
_FUSED = f"""dense AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, round(CASE WHEN q.size * d.size = 0 THEN 0 ELSE list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) / (q.size * d.size) END, 6) AS score
  FROM v q JOIN v d ON q.vec_id IN (SELECT query_id FROM queries)),
fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, chunk_id, rank FROM {_ranked("bm25", 2 * K)} UNION ALL SELECT query_id, chunk_id, rank FROM {_ranked("dense", 2 * K)}) GROUP BY ALL)"""


def hybrid(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    _, every = vectors(spark, sf_dir)
    asked = questions(spark, sf_dir).select("query_id").join(every, F.col("query_id") == F.col("chunk_id")).select("query_id", "vector")
    return R.hybrid(lexical(spark, sf_dir, 2 * k), R.dense(asked, every, 2 * k, 6), k, 6)


@query("hybrid_rrf", f"WITH {_TOKENS}, {_BM25}, {_UNIT}, {_FUSED} SELECT * FROM {_ranked('fused')}")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir)


_MEASURES = f"""
hits AS ({{arms}}),
gold AS (SELECT query_id, c.chunk_id, c.document_id FROM queries q JOIN corpus c ON contains(c.text, q.text)),
wanted AS (SELECT query_id, count(DISTINCT chunk_id) AS n_gold FROM gold GROUP BY query_id),
arms AS (SELECT DISTINCT arm FROM hits),
marked AS (SELECT h.*, g.chunk_id IS NOT NULL AS page, h.document_id IN (SELECT document_id FROM gold x WHERE x.query_id = h.query_id) AS doc FROM hits h LEFT JOIN gold g ON g.query_id = h.query_id AND g.chunk_id = h.chunk_id),
measures AS (SELECT a.arm, w.query_id, CAST(d.k AS BIGINT) AS k, coalesce(max(CAST(m.doc AS DOUBLE)), 0) AS document_hit, CAST(count(*) FILTER (m.page) > 0 AS DOUBLE) AS page_hit,
    CASE WHEN count(m.rank) = 0 THEN 0 ELSE count(*) FILTER (m.page) / count(m.rank) END AS precision, count(*) FILTER (m.page) / w.n_gold AS recall,
    coalesce(1.0 / min(CASE WHEN m.page THEN m.rank END), 0) AS mrr, CAST(min(CASE WHEN m.page THEN m.rank END) AS DOUBLE) AS first_rank,
    CASE WHEN count(m.rank) = 0 THEN 0 ELSE coalesce(sum(CASE WHEN m.page THEN 1 / log2(m.rank + 1) END), 0) / list_sum(list_transform(range(1, CAST(least(w.n_gold, count(m.rank)) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg
  FROM wanted w CROSS JOIN arms a CROSS JOIN (VALUES (1), (3), (5), (10), (20)) d(k) LEFT JOIN marked m ON m.query_id = w.query_id AND m.arm = a.arm AND m.rank <= d.k GROUP BY a.arm, w.query_id, d.k, w.n_gold),
full_measures AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM measures)
"""
_ARM = "SELECT '{arm}' AS arm, r.query_id, r.chunk_id, c.document_id, r.rank FROM {ranked} r JOIN corpus c USING (chunk_id)"
_NAMES = ("document_hit", "page_hit", "precision", "recall", "f1", "mrr", "ndcg")


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of queries and the chunks that contain their whole text: a stated set of queries against all rows."""
    chunks = corpus(spark, sf_dir)
    return R.containing(questions(spark, sf_dir), chunks).join(chunks.select("chunk_id", "document_id"), "chunk_id")


def _arm(name: str, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    return ranked.join(chunks.select("chunk_id", "document_id"), "chunk_id").withColumn("arm", F.lit(name))


@query(
    "retrieval_measures",
    f"WITH {_TOKENS}, {_BM25}, {_MEASURES.format(arms=_ARM.format(arm='bm25', ranked=_ranked('bm25', DEEP)))} SELECT arm, query_id, k, first_rank, {', '.join(f'CAST(round({n}, 6) AS DOUBLE) AS {n}' for n in _NAMES)} FROM full_measures",
)
def retrieval_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _arm("bm25", R.top_k(lexical(spark, sf_dir, DEEP), DEEP, 6), corpus(spark, sf_dir))
    return R.relevance_measures(hits, relevant(spark, sf_dir), list(DEPTHS), "arm").withColumns({n: F.round(n, 6) for n in _NAMES})


_SCOPED_CTE = _SCOPED.replace("bm25 AS", "scoped AS")
#: Vectors of the chunks; a scoped query meets those of its own document.
_CHUNK_VECTORS = "cv AS (SELECT v.vec_id, v.v, v.size, c.document_id FROM v JOIN corpus c ON c.chunk_id = v.vec_id), qv AS (SELECT v.vec_id, v.v, v.size, q.document_id FROM v JOIN queries q ON q.query_id = v.vec_id)"
_COSINE = "round(CASE WHEN q.size * d.size = 0 THEN 0 ELSE list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) / (q.size * d.size) END, 6)"


def _fusion(name: str, lexical_: str, dense_: str) -> str:
    return f"{name} AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, chunk_id, rank FROM {_ranked(lexical_, 2 * DEEP)} UNION ALL SELECT query_id, chunk_id, rank FROM {_ranked(dense_, 2 * DEEP)}) GROUP BY ALL)"


_ARMS = {"bm25": "bm25", "bm25_scoped": "scoped", "dense": "dense_open", "dense_scoped": "dense_scoped", "hybrid": "hybrid_open", "hybrid_scoped": "hybrid_scoped"}
_ALL_ARMS = f"""{_BM25}, {_SCOPED_CTE}, {_UNIT}, {_CHUNK_VECTORS}, dense_open AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, {_COSINE} AS score FROM qv q JOIN cv d ON TRUE),
  dense_scoped AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, {_COSINE} AS score FROM qv q JOIN cv d ON d.document_id = q.document_id), {_fusion("hybrid_open", "bm25", "dense_open")}, {_fusion("hybrid_scoped", "scoped", "dense_scoped")}"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 20 of each arm, written once as small tables: each search runs once, and the fusions read its top 40."""
    chunks, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    _, every = vectors(spark, sf_dir)
    placed = every.join(chunks.select("chunk_id", "document_id"), "chunk_id")
    wanted = asked.select("query_id", "document_id").join(every, F.col("query_id") == F.col("chunk_id")).select("query_id", "document_id", "vector")
    deep = lambda arm, scored: R.top_k(scored, 2 * DEEP, 6).withColumn("arm", F.lit(arm))
    searched = stash(
        deep("bm25", lexical(spark, sf_dir, 2 * DEEP)).unionByName(deep("bm25_scoped", lexical_scoped(spark, sf_dir))).unionByName(deep("dense", R.dense(wanted, placed, 2 * DEEP, 6))).unionByName(deep("dense_scoped", R.dense(wanted, placed, 2 * DEEP, 6, "document_id")))
    )
    of = lambda arm: searched.where(F.col("arm") == arm)
    fused = [R.top_k(R.fuse(of(f"bm25{s}"), of(f"dense{s}")), DEEP, 12).withColumn("arm", F.lit(f"hybrid{s}")) for s in ("", "_scoped")]
    return searched.where(F.col("rank") <= DEEP).unionByName(fused[0]).unionByName(fused[1])


@query(
    "retrieval_ablation",
    f"""WITH {_TOKENS}, {_ALL_ARMS}, {_MEASURES.format(arms=" UNION ALL ".join(_ARM.format(arm=a, ranked=_ranked(s, DEEP)) for a, s in _ARMS.items()))}
      SELECT arm, k, count(*) AS n, {", ".join(f"CAST(round(avg({n}), 6) AS DOUBLE) AS {n}" for n in _NAMES)}, round(avg(first_rank), 6) AS mean_rank FROM full_measures GROUP BY arm, k""",
)
def retrieval_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = arms(spark, sf_dir).join(corpus(spark, sf_dir).select("chunk_id", "document_id"), "chunk_id")
    measured = R.relevance_measures(hits, stash(relevant(spark, sf_dir)), list(DEPTHS), "arm")
    return R.ablation(measured, "arm").withColumns({n: F.round(n, 6) for n in (*_NAMES, "mean_rank")})


@query("dense_label_agreement", f"WITH {_UNIT}, {_DENSE} SELECT r.query_id, count(*) FILTER (a.label = b.label) AS n_same FROM {_ranked('dense')} r JOIN v a ON a.vec_id = r.query_id JOIN v b ON b.vec_id = r.chunk_id GROUP BY r.query_id")
def dense_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, every = vectors(spark, sf_dir)
    top = R.top_k(R.dense(asked, every, K, 6), K, 6)
    labels = every.select("chunk_id", "label")
    both = top.join(labels, "chunk_id").join(labels.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return both.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("own")).alias("n_same"))
