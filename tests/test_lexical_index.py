"""The stored BM25 index against the search without one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assaylake.operators import lexical_index, retrieval
from assaylake.sources import tables

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]


def _pages(n: int) -> list[tuple]:
    draw = random.Random(4)
    long = lambda: 400 if draw.random() < 0.02 else draw.randrange(0, 30)
    return [(i, f"d{i % 3}", " ".join(draw.choices(WORDS, weights=[1 / (j + 1) for j in range(60)], k=long()))) for i in range(n)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [*_pages(500), (900, "d0", None), (901, None, "waa wba"), (None, "d1", "waa"), (902, "d1", ""), (903, "d2", "waa " * 50), (904, "d2", "waa " * 50)]
    return spark.createDataFrame(rows, "chunk_id long, document_id string, text string")


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "d0", "waa"), (2, "d1", "waa wzb wzb nothing"), (3, "d2", " ".join(WORDS)), (4, "d9", "waa"), (5, "d1", ""), (6, "d0", None), (7, None, "wdc wec")]
    return spark.createDataFrame(rows, "query_id int, document_id string, text string")


def _top(scored, k):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieval.top_k(scored, k, 6).collect())


@pytest.mark.parametrize("scope", [(), ("document_id",)])
@pytest.mark.parametrize("k, first", [(1, 1), (5, 1), (5, 4), (1000, 2)])
def test_index_equals_plain_search(spark, pages, asked, tmp_path, scope, k, first):
    known = pages.dropna(subset=["chunk_id", *scope])
    index = lexical_index.write_index(pages, str(tmp_path / "index"), *scope, block_chunks=16)
    want = retrieval.bm25(asked, retrieval.postings(retrieval.tokenised(known, *scope), *scope), *scope)
    assert _top(lexical_index.search_index(index, asked, k, 6, first), k) == _top(want, k)


def test_blocks_that_cannot_reach_are_not_opened(spark, pages, asked, tmp_path):
    index = lexical_index.write_index(pages, str(tmp_path / "index"), block_chunks=16)
    assert index.blocks.select(F.max(F.size("postings"))).first()[0] <= 16
    met = tables.stash(lexical_index.block_bounds(index, asked))
    every = met.select("query_id", "block").distinct().count()
    scored, rest = lexical_index.candidate_blocks(index, met, 1, first_blocks=1)
    assert scored.select("query_id", "block").distinct().count() + rest.count() < every / 2
    assert "postings" not in met._jdf.queryExecution().toString()


def test_bounds_hold(spark, pages, tmp_path):
    index = lexical_index.write_index(pages, str(tmp_path / "index"), block_chunks=16)
    assert index.blocks.where(F.exists("postings", lambda p: p["weight"] > F.col("bound"))).count() == 0
    frequent = index.blocks.where("term = 'waa'").count()
    assert frequent > 10  # a frequent term is many rows


def test_rows_of_one_id_are_one_chunk_and_empty_tables_give_nothing(spark, asked, tmp_path):
    twice = spark.createDataFrame([(1, "waa wba"), (1, "waa"), (2, "wba")], "chunk_id long, text string")
    once = spark.createDataFrame([(1, "waa wba waa"), (2, "wba")], "chunk_id long, text string")
    found = [_top(lexical_index.search_index(lexical_index.write_index(c, str(tmp_path / n)), asked, 3), 3) for c, n in ((twice, "a"), (once, "b"))]
    assert found[0] == found[1] and found[0]
    none = lexical_index.write_index(once.limit(0), str(tmp_path / "c"))
    assert lexical_index.search_index(none, asked, 3).count() == 0


def test_a_changed_table_has_another_version(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    before = tables.version(spark, path)
    assert tables.version(spark, path) == before
    spark.range(1).write.mode("append").parquet(path)
    assert tables.version(spark, path) != before


def test_lasting_paths_outlive_scratch(spark):
    with tables.scratch():
        path, there = tables.lasting_path(spark, "lasting-test")
        assert not there
        spark.range(1).write.parquet(path)
    assert tables.lasting_path(spark, "lasting-test")[1]


def test_a_local_warehouse_is_no_shared_folder_of_a_cluster():
    assert tables._beside_warehouse("local[4]", "file:/w/") == "file:/w/_shared"
    assert tables._beside_warehouse("spark://a:7077", "hdfs://n/w") == "hdfs://n/w/_shared"
    for place in ("file:/w", "/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables._beside_warehouse("yarn", place)


@pytest.mark.parametrize("scope", [(), ("document_id",)])
def test_bounded_search_gives_the_same(spark, pages, asked, tmp_path, scope):
    index = lexical_index.write_index(pages, str(tmp_path / "index"), *scope, block_chunks=16)
    assert _top(lexical_index.search_bounded(index, asked, 5, 6, 2), 5) == _top(lexical_index.search_index(index, asked, 5, 6), 5)


def test_few_rows_of_each_query_leave_a_group(spark, tmp_path):
    alike = spark.createDataFrame([(i, "waa wba") for i in range(3000)], "chunk_id long, text string")  # copies score alike
    index = lexical_index.write_index(alike, str(tmp_path / "index"), block_chunks=16)
    queries = spark.createDataFrame([(q, "waa wba") for q in range(20)], "query_id int, text string")
    found = lexical_index.search_index(index, queries, 5, 6, 64)
    assert found.count() <= 20 * 3 * 5  # three groups, and not 20 times 3,000 scores
    assert all(chunk < 5 for _, _, chunk, _ in _top(found, 5))


def test_candidates_hold_the_best_however_ties_are_rounded():
    import numpy as np

    scores = np.array([1.0000005, 1.000001, 0.0, 1.0, 1.0000004, 1.000001, 2.0])
    assert set(lexical_index._candidates(scores, 2, 6)) >= {6, 0, 1}  # the first may round to what the second is
    assert 2 not in lexical_index._candidates(scores, 7, 6)
    assert list(lexical_index._candidates(np.full(100, 0.5), 3, 6)) == [0, 1, 2]
