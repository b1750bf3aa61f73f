"""Runs from stored predictions, reports over many runs, and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assaylake.__main__ import main
from assaylake.operators import evaluation, numbering, reports, retrieval, runs, samples
from assaylake.plans import evaluation_queries
from assaylake.sources import benchmarks, sinks, tables, tasks

SF_DIR = "/root/testdata/sf0.001"


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_predictions_of_unknown_samples_raise(spark):
    asked = rows(spark, [("s1", "b"), ("s2", "b")], "sample_id string, benchmark string")
    assert [tuple(r) for r in evaluation.join_predictions(asked, rows(spark, [("r", "s2")], "run_id string, sample_id string")).collect()] == [("s2", "r", "b")]
    with pytest.raises(Exception, match="does not exist: s9"):
        evaluation.join_predictions(asked, rows(spark, [("r", "s9")], "run_id string, sample_id string")).collect()


def test_interleaved_places_equal_the_turns(spark):
    df = rows(spark, [(f, p) for f, n in (("a", 3), ("b", 1), ("c", 5)) for p in range(n)], "task_family string, pos int")
    got = [r.task_family for r in samples.interleave(df).orderBy("place").collect()]
    assert got == ["a", "b", "c", "a", "c", "a", "c", "c", "c"]


def test_reattribution_keeps_what_was_not_retrieved(spark):
    failed = rows(spark, [("r", s, "WRONG_NUMBER", False) for s in "abcd"], "run_id string, sample_id string, failure_type string, catastrophic boolean")
    found = rows(spark, [("r", "a", False, False), ("r", "b", True, False), ("r", "c", True, True)], "run_id string, sample_id string, document_hit boolean, page_hit boolean")
    graded = rows(spark, [("r", s, False, s == "c") for s in "abcd"], "run_id string, sample_id string, passed boolean, refused boolean")
    got = {r.sample_id: r.failure_type for r in evaluation.reattribute(failed, found, graded).collect()}
    assert got == {"a": "WRONG_DOCUMENT", "b": "RETRIEVAL_MISS", "c": "UNNECESSARY_REFUSAL", "d": "WRONG_NUMBER"}


def test_gates_of_nothing_are_not_passed(spark):
    none = rows(spark, [], "run_id string, run_type string, fingerprint string, n_samples long, sample_id_set_hash string")
    got = {r.gate_name: r.passed for r in reports.release_gates(none, none, rows(spark, [], "k int"), "f").collect()}
    assert len(got) == 6 and all(p is None for p in got.values())


def test_pages_tell_three_states(spark):
    text = reports.page("A <b>", [("T", rows(spark, [("x<", 0.5, None), ("y", None, True)], "n string, v double, ok boolean"))])
    assert "A &lt;b&gt;" in text and "x&lt;" in text and "0.5000" in text and "skipped" in text and "pass" in text and "&mdash;" in text


def test_passages_are_found_by_a_word_inside(spark):
    passages = rows(spark, [(1, "the quick brown fox"), (2, "fox"), (3, "Quick  brown"), (4, "")], "query_id int, text string")
    chunks = rows(spark, [(10, "see the quick brown foxes"), (11, "a fox"), (12, "the quick red fox"), (13, "Quick  brown"), (14, None)], "chunk_id int, text string")
    got = {tuple(r) for r in retrieval.containing(passages, chunks).collect()}
    assert got == {(1, 10), (2, 10), (2, 11), (2, 12), (3, 13), (4, 10), (4, 11), (4, 12), (4, 13)}


def test_queries_without_a_scope_see_all(spark):
    pages = rows(spark, [("d", 1, "cash flow"), ("e", 2, "cash debt")], "document_id string, chunk_id int, text string")
    asked = rows(spark, [(1, "d", "cash"), (2, None, "cash")], "query_id int, document_id string, text string")
    got = {(r.query_id, r.chunk_id) for r in retrieval.search(asked, pages, "document_id").collect()}
    assert got == {(1, 1), (2, 1), (2, 2)}


def test_scratch_removes_what_was_stashed(spark, tmp_path):
    with tables.scratch():
        kept = tables.stash(spark.range(5))
        held = tables.bucketed(spark.range(5), "id", 2)
        assert kept.count() == held.count() == 5
        places = [p.removeprefix("file:") for p, _ in tables._OPEN[-1]]
    import os

    assert len(places) == 2 and not any(os.path.exists(p) for p in places)


def test_backoff_stays_below_its_bound(spark):
    got = [r.d for r in spark.range(200).select(reports.backoff_delay(F.col("id").cast("string"), F.col("id").cast("int") % 12, 2.0, 30.0).alias("d")).collect()]
    assert all(0 <= d < 30 for d in got) and max(got) > 15 and got[1] < 2


def test_splits_of_the_books(spark):
    got = tasks.load(spark, "smoke").collect()
    assert len(got) == 12 and [r.place for r in got] == list(range(1, 13)) and len({r.task_family for r in got}) == 12
    tricky = tasks.load(spark, "private", "x").where("payload is not null or should_refuse").count()
    assert tricky > 0
    for split in ("private", "none"):
        with pytest.raises(ValueError, match="split|secret"):
            tasks.load(spark, split)


def test_benchmark_files_are_verified(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"QID": "1"}\n\n{"QID": "2"}\n')
    import hashlib

    good = hashlib.sha256(path.read_bytes()).hexdigest()
    benchmarks.verified(spark, {"a": str(path)}, {"a": good}, {"a": 2})
    for bad in ({"checksums": {"a": "0"}}, {"counts": {"a": 3}}):
        with pytest.raises(ValueError, match="a:"):
            benchmarks.verified(spark, {"a": str(path)}, **bad)
    with pytest.raises(ValueError, match="no split"):
        benchmarks.read_samples(spark, "finqa", str(path), "nowhere")
    assert benchmarks.manifests(spark).count() == 6


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"first page\fsecond   page")
    (tmp_path / "two.pdf").write_bytes(b"broken")

    def read(content):
        if content == b"broken":
            raise ValueError
        return [*content.decode().split("\f"), None]

    got = sorted(tuple(r) for r in benchmarks.pages_from_files(spark, str(tmp_path), read).collect())
    assert got == [("one", 1, "one#p1", "first page"), ("one", 2, "one#p2", "second page"), ("one", 3, "one#p3", "")]


def test_judges_and_json(spark):
    said = rows(spark, [('go {"a": 1} on',), ("{no}",), (None,)], "t string").select(runs.extract_json(F.col("t")).alias("j")).collect()
    assert [r.j for r in said] == ['{"a": 1}', None, None]
    pair = lambda a, b: rows(spark, [(a, b)], "a string, b string").select(runs.guard_judge(F.col("a"), F.col("b")).alias("j"))
    assert pair("x/qwen3", "x/llama3").first().j == "x/qwen3"
    with pytest.raises(Exception, match="may not judge"):
        pair("x/qwen3", "y/qwen2.5").collect()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Stored samples, predictions and prices of two runs."""
    folder = str(tmp_path_factory.mktemp("runs"))
    p = evaluation_queries.predictions(spark, SF_DIR).where("pos < 2000").withColumn("model_ref", F.concat(F.lit("m/"), F.col("run_id")))
    said = ("run_id", "sample_id", "model_ref", "has_response", "error_type", "content", "answer", "explanation", "number", "unit", "flag", "cited", "prompt_tokens", "completion_tokens", "cache_hit")
    p.select(*said).write.parquet(f"{folder}/predictions.parquet")
    p.where("run_id = 'a'").drop(*(c for c in said if c != "sample_id"), "predicted", "refused", "has_answer", "canary_stated").write.parquet(f"{folder}/samples.parquet")
    spark.createDataFrame([("m/a", 1.0, 2.0)], "model_ref string, prompt_price double, completion_price double").write.parquet(f"{folder}/prices.parquet")
    spark.createDataFrame([("a", "m/a", "local", "real", "all", "f"), ("b", "m/b", "mock", None, "all", "f")], "run_id string, model_ref string, provider string, run_type string, benchmark string, fingerprint string").write.parquet(f"{folder}/environments.parquet")
    assert main(["rescore", "--runs", folder, "--run", "a"]) == 0
    return folder


def test_rescored_runs(spark, stored, capsys):
    read = lambda n: spark.read.parquet(f"{stored}/{n}.parquet")
    assert {r.run_id for r in read("scores").collect()} == {"a", "b"} and read("gates").count() == 22
    whole = evaluation_queries.results(evaluation_queries.predictions(spark, SF_DIR).where("pos < 2000"))
    assert read("metric_details").count() == whole.count()
    from pathlib import Path

    assert "## Gates" not in (text := (Path(stored) / "a" / "summary.md").read_text()) and "| gate |" in text and "<h2>Gates</h2>" in (Path(stored) / "a" / "report.html").read_text()
    assert main(["report", "--runs", stored, "--run", "b"]) == 0 and "| metric |" in capsys.readouterr().out
    assert main(["compare", "--runs", stored, "--run", "a", "--with", "b", "--metric", "exact_match"]) == 0 and "n_paired" in capsys.readouterr().out
    assert main(["capability-report", "--runs", stored]) == 0
    out = f"{stored}/board"
    assert main(["leaderboard", "--runs", stored, "--out", out]) == 0
    left_out = {r.run_id: r.excluded_because for r in spark.read.option("header", True).csv(f"{out}/excluded.csv").collect()}
    assert left_out == {"a": "no score", "b": "not a real run"}  # the index of the first is withheld
    assert main(["release-build", "--runs", stored, "--out", f"{stored}/release"]) == 0
    made = spark.read.json(f"{stored}/release/release_manifest.json").collect()
    assert [r.run_id for r in made] == ["a"] and len(made[0].sample_id_set_hash) == 16


def test_samples_from_the_command_line(spark, tmp_path, capsys):
    good = [{"sample_id": f"b:test:{i}", "benchmark": "b", "split": "test", "task_family": "fg"[i % 2], "question": "q", "language": "en"} for i in range(6)]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, good)))
    assert main(["validate", "--samples", str(tmp_path / "s.jsonl")]) == 0
    assert main(["freeze-manifest", "--samples", str(tmp_path / "s.jsonl"), "--take", "4", "--out", str(tmp_path / "m")]) == 0
    assert spark.read.json(str(tmp_path / "m")).count() == 4
    (tmp_path / "bad.jsonl").write_text(json.dumps({**good[0], "benchmark": "c"}))
    with pytest.raises(SystemExit):
        main(["validate", "--samples", str(tmp_path / "bad.jsonl")])
    with pytest.raises(SystemExit):
        main(["compare", "--runs", "x"])


def test_the_cache_stores_a_key_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert sinks.cache_stats(spark, path).first().n_responses == 0
    for keys in (["aa1", "ab2", "aa1"], ["ab2", "cc3"]):
        sinks.append_to_cache(rows(spark, [(k, "r") for k in keys], "request_hash string, response string"), path)
    assert tuple(sinks.cache_stats(spark, path).first()) == (3, 3)
    assert main(["cache-clear", "--cache", path]) == 0 and sinks.cache_stats(spark, path).first().n_responses == 0


@pytest.mark.parametrize("groups", [1, 3, 40])
def test_numbers_equal_a_window(spark, groups):
    """Also for one group of all rows, with nulls in group and order and columns whose names are used inside."""
    rows = spark.range(5_000).select(
        F.when(F.col("id") % 7 != 0, F.col("id") % groups).alias("g"), F.when(F.col("id") % 11 != 0, F.xxhash64("id") % 900).alias("o"), "id", F.lit(1).alias("_part"), F.lit(2).alias("_place"), F.lit(3).alias("number")
    )
    found = numbering.numbered(rows, ["g"], ["o", "id"], ranges=9)
    assert found.columns == [c for c in rows.columns if c != "number"] + ["number"]
    expected = rows.withColumn("number", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_a_group_of_all_rows_is_spread(spark):
    rows = spark.range(20_000).withColumn("g", F.lit("all"))
    found = numbering.numbered(rows, ["g"], ["id"], "turn", ranges=8)
    assert found.where("turn <> id + 1").count() == 0 and found.count() == 20_000
    sizes = [r["count"] for r in rows.repartitionByRange(8, "g", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 20_000 / 4
    assert numbering.numbered(rows.limit(0), ["g"], ["id"]).count() == 0
    assert [r.number for r in numbering.numbered(rows.limit(3), [], ["id"]).orderBy("id").collect()] == [1, 2, 3]
