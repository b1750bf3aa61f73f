"""Readers, sinks and streams over small files."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assaylake.operators.samples import request_hash, short_hash, slug, violations
from assaylake.schemas import SAMPLES
from assaylake.sources import benchmarks, sinks
from assaylake.streaming import events


def put(path, value, lines=False):
    path.write_text("\n".join(map(json.dumps, value)) if lines else json.dumps(value))
    return str(path)


def test_finqa(spark, tmp_path):
    rows = [
        {"id": "a", "filename": "f", "pre_text": ["p"], "post_text": ["q"], "table": [["h", "1"], ["r", "2"]], "qa": {"question": "why", "answer": "1%", "program": "divide(1, 2)", "exe_ans": 0.5}},
        {"id": "b", "filename": "f", "pre_text": [], "post_text": [], "table": [], "qa": {"question": "is it", "answer": "yes", "program": "greater(2, 1)", "exe_ans": "yes"}},
    ]
    got = {r.sample_id: r for r in benchmarks.read_samples(spark, "finqa", put(tmp_path / "x.json", rows), "dev").collect()}
    assert got["finqa:dev:a"].gold.numeric_value == 0.5 and got["finqa:dev:a"].context_text == ["p", "q"] and got["finqa:dev:a"].context_tables[0].rows[1] == ["r", "2"]
    assert got["finqa:dev:b"].gold.numeric_value is None and got["finqa:dev:b"].gold.answer == "yes" and got["finqa:dev:b"].context_tables == []


def test_tatqa_fans_out(spark, tmp_path):
    q = lambda uid, answer, kind, scale="": {"uid": uid, "order": 1, "question": "how much", "answer": answer, "derivation": "", "answer_type": kind, "answer_from": "table", "scale": scale}
    rows = [{"table": {"uid": "t", "table": [["a", "b"]]}, "paragraphs": [{"uid": "2", "order": 2, "text": "second"}, {"uid": "1", "order": 1, "text": "first"}], "questions": [q("1", ["x", "y"], "multi-span"), q("2", "$1,200", "arithmetic", "thousand"), q("", "5", "count"), q("4", "", "span"), q("5", None, "span")]}]
    got = {r.sample_id: r for r in benchmarks.tatqa(spark, put(tmp_path / "x.json", rows), "dev").collect()}
    assert sorted(got) == ["tatqa:dev:1", "tatqa:dev:2"]
    assert got["tatqa:dev:1"].gold.answer == "x | y" and got["tatqa:dev:1"].gold.acceptable_answers == ["x", "y"] and got["tatqa:dev:1"].context_text == ["first", "second"] and got["tatqa:dev:1"].task_family == "tatqa_multi_span"
    assert got["tatqa:dev:2"].gold.numeric_value == 1200.0 and got["tatqa:dev:2"].metadata["scale"] == "thousand" and got["tatqa:dev:2"].capability_tags == ["table_text", "calculation"]


def test_convfinqa_turns_and_their_sources(spark, tmp_path):
    note = {"dialogue_break": ["a", "b", "c"], "turn_program": ["60.94", "25.14", "subtract(60.94, 25.14), divide(#0, const_100)"], "exe_ans_list": [60.94, 25.14, 0.358]}
    rows = [{"id": "k", "pre_text": [], "post_text": [], "table": [], "annotation": note}, {"id": "bad", "pre_text": [], "post_text": [], "table": [], "annotation": {**note, "exe_ans_list": [1]}}]
    got = {r.metadata["turn_index"]: r for r in benchmarks.convfinqa(spark, put(tmp_path / "x.json", rows), "dev").collect()}
    assert len(got) == 3 and got["2"].metadata["reuses_turns"] == "0,1" and got["0"].metadata["reuses_turns"] == ""
    assert [h.content for h in got["2"].history] == ["a", "b"] and got["2"].metadata["is_last_turn"] == "true" and got["2"].gold.numeric_value == 0.358


def test_finance_reasoning_pivots_columns(spark, tmp_path):
    q = lambda k, gold, context: {"question_id": k, "level": "hard", "question": "q", "context": context, "ground_truth": gold, "difficulty": "1"}
    rows = [q("1", 5, json.dumps({"2020": {"cash": "1", "debt": "2"}, "2021": {"debt": "3", "tax": "4"}})), q("2", True, "plain words"), q("3", "n/a", ""), q(None, 1, "")]
    got = {r.sample_id.rsplit(":", 1)[1]: r for r in benchmarks.finance_reasoning(spark, put(tmp_path / "x.json", rows), "dev").collect()}
    assert sorted(got) == ["1", "2"] and got["1"].context_tables[0].rows == [["", "2020", "2021"], ["cash", "1", ""], ["debt", "2", "3"], ["tax", "", "4"]]
    assert got["2"].gold.answer_type == "boolean" and got["2"].context_text == ["plain words"]


@pytest.mark.parametrize(("answer", "shape"), [("Yes, it did.", "boolean"), ("No", "boolean"), ("$1,577.00", "numeric"), ("12.5%", "numeric"), ("Nothing of note", "analytical"), ("1577 was the figure that the company reported in the year", "analytical"), ("Notable", "analytical")])
def test_answer_shapes(spark, answer, shape):
    assert spark.createDataFrame([(answer,)], "a string").select(benchmarks.answer_shape(F.col("a")).alias("s")).first().s == shape


def test_filings_qa_and_secque(spark, tmp_path):
    rows = [{"qa_id": "f1", "company": "C", "doc_name": "D", "question_type": "metrics", "question_reasoning": "", "question": "q", "answer": "$5", "justification": "", "evidence": [{"evidence_text": "t", "doc_name": "D", "evidence_page_num": "7"}]}]
    got = benchmarks.filings_qa(spark, put(tmp_path / "x.jsonl", rows, lines=True), "open", id_field="qa_id").first()
    assert got.gold.numeric_value == 5.0 and got.evidence[0].page == 7 and got.metadata["answer_shape"] == "numeric"
    record = lambda k: {"QID": k, "question_type": "t", "Question": "q", "ground_truth_answer": "a", "context_markdown_with_headers": "# Acme Corp 10-K for 2021\nbody", "accession_number": "1"}
    paths = {c: put(tmp_path / f"{c}.jsonl", [record(f"{c}{i}") for i in (2, 1)], lines=True) for c in ("risk", "analyst")}
    placed = benchmarks.secque(spark, paths, "test").orderBy("turn", "task_family").collect()
    assert [r.sample_id.rsplit(":", 1)[1] for r in placed] == ["analyst1", "risk1", "analyst2", "risk2"] and placed[0].metadata["company"] == "Acme Corp" and placed[0].metadata["fiscal_year"] == "2021"
    with pytest.raises(ValueError, match="unknown benchmark"):
        benchmarks.read_samples(spark, "none", "", "dev")


def test_typed_lines_fail_on_wrong_records(spark, tmp_path):
    good = put(tmp_path / "good.jsonl", [{"sample_id": "b:test:1", "benchmark": "b", "split": "test", "task_family": "f", "question": "q", "language": "en"}], lines=True)
    assert benchmarks.jsonl_samples(spark, good).count() == 1 and violations(benchmarks.jsonl_samples(spark, good)).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"sample_id": "x", "gold": 5}\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        sinks.read_json_lines(spark, str(tmp_path / "bad.jsonl"), SAMPLES).collect()


def test_runs_are_read_when_they_are_complete(spark, tmp_path):
    metrics = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, v int")
    sinks.write_run({"metrics": metrics, "gates": metrics.where("run_id = 'a'")}, str(tmp_path / "runs"))
    assert [r.run_id for r in sinks.load_runs(spark, str(tmp_path / "runs"), ["metrics", "gates"])["metrics"].collect()] == ["a"]
    sinks.write_csv(metrics, str(tmp_path / "csv"))
    sinks.write_json_lines(metrics, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sums = sinks.checksums(spark, str(tmp_path / "json")).collect()
    assert all(len(r.sha256) == 64 for r in sums) and [r.path for r in sums] == sorted(r.path for r in sums)


def test_cache_splits_requests(spark, tmp_path):
    requests = spark.createDataFrame([("q1", "m"), ("q2", "m")], "question string, model string").withColumn("request_hash", request_hash("question", "model"))
    sinks.append_to_cache(requests.where("question = 'q1'").select("request_hash", F.lit("r").alias("response")), str(tmp_path / "cache"))
    hit, miss = sinks.cached(requests, spark.read.parquet(str(tmp_path / "cache")).drop("shard"))
    assert [r.question for r in hit.collect()] == ["q1"] and [r.question for r in miss.collect()] == ["q2"]
    row = requests.select(slug(F.lit(" A--b C! ")).alias("s"), short_hash(F.lit("a"), F.lit("b")).alias("h")).first()
    assert row.s == "a-b-c" and len(row.h) == 8


def test_summary_tells_three_states(spark):
    text = sinks.summary(
        spark.createDataFrame([("m", 2, 0.5), ("n", 0, None)], "metric_name string, n int, mean double"), spark.createDataFrame([("g", 0.1, 0.5, False), ("h", None, 1.0, None)], "gate_name string, observed double, threshold double, passed boolean"),
        spark.createDataFrame([(1, "s1", "WRONG_NUMBER", False), (3, "s0", "WRONG_SIGN", True), (2, "s2", "WRONG_SIGN", True)], "pos int, sample_id string, failure_type string, catastrophic boolean"),
    )
    assert "not applicable" in text and "FAIL" in text and "skipped" in text and text.index("s2") < text.index("s0") and "s1" not in text


def test_stream_drops_repeats_and_late_events(spark, tmp_path):
    at = lambda d: datetime(2024, 1, d, 12)
    batches = [[(1, at(1)), (2, at(1)), (1, at(1))], [(3, at(20))], [(4, at(2)), (5, at(21))], [(6, at(28))]]
    src = tmp_path / "in"
    for i, b in enumerate(batches):
        spark.createDataFrame([(k, t, 1, "view", 2.0, "{}") for k, t in b], events.EVENTS).coalesce(1).write.mode("append").parquet(str(src / f"b{i}"))
    stream = spark.readStream.schema(events.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    run = events.windowed(stream).writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.start.day: r.n for r in spark.table("rolled").collect()}
    assert got.get(1) == 2 and got.get(20) == 1 and 28 not in got


def test_stream_of_outcomes_keeps_small_state(spark, tmp_path):
    spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True), (2, 0, True)], "conv_id long, turn long, passed boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn long, passed boolean").parquet(str(tmp_path / "in"))
    run = events.running_outcomes(stream).writeStream.format("memory").queryName("outcomes").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {tuple(r) for r in spark.table("outcomes").collect()} == {(1, 3, 2, 1), (2, 1, 1, -1)}


def test_missing_keys_are_built_once(spark, tmp_path):
    for i, keys in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(k,) for k in keys], "k long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    for attempt in range(2):
        stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        events.build_missing(spark, stream, lambda b: b.withColumn("v", F.col("k") * 10), str(tmp_path / "out"), "k", str(tmp_path / f"c{attempt}")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 10), (2, 20), (3, 30)]


def test_pages_have_plain_blanks(spark, tmp_path):
    path = put(tmp_path / "p.jsonl", [{"document_id": "d", "page": 1, "text": " a   b\t c\n\n\n\nd "}, {"document_id": "d", "page": 2, "text": None}], lines=True)
    got = {r.chunk_id: r.text for r in benchmarks.pages(spark, path).collect()}
    assert got == {"d#p1": "a b c\n\nd", "d#p2": ""}


def test_tasks_are_dealt_by_rows(spark):
    from assaylake.sources import tables

    wide = spark.range(0, 10_000, 1, 2)
    dealt = tables.dealt(wide, 500)
    assert dealt.rdd.getNumPartitions() == 20 and max(dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) <= 600
    assert sorted(r.id for r in dealt.collect()) == list(range(10_000))
    assert tables.dealt(wide, 10_000).rdd.getNumPartitions() == 2


def test_predictions_are_written_by_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    from assaylake.plans import derived, evaluation_queries

    monkeypatch.setattr(evaluation_queries, "TASK_ORDERS", 100)
    p = derived.relation(spark, "/root/testdata/sf0.001", "predicted", evaluation_queries.TASK_ORDERS)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert p.rdd.getNumPartitions() >= orders // 100 and p.count() == 2 * orders
    assert evaluation_queries.predictions(spark, "/root/testdata/sf0.001").count() == 2 * orders
