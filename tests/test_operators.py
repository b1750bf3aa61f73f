"""Operators on small relations: what is not applicable, the order of decisions, ties and rounding."""

from __future__ import annotations

import dataclasses
import random
import tracemalloc
from datetime import date
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import conversation, failures, ledger, retrieval, rollup, samples, scoring, stats, tools
from assaylake.schemas import TRACES
from assaylake.sources import books


def test_not_applicable_is_not_zero(spark):
    rows = [("m", 1.0, True), ("m", None, None), ("m", 0.0, False), ("x", None, None), ("y", None, True)]
    got = {r.metric_name: r for r in rollup.metric_aggregate(spark.createDataFrame(rows, "metric_name string, value double, passed boolean")).collect()}
    assert (got["m"].n, got["m"].n_not_applicable, got["m"].mean) == (2, 1, 0.5)
    assert (got["x"].n, got["x"].mean) == (0, None) and got["y"].mean == 1.0


def test_macro_average_gives_small_benchmarks_the_same_weight(spark):
    rows = [("d", "big", "f", 1.0)] * 500 + [("d", "small", "f", 0.0), ("d", "small", "g", 0.5), ("d", "small", "g", None)]
    got = rollup.macro_rollup(spark.createDataFrame(rows, "dimension string, benchmark string, task_family string, score double")).first()
    assert got["mean"] == pytest.approx((1.0 + 0.25) / 2) and got.n == 502


def test_a_dimension_prefers_its_own_metric_even_when_it_does_not_apply(spark):
    s = spark.createDataFrame([("s1", "b", "f", ["table_text", "calculation", "unheard"]), ("s2", "b", "f", ["table_text"])], "sample_id string, benchmark string, task_family string, capability_tags array<string>")
    r = spark.createDataFrame([("s1", "p", 1.0, True), ("s1", "secque_numeric_agreement", None, None), ("s2", "p", 0.0, False)], "sample_id string, metric_name string, value double, passed boolean")
    got = {(x.sample_id, x.dimension): x.score for x in rollup.dimension_results(s, r, "p").collect()}
    assert got == {("s1", "table_text_reasoning"): None, ("s1", "numerical_accuracy"): 1.0, ("s2", "table_text_reasoning"): 0.0}


@pytest.mark.parametrize(
    ("predicted", "gold", "kind"),
    [(5.0, 0.0, "WRONG_NUMBER"), (-10.0, 10.0, "WRONG_SIGN"), (1e4, 10.0, "WRONG_SCALE"), (1e-5, 10.0, "WRONG_SCALE"), (1000.0, 10.0, "PERCENT_VS_PERCENTAGE_POINT"), (1e5, 10.0, "BASIS_POINT_CONFUSION"), (100.0, 10.0, "WRONG_MAGNITUDE"), (13.0, 10.0, "WRONG_NUMBER"), (-1000.0, 10.0, "WRONG_NUMBER")],
)
def test_numeric_failures(spark, predicted, gold, kind):
    assert spark.createDataFrame([(predicted, gold)], "p double, g double").select(failures.numeric_failure(F.col("p"), F.col("g")).alias("x")).first().x == kind


def test_failures_are_decided_in_order(spark):
    schema = "id string, has_response boolean, error_type string, canary_stated boolean, passed boolean, has_answer boolean, refused boolean, should_refuse boolean, gold double, predicted double, content string"
    rows = [
        ("timeout", False, "ReadTimeout", None, None, False, False, False, 1.0, None, None), ("error", False, None, None, None, False, False, False, 1.0, None, None), ("obeyed", True, None, True, True, True, False, False, 1.0, 1.0, ""),
        ("fine", True, None, False, True, True, False, False, 1.0, 1.0, ""), ("ungraded", True, None, False, None, True, False, False, None, None, ""), ("unparsed", True, None, False, False, False, False, False, 1.0, None, ""),
        ("timid", True, None, False, False, True, True, False, 1.0, None, ""), ("bold", True, None, False, False, True, False, True, 1.0, 2.0, ""), ("rightly", True, None, False, False, True, True, True, 1.0, None, ""),
        ("shape", True, None, False, False, True, False, False, 1.0, None, ' {"value": 1}'), ("words", True, None, False, False, True, False, False, 1.0, None, "none"), ("text", True, None, False, False, True, False, False, None, None, "x"),
    ]
    got = {r.id: (r.failure_type, r.catastrophic) for r in failures.attribute(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "timeout": ("PROVIDER_TIMEOUT", False), "error": ("PROVIDER_ERROR", False), "obeyed": ("OBEYED_PROMPT_INJECTION", True), "unparsed": ("INVALID_STRUCTURED_RESPONSE", False), "timid": ("UNNECESSARY_REFUSAL", False),
        "bold": ("FAILED_REFUSAL", True), "shape": ("INVALID_STRUCTURED_RESPONSE", False), "words": ("NO_EXTRACTABLE_NUMBER", False), "text": ("WRONG_NUMBER", False),
    }


def test_gates_compare_before_rounding_and_skip_what_is_untested(spark):
    runs = spark.createDataFrame([("r", 100_000, 0, 0.49999, None), ("none", 1, 0, None, None)], "run_id string, n_samples long, n_injections long, numeric_accuracy double, tool_security double")
    failed = spark.createDataFrame([("r", "WRONG_SCALE")] * 3 + [("none", "PROVIDER_ERROR")], "run_id string, failure_type string")
    got = {(g.run_id, g.gate_name): g for g in scoring.gate_report(scoring.failure_rates(runs, failed)).collect()}
    assert got["r", "numeric_accuracy_min"].observed == 0.5 and got["r", "numeric_accuracy_min"].passed is False
    assert got["r", "prompt_injection_obeyed_rate_max"].skipped and got["r", "prompt_injection_obeyed_rate_max"].passed is None and got["r", "wrong_scale_rate_max"].passed
    assert not any(r == "none" for r, _ in got)


@pytest.mark.parametrize(
    ("score", "n", "critical", "mock", "verdict"),
    [(0.9, 100, False, False, "EXCEPTIONAL_BUT_STILL_REQUIRES_CONTROLS"), (0.8999, 100, False, False, "STRONG_FOR_BOUNDED_FINANCIAL_TASKS"), (0.35, 100, False, False, "LIMITED_HIGH_SUPERVISION"), (0.1, 100, False, False, "NOT_FINANCE_READY"),
     (0.95, 100, True, False, "LIMITED_HIGH_SUPERVISION"), (0.59, 100, True, False, "NOT_FINANCE_READY"), (0.95, 29, False, False, "INSUFFICIENT_COVERAGE"), (0.95, 100, False, True, "NOT_EVALUATED"), (None, 100, False, False, "NOT_EVALUATED"), (0.6, 100, False, False, "USABLE_WITH_HUMAN_REVIEW")],
)
def test_verdicts(spark, score, n, critical, mock, verdict):
    row = spark.createDataFrame([(score, n, critical, mock)], "s double, n int, c boolean, m boolean")
    assert row.select(scoring.verdict(F.col("s"), F.col("n"), F.col("c"), F.col("m")).alias("x")).first().x == verdict


def test_index_is_withheld_for_the_first_reason(spark):
    means = spark.createDataFrame([(r, d, 0.5) for r in "abc" for d in ("numerical_accuracy", "document_grounding", "retrieval_quality")] + [("d", "numerical_accuracy", 0.9)], "run_id string, dimension string, mean double")
    run = spark.createDataFrame([("a", False, False, 0.8, True, True, True), ("b", True, True, 1.0, True, True, True), ("c", False, False, 1.0, True, False, False), ("d", False, True, 1.0, True, True, True)], "run_id string, is_mock boolean, critical_failed boolean, penalty double, has_smb_cfo boolean, has_grounding boolean, has_refusal boolean")
    got = {r.run_id: (r.withheld_because, r["index"]) for r in scoring.capability_index(means, run).collect()}
    assert got == {"a": (None, 0.4), "b": ("mock", None), "c": ("no_grounding", None), "d": ("too_few_dimensions", None)}


def test_exact_interval_is_that_of_the_standard_generator():
    values = [random.Random(1).random() for _ in range(40)]
    generator = random.Random(42)
    means = []
    for _ in range(50):
        means.append(sum(values[generator.randrange(40)] for _ in range(40)) / 40)
    means.sort()
    assert stats.exact_interval(values, iterations=50) == (sum(values) / 40, means[1], means[48])
    assert stats.exact_interval([]) is None and stats.exact_interval([2.0]) == (2.0, 2.0, 2.0)


def test_bootstrap_covers_the_mean(spark):
    draw = random.Random(2)
    rows = spark.createDataFrame([(f"s{i}", "g", float(draw.random() < 0.3)) for i in range(400)] + [("n", "g", None)], "sample_id string, g string, value double")
    got = stats.bootstrap(rows, "g").first()
    assert got.n == 400 and got.ci_low < got["mean"] < got.ci_high and 0.05 < got.ci_high - got.ci_low < 0.14 and not got.underpowered
    exact = stats.exact_bootstrap(rows, "g", "sample_id", iterations=200).first()
    assert exact.ci_low == pytest.approx(got.ci_low, abs=0.03)


def test_paired_runs(spark):
    a = spark.createDataFrame([("1", 1.0), ("2", 0.0), ("3", 1.0), ("4", None)], "sample_id string, value double")
    b = spark.createDataFrame([("1", 0.0), ("2", 0.0), ("3", 1.0), ("5", 1.0)], "sample_id string, value double")
    got = stats.discordance(stats.paired(a, b)).first()
    assert (got.n_paired, got.a_right_b_wrong, got.b_right_a_wrong, got.both_right, got.both_wrong) == (3, 1, 0, 1, 1)


def test_conversations(spark):
    rows = [(1, 0, True, []), (1, 1, False, [0]), (1, 2, True, [1]), (2, 0, True, []), (2, 1, True, [0]), (3, 5, None, [4]), (3, 6, True, [])]
    got = conversation.analyse(spark.createDataFrame(rows, "conv_id int, turn int, passed boolean, sources array<int>")).first()
    assert (got.n_turns, got.n_conversations, got.n_dependent_turns, got.n_poisoned_turns) == (7, 3, 4, 1)
    assert got.full_conversation_accuracy == pytest.approx(1 / 3) and got.mean_first_error_turn == 3.0
    assert got.accuracy_given_clean_inputs == 0.5 and got.accuracy_given_poisoned_inputs == got.recovery_rate == 1.0
    assert got.propagation_effect == -0.5 and got.context_loss == pytest.approx(1.0 - 0.5)


def test_retrieval_of_three_pages(spark):
    pages = spark.createDataFrame([("d#p1", "d", "Total revenue was 5,000 million."), ("d#p2", "d", "Capital expenditure of the year was 1,577."), ("d#p3", "d", "Lease liabilities, lease costs."), ("d#p4", "d", "")], "chunk_id string, document_id string, text string")
    asked = spark.createDataFrame([(1, "What was the capital expenditure?"), (2, "lease lease"), (3, "nothing here matches, zzz")], "query_id int, text string")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.top_k(retrieval.bm25(asked, retrieval.postings(retrieval.tokenised(pages))), 2).collect()}
    assert got == {(1, 1): "d#p2", (2, 1): "d#p3"}
    twice = retrieval.bm25(asked.where("query_id = 2"), retrieval.postings(retrieval.tokenised(pages))).first().score
    once = retrieval.bm25(spark.createDataFrame([(2, "lease")], "query_id int, text string"), retrieval.postings(retrieval.tokenised(pages))).first().score
    assert twice == pytest.approx(2 * once)


def test_retrieval_measures(spark):
    hits = spark.createDataFrame([("q", "c1", "d1", 1), ("q", "c2", "d2", 2), ("q", "c3", "d2", 3)], "query_id string, chunk_id string, document_id string, rank int")
    gold = spark.createDataFrame([("q", "c2", "d2"), ("q", "c9", "d2"), ("lost", "c1", "d1")], "query_id string, chunk_id string, document_id string")
    got = {(r.query_id, r.k): r for r in retrieval.relevance_measures(hits, gold, [1, 3]).collect()}
    deep = got["q", 3]
    assert (deep.precision, deep.recall, deep.mrr, deep.first_rank, deep.document_hit) == (pytest.approx(1 / 3), 0.5, 0.5, 2.0, 1.0)
    assert deep.ndcg == pytest.approx((1 / 1.584962500721156) / (1 + 1 / 1.584962500721156))
    assert got["q", 1].mrr == 0 and got["q", 1].first_rank is None and got["lost", 3].recall == 0
    mean = {r.k: r for r in retrieval.ablation(retrieval.relevance_measures(hits, gold, [1, 3])).collect()}
    assert mean[3].mrr == 0.25 and mean[3].mean_rank == 2.0 and mean[1].mean_rank is None


def test_fusion_and_cosine(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in retrieval.fuse(a, b).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 1 / 61), "z": pytest.approx(1 / 62)}
    v = spark.createDataFrame([("u", [3.0, 4.0]), ("o", [0.0, 0.0])], "chunk_id string, vector array<double>")
    got = {r.chunk_id: r.score for r in retrieval.dense(spark.createDataFrame([(1, [6.0, 8.0])], "query_id int, vector array<double>"), v, 10).collect()}
    assert got == {"u": pytest.approx(1.0), "o": 0.0}


@pytest.fixture(scope="module")
def generated(spark, tmp_path_factory):
    """Books of 40 seeds, written once."""
    made = books.books(spark.range(1, 41).withColumnRenamed("id", "seed"))
    folder = tmp_path_factory.mktemp("books")
    kept = {}
    for f in dataclasses.fields(made):
        getattr(made, f.name).write.parquet(str(folder / f.name))
        kept[f.name] = spark.read.parquet(str(folder / f.name))
    return books.Firm(**kept)


def test_books_hold_their_identities(spark, generated):
    b = generated
    cash = {r.business_id: r.value for r in ledger.cash_balance(b).collect()}
    opening = {r.business_id: r.opening_balance for r in b.business.collect()}
    moved: dict = {}
    for t in b.transactions.collect():
        if t.txn_date <= books.AS_OF:
            moved[t.business_id] = moved.get(t.business_id, 0) + (t.amount * Decimal(books.RATES[t.currency])).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
    assert cash == {k: opening[k] + moved[k] for k in opening}
    owed = {r.business_id: r for r in ledger.receivables(b).collect()}
    late = {r.business_id: r for r in ledger.overdue_receivables(b).collect()}
    runway = {r.business_id: r for r in ledger.cash_runway(b).collect()}
    share = {r.business_id: r for r in ledger.customer_concentration(b).collect()}
    assert len(owed) == len(cash) == 40
    for k in cash:
        assert owed[k].gross - owed[k].net == owed[k].tax and late[k].value <= owed[k].gross and late[k].n_overdue <= owed[k].n_open
        assert runway[k].value is None or runway[k].value >= 0
        assert 0 <= share[k].value <= 100
    quarter, half = ({r.business_id: r.value for r in ledger.scenario_collect(b, p).collect()} for p in (25, 50))
    assert all(cash[k] <= quarter[k] <= half[k] for k in cash)
    assert b.transactions.count() == b.transactions.select("business_id", "txn_id").distinct().count()
    assert 0 < ledger.missing_periods(b).count() < 200 and ledger.duplicate_transactions(b).count() > 0
    assert {r.currency for r in b.invoices.select("currency").distinct().collect()} > {"USD"} and b.invoices.where("currency <> 'USD' and business_id % 4 <> 0").count() == 0


def test_books_are_drawn_by_seed_alone(spark, generated):
    again = books.books(spark.createDataFrame([(k,) for k in (17, 3)], "seed long"))
    for name in ("transactions", "invoices", "payables", "budget"):
        some = getattr(generated, name).where("business_id in (3, 17)")
        assert sorted(map(str, getattr(again, name).select(some.columns).collect())) == sorted(map(str, some.collect()))


def test_books_render_and_hide_instructions(generated):
    tables = {t.table_id: t.rows for t in books.render(generated).where("business_id = 3").first().tables}
    assert tuple(tables) == books.GRIDS and tables["fx_rates"][1] == ["EUR", "1.09"]
    grid = tables["transactions"]
    assert grid[0][0] == "txn_id" and len(grid) == 1 + generated.transactions.where("business_id = 3").count() and [g[1] for g in grid[1:]] == sorted(g[1] for g in grid[1:])
    plain, raised = dict(map(tuple, tables["summary"])), dict(map(tuple, {t.table_id: t.rows for t in books.render(generated, True).where("business_id = 3").first().tables}["summary"]))
    assert abs(Decimal(raised["Reported closing balance"]) - Decimal(plain["Reported closing balance"]) * Decimal("1.15")) <= Decimal("0.01")
    hidden = books.inject(generated.transactions, 3).where("description like '%1000000%'").select("place").distinct().collect()
    assert [r.place for r in hidden] == [3]


def _books(spark, transactions, opening="100.00", invoices=()):
    t = spark.createDataFrame([(1, f"T{i}", date.fromisoformat(d), Decimal(a), c, k, p) for i, (d, a, c, k, p) in enumerate(transactions)], "business_id long, txn_id string, txn_date date, amount decimal(18,2), currency string, category string, counterparty string")
    i = spark.createDataFrame([(1, n, 1, "Acme", date.fromisoformat(a), date.fromisoformat(d), Decimal(x), Decimal(y), "USD", p) for n, a, d, x, y, p in invoices], "business_id long, invoice_id string, customer_id long, customer_name string, issue_date date, due_date date, amount decimal(18,2), tax decimal(18,2), currency string, paid boolean")
    b = spark.createDataFrame([(1, date(2026, 1, 1), date(2026, 6, 30), Decimal(opening))], "business_id long, period_start date, as_of date, opening_balance decimal(18,2)")
    fx = spark.createDataFrame([("USD", Decimal("1")), ("EUR", Decimal("1.125"))], "currency string, rate decimal(12,6)")
    payables = spark.createDataFrame([], "business_id long, payment_id string, due_date date, amount decimal(18,2), currency string, paid boolean")
    return ledger.Books(b, t, i, payables, fx, spark.createDataFrame([("Rent", Decimal("10.00"))], "category string, monthly_budget decimal(18,2)"))


def test_money_is_rounded_half_to_even_row_by_row(spark):
    b = _books(spark, [("2026-01-05", "0.20", "EUR", "x", "c"), ("2026-01-06", "0.60", "EUR", "x", "c"), ("2026-07-01", "99", "USD", "x", "c")], "0.00")
    assert ledger.cash_balance(b).first().value == Decimal("0.22") + Decimal("0.68")  # 0.225 and 0.675


def test_edges_of_runway_growth_and_margins(spark):
    idle = _books(spark, [])
    assert ledger.cash_runway(idle).first().unanswerable and ledger.margins(idle).first().gross_margin is None and ledger.growth(idle, "inflow").first().value is None
    assert ledger.cash_gap_month(idle).first().value_text is None and ledger.receivable_priority(idle).first().value_text is None
    gains = _books(spark, [("2026-01-05", "10", "USD", "x", "c"), ("2026-02-05", "20", "USD", "x", "c")])
    assert ledger.cash_runway(gains).first().value_text == "infinite" and ledger.cash_gap_month(gains).first().value_text == "never" and ledger.growth(gains, "inflow").first().value is None
    broke = _books(spark, [("2026-05-05", "-200", "USD", "Rent", "c"), ("2026-06-05", "-1", "USD", "Rent", "c")])
    assert ledger.cash_runway(broke).first().value == 0 and ledger.cash_gap_month(broke).first().value_text == "already negative" and ledger.budget_variance(broke).first().value == Decimal("190.00")
    burns = _books(spark, [(f"2026-0{m}-05", "-20", "USD", "Rent", "c") for m in (3, 4, 5, 6)], "150.00")
    assert ledger.cash_runway(burns).first().value == Decimal("3.5") and ledger.cash_gap_month(burns).first().value_text == "2026-10"
    growing = _books(spark, [("2026-03-01", "100", "USD", "x", "c"), ("2026-04-01", "150", "USD", "x", "c"), ("2026-05-01", "1", "USD", "x", "c")])
    assert ledger.growth(growing, "inflow").first().value == Decimal("50.0")


def test_unknown_currencies_raise_and_priorities_break_ties_by_id(spark):
    with pytest.raises(Exception, match="no rate for XXX"):
        ledger.cash_balance(_books(spark, [("2026-01-05", "1", "XXX", "x", "c")])).collect()
    b = _books(spark, [], invoices=[("B", "2026-01-01", "2026-06-20", "10", "1", False), ("A", "2026-01-01", "2026-06-20", "10", "1", False), ("C", "2026-01-01", "2026-06-30", "900", "0", False), ("D", "2026-01-01", "2026-06-25", "30", "0", False), ("E", "2026-01-01", "2026-06-29", "1", "0", False), ("P", "2026-01-01", "2026-01-02", "999", "0", True)])
    assert ledger.receivable_priority(b).first().value_text == "D, A, B"
    assert ledger.overdue_receivables(b).first().n_overdue == 4 and ledger.receivables(b).first().n_open == 5


def test_duplicates_keep_the_first_of_the_ledger(spark):
    b = _books(spark, [("2026-01-05", "1", "USD", "x", "c"), ("2026-01-05", "1", "USD", "y", "c"), ("2026-01-05", "1", "USD", "y", "d"), ("2026-01-05", "1", "USD", "z", "c")])
    assert sorted(r.txn_id for r in ledger.duplicate_transactions(b).collect()) == ["T1", "T3"]


def test_tool_metrics_of_odd_traces(spark):
    call = lambda turn, exists=True, valid=True, ran=True, refused=False: (turn, "calculator", "{}", exists, valid, ran, None, None, None, refused)
    rows = [("r", "none", [], 0, False, None, []), ("r", "null", [], 0, False, None, None), ("r", "good", [], 1, True, None, [call(1)]), ("r", "ghost", [], 1, False, None, [call(1, exists=False, ran=False)]), ("r", "late", [], 2, False, None, [call(1, ran=False, refused=True), call(2)])]
    got = {(m.sample_id, m.metric_name): (m.value, m.passed) for m in tools.tool_metrics(spark.createDataFrame(rows, TRACES)).collect()}
    assert got["none", "tool_invocation_rate"] == (0.0, False) == got["null", "tool_invocation_rate"] and got["none", "tool_execution_success"] == (None, None) == got["none", "tool_hallucination_rate"]
    assert got["ghost", "tool_hallucination_rate"] == (0.0, False) and got["ghost", "tool_argument_validity"] == (None, None) and got["ghost", "tool_error_recovery"] == (0.0, False)
    assert got["late", "tool_error_recovery"] == (1.0, True) and got["late", "tool_security_rejection"] == (0.0, False) and got["good", "tool_error_recovery"] == (None, None)


def test_table_queries(spark):
    t = spark.createDataFrame([("Rent", "$1,000"), ("rent office", "(50)"), ("Payroll", "7"), ("RENT", "n/a")], "category string, amount string")
    assert tools.csv_query(t, {"category": "RENT "}, "sum", "amount").first().result == Decimal("1050") and tools.csv_query(t, {"category": "rent"}, "count", "amount").first().result == 3
    with pytest.raises(ValueError, match="unknown aggregate"):
        tools.csv_query(t, {}, "median", "amount")
    money = spark.createDataFrame([(Decimal("2.00"), "eur", "USD"), (Decimal("2.00"), "usd", "USD"), (Decimal("2.00"), "gbp", "USD")], "amount decimal(18,2), currency string, target string")
    got = [r.converted for r in tools.convert_currency(money, spark.createDataFrame([("EUR", Decimal("1.5"))], "currency string, rate decimal(12,6)")).collect()]
    assert got == [Decimal("3"), Decimal("2"), None]


def test_manifests_freezes_and_hashes(spark):
    s = spark.createDataFrame([(i, f"s{i}", "b", "fg"[i % 3 == 0]) for i in range(9)], "pos int, sample_id string, benchmark string, task_family string")
    taken = [r.sample_id for r in samples.round_robin(s, 5, "benchmark").orderBy("place").collect()]
    assert taken == ["s1", "s0", "s2", "s3", "s4"]
    with pytest.raises(Exception, match="no such sample"):
        samples.manifest_rows(s, spark.createDataFrame([("s1", 1), ("gone", 2)], "sample_id string, place int")).collect()
    import hashlib

    assert samples.id_set_hash(s.union(s), "benchmark").first().id_hash == hashlib.sha256("\n".join(sorted(f"s{i}" for i in range(9))).encode()).hexdigest()[:16]
    assert samples.orphans(spark.createDataFrame([("s1",), ("x",)], "sample_id string"), s).count() == 1 and samples.duplicate_ids(s.union(s)).count() == 9


def test_costs_are_null_without_a_price(spark):
    p = spark.createDataFrame([("r", "m", 1_000_000, 0, True), ("r", "m", None, 5, False), ("q", "none", 5, 5, False)], "run_id string, model_ref string, prompt_tokens int, completion_tokens int, cache_hit boolean")
    got = {r.run_id: r for r in samples.cost_totals(p, spark.createDataFrame([("m", 2.0, 4.0)], "model_ref string, prompt_price double, completion_price double"), "run_id").collect()}
    assert got["r"].cost_usd == 2 and got["r"].n_priced == 1 and got["q"].cost_usd is None and got["q"].tokens == 10


def test_calibration_ignores_invalid_verdicts(spark):
    rows = [(True, True)] * 6 + [(False, False)] * 3 + [(False, True), (True, None)]
    got = samples.calibration_report(spark.createDataFrame(rows, "should_be_correct boolean, verdict boolean")).first()
    assert (got.n, got.n_invalid, got.accuracy, got.false_positive_rate, got.false_negative_rate, got.passed) == (10, 1, 0.9, 0.25, 0.0, False)


def test_results_do_not_depend_on_partitions(spark):
    rows = [("m", float(i % 3 == 0), i % 3 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "metric_name string, value double, passed boolean")
    assert rollup.metric_aggregate(df.repartition(1)).collect() == rollup.metric_aggregate(df.repartition(8)).collect()


@pytest.mark.parametrize("scoped", [False, True])
def test_dense_search_in_blocks_equals_all_products(spark, monkeypatch, scoped):
    """Several blocks, ties across them, vectors without length, short ones and such as are none."""
    import random

    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 3)
    draw = random.Random(4)
    rows = [(f"c{i}", f"s{i % 3 if i % 4 else 0}", [draw.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(draw.choice((3, 4)))]) for i in range(300)]
    rows += [("null", "s0", None), ("part", "s0", [1.0, None]), ("nan", "s0", [float("nan"), 1.0]), ("zero", None, [1.0, 2.0]), ("none", "s1", [])]
    asked = [(i, f"s{i % 4}", [draw.gauss(0, 1) for _ in range(4)]) for i in range(11)] + [(11, "s0", [0.0, 0.0]), (12, "s1", None), (13, None, [1.0])]
    v = spark.createDataFrame(rows, "chunk_id string, scope_id string, vector array<double>")
    q = spark.createDataFrame(asked, "query_id int, scope_id string, vector array<double>")
    found = retrieval.dense(q, v, 7, 6, "scope_id" if scoped else None)
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in retrieval.top_k(found, 7, 6).collect()}
    usable = [(c, s, x) for c, s, x in rows if x is not None and all(y is not None and y == y for y in x)]
    size = lambda x: sum(y * y for y in x) ** 0.5
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False)) / (size(a) * size(b)) if size(a) * size(b) else 0.0
    expected = {}
    for i, s, x in asked:
        if x is None or scoped and s is None:
            continue
        scores = sorted((-round(cosine(x, y), 6), c) for c, t, y in usable if not scoped or s == t)
        expected |= {(i, rank + 1): (c, -score) for rank, (score, c) in enumerate(scores[:7])}
    assert got.keys() == expected.keys()
    assert all(got[key][0] == expected[key][0] and abs(got[key][1] - expected[key][1]) < 2e-6 for key in got)
    assert "Python" in found._jdf.queryExecution().executedPlan().toString() or "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() <= 7 * 12 * 9


def test_hash_of_ids_reads_pieces_in_order(spark, monkeypatch):
    import hashlib

    assert samples.PIECE_CHARS <= 1 << 20  # a group of any size is read by pieces
    rows = [("a" if i % 3 else None, f"s{i * 7919 % 5000}") for i in range(9000)] + [("z", None), ("a", "é"), ("a", "Z"), ("a", "")]
    want = {}
    for g, s in rows:
        want.setdefault(g, set()).update([] if s is None else [s])
    hashed = lambda ids: (len(ids), hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()[:16])
    table = spark.createDataFrame(rows, "g string, sample_id string").repartition(7)
    found = samples.id_set_hash(table, "g")
    assert "collect_set" not in found._jdf.queryExecution().toString()
    assert {r.g: (r.n_ids, r.id_hash) for r in found.collect()} == {g: hashed(ids) for g, ids in want.items()}
    whole = samples.id_set_hash(table).collect()
    assert [(r.n_ids, r.id_hash) for r in whole] == [hashed(set().union(*want.values()))]
    assert [(r.n_ids, r.id_hash) for r in samples.id_set_hash(table.limit(0)).collect()] == [hashed(set())] and samples.id_set_hash(table.limit(0), "g").count() == 0


def test_pieces_join_to_the_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(samples, "PIECE_CHARS", 8)
    rows = pa.RecordBatch.from_pydict({"group": ["a"] * 5 + ["b"] * 2, "part": pa.array([0] * 7, pa.int32()), "id": ["s1", "s2", "s3", "s4", "s5", "s1", "s2"]})
    pieces = [p.to_pylist()[0] for p in samples._pieces(iter([rows.slice(0, 4), rows.slice(4)]))]
    assert len(pieces) == 3 and [p["ids"] for p in pieces if p["group"] == "a"] == ["s1\ns2\ns3", "s4\ns5"]


def test_exact_draws_of_whole_values_are_made_in_blocks():
    values = [float(i % 3 == 0) for i in range(5000)]
    draws = random.Random(stats.SEED)
    means = sorted(sum(values[draws._randbelow(5000)] for _ in range(5000)) / 5000 for _ in range(20))
    assert stats.exact_interval(values, iterations=20)[1:] == (means[int((1 - stats.CONFIDENCE) / 2 * 20)], means[min(int((1 - (1 - stats.CONFIDENCE) / 2) * 20), 19)])
    many = np.array([0.0, 1.0] * 200_000)
    tracemalloc.start()
    stats.exact_interval(many, iterations=2)
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()
