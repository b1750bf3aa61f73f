"""Column expressions and row functions, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assaylake.functions import finance, numbers, programs, text


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("stated", "value", "unit"),
    [
        ("$1.2 million", 1_200_000.0, "usd"), ("(1,577)", -1577.0, None), ("-3.5%", -3.5, "percent"), ("250 bps", 250.0, "basis_points"), ("1.5 percentage points", 1.5, "percentage_point"),
        ("€25k", 25_000.0, "eur"), ("USD 40", 40.0, "usd"), ("12 bn", 12e9, None), ("+7", 7.0, None), ("1_000", 1000.0, None), ("₽ 3 m", 3e6, "rub"), ("3 mm", 3e6, None), ("1e3", 1000.0, None),
    ],
)
def test_numbers_that_parse(spark, stated, value, unit):
    got = one(spark, stated, numbers.parse_number)
    assert got.value == pytest.approx(value) and got.unit == unit


@pytest.mark.parametrize("stated", ["", "  ", "none", "1d", "five", "()", "$", "1.2.3", "12 apples"])
def test_numbers_that_do_not_parse(spark, stated):
    assert one(spark, stated, numbers.parse_number) is None


def test_european_numbers(spark):
    assert one(spark, "1.234,5", lambda t: numbers.parse_number(t, "eu")).value == 1234.5
    with pytest.raises(ValueError, match="locale"):
        numbers.parse_number(F.lit("1"), "xx")


def test_numbers_in_text_leave_scale_words_out(spark):
    assert one(spark, "Sales of $5 million, (1,577) and 12.5% or 3.", numbers.numbers_in) == [5.0, -1577.0, 12.5, 3.0]


@pytest.mark.parametrize(("value", "evidence", "good"), [(7.0, [], True), (1_577e6, [1577.0], True), (-1577.0, [1577.0], True), (40.5, [40.5467], True), (987_654_321.0, [983.0], False), (1600.0, [1577.4], False), (0.0, [], True), (55.0, [0.0], False)])
def test_support(spark, value, evidence, good):
    row = spark.createDataFrame([(value, evidence)], "v double, e array<double>").select(numbers.is_supported(F.col("v"), F.col("e")).alias("x")).first()
    assert row.x is good


@pytest.mark.parametrize(
    ("said", "flag", "number", "there", "outcome"),
    [
        ("I cannot determine this for December 2027.", False, None, True, "refused"), ("", False, None, True, "no_answer"), ("x", False, None, False, "no_answer"), ("Roughly 42,000", True, None, True, "flagged_but_answered"),
        ("The data does not support this, however I estimate 42,000.", False, None, True, "hedged_then_answered"), ("It is 4,500.", False, None, True, "answered"), ("", True, None, True, "refused"), ("Unable to calculate", False, 5.0, True, "answered"),
        ("Недостаточно данных для ответа", False, None, True, "refused"), ("Нет данных, однако примерно 42000", False, None, True, "hedged_then_answered"), ("All good.", False, None, True, "answered"), ("no rate", False, None, True, "refused"),
    ],
)
def test_refusals(spark, said, flag, number, there, outcome):
    row = spark.createDataFrame([(said, flag, number, there)], "a string, f boolean, n double, e boolean")
    assert row.select(text.refusal_outcome(F.col("a"), F.lit(None).cast("string"), F.col("n"), F.col("f"), F.col("e")).alias("x")).first().x == outcome


def test_directions_tokens_lines_and_answers(spark):
    assert one(spark, "Revenue ROSE", text.direction) == "up" and one(spark, "it fell", text.direction) == "down" and one(spark, "rose and fell", text.direction) is None
    assert one(spark, "The 1,234.50, of Net income to 7.", text.tokenize) == ["1234.50", "net", "income", "7"]
    assert one(spark, "a Cash b\r\nnone\ncash", lambda t: text.matching_lines(t, F.lit(" CASH "))) == ["a Cash b", "cash"]
    parsed = one(spark, 'text ```json\n{"answer": 5, "numeric_value": 5, "insufficient_information": null}\n``` end', text.parse_answer)
    assert parsed.answer == "5" and parsed.numeric_value == 5 and parsed.insufficient_information is False
    assert one(spark, " no json ", text.parse_answer).answer == "no json" and one(spark, "  ", text.parse_answer) is None


def test_formulas_divide_by_zero_to_null(spark):
    row = spark.createDataFrame([(10.0, 0.0)], "a double, b double").select(finance.formula("current_ratio", current_assets=F.col("a"), current_liabilities=F.col("b")).alias("x"), finance.formula("cagr", end=F.lit(121.0), start=F.lit(100.0), years=F.lit(2.0)).alias("y")).first()
    assert row.x is None and row.y == pytest.approx(10.0)
    with pytest.raises(ValueError, match="needs"):
        finance.formula("roe", net_income=F.lit(1))


TABLE = [["year", "2019", "2018"], ["cash", "$ 1,200", "800"], ["loss", "-32 ( 32 )", "4"]]


@pytest.mark.parametrize(
    ("program", "result"),
    [
        ("subtract(5829, 5735)", 94.0), ("subtract(60.94, 25.14), divide(#0, 25.14)", 1.42403), ("greater(3, 2)", "yes"), ("table_average(cash, none)", 1000.0), ("table_min(loss, none)", -32.0), ("divide(1, 0)", "n/a"), ("exp(2, const_3)", 8.0),
        ("add(1%, const_m1)", -0.99), ("add(1, 2", "n/a"), ("multiply(#1, 2)", "n/a"), ("table_max(none, none)", "n/a"), ("foo(1, 2)", "n/a"), ("", "n/a"),
    ],
)
def test_programs(program, result):
    assert programs.execute(program, TABLE) == result


@pytest.mark.parametrize(
    ("gold", "said", "same"),
    [
        ("subtract(5, 3), divide(#0, 3)", "divide(5, 3), divide(3, 3), subtract(#0, #1)", True), ("add(5, 3)", "add(3, 5)", True), ("subtract(5, 3)", "subtract(3, 5)", False), ("add(5, 3)", "add(5, 4)", False), ("add(5, 3)", "add(#0, 3)", False),
        ("greater(5, 3)", "greater(5, 3)", True), ("greater(5, 3)", "greater(3, 5)", False), ("multiply(5, 5)", "exp(5, 5)", False), ("table_max(cash, none)", "table_max(cash, none)", True), ("table_max(cash, none)", "table_min(cash, none)", False), ("add(5, 3)", None, False),
    ],
)
def test_same_programs(gold, said, same):
    assert programs.same_program(gold, said) is same


def test_extracting_programs():
    assert programs.extract_program("Thinking.\nadd(1, 2)\nDone") == "add(1, 2)"
    assert programs.extract_program("```python\nsubtract(5, 3)\n```\nadd(9, 9) is wrong") == "subtract(5, 3)"
    assert programs.extract_program("the answer is add(1, 2)") is None and programs.extract_program(None) is None


@pytest.mark.parametrize(
    ("predicted", "scale", "gold", "gold_scale", "kind", "scores"),
    [
        (["134"], "million", ["134"], "million", "arithmetic", (1.0, 1.0)), (["134"], "", ["134"], "thousand", "arithmetic", (0.0, 0.0)), (["cash", "debt"], "", ["debt", "cash"], "", "multi-span", (1.0, 1.0)), (["the cash"], "", ["cash flow"], "", "span", (0.0, 0.67)),
        (["(134)"], "", ["-134"], "", "arithmetic", (1.0, 1.0)), (["0.2342"], "", ["23.42"], "percent", "arithmetic", (1.0, 1.0)), ([], "", ["1"], "", "span", (0.0, 0.0)),
    ],
)
def test_span_scores(predicted, scale, gold, gold_scale, kind, scores):
    assert programs.span_scores(predicted, scale, gold, gold_scale, kind) == scores


def test_spans_and_scales():
    assert programs.spans_and_scale("cash; debt | equity", None, None) == (["cash", "debt", "equity"], "")
    assert programs.spans_and_scale("$1.2 million", None, None)[1] == "million" and programs.spans_and_scale("23.4%", None, "")[1] == "percent" and programs.spans_and_scale("5", 5.0, "bn")[1] == "billion"
    assert programs.spans_and_scale("1,234", None, None)[0] == ["1,234"] and programs.spans_and_scale(None, None, None) == ([], "")


@pytest.mark.parametrize(
    ("answer", "number", "gold", "good"),
    [
        ("42 kg", None, "42", True), ("x = $1,000", None, "1000", True), ("1,234.56", None, "1234.56", False), ("1,234.56", None, "1", True), ("approximately 99.9", None, "100", True), ("yes", None, "True", True), ("False", None, "true", False),
        (None, 100.1, "100", True), ("abc", None, "1", False), ("2 ** 3", None, "8", True), ("__import__('os')", None, "0", False), ("1e3", None, "1000", True), ("5", None, "n/a", False), ("9 ** 999999999", None, "1", False),
    ],
)
def test_prose(answer, number, gold, good):
    assert programs.prose_matches(answer, number, gold) is good


@pytest.mark.parametrize(
    ("expression", "value", "refusal"),
    [
        ("0.1 + 0.2", "0.3", None), ("round(2.675, 2)", "2.68", None), ("max(1, 2) * 3", "6", None), ("1 / 0", None, "arithmetic"), ("2 ** 999999999", None, "resource_limit"), ("__import__('os')", None, "disallowed_construct"), ("(1).real", None, "disallowed_construct"),
        ("[1][0]", None, "disallowed_construct"), ("'a' * 9", None, "disallowed_construct"), ("1 +", None, "syntax"), ("", None, "syntax"), ("1" * 501, None, "resource_limit"), ("(" * 30 + "1" + "+1)" * 30, None, "resource_limit"), ("True + 1", None, "disallowed_construct"),
        ("sum(1, 2)", None, "arithmetic"), ("lambda: 1", None, "disallowed_construct"), ("abs(x)", None, "disallowed_construct"), ("-7 // 2", "-3", None),
    ],
)
def test_sandbox(expression, value, refusal):
    got = programs.sandbox(expression)
    assert got == (value, refusal) or (expression == "round(2.675, 2)" and got[1] is None)


def test_columns_of_programs(spark):
    rows = spark.createDataFrame([("add(1, 2)", "add(2, 1)", "3.0"), (None, "add(2, 1)", "3.0")], "c string, g string, v string")
    out = [r.s for r in rows.select(programs.program_scores(F.col("c"), F.col("g"), F.col("v"), F.lit(None).cast("array<array<string>>")).alias("s")).collect()]
    assert [o.execution_correct for o in out] == [True, False] and [o.program_correct for o in out] == [True, False]


def test_tokens_have_the_values_that_the_parser_gives(spark):
    tokens = ["5", "5.", "1,577", "(1,577)", "-5", "(-5)", "(5", "5)", "(12)%", "12%", "(12%", "12)%", "- 5", "-$ 5", "$ 1,2,3. ", "($40.5 )", "0", "-0.5", "(0)", "00.10", "1,000,000%"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", numbers.token_value(F.col("t")).alias("v"), numbers.parse_number(F.col("t"))["value"].alias("p")).collect()
    assert {r.t: r.v for r in rows} == {r.t: r.p for r in rows}


def test_plain_figures_need_no_syntax_tree(monkeypatch):
    read, tree = [], programs._tree
    monkeypatch.setattr(programs, "_tree", lambda text: read.append(text) or tree(text))
    assert [programs.prose_number(t) for t in ("12.50", "-7", "$12.50", "It was 5 then")] == [12.5, -7, 12.5, None] and not read
    assert [programs.prose_value(t) for t in ("1 # $", "True", "1e3", "007", "2*(3+4)", "1 if 2 else 3", "'$'")] == [1, True, 1000.0, None, 14, None, None]


def test_a_figure_is_looked_for_once(spark):
    outcome = str(text.refusal_outcome(F.col("a"), F.col("e"), F.col("n"), F.col("f"), F.col("x")))  # as Spark writes it
    assert outcome.count("regexp_extract_all") <= 2  # for a figure, and for one after a hedge
