"""Queries over numbers, answers, tool traces and programs that are written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions import finance, numbers, programs, text, toolbox
from assaylake.operators import tools
from assaylake.plans.derived import relation
from assaylake.plans.registry import query

#: Statements of numbers in many forms, from the orders.
_STATED = """
SELECT o_orderkey AS pos, CASE o_orderkey % 9 WHEN 0 THEN '$' || amount || ' million' WHEN 1 THEN '(' || amount || ')' WHEN 2 THEN amount || '%' WHEN 3 THEN '-' || amount WHEN 4 THEN amount || ' bps'
  WHEN 5 THEN '€' || amount || 'k' WHEN 6 THEN amount || ' usd' WHEN 7 THEN 'none given' ELSE amount END AS stated, total
FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(30)) AS amount, CAST(floor(o_totalprice) AS DOUBLE) AS total FROM orders)
"""


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _STATED.replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, orders=relation(spark, sf_dir, "orders"))


@query(
    "numeric_parse",
    f"""SELECT pos, CASE pos % 9 WHEN 7 THEN NULL WHEN 0 THEN total * 1e6 WHEN 1 THEN -total WHEN 3 THEN -total WHEN 5 THEN total * 1e3 ELSE total END AS value,
         CASE pos % 9 WHEN 0 THEN 'usd' WHEN 2 THEN 'percent' WHEN 4 THEN 'basis_points' WHEN 5 THEN 'eur' WHEN 6 THEN 'usd' END AS unit, CASE pos % 9 WHEN 0 THEN 'usd' WHEN 5 THEN 'eur' WHEN 6 THEN 'usd' END AS currency FROM ({_STATED})""",
)
def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stated(spark, sf_dir).select("pos", numbers.parse_number(F.col("stated")).alias("n"))
    return rows.select("pos", F.col("n.value").alias("value"), F.col("n.unit").alias("unit"), F.col("n.currency").alias("currency"))


@query(
    "numbers_in_text",
    """SELECT doc_id, len(v) AS n_numbers, coalesce(round(list_sum(v), 2), 0) AS total FROM (SELECT doc_id, [abs_value FOR abs_value IN
         list_transform(regexp_extract_all(said, '\\(?-?\\$?\\s*[0-9][0-9,]*\\.?[0-9]*\\s*\\)?%?'), lambda t: CAST(replace(regexp_replace(t, '[^0-9.,-]', '', 'g'), ',', '') AS DOUBLE) * CASE WHEN starts_with(trim(t), '(') THEN -1 ELSE 1 END)] AS v
       FROM (SELECT doc_id, 'Sales of $' || CAST(n_chars AS VARCHAR) || ' and (' || CAST(doc_id AS VARCHAR) || ') or ' || CAST(doc_id % 90 AS VARCHAR) || '.5% here' AS said FROM documents))""",
)
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = relation(spark, sf_dir, "documents")
    said = F.concat(F.lit("Sales of $"), F.col("n_chars").cast("string"), F.lit(" and ("), F.col("doc_id").cast("string"), F.lit(") or "), (F.col("doc_id") % 90).cast("string"), F.lit(".5% here"))
    rows = d.select("doc_id", numbers.numbers_in(said).alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("n_numbers"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


@query(
    "supported_numbers",
    """SELECT pos, said, said IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 100) OR len(list_filter([1.0, 1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9, 0.01, 100.0], lambda f: CASE WHEN total * f <= 0 THEN FALSE ELSE
         abs(said - total * f) / greatest(total * f, 1e-9) <= 0.001 OR (said > 0 AND CAST(floor(said / pow(10, floor(log10(CASE WHEN said > 0 THEN said ELSE 1 END))) * 100) AS INTEGER) = CAST(floor(total * f / pow(10, floor(log10(total * f))) * 100) AS INTEGER)) END)) > 0 AS supported
       FROM (SELECT o_orderkey AS pos, floor(o_totalprice) + 0.5 AS total, CASE o_orderkey % 6 WHEN 0 THEN (floor(o_totalprice) + 0.5) * 1000 WHEN 1 THEN (floor(o_totalprice) + 0.5) * 1.0005 WHEN 2 THEN (floor(o_totalprice) + 0.5) * 1.5 WHEN 3 THEN 7.0 WHEN 4 THEN (floor(o_totalprice) + 0.5) / 7 ELSE 987654321.0 END AS said FROM orders)""",
)
def supported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = relation(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.floor("o_totalprice") + 0.5).alias("total"))
    k = F.col("pos") % 6
    said = F.when(k == 0, F.col("total") * 1000).when(k == 1, F.col("total") * 1.0005).when(k == 2, F.col("total") * 1.5).when(k == 3, 7.0).when(k == 4, F.col("total") / 7).otherwise(987654321.0)
    return o.withColumn("said", said).select("pos", "said", numbers.is_supported(F.col("said"), F.array("total")).alias("supported"))


@query(
    "refusal_outcome",
    """SELECT pos, CASE pos % 8 WHEN 0 THEN 'no_answer' WHEN 1 THEN 'refused' WHEN 2 THEN 'answered' WHEN 3 THEN 'flagged_but_answered' WHEN 4 THEN 'hedged_then_answered' WHEN 5 THEN 'refused' WHEN 6 THEN 'answered' ELSE 'refused' END AS outcome
       FROM (SELECT o_orderkey AS pos FROM orders)""",
)
def refusal_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = relation(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"))
    k = F.col("pos") % 8
    said = (
        F.when(k == 1, "I cannot determine this for December 2027.")
        .when(k == 2, "The total is 4,500.")
        .when(k == 3, "Roughly 42,000")
        .when(k == 4, "The data does not support this, however I estimate 42,000.")
        .when(k == 5, "Недостаточно данных")
        .when(k == 6, "It went well.")
        .otherwise("")
    )
    flag = (k == 3) | (k == 7)
    return o.select("pos", text.refusal_outcome(said, F.lit(None).cast("string"), F.lit(None).cast("double"), flag, k != 0).alias("outcome"))


_FORMULA_VALUES = {
    "revenue": "a", "cogs": "b", "net_income": "b", "current_assets": "a", "current_liabilities": "c", "inventory": "b", "ebit": "a", "interest_expense": "c", "total_debt": "b", "total_equity": "c",
    "total_assets": "a", "new": "a", "old": "b", "end": "a", "start": "b", "years": "y", "cash": "a", "monthly_burn": "c",
}


@query(
    "formula_values",
    """SELECT pos, formula, round(value, 6) AS value FROM (SELECT pos, unnest([
         {'formula': 'gross_margin', 'value': (a - b) / nullif(a, 0) * 100}, {'formula': 'net_margin', 'value': b / nullif(a, 0) * 100}, {'formula': 'current_ratio', 'value': a / nullif(c, 0)}, {'formula': 'quick_ratio', 'value': (a - b) / nullif(c, 0)},
         {'formula': 'interest_coverage', 'value': a / nullif(c, 0)}, {'formula': 'debt_to_equity', 'value': b / nullif(c, 0)}, {'formula': 'roe', 'value': b / nullif(c, 0) * 100}, {'formula': 'roa', 'value': b / nullif(a, 0) * 100},
         {'formula': 'percent_change', 'value': (a - b) / nullif(b, 0) * 100}, {'formula': 'cagr', 'value': (pow(a / nullif(b, 0), 1.0 / nullif(y, 0)) - 1) * 100}, {'formula': 'runway_months', 'value': a / nullif(c, 0)}, {'formula': 'working_capital', 'value': a - c}], recursive := true)
       FROM (SELECT l_orderkey * 10 + l_linenumber AS pos, l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b, l_quantity % 7 AS c, CAST(l_linenumber AS DOUBLE) AS y FROM lineitem))""",
)
def formula_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"), (F.col("l_quantity") % 7).alias("c"), F.col("l_linenumber").cast("double").alias("y"))
    each = F.array(*(F.struct(F.lit(name).alias("formula"), F.round(finance.formula(name, **{i: F.col(_FORMULA_VALUES[i]) for i in inputs}), 6).alias("value")) for name, (inputs, _) in finance.FORMULAS.items()))
    return rows.select("pos", F.inline(each))


@query("date_differences", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = relation(spark, sf_dir, "lineitem").join(relation(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    asked = F.create_map(F.lit("from"), day("o_orderdate"), F.lit("to"), day("l_shipdate"))
    return both.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), toolbox.date_diff(asked, F.lit(None), F.lit(None))["output"].cast("long").alias("days"))


@query("json_answers", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS numeric_value, FALSE AS insufficient_information FROM events")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = relation(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    said = F.concat(F.lit('Here you are: {"answer": "see", "numeric_value": '), k, F.lit(', "insufficient_information": null} done'))
    return e.select("event_id", text.parse_answer(said).alias("p")).select("event_id", F.col("p.numeric_value").alias("numeric_value"), F.col("p.insufficient_information").alias("insufficient_information"))


@query(
    "csv_query",
    """SELECT c_mktsegment, kind, CAST(result AS DOUBLE) AS result FROM (
         SELECT c_mktsegment, unnest([{'kind': 'sum', 'result': CAST(sum(v) AS DOUBLE)}, {'kind': 'min', 'result': CAST(min(v) AS DOUBLE)}, {'kind': 'max', 'result': CAST(max(v) AS DOUBLE)}, {'kind': 'count', 'result': CAST(count(*) AS DOUBLE)}], recursive := true)
         FROM (SELECT c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer WHERE contains(lower(c_name), '#00000')) GROUP BY c_mktsegment)""",
)
def csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relation(spark, sf_dir, "customer").withColumn("balance", F.format_number(F.col("c_acctbal").cast("decimal(18,2)"), 2))
    parts = [tools.csv_query(c, {"c_name": "#00000"}, kind, "balance", "c_mktsegment").select("c_mktsegment", F.lit(kind).alias("kind"), F.col("result").cast("double").alias("result")) for kind in ("sum", "min", "max", "count")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(
    "document_search",
    """SELECT doc_id, least(len(l), 20) AS n_lines, substr(l[1], 1, 40) AS first_line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the')) AS l FROM documents) WHERE len(l) > 0""",
)
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relation(spark, sf_dir, "documents").select("doc_id", text.matching_lines(F.col("text"), F.lit(" THE "), toolbox.MAX_LINES).alias("l"))
    return found.where(F.size("l") > 0).select("doc_id", F.size("l").alias("n_lines"), F.substring(F.get("l", F.lit(0)), 1, 40).alias("first_line"))


_CALLS = """
SELECT o_orderkey AS pos, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)) AS x, CAST(2 * o_custkey + 1 AS VARCHAR(30)) AS y FROM orders
"""


@query(
    "tool_calls",
    f"""SELECT pos, CASE pos % 8 WHEN 0 THEN 2 * dy + 1 WHEN 1 THEN round((dx - dy) * 100 / dy, 6) WHEN 2 THEN round(dx / 100, 6) WHEN 3 THEN round(dx * 1.09, 6) WHEN 4 THEN dx + 7 WHEN 5 THEN round((dx - dy) / dx * 100, 6) END AS output,
         CASE pos % 8 WHEN 6 THEN 'not_found' WHEN 7 THEN 'unknown_tool' END AS error FROM (SELECT pos, CAST(x AS DOUBLE) AS dx, CAST(y AS DOUBLE) AS dy FROM ({_CALLS}))""",
)
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored calls of the tools, and what they give; a number is read back from the output."""
    rows = spark.sql(_CALLS.replace("FROM orders", "FROM {orders}"), orders=relation(spark, sf_dir, "orders"))
    k = F.col("pos") % 8
    say = lambda form, *args: F.format_string(form, *args)
    name, args = F.lit("none"), F.lit("{}")
    calls = (
        ("calculator", say('{"expression": "2 * %s + 1"}', "y")), ("percent_change", say('{"old": %s, "new": "%s"}', "y", "x")), ("basis_points", say('{"basis_points": %s}', "x")), ("convert_currency", say('{"amount": %s, "from": "eur", "to": "usd"}', "x")),
        ("csv_query", say('{"aggregate": "sum", "column": "Amount", "where": {"name": "row"}}')), ("formula", say('{"name": "gross_margin", "values": {"revenue": %s, "cogs": %s}}', "x", "y")), ("table_lookup", say('{"row": "nothing like it"}')),
    )
    for i, (tool, given) in enumerate(calls):
        name, args = F.when(k == i, tool).otherwise(name), F.when(k == i, given).otherwise(args)
    grid = lambda table, *lines: F.struct(F.lit(table).alias("table_id"), F.array(*(F.array(*(c if not isinstance(c, str) else F.lit(c) for c in line)) for line in lines)).alias("rows"))
    tables = F.array(grid("ledger", ("name", "amount"), ("row one", F.concat(F.lit("$"), "x")), ("Row two", "(7)"), ("total", "9")), grid("fx_rates", ("Currency", "Rate"), ("EUR", "1.09")))
    told = rows.select("pos", toolbox.tool_result(name, args, F.array(F.lit("no text")), tables).alias("r"))
    return told.select("pos", F.round(F.col("r.output").try_cast("double"), 6).alias("output"), F.col("r.error").alias("error"))


@query(
    "tool_metrics",
    """WITH calls AS (SELECT l_orderkey, l_linenumber AS turn, l_quantity % 5 <> 0 AS real, l_quantity % 7 <> 0 AS valid, l_quantity % 5 <> 0 AND l_quantity % 7 <> 0 AND l_returnflag <> 'R' AS ran, l_quantity = 50 AS refused FROM lineitem),
         t AS (SELECT l_orderkey, count(*) AS n, bool_or(real) AS any_real, bool_or(ran) AS any_ran, bool_and(real) AS all_real, bool_or(refused) AS any_refused, count(*) FILTER (real) AS n_real, count(*) FILTER (real AND valid) AS n_valid, min(CASE WHEN NOT ran THEN turn END) AS failed, max(CASE WHEN ran THEN turn END) AS last_ran FROM calls GROUP BY l_orderkey)
       SELECT 'orders:test:' || CAST(l_orderkey AS VARCHAR) AS sample_id, metric_name, value, passed FROM (SELECT l_orderkey, unnest([
         {'metric_name': 'tool_selection_accuracy', 'value': CAST(any_real AS DOUBLE), 'passed': any_real}, {'metric_name': 'tool_execution_success', 'value': CAST(any_ran AS DOUBLE), 'passed': any_ran},
         {'metric_name': 'tool_result_utilization', 'value': CASE WHEN any_ran THEN CAST(l_orderkey % 2 = 0 AS DOUBLE) END, 'passed': CASE WHEN any_ran THEN l_orderkey % 2 = 0 END},
         {'metric_name': 'tool_security_rejection', 'value': CAST(NOT any_refused AS DOUBLE), 'passed': NOT any_refused}, {'metric_name': 'tool_invocation_rate', 'value': 1.0::DOUBLE, 'passed': TRUE},
         {'metric_name': 'tool_argument_validity', 'value': CASE WHEN n_real > 0 THEN CAST(n_valid AS DOUBLE) / n_real END, 'passed': CASE WHEN n_real > 0 THEN n_valid = n_real END},
         {'metric_name': 'tool_hallucination_rate', 'value': CAST(all_real AS DOUBLE), 'passed': all_real},
         {'metric_name': 'tool_error_recovery', 'value': CASE WHEN failed IS NOT NULL THEN CAST(coalesce(last_ran > failed, FALSE) AS DOUBLE) END, 'passed': CASE WHEN failed IS NOT NULL THEN coalesce(last_ran > failed, FALSE) END}], recursive := true) FROM t)""",
)
def tool_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    real, valid = q % 5 != 0, q % 7 != 0
    ran = real & valid & (F.col("l_returnflag") != "R")
    call = F.struct(F.col("l_linenumber").cast("int").alias("turn"), F.lit("calculator").alias("tool_name"), F.lit("{}").alias("arguments"), real.alias("tool_exists"), valid.alias("arguments_valid"), ran.alias("executed"), F.lit(None).cast("string").alias("output"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("latency_ms"), (q == 50).alias("security_refused"))
    traces = relation(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(call).alias("calls"))  # the calls of one sample
    traces = traces.select(F.lit("a").alias("run_id"), F.concat(F.lit("orders:test:"), F.col("l_orderkey").cast("string")).alias("sample_id"), (F.col("l_orderkey") % 2 == 0).alias("result_used"), "calls")
    return tools.tool_metrics(traces).select("sample_id", "metric_name", "value", "passed")


_PROGRAMS = """
SELECT o_orderkey AS pos, floor(o_totalprice) AS x, 2 * o_custkey + 1 AS y, o_orderkey % 6 AS k FROM orders
"""


@query(
    "program_accuracy",
    f"""SELECT pos, CASE WHEN k = 3 THEN 'n/a' WHEN k = 4 THEN CASE WHEN x > y THEN 'yes' ELSE 'no' END ELSE CAST(found AS VARCHAR) END AS executed, coalesce(k < 2 OR k = 5, FALSE) AS execution_correct, k IN (0, 5) AS program_correct FROM (
          SELECT *, CASE k WHEN 2 THEN CAST(x + y AS DOUBLE) ELSE round((CAST(x AS DOUBLE) - y) / y, 5) END AS found FROM ({_PROGRAMS}))""",
)
def program_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs over two numbers of an order: as the gold one, rewritten with a constant, wrong, none, a comparison, or the same function
    with its steps in another order. The divisor is odd, so no quotient is a tie of its fifth digit."""
    o = spark.sql(_PROGRAMS.replace("FROM orders", "FROM {orders}"), orders=relation(spark, sf_dir, "orders")).withColumns({"x": F.col("x").cast("long").cast("string"), "y": F.col("y").cast("string")})
    k = F.col("k")
    made = lambda form, *names: F.format_string(form, *names)
    gold = made("subtract(%s, %s), divide(#0, %s)", "x", "y", "y")
    said = (
        F.when(k == 0, F.concat(F.lit("```\n"), gold, F.lit("\n```"))).when(k == 1, made("divide(%s, %s), subtract(#0, const_1)", "x", "y")).when(k == 2, made("add(%s, %s)", "x", "y"))
        .when(k == 4, made("greater(%s, %s)", "x", "y")).when(k == 5, made("divide(%s, %s), divide(%s, %s), subtract(#0, #1)", "x", "y", "y", "y")).otherwise("no program here")
    )
    value = F.round((F.col("x").cast("double") - F.col("y").cast("double")) / F.col("y").cast("double"), 5)
    scored = o.withColumn("s", programs.program_scores(said, gold, value.cast("string"), F.lit(None).cast("array<array<string>>")))
    return scored.select("pos", "s.executed", "s.execution_correct", "s.program_correct")


_SPANS = """
SELECT o_orderkey AS pos, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(30)) AS x, o_orderkey % 6 AS k,
  CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(30)) WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(30)) || ' thousand' WHEN 2 THEN 'the ' || o_orderstatus || 'x, and the debt' WHEN 3 THEN '12.5%'
    WHEN 4 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(30)) ELSE 'cash of ' || o_orderpriority END AS said,
  CASE o_orderkey % 6 WHEN 2 THEN 'debt|fx' WHEN 3 THEN '12.5' WHEN 5 THEN 'cash|' || o_orderpriority ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(30)) END AS gold,
  CASE o_orderkey % 6 WHEN 1 THEN 'thousand' WHEN 3 THEN 'percent' ELSE '' END AS scale FROM orders
"""
_WORDS = "list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), ' '), lambda w: w <> ''))"


@query(
    "span_answers",
    f"""SELECT pos, CASE WHEN worded THEN CAST(exact_words AS DOUBLE) ELSE CAST(said_number = gold_number AS DOUBLE) END AS exact_match, CASE WHEN worded THEN round(2.0 * common / (n_said + n_gold), 2) ELSE CAST(said_number = gold_number AS DOUBLE) END AS f1, scale_said = scale AS scale_correct FROM (
          SELECT *, k IN (2, 5) AS worded, len(list_intersect(w, g)) AS common, len(w) AS n_said, len(g) AS n_gold, len(w) = len(g) AND len(list_intersect(w, g)) = len(g) AND k <> 2 AND k <> 5 AS exact_words,
            CASE WHEN contains(said, '%') THEN CAST(replace(said, '%', '') AS DOUBLE) / 100 WHEN k IN (0, 1, 4) THEN CAST(x AS DOUBLE) * CASE WHEN contains(said, 'thousand') THEN 1000 * 1000 ELSE 1 END END AS said_number,
            CASE WHEN k IN (0, 1, 3, 4) THEN CAST(gold AS DOUBLE) * CASE scale WHEN 'thousand' THEN 1000 WHEN 'percent' THEN 0.01 ELSE 1 END END AS gold_number, CASE WHEN contains(said, '%') THEN 'percent' WHEN contains(said, 'thousand') THEN 'thousand' ELSE '' END AS scale_said
          FROM (SELECT *, {_WORDS.format("replace(said, ',', ' ')")} AS w, {_WORDS.format("replace(gold, '|', ' ')")} AS g FROM ({_SPANS})))""",
)
def span_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span and number answers with scales, from the orders. A scale word in an answer counts in the number and as its scale."""
    o = spark.sql(_SPANS.replace("FROM orders", "FROM {orders}"), orders=relation(spark, sf_dir, "orders"))
    k = F.col("k")
    kind = F.when(k == 2, "multi-span").when(k == 5, "span").otherwise("arithmetic")
    rows = o.withColumn("s", programs.span_metrics(F.col("said"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.split("gold", r"\|"), F.col("scale"), kind))
    return rows.select("pos", "s.exact_match", "s.f1", "s.scale_correct")


@query("prose_answers", "SELECT pos, coalesce(abs(TRY_CAST(regexp_extract(said, '[0-9]+') AS DOUBLE) - x) <= x * 0.002, FALSE) AS correct FROM (SELECT o_orderkey AS pos, floor(o_totalprice) AS x, CASE o_orderkey % 6 WHEN 0 THEN 'approximately ' || v WHEN 1 THEN 'total = $' || v WHEN 2 THEN v || ' kg' WHEN 3 THEN CAST(CAST(2 * floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 4 THEN CAST(CAST(floor(o_totalprice * 1.0015) AS BIGINT) AS VARCHAR) ELSE 'no number' END AS said FROM (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS v FROM orders))")
def prose_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in prose, near the gold or too far from it."""
    o = relation(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.floor("o_totalprice").alias("x"), F.floor(F.col("o_totalprice") * 1.0015).cast("string").alias("near"))
    k, x = F.col("pos") % 6, F.col("x").cast("string")
    said = F.when(k == 0, F.concat(F.lit("approximately "), x)).when(k == 1, F.concat(F.lit("total = $"), x)).when(k == 2, F.concat(x, F.lit(" kg"))).when(k == 3, (F.col("x") * 2).cast("string")).when(k == 4, F.col("near")).otherwise("no number")
    return o.select("pos", programs.prose_correct(said, F.lit(None).cast("double"), x).alias("correct"))


@query("sandbox_values", "SELECT o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey * 3 + 1 AS VARCHAR) END AS value, CASE o_orderkey % 4 WHEN 1 THEN 'arithmetic' WHEN 2 THEN 'disallowed_construct' WHEN 3 THEN 'resource_limit' END AS refusal FROM orders")
def sandbox_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions of a calculator tool: sums, divisions by zero, calls of code and exponents beyond the limit."""
    o = relation(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("x"))
    k = F.col("pos") % 4
    said = F.when(k == 0, F.concat("x", F.lit(" * 3 + 1"))).when(k == 1, F.concat("x", F.lit(" / 0"))).when(k == 2, F.lit("__import__('os').system('x')")).otherwise(F.concat("x", F.lit(" ** 999999")))
    return o.withColumn("s", programs.sandboxed(said)).select("pos", "s.value", "s.refusal")
