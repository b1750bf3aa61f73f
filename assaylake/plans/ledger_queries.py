"""Ledger queries over the derived books, one row for each business unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators import ledger as L
from assaylake.plans.derived import oracle, relation
from assaylake.plans.registry import query

BOOKS = ("business", "transactions", "invoices", "payables", "fx_rates", "budget")

#: Entries in base currency, flows of months and open invoices, as the oracles spell them.
_STEPS = """
entries AS (
  SELECT t.business_id, t.txn_id, t.txn_date, t.category, t.counterparty, b.as_of, strftime(t.txn_date, '%Y-%m') AS month,
         CAST(round_even(t.amount * f.rate, 2) AS DECIMAL(18,2)) AS amount
  FROM transactions t JOIN business b USING (business_id) JOIN fx_rates f USING (currency) WHERE t.txn_date <= b.as_of),
flows AS (
  SELECT business_id, month, sum(CASE WHEN amount > 0 THEN amount END) AS inflow, sum(CASE WHEN amount <= 0 THEN -amount END) AS outflow, sum(amount) AS net,
         row_number() OVER (PARTITION BY business_id ORDER BY month DESC) AS r, count(*) OVER (PARTITION BY business_id) AS n
  FROM entries GROUP BY business_id, month),
cash AS (
  SELECT b.business_id, CAST(b.opening_balance + coalesce((SELECT sum(amount) FROM entries e WHERE e.business_id = b.business_id), 0) AS DECIMAL(24,2)) AS cash FROM business b),
burn AS (
  SELECT business_id, CAST(round_even(CAST(CAST(sum(net) AS DOUBLE) / count(*) AS DECIMAL(24,8)), 2) AS DECIMAL(24,2)) AS net
  FROM flows WHERE (r BETWEEN 2 AND 4) OR n = 1 GROUP BY business_id),
opened AS (
  SELECT i.*, b.as_of, CAST(round_even(i.amount * f.rate, 2) AS DECIMAL(18,2)) AS net, CAST(round_even((i.amount + i.tax) * f.rate, 2) AS DECIMAL(18,2)) AS gross
  FROM invoices i JOIN business b USING (business_id) JOIN fx_rates f USING (currency) WHERE NOT i.paid AND i.issue_date <= b.as_of)
"""


def books(spark: SparkSession, sf_dir: str) -> L.Books:
    return L.Books(*(relation(spark, sf_dir, n) for n in BOOKS))


def _sql(body: str, *extra: str) -> str:
    return oracle(f"WITH {_STEPS}{''.join(', ' + e for e in extra)} {body}", *BOOKS)


@query("cash_balance", _sql("SELECT business_id, cash AS value FROM cash"), decimals="value")
def cash_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cash_balance(books(spark, sf_dir))


@query("monthly_burn", _sql("SELECT business_id, net AS value FROM business LEFT JOIN burn USING (business_id)"), decimals="value")
def monthly_burn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.monthly_burn(books(spark, sf_dir))


_RUNWAY = """
  SELECT c.business_id, c.cash, n.net,
         CASE WHEN n.net IS NULL THEN NULL WHEN c.cash <= 0 THEN 0 WHEN n.net < 0 THEN round_even(CAST(CAST(c.cash AS DOUBLE) / CAST(-n.net AS DOUBLE) AS DECIMAL(24,8)), 1) END AS months
  FROM cash c LEFT JOIN {net} n USING (business_id)
"""


@query("cash_runway", _sql("SELECT business_id, CAST(months AS DECIMAL(24,1)) AS value, CASE WHEN cash > 0 AND net >= 0 THEN 'infinite' END AS value_text, net IS NULL AS unanswerable FROM runway", f"runway AS ({_RUNWAY.format(net='burn')})"), decimals="value")
def cash_runway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cash_runway(books(spark, sf_dir))


@query(
    "cash_gap_month",
    _sql(
        """SELECT business_id, CASE WHEN net IS NULL THEN NULL WHEN cash > 0 AND net >= 0 THEN 'never' WHEN months <= 0 THEN 'already negative'
             ELSE strftime(CAST(date_trunc('month', as_of) AS DATE) + to_months(CAST(floor(months) AS INTEGER) + 1), '%Y-%m') END AS value_text
           FROM runway JOIN business USING (business_id)""",
        f"runway AS ({_RUNWAY.format(net='burn')})",
    ),
)
def cash_gap_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cash_gap_month(books(spark, sf_dir))


@query(
    "receivables",
    _sql(
        """SELECT business_id, CAST(coalesce(sum(gross), 0) AS DECIMAL(24,2)) AS gross, CAST(coalesce(sum(net), 0) AS DECIMAL(24,2)) AS net,
             CAST(coalesce(sum(gross) - sum(net), 0) AS DECIMAL(24,2)) AS tax, count(invoice_id) AS n_open FROM business LEFT JOIN opened USING (business_id) GROUP BY business_id"""
    ), decimals="gross net tax")
def receivables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.receivables(books(spark, sf_dir))


@query(
    "overdue_receivables",
    _sql(
        """SELECT b.business_id, CAST(coalesce(sum(o.gross), 0) AS DECIMAL(24,2)) AS value, count(o.invoice_id) AS n_overdue
           FROM business b LEFT JOIN opened o ON o.business_id = b.business_id AND o.due_date < b.as_of GROUP BY b.business_id"""
    ), decimals="value")
def overdue_receivables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.overdue_receivables(books(spark, sf_dir))


@query(
    "receivable_priority",
    _sql(
        "SELECT b.business_id, string_agg(l.invoice_id, ', ' ORDER BY l.r) AS value_text FROM business b LEFT JOIN late l ON l.business_id = b.business_id AND l.r <= 3 GROUP BY b.business_id",
        "late AS (SELECT business_id, invoice_id, row_number() OVER (PARTITION BY business_id ORDER BY gross * (as_of - due_date) DESC, invoice_id) AS r FROM opened WHERE due_date < as_of)",
    ),
)
def receivable_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.receivable_priority(books(spark, sf_dir))


@query(
    "payable_pressure",
    _sql(
        """SELECT b.business_id, CAST(coalesce(sum(CAST(round_even(p.amount * f.rate, 2) AS DECIMAL(18,2))), 0) AS DECIMAL(24,2)) AS value
           FROM business b LEFT JOIN payables p ON p.business_id = b.business_id AND NOT p.paid AND p.due_date <= b.as_of + 30 LEFT JOIN fx_rates f ON f.currency = p.currency GROUP BY b.business_id"""
    ), decimals="value")
def payable_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.payable_pressure(books(spark, sf_dir))


@query(
    "margins",
    _sql(
        """SELECT business_id, CAST(revenue AS DECIMAL(24,2)) AS revenue, CAST(cogs AS DECIMAL(24,2)) AS cogs, CAST(opex AS DECIMAL(24,2)) AS opex,
             CASE WHEN revenue <> 0 THEN CAST(round_even(CAST(CAST(revenue - cogs AS DOUBLE) / CAST(revenue AS DOUBLE) * 100 AS DECIMAL(38,10)), 1) AS DECIMAL(18,1)) END AS gross_margin,
             CASE WHEN revenue <> 0 THEN CAST(round_even(CAST(CAST(revenue - cogs - opex AS DOUBLE) / CAST(revenue AS DOUBLE) * 100 AS DECIMAL(38,10)), 1) AS DECIMAL(18,1)) END AS operating_margin
           FROM business LEFT JOIN sums USING (business_id)""",
        """sums AS (SELECT business_id, coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS revenue,
             coalesce(sum(CASE WHEN amount <= 0 AND category = 'Cost of goods sold' THEN -amount END), 0) AS cogs,
             coalesce(sum(CASE WHEN amount <= 0 AND category <> 'Cost of goods sold' THEN -amount END), 0) AS opex FROM entries GROUP BY business_id)""",
    ), decimals="revenue cogs opex gross_margin operating_margin")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.margins(books(spark, sf_dir))


def _growth_sql(flow: str) -> str:
    return _sql(
        """SELECT business_id, CASE WHEN previous <> 0 THEN CAST(round_even(CAST(CAST(latest - previous AS DOUBLE) / CAST(previous AS DOUBLE) * 100 AS DECIMAL(38,10)), 1) AS DECIMAL(18,1)) END AS value
           FROM business LEFT JOIN pair USING (business_id)""",
        f"""pair AS (SELECT business_id, max(CASE WHEN k = 2 THEN {flow} END) AS latest, max(CASE WHEN k = 3 THEN {flow} END) AS previous
             FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY month DESC) AS k FROM flows WHERE {flow} IS NOT NULL) GROUP BY business_id)""",
    )


@query("revenue_growth", _growth_sql("inflow"), decimals="value")
def revenue_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.growth(books(spark, sf_dir), "inflow")


@query("expense_growth", _growth_sql("outflow"), decimals="value")
def expense_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.growth(books(spark, sf_dir), "outflow")


@query(
    "budget_variance",
    _sql(
        """SELECT s.business_id, s.category, CAST(round_even(CAST(CAST(sum(s.spent) AS DOUBLE) / count(*) - CAST(g.monthly_budget AS DOUBLE) AS DECIMAL(24,8)), 2) AS DECIMAL(24,2)) AS value
           FROM (SELECT *, row_number() OVER (PARTITION BY business_id, category ORDER BY month DESC) AS r, count(*) OVER (PARTITION BY business_id, category) AS n FROM spend) s
           JOIN budget g ON g.category = s.category WHERE s.r > 1 OR s.n = 1 GROUP BY s.business_id, s.category, g.monthly_budget""",
        "spend AS (SELECT business_id, category, month, sum(-amount) AS spent FROM entries WHERE amount < 0 GROUP BY business_id, category, month)",
    ), decimals="value")
def budget_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.budget_variance(books(spark, sf_dir))


_TOP = """SELECT b.business_id, t.name, CAST(t.total AS DECIMAL(24,2)) AS amount,
  CAST(round_even(CAST(CAST(t.total AS DOUBLE) / CAST(g.grand AS DOUBLE) * 100 AS DECIMAL(38,10)), 1) AS DECIMAL(18,1)) AS value
  FROM business b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY total DESC, name DESC) AS r FROM totals) t ON t.business_id = b.business_id AND t.r = 1
  LEFT JOIN (SELECT business_id, sum(total) AS grand FROM totals GROUP BY business_id) g ON g.business_id = b.business_id"""
_CUSTOMER_TOTALS = """totals AS (SELECT i.business_id, i.customer_name AS name, sum(CAST(round_even(i.amount * f.rate, 2) AS DECIMAL(18,2))) AS total
  FROM invoices i JOIN business b USING (business_id) JOIN fx_rates f USING (currency) WHERE i.issue_date <= b.as_of AND i.customer_name IS NOT NULL GROUP BY i.business_id, i.customer_name)"""


@query("customer_concentration", _sql(_TOP, _CUSTOMER_TOTALS), decimals="amount value")
def customer_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.customer_concentration(books(spark, sf_dir))


@query("supplier_concentration", _sql(_TOP, "totals AS (SELECT business_id, counterparty AS name, sum(-amount) AS total FROM entries WHERE amount < 0 AND counterparty <> 'Internal' GROUP BY business_id, counterparty)"), decimals="amount value")
def supplier_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.supplier_concentration(books(spark, sf_dir))


@query("scenario_lose_customer", _sql("SELECT business_id, name, CAST(total AS DECIMAL(24,2)) AS value FROM totals QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY total DESC, name DESC) = 1", _CUSTOMER_TOTALS), decimals="value")
def scenario_lose_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.customer_concentration(books(spark, sf_dir)).where("name is not null").select("business_id", "name", F.col("amount").alias("value"))


@query(
    "scenario_collect",
    _sql(
        """SELECT c.business_id, CAST(p.percent AS BIGINT) AS percent, CAST(round_even(c.cash + CAST(coalesce(o.gross, 0) AS DECIMAL(24,2)) * p.percent * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(24,2)) AS value
           FROM cash c LEFT JOIN (SELECT business_id, sum(gross) AS gross FROM opened GROUP BY business_id) o USING (business_id), (VALUES (25), (50), (75)) p(percent)"""
    ), decimals="value")
def scenario_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = books(spark, sf_dir)
    parts = [L.scenario_collect(b, p).withColumn("percent", F.lit(p)) for p in (25, 50, 75)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _scenario_sql(revenue: int, expense: int) -> str:
    return _sql(
        "SELECT business_id, CAST(months AS DECIMAL(24,1)) AS value, CASE WHEN cash > 0 AND net >= 0 THEN 'infinite' END AS value_text FROM runway",
        f"changed AS (SELECT business_id, (CAST(sum(coalesce(inflow, 0)) AS DOUBLE) * {revenue} - CAST(sum(coalesce(outflow, 0)) AS DOUBLE) * {expense}) / (count(*) * 100) AS net FROM flows WHERE r BETWEEN 2 AND 4 GROUP BY business_id)",
        f"runway AS ({_RUNWAY.format(net='changed')})",
    )


@query("scenario_revenue_drop", _scenario_sql(80, 100), decimals="value")
def scenario_revenue_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scenario_runway(books(spark, sf_dir), revenue_drop=20)


@query("scenario_cut_expenses", _scenario_sql(100, 85), decimals="value")
def scenario_cut_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scenario_runway(books(spark, sf_dir), expense_cut=15)


@query(
    "duplicate_transactions",
    oracle(
        """SELECT business_id, txn_id FROM (SELECT *, row_number() OVER (PARTITION BY business_id, counterparty, category, strftime(txn_date, '%Y-%m') ORDER BY txn_date, txn_id) AS r FROM transactions) WHERE r > 1""",
        "transactions",
    ),
)
def duplicate_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = books(spark, sf_dir)
    by_month = b.transactions.withColumn("month", F.date_format("txn_date", "yyyy-MM"))
    return L.duplicate_transactions(L.Books(b.business, by_month, b.invoices, b.payables, b.fx_rates, b.budget), "counterparty", "category", "month")


@query(
    "missing_periods",
    oracle(
        """SELECT e.business_id, e.month FROM (
             SELECT business_id, strftime(m, '%Y-%m') AS month FROM (SELECT business_id, as_of, unnest(generate_series(date_trunc('month', period_start), date_trunc('month', as_of), INTERVAL 1 MONTH)) AS m FROM business)
             WHERE m < date_trunc('month', as_of)) e
           ANTI JOIN (SELECT DISTINCT business_id, strftime(txn_date, '%Y-%m') AS month FROM transactions WHERE category = 'Payroll') s USING (business_id, month)""",
        "business", "transactions",
    ),
)
def missing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.missing_periods(books(spark, sf_dir))


@query("last_complete_revenue", _sql("SELECT b.business_id, f.month, CAST(f.inflow AS DECIMAL(24,2)) AS value FROM business b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY month DESC) AS k FROM flows WHERE inflow IS NOT NULL) f ON f.business_id = b.business_id AND f.k = 2"), decimals="value")
def last_complete_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.last_complete_revenue(books(spark, sf_dir))
