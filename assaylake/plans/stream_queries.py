"""The windowed rollup of events as a batch, with which the stream agrees when nothing is late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.plans.derived import relation
from assaylake.plans.registry import query
from assaylake.sources import books
from assaylake.streaming import events


@query("event_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(DISTINCT event_id) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = events.windowed(relation(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rolled.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def _draw(below: int | str, *labels: str) -> str:
    """A draw of the generated books in SQL; labels are SQL expressions."""
    return f"(CAST('0x' || substr(md5(concat_ws('/', seed, {', '.join(labels)})), 1, 8) AS BIGINT) % {below})"


_COSTS = ", ".join(f"('{category}', {base})" for category, base in books.COSTS.items())
_TAX = f"CAST(([0.10, 0.12, 0.20])[{_draw(3, repr('tax'))} + 1] AS DECIMAL(6,4))"
_CURRENCY = f"CASE WHEN seed % 4 = 0 AND {_draw(100, repr('foreign'), 'c')} < 30 THEN ([{', '.join(repr(c) for c in books.RATES)}])[{_draw(len(books.RATES), repr('currency'), 'c')} + 1] ELSE 'USD' END"
_START = "DATE '2025-07-01' + to_months(CAST(m - 1 AS INTEGER))"
_BOOKS = f"""
WITH firms AS (SELECT CAST(1000000 + n_nationkey AS BIGINT) AS seed FROM nation),
bills AS (SELECT *, CAST({_START} AS DATE) + CAST({_draw(26, repr('issued'), 'c', 'm')} AS INTEGER) + ([14, 30, 45])[{_draw(3, repr('terms'), 'c')} + 1] AS due, {_TAX} AS rate, {_CURRENCY} AS currency,
    CAST(((15 + {_draw(40, repr('usual'), 'c')}) * CASE WHEN c = 1 THEN 300 ELSE 100 END * (80 + {_draw(41, repr('bill'), 'c', 'm')} + 2 * m)) / 100 AS DECIMAL(18,2)) AS amount
  FROM firms, (SELECT unnest(range(1, 9)) AS c), (SELECT unnest(range(1, 13)) AS m) WHERE c = 1 OR {_draw(100, repr('bills'), 'c', 'm')} < 75),
paid AS (SELECT *, CAST(round_even(amount * rate, 2) AS DECIMAL(18,2)) AS tax, due + CAST({_draw(17, repr('late'), 'c', 'm')} AS INTEGER) - 5 <= DATE '2026-06-30' AND {_draw(100, repr('pays'), 'c', 'm')} < 85 AS settled FROM bills),
costs AS (SELECT seed, -CAST(base * CASE WHEN category IN ('Payroll', 'Rent') THEN 100 ELSE 85 + {_draw(31, repr('cost'), 'category', 'm')} END / 100 AS DECIMAL(18,2)) AS amount, category NOT IN ('Payroll', 'Rent') AND {_draw(100, repr('double'), 'category', 'm')} < 3 AS twice
  FROM firms, (VALUES {_COSTS}) k(category, base), (SELECT unnest(range(1, 13)) AS m)
  WHERE CASE category WHEN 'Payroll' THEN {_draw(100, repr('gap'), 'm')} >= 4 WHEN 'Rent' THEN TRUE ELSE {_draw(100, repr('spends'), 'category', 'm')} < 60 END),
rows AS (
  SELECT seed, 'business' AS kind, CAST(20000 + {_draw(100001, repr('opening'))} AS DECIMAL(18,2)) AS amount FROM firms
  UNION ALL SELECT seed, 'invoice', amount + tax FROM paid UNION ALL SELECT seed, 'foreign_invoice', amount FROM paid WHERE currency <> 'USD'
  UNION ALL SELECT seed, 'transaction', amount + tax FROM paid WHERE settled UNION ALL SELECT seed, 'transaction', amount FROM costs UNION ALL SELECT seed, 'transaction', amount FROM costs WHERE twice
  UNION ALL SELECT seed, 'payable', CAST(500 + {_draw(8500, repr('payable'), 'p')} AS DECIMAL(18,2)) FROM firms, (SELECT unnest(range(1, 10)) AS p) WHERE p <= 4 + {_draw(6, repr('payables'))}
  UNION ALL SELECT seed, 'budget', CAST(base * (90 + {_draw(31, repr('budget'), 'category')}) / 100 AS DECIMAL(18,2)) FROM firms, (VALUES {_COSTS}) k(category, base) WHERE {_draw(100, repr('budgets'), 'category')} < 50)
SELECT seed AS business_id, kind, count(*) AS n, sum(amount) AS total FROM rows GROUP BY seed, kind
"""


@query("synthetic_books", _BOOKS, decimals="total")
def synthetic_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated books, one for each nation: rows and sums by kind."""
    made = books.books(relation(spark, sf_dir, "nation").select((F.lit(1_000_000) + F.col("n_nationkey")).cast("long").alias("seed")))
    of = lambda df, kind, amount="amount": df.select("business_id", F.lit(kind).alias("kind"), F.col(amount).cast("decimal(18,2)").alias("amount"))
    gross = made.invoices.withColumn("amount", F.col("amount") + F.col("tax"))
    rows = of(made.business, "business", "opening_balance").union(of(gross, "invoice")).union(of(made.invoices.where("currency <> 'USD'"), "foreign_invoice"))
    rows = rows.union(of(made.transactions, "transaction")).union(of(made.payables, "payable")).union(of(made.budget, "budget", "monthly_budget"))
    return rows.groupBy("business_id", "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
