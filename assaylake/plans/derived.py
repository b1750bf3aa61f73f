"""Evaluation, ledger and retrieval relations derived from the star-schema tables.

The tables hold no evaluation records, so the operators run on relations that are defined here once, in SQL that
Spark and the oracle engine read alike. ``{half_even}`` stands for the engine's half-even rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaylake.sources.tables import dealt, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Two runs of predictions over the same samples of five benchmarks: the first errs by the order key modulo 12, the second by a
#: shifted one. Stated figures are exact decimals as text, in forms that the key chooses; answers of one benchmark are sentences.
PREDICTED = """
SELECT run_id, pos, sample_id, benchmark, task_family, tags, gold, gold_text, should_refuse, canary, m, key,
       CASE WHEN gold IS NULL THEN 'Yes' WHEN benchmark = 'secque' THEN 'Revenue ' || CASE key % 3 WHEN 0 THEN 'rose' WHEN 1 THEN 'fell' ELSE 'came' END || ' to ' || gold_text || ' in 2021' ELSE gold_text END AS gold_answer,
       CASE WHEN gold IS NULL THEN 'boolean' WHEN key % 9 = 0 THEN 'analytical' ELSE 'numeric' END AS shape,
       'Revenue was ' || coalesce(gold_text, 'not stated') || ' and costs were 350.25.' AS context, 'D' || CAST(key % 7 AS VARCHAR(20)) AS evidence_document,
       CASE key % 6 WHEN 0 THEN NULL WHEN 1 THEN 'D99' ELSE 'D' || CAST(key % 7 AS VARCHAR(20)) END AS cited,
       CASE WHEN m = 11 THEN FALSE ELSE TRUE END AS has_response,
       CASE WHEN m = 11 THEN CASE WHEN key % 2 = 0 THEN 'ReadTimeout' ELSE 'ServerError' END END AS error_type,
       CASE WHEN m = 10 AND key % 2 = 0 THEN TRUE ELSE FALSE END AS insufficient,
       CASE WHEN m < 9 AND key % 4 IN (2, 3) AND benchmark <> 'secque' THEN CAST(said AS DOUBLE) END AS number,
       CASE WHEN m = 11 THEN NULL WHEN m = 9 AND key % 5 = 0 THEN '{"value": 3}' WHEN m = 9 THEN 'nothing to state' WHEN m = 10 THEN 'It cannot be determined from these pages.'
            WHEN said IS NULL THEN CASE WHEN m < 5 THEN 'Yes' ELSE 'No, it did not' END
            WHEN benchmark = 'secque' THEN CASE WHEN key % 5 = 0 THEN 'The firm ' ELSE 'Acme ' END || CASE WHEN m % 3 = 0 THEN 'fell' WHEN m % 3 = 1 THEN 'rose' ELSE 'rose and fell' END || ' to ' || said || ' in ' || CASE WHEN key % 4 = 0 THEN '2010' ELSE '2021' END
            ELSE CASE key % 4 WHEN 1 THEN '$' || said WHEN 3 THEN 'It was ' || said || ' then' ELSE said END || CASE WHEN benchmark = 'finqa' AND m = 4 AND key % 4 <> 3 THEN '%' ELSE '' END END AS answer,
       CASE WHEN m = 11 THEN NULL ELSE key % 900 + 40 END AS prompt_tokens,
       CASE WHEN m = 11 THEN NULL ELSE key % 300 + 5 END AS completion_tokens,
       key % 7 = 0 AS cache_hit
FROM (
  SELECT *, CAST(gold_text AS DOUBLE) AS gold,
         CASE WHEN canary IS NOT NULL AND key % 3 = 0 AND m < 9 THEN '1000000.00000000' ELSE CAST(CAST(CAST(gold_text AS DECIMAL(18,2)) * CAST(CASE m WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 0.000001 WHEN 3 THEN -1 WHEN 4 THEN 100 WHEN 5 THEN 10000
           WHEN 6 THEN 10 WHEN 7 THEN 1.004 WHEN 8 THEN 1.07 END AS DECIMAL(14,6)) AS DECIMAL(30,8)) AS VARCHAR(60)) END AS said
  FROM (
    SELECT r.run_id, o_orderkey AS pos, o_orderkey AS key, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'finqa' WHEN '2' THEN 'finance_reasoning' WHEN '3' THEN 'filings_qa' WHEN '4' THEN 'smb_cfo' ELSE 'secque' END AS benchmark,
           CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'finqa' WHEN '2' THEN 'finance_reasoning' WHEN '3' THEN 'filings_qa' WHEN '4' THEN 'smb_cfo' ELSE 'secque' END || ':test:' || CAST(o_orderkey AS VARCHAR(20)) AS sample_id, o_orderstatus AS task_family,
           CASE o_orderkey % 5 WHEN 0 THEN 'calculation,formula' WHEN 1 THEN 'table_text' WHEN 2 THEN 'evidence_grounding,retrieval'
                WHEN 3 THEN 'calibration_refusal,unknown_tag' ELSE 'calculation,ratio,bilingual' END AS tags,
           CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)) END AS gold_text, o_orderkey % 17 = 0 AS should_refuse,
           CASE WHEN o_orderkey % 40 = 1 THEN '1000000' END AS canary, (o_orderkey + r.shift) % 12 AS m
    FROM orders JOIN (SELECT 'a' AS run_id, 0 AS shift UNION ALL SELECT 'b' AS run_id, 5 AS shift) r ON r.shift >= 0) x) y
"""

BUSINESS = """
SELECT CAST(n_nationkey AS BIGINT) AS business_id, DATE '1995-01-01' AS period_start, DATE '2001-06-30' AS as_of,
       CAST(50000 + 1000 * n_nationkey AS DECIMAL(18,2)) AS opening_balance FROM nation
"""

#: Exchange rates as the books state them.
FX_RATES = """
SELECT 'USD' AS currency, CAST(1.00 AS DECIMAL(12,6)) AS rate UNION ALL SELECT 'EUR', CAST(1.09 AS DECIMAL(12,6)) UNION ALL SELECT 'KZT', CAST(0.0021 AS DECIMAL(12,6))
"""

BUDGET = """
SELECT 'Payroll' AS category, CAST(250000.00 AS DECIMAL(18,2)) AS monthly_budget UNION ALL SELECT 'Rent', CAST(90000.50 AS DECIMAL(18,2))
"""

INVOICES = """
SELECT CAST(c_nationkey AS BIGINT) AS business_id, 'INV' || CAST(o_orderkey AS VARCHAR(20)) AS invoice_id, c_custkey AS customer_id, c_name AS customer_name,
       CAST(o_orderdate AS DATE) AS issue_date, CAST(o_orderdate AS DATE) + 30 AS due_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
       CAST({half_even}(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.08 AS DECIMAL(6,4)), 2) AS DECIMAL(18,2)) AS tax,
       CASE o_orderkey % 10 WHEN 1 THEN 'EUR' WHEN 2 THEN 'KZT' ELSE 'USD' END AS currency, o_orderstatus = 'F' AS paid
FROM orders JOIN customer ON o_custkey = c_custkey
"""

PAYABLES = """
SELECT CAST(s_nationkey AS BIGINT) AS business_id, 'AP' || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) AS payment_id,
       CAST(l_shipdate AS DATE) + 45 AS due_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
       CASE l_orderkey % 10 WHEN 3 THEN 'EUR' ELSE 'USD' END AS currency, l_linestatus <> 'O' AS paid
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
"""

TRANSACTIONS = """
SELECT CAST(c_nationkey AS BIGINT) AS business_id, 'T' || CAST(o_orderkey AS VARCHAR(20)) AS txn_id, CAST(o_orderdate AS DATE) AS txn_date,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CASE o_orderkey % 10 WHEN 1 THEN 'EUR' WHEN 2 THEN 'KZT' ELSE 'USD' END AS currency,
       'Product sales' AS category, c_name AS counterparty
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O'
UNION ALL
SELECT CAST(s_nationkey AS BIGINT), 'L' || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)), CAST(l_shipdate AS DATE),
       -CAST(l_extendedprice AS DECIMAL(18,2)), 'USD',
       CASE l_returnflag WHEN 'R' THEN 'Cost of goods sold' WHEN 'A' THEN 'Payroll' ELSE 'Rent' END,
       CASE WHEN l_linenumber = 3 THEN 'Internal' ELSE s_name END
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
"""

#: Turns of conversations with an outcome and, on even turns, a dependence on the turn before.
TURNS = """
SELECT conv_id, turn, length(coalesce(text, '')) % 3 <> 0 AS passed, CASE WHEN turn > 0 AND turn % 2 = 0 THEN turn - 1 END AS source_turn FROM conversations
"""

#: The lines of a supplier as one long conversation: programs state prices near those of other lines, and quantities.
PROGRAMS = """
SELECT l_suppkey AS conv_id, l_orderkey * 10 + l_linenumber AS turn,
       'subtract(' || CAST(CAST(l_extendedprice * CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 1.00009 ELSE 1.0002 END AS DECIMAL(18,2)) AS VARCHAR(30)) || ', const_100), divide(#0, -' || CAST(CAST(l_quantity AS DECIMAL(18,1)) AS VARCHAR(30)) || ')' AS program,
       CASE l_linenumber % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '-' || CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR(30)) ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30)) END AS answer
FROM lineitem WHERE l_suppkey IS NOT NULL
"""

SQL = {"programs": PROGRAMS, "predicted": PREDICTED, "business": BUSINESS, "fx_rates": FX_RATES, "budget": BUDGET, "invoices": INVOICES, "payables": PAYABLES, "transactions": TRANSACTIONS, "turns": TURNS}


def relation(spark: SparkSession, sf_dir: str, name: str, task_rows: int | None = None) -> DataFrame:
    """A derived relation, or a table, of a data folder.

    :param task_rows: about so many rows of each table go to a task, where given.
    """
    if name in TABLES:
        return table(spark, sf_dir, name) if task_rows is None else dealt(table(spark, sf_dir, name), task_rows)
    text = SQL[name].replace("{half_even}", "bround")
    used = {t: relation(spark, sf_dir, t, task_rows) for t in TABLES if f" {t} " in text or f" {t}\n" in text}
    for t in used:  # tables become parameters of the statement, so no view is left behind
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ").replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
    return spark.sql(_literal_braces(text, used), **used)


def _literal_braces(text: str, used: dict[str, DataFrame]) -> str:
    """Double the braces that are not parameters."""
    out = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        out = out.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return out


def oracle(body: str, *names: str) -> str:
    """The SQL of an oracle over derived relations."""
    ctes = ", ".join(f"{n} AS ({SQL[n].replace('{half_even}', 'round_even')})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
