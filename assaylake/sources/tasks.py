"""The task families of the ledger: questions about the books with their answers, for all businesses at once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators import ledger as L

Answer = Callable[[L.Books], DataFrame]


def _number(df: DataFrame, column: str = "value") -> DataFrame:
    return df.select(L.KEY, F.col(column).cast("decimal(24,2)").alias("value_num"), F.lit(None).cast("string").alias("value_text"))


def _either(df: DataFrame) -> DataFrame:
    return df.select(L.KEY, F.when(F.col("value_text").isNull(), F.col("value")).cast("decimal(24,2)").alias("value_num"), "value_text")


def _words(df: DataFrame) -> DataFrame:
    return df.select(L.KEY, F.lit(None).cast("decimal(24,2)").alias("value_num"), "value_text")


def _count(books: L.Books, rows: DataFrame) -> DataFrame:
    counted = rows.groupBy(L.KEY).agg(F.count("*").alias("value"))
    return _number(books.business.select(L.KEY).join(counted, L.KEY, "left").fillna(0, ["value"]))


def _variance(books: L.Books) -> DataFrame:
    """The first budgeted category in order of name."""
    first = L.budget_variance(books).groupBy(L.KEY).agg(F.min_by("value", "category").alias("value"))
    return _number(books.business.select(L.KEY).join(first, L.KEY, "left"))


#: Family, unit, tags, question in English and in Russian, and the operator that answers it.
FAMILIES: tuple[tuple[str, str, tuple[str, ...], str, str, Answer], ...] = (
    ("current_cash_balance", "currency", ("calculation",), "What is the cash balance today?", "Каков остаток денежных средств на сегодня?", lambda b: _number(L.cash_balance(b))),
    ("monthly_burn", "currency", ("calculation",), "What is the mean net cash movement of the last three complete months?", "Каково среднее чистое движение денег за последние три полных месяца?", lambda b: _number(L.monthly_burn(b))),
    ("cash_runway", "months", ("calculation", "formula"), "For how many months does the cash last at the recent burn?", "На сколько месяцев хватит денег при текущем расходе?", lambda b: _either(L.cash_runway(b))),
    ("cash_gap_date", "date", ("calculation", "formula"), "In which month does the cash run out?", "В каком месяце закончатся деньги?", lambda b: _words(L.cash_gap_month(b))),
    ("accounts_receivable", "currency", ("calculation", "table_text"), "How much do customers owe, tax included?", "Сколько должны клиенты с учётом налога?", lambda b: _number(L.receivables(b), "gross")),
    ("overdue_receivables", "currency", ("calculation", "table_text"), "How much of that is overdue?", "Какая сумма просрочена?", lambda b: _number(L.overdue_receivables(b))),
    ("receivable_prioritization", "text", ("analysis", "table_text"), "Which three invoices should be chased first?", "Какие три счёта взыскать в первую очередь?", lambda b: _words(L.receivable_priority(b))),
    ("accounts_payable_pressure", "currency", ("calculation", "table_text"), "How much is due to suppliers within 30 days?", "Сколько нужно заплатить поставщикам за 30 дней?", lambda b: _number(L.payable_pressure(b))),
    ("gross_margin", "percent", ("ratio", "calculation"), "What is the gross margin?", "Какова валовая маржа?", lambda b: _number(L.margins(b), "gross_margin")),
    ("operating_margin", "percent", ("ratio", "calculation"), "What is the operating margin?", "Какова операционная маржа?", lambda b: _number(L.margins(b), "operating_margin")),
    ("revenue_growth", "percent", ("calculation",), "How did revenue change between the last two complete months?", "Как изменилась выручка за два последних полных месяца?", lambda b: _number(L.growth(b, "inflow"))),
    ("expense_growth", "percent", ("calculation",), "How did expenses change between the last two complete months?", "Как изменились расходы за два последних полных месяца?", lambda b: _number(L.growth(b, "outflow"))),
    ("budget_variance", "currency", ("calculation",), "How far is spending from the budget?", "Насколько расходы отличаются от бюджета?", _variance),
    ("customer_concentration", "percent", ("ratio",), "What share of revenue is the largest customer's?", "Какова доля крупнейшего клиента?", lambda b: _number(L.customer_concentration(b))),
    ("supplier_concentration", "percent", ("ratio",), "What share of spending is the largest supplier's?", "Какова доля крупнейшего поставщика?", lambda b: _number(L.supplier_concentration(b))),
    ("scenario_collect_25", "currency", ("calculation",), "What is the cash once 25 % of receivables are collected?", "Сколько будет денег после взыскания 25 %?", lambda b: _number(L.scenario_collect(b, 25))),
    ("scenario_collect_50", "currency", ("calculation",), "What is the cash once 50 % of receivables are collected?", "Сколько будет денег после взыскания 50 %?", lambda b: _number(L.scenario_collect(b, 50))),
    ("scenario_collect_75", "currency", ("calculation",), "What is the cash once 75 % of receivables are collected?", "Сколько будет денег после взыскания 75 %?", lambda b: _number(L.scenario_collect(b, 75))),
    ("scenario_revenue_drop", "months", ("calculation", "formula"), "How long is the runway if revenue falls by 20 %?", "На сколько хватит денег при падении выручки на 20 %?", lambda b: _either(L.scenario_runway(b, revenue_drop=20))),
    ("scenario_lose_customer", "currency", ("calculation",), "How much revenue goes with the largest customer?", "Сколько выручки уйдёт с крупнейшим клиентом?", lambda b: _number(L.customer_concentration(b), "amount")),
    ("scenario_cut_expenses", "months", ("calculation", "formula"), "How long is the runway if expenses are cut by 15 %?", "На сколько хватит денег при сокращении расходов на 15 %?", lambda b: _either(L.scenario_runway(b, expense_cut=15))),
    ("duplicate_transactions", "count", ("analysis", "table_text"), "How many transactions look like double entries?", "Сколько операций похожи на дубли?", lambda b: _count(b, L.duplicate_transactions(b))),
    ("missing_periods", "count", ("analysis", "table_text"), "For how many months is payroll missing?", "За сколько месяцев нет зарплаты?", lambda b: _count(b, L.missing_periods(b))),
    ("tax_inclusive_vs_exclusive", "currency", ("calculation", "table_text"), "How much tax is in the receivables?", "Сколько налога в дебиторской задолженности?", lambda b: _number(L.receivables(b), "tax")),
)


def samples(books: L.Books, split: str, bilingual: bool = False, families: tuple[str, ...] | None = None) -> DataFrame:
    """A sample for each business and family (and language); where the books have no answer, a refusal is right."""
    parts = None
    for family, unit, tags, english, russian, answer in FAMILIES:
        if families is not None and family not in families:
            continue
        languages = [("en", english, tags), ("ru", russian, (*tags, "bilingual"))] if bilingual else [("en", english, tags)]
        asked = F.array(*(F.struct(F.lit(code).alias("language"), F.lit(q).alias("question"), F.array(*(F.lit(t) for t in ts)).alias("capability_tags")) for code, q, ts in languages))
        rows = answer(books).withColumn("asked", F.explode(asked)).select(L.KEY, F.lit(family).alias("task_family"), F.lit(unit).alias("unit"), "asked.*", "value_num", "value_text")
        parts = rows if parts is None else parts.unionByName(rows)
    none = F.col("value_num").isNull() & F.col("value_text").isNull()
    answer_text = F.when(none, "INSUFFICIENT_INFORMATION").otherwise(F.coalesce(F.col("value_num").cast("string"), "value_text"))
    return parts.select(
        F.lit("smb_cfo").alias("benchmark"), F.lit(split).alias("split"), F.concat_ws(":", F.lit("smb_cfo"), F.lit(split), F.col(L.KEY).cast("string"), "task_family", "language").alias("sample_id"), "*",
        answer_text.alias("gold_answer"), F.when(none, "refusal").when(F.col("value_num").isNotNull(), "numeric").otherwise("text").alias("answer_type"), none.alias("should_refuse"),
    )


# The first seed and the size of each split, whether it asks in two languages, and which businesses have a trap.
SPLITS = {"public": (1_000_000, 300, False, 0), "adversarial": (2_000_000, 150, False, 1), "bilingual": (3_000_000, 100, True, 0), "smoke": (4_000_000, 12, False, 0), "private": (None, 200, True, 3)}


def load(spark: SparkSession, split: str, secret: str | None = None) -> DataFrame:
    """The samples of a split, with ``place``: business after business, each with the next family or, where it is due, a trap.

    The seeds of the private split come from a secret; without it the split cannot be made.
    """
    from assaylake.operators.samples import head
    from assaylake.sources import traps
    from assaylake.sources.books import books

    if split not in SPLITS:
        raise ValueError(f"smb_cfo has no split {split!r}: one of {sorted(SPLITS)}")
    base, size, bilingual, every = SPLITS[split]
    if base is None:
        if not secret:
            raise ValueError("the private split needs a secret")
        base = int(hashlib.sha256(secret.encode()).hexdigest()[:8], 16)
    index = F.col("id") + 1
    due = (index % every == 0) if every else F.lit(False)
    names = F.array(*(F.lit(f[0]) for f in FAMILIES))
    seeds = spark.range(size).select((F.col("id") + base).alias("seed"), index.alias("source_place"), due.alias("due"), F.get(names, (index % len(FAMILIES)).cast("int")).alias("family"))
    chosen = seeds.select(F.col("seed").alias("of"), "source_place", "due", "family")
    made = books(seeds.select("seed"))
    asked = samples(made, split, bilingual).join(chosen, (F.col(L.KEY) == F.col("of")) & (F.col("family") == F.col("task_family")) & ~F.col("due")).withColumn("payload", F.lit(None).cast("string"))
    tricky = traps.cases(made, split).join(chosen, (F.col(L.KEY) == F.col("of")) & F.col("due"))
    rows = tricky if every == 1 else asked if not every else asked.unionByName(tricky.select(asked.columns))
    return head(rows.drop("of", "due", "family"), size, "source_place", "language")
