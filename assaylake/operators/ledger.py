"""Ledger analytics of small businesses, for all businesses at once.

Amounts are converted to the base currency and rounded half to even row by row before they are summed; rows after the
date of the books do not count. Every answer is one row for each business; where the books cannot answer, the
value is null and ``unanswerable`` is true.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.finance import half_even, month

KEY = "business_id"
INTERNAL, COGS = "Internal", "Cost of goods sold"
LAST_MONTHS = 3


@dataclass(frozen=True)
class Books:
    """The relations of the books; ``fx_rates`` hold for all businesses, and so does a ``budget`` without ``business_id``."""

    business: DataFrame
    transactions: DataFrame
    invoices: DataFrame
    payables: DataFrame
    fx_rates: DataFrame
    budget: DataFrame


def in_base(books: Books, rows: DataFrame, *amounts: str) -> DataFrame:
    """The rows with each amount in the base currency; a currency without a rate in the books raises."""
    rates = books.fx_rates.withColumnRenamed("currency", "rate_currency")
    joined = rows.join(rates, F.col("currency") == F.col("rate_currency"), "left").drop("rate_currency")
    rate = F.coalesce("rate", F.raise_error(F.concat(F.lit("no rate for "), F.col("currency"))).cast("decimal(12,6)"))
    return joined.withColumns({a: half_even(F.col(a) * rate).cast("decimal(18,2)") for a in amounts}).drop("rate")


def entries(books: Books) -> DataFrame:
    """Transactions up to the date of the books, in the base currency, with ``month``."""
    dated = books.transactions.join(books.business.select(KEY, "as_of"), KEY).where("txn_date <= as_of")
    return in_base(books, dated, "amount").withColumn("month", month(F.col("txn_date")))


def open_invoices(books: Books) -> DataFrame:
    """Unpaid invoices issued by the date of the books, with ``net`` and ``gross`` in the base currency."""
    rows = books.invoices.join(books.business.select(KEY, "as_of"), KEY).where("not paid and issue_date <= as_of")
    return in_base(books, rows.withColumn("net", F.col("amount")).withColumn("gross", (F.col("amount") + F.col("tax")).cast("decimal(18,2)")), "net", "gross")


def _every(books: Books, answers: DataFrame) -> DataFrame:
    """An answer for each business, also for one without rows."""
    return books.business.select(KEY).join(answers, KEY, "left")


def _sum(rows: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return rows.groupBy(KEY).agg(F.sum(value).cast("decimal(24,2)").alias(name))


def _zero(books: Books, answers: DataFrame, name: str = "value") -> DataFrame:
    return _every(books, answers).withColumn(name, F.coalesce(name, F.lit(0).cast("decimal(24,2)")))


def cash_balance(books: Books) -> DataFrame:
    """Opening balance and all entries."""
    moved = _sum(entries(books), F.col("amount"), "moved")
    return books.business.join(moved, KEY, "left").select(KEY, (F.col("opening_balance") + F.coalesce("moved", F.lit(0))).cast("decimal(24,2)").alias("value"))


def recent_months(flows: DataFrame, last: int = LAST_MONTHS) -> DataFrame:
    """The last complete months of each business: the newest month is not complete unless it is the only one."""
    newest = Window.partitionBy(KEY).orderBy(F.desc("month"))
    ranked = flows.withColumn("r", F.row_number().over(newest)).withColumn("n", F.count("*").over(Window.partitionBy(KEY)))
    return ranked.where(((F.col("r") > 1) & (F.col("r") <= last + 1)) | (F.col("n") == 1)).drop("r", "n")


def monthly_flows(books: Books) -> DataFrame:
    """Inflow, outflow and net of each month; an amount of zero is an outflow."""
    positive = F.col("amount") > 0
    return entries(books).groupBy(KEY, "month").agg(
        F.sum(F.when(positive, F.col("amount"))).alias("inflow"), F.sum(F.when(~positive, F.abs("amount"))).alias("outflow"), F.sum("amount").alias("net")
    )


def monthly_burn(books: Books) -> DataFrame:
    """Mean net movement of the last complete months; negative where cash is burnt."""
    mean = recent_months(monthly_flows(books)).groupBy(KEY).agg((F.sum("net").cast("decimal(24,2)") / F.count("*").cast("decimal(10,0)")).alias("mean"))
    return _every(books, mean).select(KEY, half_even(F.col("mean")).cast("decimal(24,2)").alias("value"))


def _runway(cash: Column, net: Column) -> tuple[Column, Column]:
    """Months of cash and the words for them; nothing left is 0, a business that gains cash has no end."""
    months = F.when(cash <= 0, F.lit(0).cast("decimal(24,1)")).when(net < 0, half_even(cash.cast("decimal(24,2)") / F.abs(net).cast("decimal(24,8)"), 1).cast("decimal(24,1)"))
    return months, F.when((cash > 0) & (net >= 0), "infinite")


def cash_runway(books: Books) -> DataFrame:
    """Months until the cash is gone at the recent burn."""
    both = cash_balance(books).withColumnRenamed("value", "cash").join(monthly_burn(books).withColumnRenamed("value", "net"), KEY)
    months, words = _runway(F.col("cash"), F.col("net"))
    return both.select(KEY, F.when(F.col("net").isNotNull(), months).alias("value"), F.when(F.col("net").isNotNull(), words).alias("value_text"), F.col("net").isNull().alias("unanswerable"))


def cash_gap_month(books: Books) -> DataFrame:
    """The month in which the cash runs out at the recent burn."""
    runway = cash_runway(books).join(books.business.select(KEY, "as_of"), KEY)
    ahead = F.add_months(F.trunc("as_of", "month"), F.floor("value").cast("int") + 1)
    words = F.when(F.col("unanswerable"), None).when(F.col("value_text") == "infinite", "never").when(F.col("value") <= 0, "already negative").otherwise(month(ahead))
    return runway.select(KEY, words.alias("value_text"))


def receivables(books: Books) -> DataFrame:
    """What customers owe, with tax and without, and the tax in it."""
    sums = open_invoices(books).groupBy(KEY).agg(F.sum("gross").cast("decimal(24,2)").alias("gross"), F.sum("net").cast("decimal(24,2)").alias("net"), F.count("*").alias("n_open"))
    zero = F.lit(0).cast("decimal(24,2)")
    return _every(books, sums).select(KEY, F.coalesce("gross", zero).alias("gross"), F.coalesce("net", zero).alias("net"), (F.coalesce("gross", zero) - F.coalesce("net", zero)).cast("decimal(24,2)").alias("tax"), F.coalesce("n_open", F.lit(0)).alias("n_open"))


def overdue_receivables(books: Books) -> DataFrame:
    """Open invoices that were due before the date of the books."""
    late = open_invoices(books).where("due_date < as_of").groupBy(KEY).agg(F.sum("gross").cast("decimal(24,2)").alias("value"), F.count("*").alias("n_overdue"))
    return _zero(books, late).withColumn("n_overdue", F.coalesce("n_overdue", F.lit(0)))


def receivable_priority(books: Books, top: int = 3) -> DataFrame:
    """The overdue invoices to chase first, by amount times days overdue, as a list of ids."""
    late = open_invoices(books).where("due_date < as_of").withColumn("weight", F.col("gross") * F.datediff("as_of", "due_date"))
    order = Window.partitionBy(KEY).orderBy(F.desc("weight"), "invoice_id")
    first = late.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    lists = first.groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "invoice_id"))), lambda x: x["invoice_id"]), ", ").alias("value_text"))
    return _every(books, lists)


def payable_pressure(books: Books, days: int = 30) -> DataFrame:
    """What is owed to suppliers and due within some days, past dues included."""
    rows = books.payables.join(books.business.select(KEY, "as_of"), KEY).where(~F.col("paid") & (F.col("due_date") <= F.date_add("as_of", days)))
    return _zero(books, _sum(in_base(books, rows, "amount"), F.col("amount")))


def margins(books: Books) -> DataFrame:
    """Revenue, cost of goods, other cost, and the gross and operating margin in percent; null without revenue."""
    a, positive = F.col("amount"), F.col("amount") > 0
    zero = F.lit(0).cast("decimal(24,2)")
    sums = entries(books).groupBy(KEY).agg(
        F.coalesce(F.sum(F.when(positive, a)).cast("decimal(24,2)"), zero).alias("revenue"),
        F.coalesce(F.sum(F.when(~positive & (F.col("category") == COGS), -a)).cast("decimal(24,2)"), zero).alias("cogs"),
        F.coalesce(F.sum(F.when(~positive & (F.col("category") != COGS), -a)).cast("decimal(24,2)"), zero).alias("opex"),
    )

    def percent(part: Column) -> Column:
        return F.bround(F.try_divide(part, F.col("revenue")).cast("decimal(38,12)") * 100, 1).cast("decimal(18,1)")

    both = sums.withColumn("gross_margin", percent(F.col("revenue") - F.col("cogs"))).withColumn("operating_margin", percent(F.col("revenue") - F.col("cogs") - F.col("opex")))
    return _every(books, both)


def growth(books: Books, flow: str) -> DataFrame:
    """Change of a flow from the third newest month with it to the second newest, in percent; three months are needed."""
    by_month = monthly_flows(books).where(F.col(flow).isNotNull()).select(KEY, "month", F.col(flow).alias("v"))
    ranked = by_month.withColumn("r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("month")))).where("r in (2, 3)")
    pair = ranked.groupBy(KEY).agg(F.max(F.when(F.col("r") == 2, F.col("v"))).alias("latest"), F.max(F.when(F.col("r") == 3, F.col("v"))).alias("previous"))
    change = F.bround(F.try_divide((F.col("latest") - F.col("previous")).cast("decimal(24,2)"), F.col("previous").cast("decimal(24,2)")).cast("decimal(38,12)") * 100, 1)
    return _every(books, pair.select(KEY, change.cast("decimal(18,1)").alias("value")))


def budget_variance(books: Books) -> DataFrame:
    """Mean monthly spend of each budgeted category less its budget, over its months but the newest."""
    spend = entries(books).where("amount < 0").groupBy(KEY, "category", "month").agg(F.sum(-F.col("amount")).alias("spent"))
    by = Window.partitionBy(KEY, "category")
    ranked = spend.withColumn("r", F.row_number().over(by.orderBy(F.desc("month")))).withColumn("n", F.count("*").over(by)).where("r > 1 or n = 1")
    mean = ranked.groupBy(KEY, "category").agg((F.sum("spent").cast("decimal(24,2)") / F.count("*").cast("decimal(10,0)")).alias("mean"))
    return mean.join(books.budget, [k for k in (KEY, "category") if k in books.budget.columns]).select(KEY, "category", half_even(F.col("mean") - F.col("monthly_budget")).cast("decimal(24,2)").alias("value"))


def _concentration(books: Books, totals: DataFrame) -> DataFrame:
    """The largest name's share of a total; of equal totals the larger name."""
    top = totals.groupBy(KEY).agg(F.max(F.struct("total", "name")).alias("top"), F.sum("total").cast("decimal(24,2)").alias("grand"))
    share = F.bround(F.try_divide(F.col("top.total"), F.col("grand")).cast("decimal(38,12)") * 100, 1).cast("decimal(18,1)")
    return _every(books, top.select(KEY, F.col("top.name").alias("name"), F.col("top.total").alias("amount"), share.alias("value")))


def customer_totals(books: Books) -> DataFrame:
    rows = books.invoices.join(books.business.select(KEY, "as_of"), KEY).where("issue_date <= as_of and customer_name is not null")
    return in_base(books, rows, "amount").groupBy(KEY, F.col("customer_name").alias("name")).agg(F.sum("amount").cast("decimal(24,2)").alias("total"))


def customer_concentration(books: Books) -> DataFrame:
    """The largest customer's share of net invoices; losing it would cost ``amount``."""
    return _concentration(books, customer_totals(books))


def supplier_concentration(books: Books) -> DataFrame:
    """The largest counterparty's share of outflows, internal ones aside."""
    rows = entries(books).where((F.col("amount") < 0) & (F.col("counterparty") != INTERNAL))
    return _concentration(books, rows.groupBy(KEY, F.col("counterparty").alias("name")).agg(F.sum(-F.col("amount")).cast("decimal(24,2)").alias("total")))


def scenario_collect(books: Books, percent: int) -> DataFrame:
    """Cash once a share of the receivables is collected."""
    both = cash_balance(books).join(receivables(books), KEY)
    return both.select(KEY, half_even(F.col("value") + F.col("gross") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(4,0)")).cast("decimal(24,2)").alias("value"))


def scenario_runway(books: Books, revenue_drop: int = 0, expense_cut: int = 0) -> DataFrame:
    """The runway if revenue fell, or expenses were cut, by some percent; means over the last complete months, in which a
    missing flow is 0."""
    zero = F.lit(0).cast("decimal(24,2)")
    newest = Window.partitionBy(KEY).orderBy(F.desc("month"))
    recent = monthly_flows(books).withColumn("r", F.row_number().over(newest)).where((F.col("r") > 1) & (F.col("r") <= LAST_MONTHS + 1))
    n = F.count("*").cast("decimal(10,0)")
    inflow, outflow = (F.sum(F.coalesce(c, zero)).cast("decimal(24,2)") for c in ("inflow", "outflow"))
    net = (inflow * F.lit(100 - revenue_drop).cast("decimal(4,0)") - outflow * F.lit(100 - expense_cut).cast("decimal(4,0)")) / (n * F.lit(100).cast("decimal(4,0)"))
    both = cash_balance(books).withColumnRenamed("value", "cash").join(recent.groupBy(KEY).agg(net.cast("decimal(24,8)").alias("net")), KEY, "left")
    months, words = _runway(F.col("cash"), F.col("net"))
    return both.select(KEY, F.when(F.col("net").isNotNull(), months).alias("value"), F.when(F.col("net").isNotNull(), words).alias("value_text"))


def duplicate_transactions(books: Books, *same: str) -> DataFrame:
    """All but the first of the transactions that agree in date, amount and counterparty (or in other columns)."""
    order = Window.partitionBy(KEY, *(same or ("txn_date", "amount", "counterparty"))).orderBy("txn_date", "txn_id")
    return books.transactions.withColumn("copy", F.row_number().over(order)).where("copy > 1").select(KEY, "txn_id")


def missing_periods(books: Books, category: str = "Payroll") -> DataFrame:
    """Months from the start to the date of the books, the newest aside, in which a category has no transaction."""
    months = books.business.select(KEY, F.explode(F.expr("sequence(trunc(period_start, 'month'), trunc(as_of, 'month'), interval 1 month)")).alias("m"), "as_of")
    expected = months.where(F.col("m") < F.trunc("as_of", "month")).select(KEY, month(F.col("m")).alias("month"))
    seen = books.transactions.where(F.col("category") == category).select(KEY, month(F.col("txn_date")).alias("month")).distinct()
    return expected.join(seen, [KEY, "month"], "left_anti")


def last_complete_revenue(books: Books) -> DataFrame:
    """The revenue of the second newest month that has any."""
    earning = monthly_flows(books).where("inflow is not null")
    ranked = earning.withColumn("r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("month")))).where("r = 2")
    return _every(books, ranked.select(KEY, "month", F.col("inflow").cast("decimal(24,2)").alias("value")))
