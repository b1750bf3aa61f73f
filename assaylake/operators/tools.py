"""Metrics of stored tool traces, and the tools that are queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.numbers import cell_decimal

TOOL_METRICS = (
    "tool_selection_accuracy", "tool_execution_success", "tool_result_utilization", "tool_security_rejection",
    "tool_invocation_rate", "tool_argument_validity", "tool_hallucination_rate", "tool_error_recovery",
)


def _any(calls: Column, test: str) -> Column:
    return F.exists(calls, lambda c: c[test])


def tool_metrics(traces: DataFrame) -> DataFrame:
    """The eight metrics of each trace, one row each; a metric that cannot apply has null for value and pass.

    ``tool_hallucination_rate`` is true for a clean trace, ``tool_security_rejection`` for one without a refusal.
    """
    calls = F.coalesce("calls", F.array().cast(traces.schema["calls"].dataType))
    n = F.size(calls)
    none, some_run = n == 0, _any(calls, "executed")
    real = F.size(F.filter(calls, lambda c: c["tool_exists"]))
    valid = F.size(F.filter(calls, lambda c: c["tool_exists"] & c["arguments_valid"]))
    failed = F.array_min(F.transform(F.filter(calls, lambda c: ~c["executed"]), lambda c: c["turn"]))
    recovered = F.exists(calls, lambda c: c["executed"] & (c["turn"] > failed))
    ratio = F.try_divide(valid.cast("double"), real)
    passes = {
        "tool_selection_accuracy": _any(calls, "tool_exists"), "tool_execution_success": F.when(~none, some_run), "tool_result_utilization": F.when(some_run, F.col("result_used")),
        "tool_security_rejection": ~_any(calls, "security_refused"), "tool_invocation_rate": ~none, "tool_argument_validity": ratio == 1,
        "tool_hallucination_rate": F.when(~none, F.forall(calls, lambda c: c["tool_exists"])), "tool_error_recovery": F.when(failed.isNotNull(), recovered),
    }
    rows = F.array(*(F.struct(F.lit(name).alias("metric_name"), (ratio if name == "tool_argument_validity" else p.cast("double")).alias("value"), p.alias("passed")) for name, p in passes.items()))
    return traces.select("run_id", "sample_id", F.inline(rows))


def result_used(outputs: Column, answer: Column) -> Column:
    """Whether a number of a tool's output is stated in the answer, within 2 % of its size (of 1 at least)."""
    return F.exists(outputs, lambda a: F.exists(answer, lambda b: F.abs(a - b) <= 0.02 * F.greatest(F.abs(a), F.lit(1.0))))


def csv_query(table: DataFrame, where: dict[str, str], aggregate: str, column: str, *by: str) -> DataFrame:
    """Count, sum, mean, min or max of a column over the rows whose cells contain all the wanted texts, whatever the case.
    Cells without a number are skipped, but rows are counted."""
    rows = table
    for name, wanted in where.items():
        rows = rows.where(F.contains(F.lower(F.col(name).cast("string")), F.lit(wanted.strip().lower())))
    number = cell_decimal(F.col(column).cast("string"))
    if aggregate == "count":
        return rows.groupBy(*by).agg(F.count("*").cast("decimal(38,6)").alias("result"))
    kinds = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    if aggregate not in kinds:
        raise ValueError(f"unknown aggregate {aggregate!r}")
    return rows.groupBy(*by).agg(kinds[aggregate](number).alias("result"))


def convert_currency(amounts: DataFrame, rates: DataFrame, amount: str = "amount", source: str = "currency", target: str = "target") -> DataFrame:
    """Amounts at the rates that the books state; without a rate the result is null, unless nothing is to be converted."""
    r = rates.select(F.upper(F.trim("currency")).alias("rate_currency"), "rate")
    joined = amounts.join(r, F.upper(F.trim(F.col(source))) == F.col("rate_currency"), "left")
    same = F.upper(F.trim(F.col(source))) == F.upper(F.trim(F.col(target)))
    return joined.withColumn("converted", F.when(same, F.col(amount)).otherwise(F.col(amount) * F.col("rate"))).drop("rate", "rate_currency")
