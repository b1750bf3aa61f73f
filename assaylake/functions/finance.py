"""Financial formulas, vectors and money as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


#: Each formula with its inputs in order; a division by zero gives null.
FORMULAS = {
    "gross_margin": (("revenue", "cogs"), lambda r, c: _ratio(r - c, r) * 100),
    "net_margin": (("net_income", "revenue"), lambda n, r: _ratio(n, r) * 100),
    "current_ratio": (("current_assets", "current_liabilities"), _ratio),
    "quick_ratio": (("current_assets", "inventory", "current_liabilities"), lambda a, i, c: _ratio(a - i, c)),
    "interest_coverage": (("ebit", "interest_expense"), _ratio),
    "debt_to_equity": (("total_debt", "total_equity"), _ratio),
    "roe": (("net_income", "total_equity"), lambda n, e: _ratio(n, e) * 100),
    "roa": (("net_income", "total_assets"), lambda n, a: _ratio(n, a) * 100),
    "percent_change": (("new", "old"), lambda n, o: _ratio(n - o, o) * 100),
    "cagr": (("end", "start", "years"), lambda e, s, y: (F.pow(_ratio(e, s), _ratio(F.lit(1.0), y)) - 1) * 100),
    "runway_months": (("cash", "monthly_burn"), _ratio),
    "working_capital": (("current_assets", "current_liabilities"), lambda a, c: a - c),
}


def formula(name: str, **values: Column) -> Column:
    """A named formula of columns."""
    inputs, body = FORMULAS[name]
    missing = [i for i in inputs if i not in values]
    if missing:
        raise ValueError(f"{name} needs {missing}")
    return body(*(values[i] for i in inputs))


def to_basis_points(percent: Column) -> Column:
    return percent * 100


def to_percent(basis_points: Column) -> Column:
    return basis_points / 100


def half_even(x: Column, digits: int = 2) -> Column:
    """Rounded half to even; decimals stay decimals."""
    return F.bround(x, digits)


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def token_cost(prompt: Column, completion: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Cost of a call in dollars from prices for a million tokens, to 8 digits; null if a price or a count is missing."""
    return F.round((prompt * prompt_price + completion * completion_price) / 1e6, 8)
