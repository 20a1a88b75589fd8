"""Ratios of statement measures; a zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

c = F.col


def by_period():
    return W.partitionBy("act_symbol", "period").orderBy("date")


def roic() -> Column:
    return F.try_divide(c("pretax_income") - c("income_taxes") - c("non_operating_income"), c("total_assets") - c("total_liabilities"))


def operating_margin() -> Column:
    return F.try_divide(c("pretax_income") - c("non_operating_income"), c("sales"))


def free_cash() -> Column:
    return c("net_cash_from_operating_activities") - c("property_and_equipment")


def fcf_margin() -> Column:
    return F.try_divide(free_cash(), c("sales"))


def market_value() -> Column:
    return c("shares_outstanding") * c("book_value_per_share")


def fcf_yield() -> Column:
    return F.try_divide(free_cash(), market_value())


def enterprise_value() -> Column:
    return market_value() + c("long_term_debt") + c("notes_payable") + c("preferred_stock") + c("minority_interest") - c("cash_and_equivalents")


def ebitda() -> Column:
    return c("income_before_depreciation_and_amortization")


def ev_ebitda() -> Column:
    return F.try_divide(enterprise_value(), ebitda())


def _growth(x: Column) -> Column:
    q = F.try_divide(x, F.lag(x).over(by_period()))
    return F.when(c("period") == "Quarter", q * q * q * q).otherwise(q)


def revenue_growth() -> Column:
    """Growth to a year's scale, without taking 1 off."""
    return _growth(c("sales"))


def eps_growth() -> Column:
    return _growth(c("diluted_net_eps")) - 1


VARIABLES = {
    "ROIC": roic, "operating_margin": operating_margin, "FCF_margin": fcf_margin, "FCF_yield": fcf_yield,
    "EV/EBITDA": ev_ebitda, "revenue_CAGR": revenue_growth, "EPS_CAGR": eps_growth,
}
