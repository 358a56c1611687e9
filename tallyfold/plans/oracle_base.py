"""The same views as ``mapping``, written as SQL common table expressions."""

from __future__ import annotations

from tallyfold import model as M
from tallyfold.plans import mapping as MP


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


SIGN_SQL = f"""case
    when metric_type in ({_quoted(M.NEGATIVE_MAGNITUDE)}) then -abs(raw)
    when metric_type in ({_quoted(M.SIGN_FLIP)}) then -raw
    when metric_type in ({_quoted(M.POSITIVE_MAGNITUDE)}) then abs(raw)
    else raw end + 0.0::double"""

LINES = f"lines as (select {MP.LINE_SQL} from lineitem)"


def cells(names=MP.ALL_MEASURES) -> str:
    sums = ",\n    ".join(f"{MP.sum_sql(n)} as {n}" for n in names)
    return f"cells as (select l_suppkey, yr, qn,\n    {sums}\n  from lines group by l_suppkey, yr, qn)"


def metrics(names=MP.ALL_MEASURES) -> str:
    """CTE list ending in ``metrics``."""
    names = [n for n in names if n in MP.MEASURES]
    q = ", ".join(f"cast({n} as double) / cast(10000 as double) as {n}" for n in names)
    y = ", ".join(f"cast(sum({n}) as double) / cast(10000 as double) as {n}" for n in names)
    on = ", ".join(names)
    return f"""{LINES},
{cells(names)},
wide0 as (
  select 'S' || l_suppkey as ticker, 'quarterly' as period_type,
         last_day(make_date(yr, qn * 3, 1)) as period_end, {q} from cells
  union all
  select 'S' || l_suppkey, 'annual', make_date(yr, 12, 31), {y} from cells group by l_suppkey, yr),
metrics as (
  select ticker, metric_type, {SIGN_SQL} as value, period_type, period_end,
         case when period_type = 'annual' then 'Twelve Months Ended ' else 'Quarter Ended ' end
           || strftime(period_end, '%m/%d/%Y') as period,
         case when period_type = 'annual' then '10-K' else '10-Q' end as source
  from (unpivot wide0 on {on} into name metric_type value raw))"""


def pick(names, alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(f"max(case when {p}metric_type = '{n}' then {p}value end) as {n}" for n in names)


def facts() -> str:
    """CTE list ending in ``facts``."""
    flow = {**MP.FACT_FLOWS, MP.FACT_ALIAS[0]: MP.FACT_ALIAS[1]}
    names = [*flow, *MP.FACT_STOCKS]
    parts = []
    for n, tag in flow.items():
        parts.append(f"select l_suppkey, yr, qn, '{tag}' as concept, ytd_{n} as cell, make_date(yr, 1, 1) as period_start "
                     f"from running where {n} is not null")
        parts.append(f"select l_suppkey, yr, qn, '{tag}', {n}, make_date(yr, qn * 3 - 2, 1) from running "
                     f"where {n} is not null and qn = 3 and interest_expense is not null")
    for n, tag in MP.FACT_STOCKS.items():
        parts.append(f"select l_suppkey, yr, qn, '{tag}', {n}, null from running where {n} is not null")
    union = "\n  union all ".join(parts)
    ytd = ", ".join(
        f"sum({n}) over (partition by l_suppkey, yr order by qn rows unbounded preceding) as ytd_{n}" for n in flow)
    return f"""{LINES},
{cells([*names, "interest_expense"])},
running as (select *, {ytd} from cells),
flat as ({union}),
facts as (
  select 'S' || l_suppkey as ticker, cast(l_suppkey as varchar) as cik, concept,
         cast(cell + case when unit = 'EUR' then cell else later * 10000 end as double) / cast(10000 as double) as numeric_value,
         unit, case when qn = 4 then 'FY' else 'Q' || qn end as fiscal_period,
         cast(yr + later as integer) as fiscal_year, period_start,
         last_day(make_date(yr, qn * 3, 1)) as period_end
  from flat cross join (values (0, 'USD'), (1, 'USD'), (0, 'EUR')) as k(later, unit))"""
