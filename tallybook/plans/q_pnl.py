"""Registered profit-and-loss queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import pnl
from tallybook.plans.catalog import register
from tallybook.plans.oracle import margin, money, with_ledgers
from tallybook.sources import fixtures as fx

LEDGER_NAMES = ("projects", "labor_costs", "material_costs", "payment_milestones")


def _args(spark, sf_dir):
    return (fx.projects(spark, sf_dir), fx.labor_costs(spark, sf_dir),
            fx.material_costs(spark, sf_dir), fx.payment_milestones(spark, sf_dir))


# -- exact oracle: one aggregate per child, then left joins -------------------
_EXACT_CHILDREN = """,
lt AS (SELECT project_id, SUM(total_amount) AS s, SUM(total_amount - paid_amount) AS u
       FROM labor_costs GROUP BY project_id),
mt AS (SELECT project_id, SUM(total_amount) AS s FROM material_costs GROUP BY project_id),
st AS (SELECT project_id,
              SUM(CASE WHEN status = 'received' THEN amount ELSE 0 END) AS r,
              SUM(CASE WHEN status = 'pending' THEN amount ELSE 0 END) AS p
       FROM payment_milestones GROUP BY project_id),
x AS (SELECT p.*, COALESCE(lt.s, 0) AS labor_total, COALESCE(mt.s, 0) AS material_total,
             COALESCE(st.r, 0) AS received, COALESCE(st.p, 0) AS pending_receive,
             COALESCE(lt.u, 0) AS unpaid_labor
      FROM projects p LEFT JOIN lt ON lt.project_id = p.id
                      LEFT JOIN mt ON mt.project_id = p.id
                      LEFT JOIN st ON st.project_id = p.id)
"""

# -- reference oracle: the literal fan-out join ---------------------------------
_FANOUT = """,
x AS (SELECT p.id, p.user_id, p.name, p.client_name, p.contract_value, p.status,
             COALESCE(SUM(l.total_amount), 0) AS labor_total,
             COALESCE(SUM(m.total_amount), 0) AS material_total,
             COALESCE(SUM(CASE WHEN ms.status = 'received' THEN ms.amount ELSE 0 END), 0) AS received,
             COALESCE(SUM(CASE WHEN ms.status = 'pending' THEN ms.amount ELSE 0 END), 0) AS pending_receive,
             COALESCE(SUM(l.total_amount - l.paid_amount), 0) AS unpaid_labor
      FROM projects p
      LEFT JOIN labor_costs l ON l.project_id = p.id
      LEFT JOIN material_costs m ON m.project_id = p.id
      LEFT JOIN payment_milestones ms ON ms.project_id = p.id
      GROUP BY p.id, p.user_id, p.name, p.client_name, p.contract_value, p.status)
"""


def _list_sql(children: str) -> str:
    body = f"""{children}SELECT id, user_id, name, client_name, {money('contract_value')} AS contract_value,
       status, {money('labor_total')} AS labor_total, {money('material_total')} AS material_total,
       {money('received')} AS received,
       {money('contract_value - labor_total - material_total')} AS estimated_profit
FROM x"""
    return _prefix(body)


def _prefix(body: str) -> str:
    # body is ",\n<extra ctes>\nSELECT ..."
    ctes, select = body.split("\nSELECT", 1)
    return with_ledgers("SELECT" + select, *LEDGER_NAMES, extra=ctes.lstrip(",\n"))


def _summary_sql(children: str) -> str:
    profit = "(contract_value - (labor_total + material_total))"
    m = margin(profit, "contract_value")
    body = f"""{children}SELECT id AS project_id, user_id, name AS project, client_name AS client,
       {money('contract_value')} AS contract_value,
       {money('labor_total')} AS labor_total, {money('material_total')} AS material_total,
       {money('labor_total + material_total')} AS total_cost,
       {money(profit)} AS estimated_profit,
       {m} AS margin_pct,
       CASE WHEN COALESCE(CAST(contract_value AS DOUBLE), 0) = 0 THEN '0%'
            ELSE CAST({m} AS VARCHAR) || '%' END AS profit_margin,
       {money('received')} AS received, {money('pending_receive')} AS pending_receive,
       {money('unpaid_labor')} AS unpaid_labor
FROM x"""
    return _prefix(body)


@register("project_summary", _summary_sql(_EXACT_CHILDREN))
def project_summary(spark, sf_dir):
    """A1: exact summary of every project (children aggregated before the join)."""
    return pnl.project_summary(*_args(spark, sf_dir))


@register("project_summary_reference", _summary_sql(_FANOUT))
def project_summary_reference(spark, sf_dir):
    """A2: the same with the reference's join fan-out, computed from counts."""
    return pnl.project_summary(*_args(spark, sf_dir), mode="reference")


@register("project_list", _list_sql(_EXACT_CHILDREN))
def project_list(spark, sf_dir):
    """Every user's projects with exact totals."""
    return pnl.project_list(*_args(spark, sf_dir))


@register("project_list_reference", _list_sql(_FANOUT))
def project_list_reference(spark, sf_dir):
    """The project list with the reference's fan-out totals."""
    return pnl.project_list(*_args(spark, sf_dir), mode="reference")


@register("cond_sum", with_ledgers("""SELECT project_id,
       CAST(COALESCE(SUM(CASE WHEN status = 'received' THEN amount ELSE 0 END), 0) AS DOUBLE) AS received,
       CAST(COALESCE(SUM(CASE WHEN status = 'pending' THEN amount ELSE 0 END), 0) AS DOUBLE) AS pending_receive
FROM payment_milestones GROUP BY project_id""", "payment_milestones"))
def cond_sum(spark, sf_dir):
    """A3: conditional sums of milestone amounts by status, per project."""
    ms = fx.payment_milestones(spark, sf_dir)
    return ms.groupBy("project_id").agg(
        pnl.cond_sum(F.col("status") == "received", F.col("amount")).cast("double").alias("received"),
        pnl.cond_sum(F.col("status") == "pending", F.col("amount")).cast("double").alias("pending_receive"))
