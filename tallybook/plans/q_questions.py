"""Registered business questions, lookups and display helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions import display as D
from tallybook.operators import pnl
from tallybook.operators import questions as Q
from tallybook.plans.catalog import register
from tallybook.plans.oracle import margin, money, with_ledgers
from tallybook.plans.q_pnl import _EXACT_CHILDREN, LEDGER_NAMES
from tallybook.sources import fixtures as fx
from tallybook.sources.tables import table

AS_OF = "1998-01-15"


def _totals(spark, sf_dir):
    return pnl.project_totals(fx.projects(spark, sf_dir), fx.labor_costs(spark, sf_dir),
                              fx.material_costs(spark, sf_dir),
                              fx.payment_milestones(spark, sf_dir))


def _over_x(select: str) -> str:
    """Oracle over ``x`` = projects with exact totals and ``profit``."""
    extra = _EXACT_CHILDREN.strip().lstrip(",").strip() + \
        ",\ny AS (SELECT *, contract_value - (labor_total + material_total) AS profit FROM x)"
    return with_ledgers(select, *LEDGER_NAMES, extra=extra)


@register("unpaid_labor", with_ledgers(f"""SELECT user_id,
  {money('COALESCE(SUM(total_amount - paid_amount), 0)')} AS unpaid_labor
FROM labor_costs GROUP BY user_id""", "labor_costs"))
def unpaid_labor(spark, sf_dir):
    """Unpaid labour per user."""
    return Q.unpaid_labor(fx.labor_costs(spark, sf_dir))


@register("pending_milestones", with_ledgers(f"""SELECT p.user_id, ms.project_id, p.name AS project,
  ms.milestone_name, {money('ms.amount')} AS amount, CAST(ms.due_date AS VARCHAR) AS due_date
FROM payment_milestones ms JOIN projects p ON ms.project_id = p.id
WHERE ms.status = 'pending'""", "projects", "payment_milestones"))
def pending_milestones(spark, sf_dir):
    """Milestones not received, per user, by due date."""
    return Q.pending_milestones(fx.payment_milestones(spark, sf_dir), fx.projects(spark, sf_dir))


@register("material_month", with_ledgers(f"""SELECT user_id,
  {money('SUM(total_amount)')} AS material_month, COUNT(*) AS n_items
FROM material_costs
WHERE date_trunc('month', purchase_date) = date_trunc('month', DATE '{AS_OF}')
GROUP BY user_id""", "material_costs"))
def material_month(spark, sf_dir):
    """Material bought in the month of 1998-01-15, per user."""
    return Q.material_month(fx.material_costs(spark, sf_dir), AS_OF)


@register("material_total", with_ledgers(f"""SELECT user_id,
  {money('COALESCE(SUM(total_amount), 0)')} AS material_total
FROM material_costs GROUP BY user_id""", "material_costs"))
def material_total(spark, sf_dir):
    """Material over all projects, per user."""
    return Q.material_total(fx.material_costs(spark, sf_dir))


@register("profit_total", _over_x(f"""SELECT user_id, {money('SUM(profit)')} AS profit_total
FROM y GROUP BY user_id"""))
def profit_total(spark, sf_dir):
    """A10: estimated profit over all projects, per user."""
    return Q.profit_total(_totals(spark, sf_dir))


@register("top_project", _over_x(f"""SELECT user_id, id AS project_id, name AS project,
  {money('profit')} AS estimated_profit
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY profit DESC NULLS LAST, id) AS rn
      FROM y) t
WHERE rn = 1"""))
def top_project(spark, sf_dir):
    """Most profitable project per user (ties: lowest id)."""
    return Q.top_project(_totals(spark, sf_dir))


@register("business_overview", _over_x(f"""SELECT user_id, COUNT(*) AS n_projects,
  COUNT(CASE WHEN status = 'active' THEN 1 END) AS n_active,
  COUNT(CASE WHEN status = 'completed' THEN 1 END) AS n_completed,
  COUNT(CASE WHEN status = 'pending' THEN 1 END) AS n_pending,
  {money('SUM(contract_value)')} AS contract_total, {money('SUM(labor_total)')} AS labor_total,
  {money('SUM(material_total)')} AS material_total,
  {money('SUM(labor_total + material_total)')} AS total_cost,
  {money('SUM(profit)')} AS profit_total,
  {margin('SUM(profit)', 'SUM(contract_value)')} AS margin_pct,
  {money('SUM(received)')} AS received_total, {money('SUM(pending_receive)')} AS pending_total,
  {money('SUM(unpaid_labor)')} AS unpaid_total
FROM y GROUP BY user_id"""))
def business_overview(spark, sf_dir):
    """Whole-business summary per user."""
    return Q.business_overview(_totals(spark, sf_dir))


@register("monthly_cost", with_ledgers(f"""SELECT user_id,
  CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month, kind,
  {money('SUM(amt)')} AS amount, COUNT(*) AS n_rows
FROM (SELECT user_id, 'labor' AS kind, work_date AS d, total_amount AS amt FROM labor_costs
      UNION ALL SELECT user_id, 'material', purchase_date, total_amount FROM material_costs
      UNION ALL SELECT user_id, 'received', received_date, amount FROM payment_milestones
                WHERE status = 'received') u
GROUP BY ALL""", "labor_costs", "material_costs", "payment_milestones"))
def monthly_cost(spark, sf_dir):
    """Monthly labour, material and received amounts per user."""
    return Q.monthly_cost(fx.labor_costs(spark, sf_dir), fx.material_costs(spark, sf_dir),
                          fx.payment_milestones(spark, sf_dir))


@register("ledger_count", with_ledgers("""SELECT project_id, table_name, COUNT(*) AS n_rows
FROM (SELECT project_id, 'labor_costs' AS table_name FROM labor_costs
      UNION ALL SELECT project_id, 'material_costs' FROM material_costs
      UNION ALL SELECT project_id, 'payment_milestones' FROM payment_milestones) u
GROUP BY ALL""", "labor_costs", "material_costs", "payment_milestones"))
def ledger_count(spark, sf_dir):
    """Rows per project in each ledger."""
    return Q.ledger_count(fx.labor_costs(spark, sf_dir), fx.material_costs(spark, sf_dir),
                          fx.payment_milestones(spark, sf_dir), table(spark, sf_dir, "lineitem").count())


@register("user_projects", with_ledgers("SELECT user_id, id, name FROM projects", "projects"))
def user_projects(spark, sf_dir):
    """Each user's project ids and names."""
    return Q.user_projects(fx.projects(spark, sf_dir))


@register("status_label", _over_x(f"""SELECT id, user_id,
  CASE WHEN COALESCE(profit, 0) >= 0 THEN '{D.PROFIT_LABEL}' ELSE '{D.LOSS_LABEL}' END AS profit_label,
  {money('ABS(profit)')} AS abs_profit,
  CASE status WHEN 'active' THEN '{D.STATUS_ACTIVE}' WHEN 'completed' THEN '{D.STATUS_COMPLETED}'
              ELSE '{D.STATUS_OTHER}' END AS status_label
FROM y"""))
def status_label(spark, sf_dir):
    """profit/loss label, absolute profit and status label per project."""
    t = _totals(spark, sf_dir)
    return t.select("id", "user_id", D.profit_label("profit").alias("profit_label"),
                    pnl.money(F.abs("profit")).alias("abs_profit"),
                    D.status_label("status").alias("status_label"))


@register("money_text", _over_x(f"""SELECT id,
  format('{{:,.0f}}', CAST(contract_value AS DOUBLE)) || '{D.BAHT}' AS contract_text,
  format('{{:,.0f}}', CAST(profit AS DOUBLE)) || '{D.BAHT}' AS profit_text
FROM y"""))
def money_text(spark, sf_dir):
    """Contract value and profit as baht text per project."""
    t = _totals(spark, sf_dir)
    return t.select("id", D.money_text(F.col("contract_value").cast("double")).alias("contract_text"),
                    D.money_text(F.col("profit").cast("double")).alias("profit_text"))
