"""Named business questions (A6-A13) and ledger lookups.

The reference answers these through model-written SQL; here each is a fixed
plan.  Per-user rollups aggregate with map-side partial sums, so a user that
owns a third of all rows is combined per task before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators.pnl import margin_pct, money, project_totals
from tallybook.session import dealt


def unpaid_labor(labor: DataFrame, by=("user_id",)) -> DataFrame:
    """Labour still unpaid, ``SUM(total_amount - paid_amount)`` per ``by``."""
    return labor.groupBy(*by).agg(
        money(F.coalesce(F.sum(F.col("total_amount") - F.col("paid_amount")), F.lit(0)))
        .alias("unpaid_labor"))


def pending_milestones(milestones: DataFrame, projects: DataFrame) -> DataFrame:
    """Milestones not yet received, with their project and due date, for every user.  The rows have no order:
    one user's few are sorted where they are read (``orderBy("due_date", "project_id", "milestone_name")``)."""
    pend = milestones.filter(F.col("status") == "pending")
    p = projects.select(F.col("id").alias("pid"), F.col("user_id").alias("owner"),
                        F.col("name").alias("project"))
    j = pend.join(p, pend.project_id == p.pid, "inner")
    return (j.select(F.col("owner").alias("user_id"), "project_id", "project", "milestone_name",
                     money("amount").alias("amount"),
                     F.col("due_date").cast("string").alias("due_date")))


def month_bounds(as_of):
    d = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))
    start = d.replace(day=1)
    end = (start.replace(year=start.year + 1, month=1) if start.month == 12
           else start.replace(month=start.month + 1))
    return start, end


def material_month(material: DataFrame, as_of) -> DataFrame:
    """Material bought in the month of ``as_of``, per user.

    The month test is a half-open date range so it can reach the scan."""
    start, end = month_bounds(as_of)
    m = material.filter((F.col("purchase_date") >= F.lit(start)) & (F.col("purchase_date") < F.lit(end)))
    return m.groupBy("user_id").agg(money(F.sum("total_amount")).alias("material_month"),
                                    F.count(F.lit(1)).alias("n_items"))


def material_total(material: DataFrame) -> DataFrame:
    """Material over all projects, per user."""
    return material.groupBy("user_id").agg(
        money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("material_total"))


def profit_total(totals: DataFrame) -> DataFrame:
    """A10: estimated profit over all projects, per user (from :func:`project_totals`)."""
    return totals.groupBy("user_id").agg(money(F.sum("profit")).alias("profit_total"))


def top_project(totals: DataFrame) -> DataFrame:
    """Each user's project with the highest estimated profit (ties: lowest id).

    ``min_by`` over (no profit, -profit, id) is an aggregate with partial
    combining, so it needs no per-user sort of all projects."""
    key = F.struct(F.col("profit").isNull(), -F.col("profit"), F.col("id"))
    best = F.min_by(F.struct("id", "name", "profit"), key)
    return (totals.groupBy("user_id").agg(best.alias("b"))
                  .select("user_id", F.col("b.id").alias("project_id"),
                          F.col("b.name").alias("project"),
                          money("b.profit").alias("estimated_profit")))


def business_overview(totals: DataFrame) -> DataFrame:
    """Whole-business summary per user."""
    s = F.col("status")
    g = totals.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_projects"),
        F.count(F.when(s == "active", 1)).alias("n_active"),
        F.count(F.when(s == "completed", 1)).alias("n_completed"),
        F.count(F.when(s == "pending", 1)).alias("n_pending"),
        F.sum("contract_value").alias("contract"),
        F.sum("labor_total").alias("labor"),
        F.sum("material_total").alias("material"),
        F.sum("total_cost").alias("cost"),
        F.sum("profit").alias("profit"),
        F.sum("received").alias("recv"),
        F.sum("pending_receive").alias("pend"),
        F.sum("unpaid_labor").alias("unpaid"))
    return g.select(
        "user_id", "n_projects", "n_active", "n_completed", "n_pending",
        money("contract").alias("contract_total"), money("labor").alias("labor_total"),
        money("material").alias("material_total"), money("cost").alias("total_cost"),
        money("profit").alias("profit_total"),
        margin_pct(F.col("profit"), F.col("contract")).alias("margin_pct"),
        money("recv").alias("received_total"), money("pend").alias("pending_total"),
        money("unpaid").alias("unpaid_total"))


def monthly_cost(labor: DataFrame, material: DataFrame, milestones: DataFrame) -> DataFrame:
    """Month series of labour and material cost and received income.

    One union of narrow projections and one aggregate (a single shuffle)."""
    lab = labor.select("user_id", F.lit("labor").alias("kind"),
                       F.col("work_date").alias("d"), F.col("total_amount").alias("amt"))
    mat = material.select("user_id", F.lit("material").alias("kind"),
                          F.col("purchase_date").alias("d"), F.col("total_amount").alias("amt"))
    rec = (milestones.filter(F.col("status") == "received")
                     .select("user_id", F.lit("received").alias("kind"),
                             F.col("received_date").alias("d"), F.col("amount").alias("amt")))
    u = lab.unionByName(mat).unionByName(rec)
    return (u.groupBy("user_id", F.trunc("d", "MM").alias("m"), "kind")
             .agg(money(F.sum("amt")).alias("amount"), F.count(F.lit(1)).alias("n_rows"))
             .select("user_id", F.col("m").cast("string").alias("month"), "kind", "amount", "n_rows"))


def ledger_count(labor: DataFrame, material: DataFrame, milestones: DataFrame, rows: int = 0) -> DataFrame:
    """Rows per project in each ledger (``COUNT(*) WHERE project_id = ?`` for all); ``rows``, about how many all have, sets the
    number of tasks."""
    u = (labor.select("project_id", F.lit("labor_costs").alias("table_name"))
         .unionByName(material.select("project_id", F.lit("material_costs").alias("table_name")))
         .unionByName(milestones.select("project_id",
                                        F.lit("payment_milestones").alias("table_name"))))
    return dealt(u, rows, "project_id").groupBy("project_id", "table_name").agg(F.count(F.lit(1)).alias("n_rows"))


def user_projects(projects: DataFrame, user_id=None) -> DataFrame:
    """``SELECT id, name FROM projects WHERE user_id = ?`` (all users when None)."""
    p = projects if user_id is None else projects.filter(F.col("user_id") == F.lit(str(user_id)))
    return p.select("user_id", "id", "name")


__all__ = ["unpaid_labor", "pending_milestones", "material_month", "material_total",
           "profit_total", "top_project", "business_overview", "monthly_cost",
           "ledger_count", "user_projects", "project_totals"]
