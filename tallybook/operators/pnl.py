"""Project profit and loss: project list (J1/J2), summary (A1/A2), conditional sums (A3).

Plan (exact mode): the three child ledgers are narrowed to the measures
needed, unioned, and aggregated by ``project_id`` in a single shuffle with
map-side partial sums, so a project holding a third of all rows is still
combined per task before the exchange.  The result has one row per project
and is left-joined to ``projects``; adaptive execution picks a broadcast or
sort-merge join from the measured sizes.

``reference`` mode reproduces the fan-out of joining the three one-to-many
children before summing (each labour row counted
max(1, materials) x max(1, milestones) times, and so on).  It is computed
from the same per-project sums and row counts, never by materialising the
row pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("exact", "reference")


def money(c) -> Column:
    """Output form of money: rounded as decimal, then double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 2).cast("double")


def _tenant(df: DataFrame, user_id=None, project_col=None, project_id=None) -> DataFrame:
    if user_id is not None:
        df = df.filter(F.col("user_id") == F.lit(str(user_id)))
    if project_id is not None:
        df = df.filter(F.col(project_col) == F.lit(str(project_id)))
    return df


def cond_sum(cond: Column, value: Column) -> Column:
    """A3: ``COALESCE(SUM(CASE WHEN cond THEN value ELSE 0 END), 0)``."""
    return F.coalesce(F.sum(F.when(cond, value).otherwise(F.lit(0))), F.lit(0))


def child_totals(labor: DataFrame, material: DataFrame, milestones: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Per-project sums and row counts of the three children, one shuffle.

    With ``projects``, all four ledgers are bucketed by project: each child is aggregated where it lies and the sums are joined there,
    while a union would lose their partitioning."""
    status = F.col("status")
    amount = F.col("amount")
    lab = labor.select("project_id",
                       F.col("total_amount").alias("labor_amt"),
                       (F.col("total_amount") - F.col("paid_amount")).alias("unpaid_amt"),
                       F.lit(1).alias("n_l"))
    mat = material.select("project_id", F.col("total_amount").alias("material_amt"),
                          F.lit(1).alias("n_m"))
    mil = milestones.select("project_id",
                            F.when(status == "received", amount).otherwise(F.lit(0)).alias("recv_amt"),
                            F.when(status == "pending", amount).otherwise(F.lit(0)).alias("pend_amt"),
                            F.lit(1).alias("n_ms"))
    if projects is not None:
        some = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        ls = lab.groupBy("project_id").agg(F.sum("labor_amt").alias("labor_sum"), F.sum("unpaid_amt").alias("unpaid_sum"), F.count("n_l").alias("n_l"))
        ms = mat.groupBy("project_id").agg(F.sum("material_amt").alias("material_sum"), F.count("n_m").alias("n_m"))
        rs = mil.groupBy("project_id").agg(F.sum("recv_amt").alias("recv_sum"), F.sum("pend_amt").alias("pend_sum"), F.count("n_ms").alias("n_ms"))
        # a row per project from every child, so that each child joins from the left and buckets stay known
        every = projects.select(F.col("id").alias("project_id"))
        both = every.join(ls, "project_id", "left").join(ms, "project_id", "left").join(rs, "project_id", "left")
        return both.select("project_id", "labor_sum", "unpaid_sum", "material_sum", "recv_sum", "pend_sum", some("n_l"), some("n_m"), some("n_ms"))
    u = lab.unionByName(mat, allowMissingColumns=True).unionByName(mil, allowMissingColumns=True)
    return u.groupBy("project_id").agg(
        F.sum("labor_amt").alias("labor_sum"),
        F.sum("unpaid_amt").alias("unpaid_sum"),
        F.sum("material_amt").alias("material_sum"),
        F.sum("recv_amt").alias("recv_sum"),
        F.sum("pend_amt").alias("pend_sum"),
        F.coalesce(F.sum("n_l"), F.lit(0)).cast("long").alias("n_l"),
        F.coalesce(F.sum("n_m"), F.lit(0)).cast("long").alias("n_m"),
        F.coalesce(F.sum("n_ms"), F.lit(0)).cast("long").alias("n_ms"),
    )


def _with_totals(projects: DataFrame, totals: DataFrame, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    j = projects.join(totals, projects.id == totals.project_id, "left").drop("project_id")
    if mode == "exact":
        f_l = f_m = f_ms = F.lit(1)
    else:
        one = F.lit(1)
        # times each child row is repeated by the joins with the other two children
        f_l = F.greatest(one, F.coalesce("n_m", F.lit(0))) * F.greatest(one, F.coalesce("n_ms", F.lit(0)))
        f_m = F.greatest(one, F.coalesce("n_l", F.lit(0))) * F.greatest(one, F.coalesce("n_ms", F.lit(0)))
        f_ms = F.greatest(one, F.coalesce("n_l", F.lit(0))) * F.greatest(one, F.coalesce("n_m", F.lit(0)))
    zero = F.lit(0)

    def scaled(c, f):
        return F.coalesce(F.col(c) * f.cast("decimal(20,0)"), zero)

    return j.select(
        "*",
        scaled("labor_sum", f_l).alias("labor_total"),
        scaled("material_sum", f_m).alias("material_total"),
        scaled("recv_sum", f_ms).alias("received"),
        scaled("pend_sum", f_ms).alias("pending_receive"),
        scaled("unpaid_sum", f_l).alias("unpaid_labor"),
    )


def project_totals(projects: DataFrame, labor: DataFrame, material: DataFrame,
                   milestones: DataFrame, user_id=None, mode: str = "exact") -> DataFrame:
    """Projects with decimal ``labor_total, material_total, received,
    pending_receive, unpaid_labor, total_cost, profit`` (inputs of the rollups)."""
    p = _tenant(projects, user_id)
    t = child_totals(_tenant(labor, user_id), _tenant(material, user_id),
                     _tenant(milestones, user_id))
    j = _with_totals(p, t, mode)
    total_cost = F.col("labor_total") + F.col("material_total")
    return j.withColumn("total_cost", total_cost) \
            .withColumn("profit", F.col("contract_value") - F.col("total_cost"))


def project_list(projects: DataFrame, labor: DataFrame, material: DataFrame,
                 milestones: DataFrame, user_id=None, mode: str = "exact", colocated: bool = False) -> DataFrame:
    """J2 (exact) / J1 (reference): every project of a user (or of all users)
    with labour, material, received and estimated profit; ``colocated``: all four ledgers are bucketed by project."""
    p = _tenant(projects, user_id)
    t = child_totals(_tenant(labor, user_id), _tenant(material, user_id),
                     _tenant(milestones, user_id), p if colocated else None)
    j = _with_totals(p, t, mode)
    return j.select(
        "id", "user_id", "name", "client_name",
        money("contract_value").alias("contract_value"), "status",
        money("labor_total").alias("labor_total"),
        money("material_total").alias("material_total"),
        money("received").alias("received"),
        money(F.col("contract_value") - F.col("labor_total") - F.col("material_total"))
        .alias("estimated_profit"),
    )


def margin_pct(profit: Column, contract: Column) -> Column:
    """round(profit / contract * 100, 1); 0 when the contract is 0 or missing."""
    c = contract.cast("double")
    raw = profit.cast("double") / c * 100
    r = F.round(raw, 1)
    # a small loss rounds to -0.0 in the reference (binary float rounding keeps the sign)
    r = F.when((r == 0) & (raw < 0), F.lit(-0.0)).otherwise(r)
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(r)


def margin_text(margin: Column, contract: Column) -> Column:
    """Display form: "0%" when there is no contract value, else e.g. "12.3%"."""
    return F.when(F.coalesce(contract.cast("double"), F.lit(0.0)) == 0, F.lit("0%")) \
            .otherwise(F.concat(margin.cast("string"), F.lit("%")))


def project_summary(projects: DataFrame, labor: DataFrame, material: DataFrame,
                    milestones: DataFrame, user_id=None, project_id=None,
                    mode: str = "exact", colocated: bool = False) -> DataFrame:
    """A1 (exact) / A2 (reference): contract, costs, profit, margin, received,
    pending and unpaid labour per project; one project when ``project_id`` and
    ``user_id`` are given (no row when it is not theirs); ``colocated``: all four ledgers are bucketed by project."""
    p = _tenant(projects, user_id, "id", project_id)
    t = child_totals(_tenant(labor, user_id, "project_id", project_id),
                     _tenant(material, user_id, "project_id", project_id),
                     _tenant(milestones, user_id, "project_id", project_id), p if colocated else None)
    j = _with_totals(p, t, mode)
    total_cost = F.col("labor_total") + F.col("material_total")
    profit = F.col("contract_value") - total_cost
    margin = margin_pct(profit, F.col("contract_value"))
    return j.select(
        F.col("id").alias("project_id"), "user_id",
        F.col("name").alias("project"), F.col("client_name").alias("client"),
        money("contract_value").alias("contract_value"),
        money("labor_total").alias("labor_total"),
        money("material_total").alias("material_total"),
        money(total_cost).alias("total_cost"),
        money(profit).alias("estimated_profit"),
        margin.alias("margin_pct"),
        margin_text(margin, F.col("contract_value")).alias("profit_margin"),
        money("received").alias("received"),
        money("pending_receive").alias("pending_receive"),
        money("unpaid_labor").alias("unpaid_labor"),
    )
