"""Usage metering against plan quotas.

Reference rule (B12): plan ``pro`` is unlimited; a limit that is NULL or 0
is unlimited; otherwise a call is refused when the usage count has reached
the limit.  The check comes before the increment, so refused calls are not
counted.  In arrival order the n-th call of a user is therefore allowed
exactly when ``usage0 + n - 1 < limit``, which turns the reference's
one-call-at-a-time loop into a rank per user (skew-safe, see
:func:`tallybook.operators.common.ordered_rank`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.display import usage_pct
from tallybook.operators.common import ordered_rank

# Defaults of a user first seen at login, and the refusal text.
NEW_USER = {"plan": "starter", "plan_limit": 100, "usage_count": 0}
UNLIMITED_PLAN = "pro"
QUOTA_MSG_HEAD = "ใช้ครบโควต้าแล้ว ("
QUOTA_MSG_TAIL = " คำถาม) กรุณาอัปเกรดแพ็กเกจ"


def user_ensure(users: DataFrame, callers: DataFrame) -> DataFrame:
    """Insert-or-ignore: callers missing from ``users`` are added as starter/100/0."""
    new = (callers.select(F.col("user_id").alias("id")).distinct()
                  .join(users.select("id"), "id", "left_anti")
                  .select("id", F.lit(NEW_USER["plan"]).alias("plan"),
                          F.lit(NEW_USER["plan_limit"]).cast("int").alias("plan_limit"),
                          F.lit(NEW_USER["usage_count"]).cast("int").alias("usage_count")))
    return users.select("id", "plan", F.col("plan_limit").cast("int"), F.col("usage_count").cast("int")) \
                .unionByName(new)


def user_plan(calls: DataFrame, users: DataFrame) -> DataFrame:
    """Each call with its user's plan, limit and usage; unknown users get the defaults."""
    u = users.select(F.col("id").alias("user_id"), "plan", "plan_limit", "usage_count",
                     F.lit(True).alias("_known"))
    j = calls.join(u, "user_id", "left")
    known = F.coalesce("_known", F.lit(False))
    return j.select(*calls.columns,
                    F.when(known, F.col("plan")).otherwise(F.lit(NEW_USER["plan"])).alias("plan"),
                    F.when(known, F.col("plan_limit")).otherwise(F.lit(NEW_USER["plan_limit"]))
                     .cast("int").alias("plan_limit"),
                    F.when(known, F.coalesce("usage_count", F.lit(0))).otherwise(F.lit(0))
                     .cast("int").alias("usage0"))


def decide(planned: DataFrame) -> DataFrame:
    """``allowed`` and the refusal ``message`` of calls with ``rn``, plan, limit and stored usage."""
    lim = F.col("plan_limit")
    unlimited = (F.col("plan") == UNLIMITED_PLAN) | lim.isNull() | (lim == 0)
    allowed = unlimited | (F.col("usage0") + F.col("rn") - 1 < lim)
    used = F.greatest(F.col("usage0"), lim)
    msg = F.when(~allowed, F.concat(F.lit(QUOTA_MSG_HEAD), used.cast("string"), F.lit("/"),
                                    lim.cast("string"), F.lit(QUOTA_MSG_TAIL)))
    return planned.withColumn("allowed", allowed).withColumn("message", msg)


def quota_gate(calls: DataFrame, users: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """allow/refuse every call ``(event_id, ts, user_id)`` in arrival order."""
    ranked = ordered_rank(calls, ["user_id"], list(order))
    return decide(user_plan(ranked, users))


def quota_reset(calls: DataFrame, users: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """As W2 with usage reset on day 1 of each month (usage counts per month
    from 0; the stored usage applies to no month)."""
    c = calls.withColumn("month", F.trunc(F.col("ts").cast("date"), "MM"))
    ranked = ordered_rank(c, ["user_id", "month"], list(order))
    return decide(user_plan(ranked, users).withColumn("usage0", F.lit(0)))


def usage_increment(users: DataFrame, calls: DataFrame) -> DataFrame:
    """A4: usage after a batch of calls: stored usage + allowed calls.

    Of a user's n calls the gate allows what is left of the limit, so counts
    suffice: one aggregate, no ranking.
    """
    n = calls.groupBy(F.col("user_id").alias("_user")).agg(F.count(F.lit(1)).alias("_n"))
    used, lim = F.coalesce("usage_count", F.lit(0)), F.col("plan_limit")
    unlimited = F.coalesce(F.col("plan") == UNLIMITED_PLAN, F.lit(False)) | lim.isNull() | (lim == 0)
    n_calls = F.coalesce("_n", F.lit(0))
    allowed = F.when(unlimited, n_calls).otherwise(F.least(n_calls, F.greatest(lim - used, F.lit(0))))
    return users.join(n, F.col("id") == F.col("_user"), "left").select(
        "id", "plan", "plan_limit", (used + allowed).cast("int").alias("usage_count"))


def usage_report(users: DataFrame) -> DataFrame:
    """Usage bar percent per user (the UI divides by 300)."""
    return users.select("id", "usage_count", usage_pct(F.col("usage_count")).alias("usage_pct"))
