"""Registered metering queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import quota as Q
from tallybook.plans.catalog import register
from tallybook.plans.oracle import with_ledgers
from tallybook.sources import fixtures as fx

_PLANNED = """planned AS (
  SELECT c.event_id, c.ts, c.user_id, c.rn,
         CASE WHEN u.id IS NULL THEN 'starter' ELSE u.plan END AS plan,
         CASE WHEN u.id IS NULL THEN 100 ELSE u.plan_limit END AS plan_limit,
         CASE WHEN u.id IS NULL THEN 0 ELSE COALESCE(u.usage_count, 0) END AS usage0
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id{part} ORDER BY ts, event_id) AS rn
        FROM calls) c
  LEFT JOIN users u ON u.id = c.user_id)"""

_GATED = """gated AS (
  SELECT *, (plan = 'pro' OR plan_limit IS NULL OR plan_limit = 0
             OR usage0 + rn - 1 < plan_limit) AS allowed
  FROM planned)"""

_GATE_SELECT = """SELECT event_id, user_id, rn, allowed,
  CASE WHEN NOT allowed THEN 'ใช้ครบโควต้าแล้ว (' || CAST(greatest(usage0, plan_limit) AS VARCHAR)
       || '/' || CAST(plan_limit AS VARCHAR) || ' คำถาม) กรุณาอัปเกรดแพ็กเกจ' END AS message
FROM gated"""


def _gate_sql(monthly: bool) -> str:
    planned = _PLANNED.format(part=", date_trunc('month', ts)" if monthly else "")
    if monthly:
        planned = planned.replace("CASE WHEN u.id IS NULL THEN 0 ELSE COALESCE(u.usage_count, 0) END",
                                  "0")
    return with_ledgers(_GATE_SELECT, "users", "calls", extra=planned + ",\n" + _GATED)


def _calls_users(spark, sf_dir):
    return fx.calls(spark, sf_dir), fx.users(spark, sf_dir)


@register("quota_gate", _gate_sql(False))
def quota_gate(spark, sf_dir):
    """Allow or refuse each metered call in arrival order."""
    c, u = _calls_users(spark, sf_dir)
    return Q.quota_gate(c, u).select("event_id", "user_id", "rn", "allowed", "message")


@register("quota_reset", _gate_sql(True))
def quota_reset(spark, sf_dir):
    """The same gate with usage reset every month."""
    c, u = _calls_users(spark, sf_dir)
    return Q.quota_reset(c, u).select("event_id", "user_id", "rn", "allowed", "message")


_INCREMENT = with_ledgers("""SELECT u.id, u.plan, u.plan_limit,
  CAST(COALESCE(u.usage_count, 0) + COALESCE(n.n, 0) AS INTEGER) AS usage_count
FROM users u LEFT JOIN (SELECT user_id, COUNT(CASE WHEN allowed THEN 1 END) AS n FROM gated
                        GROUP BY user_id) n ON n.user_id = u.id""", "users", "calls",
                          extra=_PLANNED.format(part="") + ",\n" + _GATED)


@register("usage_increment", _INCREMENT)
def usage_increment(spark, sf_dir):
    """A4: stored usage plus the allowed calls of the batch."""
    c, u = _calls_users(spark, sf_dir)
    return Q.usage_increment(u, c)


@register("usage_pct", _INCREMENT.replace(
    "SELECT u.id, u.plan, u.plan_limit,\n  CAST(COALESCE(u.usage_count, 0) + COALESCE(n.n, 0) AS INTEGER) AS usage_count",
    "SELECT u.id, CAST(COALESCE(u.usage_count, 0) + COALESCE(n.n, 0) AS INTEGER) AS usage_count,\n"
    "  least(CAST(COALESCE(u.usage_count, 0) + COALESCE(n.n, 0) AS DOUBLE) / 300.0 * 100, 100.0) AS usage_pct"))
def usage_pct(spark, sf_dir):
    """Usage bar percent after the batch."""
    c, u = _calls_users(spark, sf_dir)
    return Q.usage_report(Q.usage_increment(u, c))


@register("user_ensure", with_ledgers("""SELECT id, plan, plan_limit, CAST(usage_count AS INTEGER) AS usage_count
FROM users
UNION ALL
SELECT DISTINCT c.user_id, 'starter', 100, 0 FROM calls c WHERE c.user_id NOT IN (SELECT id FROM users)""",
                                      "users", "calls"))
def user_ensure(spark, sf_dir):
    """Users table after insert-or-ignore of every caller."""
    c, u = _calls_users(spark, sf_dir)
    return Q.user_ensure(u, c)


@register("user_plan", with_ledgers("""SELECT c.event_id, c.user_id,
  CASE WHEN u.id IS NULL THEN 'starter' ELSE u.plan END AS plan,
  CASE WHEN u.id IS NULL THEN 100 ELSE u.plan_limit END AS plan_limit,
  CASE WHEN u.id IS NULL THEN 0 ELSE COALESCE(u.usage_count, 0) END AS usage0
FROM calls c LEFT JOIN users u ON u.id = c.user_id""", "users", "calls"))
def user_plan(spark, sf_dir):
    """Plan, limit and usage looked up for every call (defaults when unknown)."""
    c, u = _calls_users(spark, sf_dir)
    return Q.user_plan(c, u).select("event_id", "user_id", "plan", "plan_limit", "usage0")
