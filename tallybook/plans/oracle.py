"""DuckDB twins of the registered queries (the correctness oracle).

Each entry is plain SQL over the given tables; the ledger stand-ins are the
CTEs below, written from the same mapping as :mod:`tallybook.sources.fixtures`.
The SQL is written independently of the Spark plans (per-child aggregates,
literal fan-out joins, window functions) so the two engines check each other.
"""

from __future__ import annotations

CTE = {
    "projects": """projects AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS id, CAST(o.o_custkey AS VARCHAR) AS user_id,
         'Project#' || CAST(o.o_orderkey AS VARCHAR) AS name,
         c.c_name AS client_name, n.n_name AS location,
         CAST(o.o_totalprice AS DECIMAL(15,2)) AS contract_value,
         CAST(o.o_orderdate AS DATE) AS start_date,
         CAST(o.o_orderdate AS DATE) + 90 AS end_date,
         CASE o.o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed'
                              WHEN 'P' THEN 'pending' END AS status
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)""",
    "li": """li AS (
  SELECT l.*, CAST(l.l_orderkey AS VARCHAR) AS project_id,
         CAST(o.o_custkey AS VARCHAR) AS user_id,
         CASE l.l_orderkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'excel_import'
                               ELSE 'line' END AS source
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "labor_costs": """labor_costs AS (
  SELECT project_id, user_id,
         'Worker#' || CAST(l_suppkey AS VARCHAR) AS worker_name,
         l_returnflag AS worker_type,
         CAST(l_quantity AS DECIMAL(6,1)) AS work_days,
         CAST(p.p_retailprice AS DECIMAL(10,2)) AS daily_rate,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount,
         CASE WHEN l_discount <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2))
              * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) END AS paid_amount,
         CAST(l_shipdate AS DATE) AS work_date, CAST(NULL AS VARCHAR) AS note, source
  FROM li LEFT JOIN part p ON li.l_partkey = p.p_partkey
  WHERE l_linenumber IN (1, 4, 7))""",
    "material_costs": """material_costs AS (
  SELECT project_id, user_id, p.p_name AS item_name,
         CAST(l_quantity AS DECIMAL(10,2)) AS quantity, p.p_type AS unit,
         CAST(p.p_retailprice AS DECIMAL(10,2)) AS unit_price,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount,
         s.s_name AS supplier, CAST(l_shipdate AS DATE) AS purchase_date,
         CAST(NULL AS VARCHAR) AS note, source
  FROM li LEFT JOIN part p ON li.l_partkey = p.p_partkey
          LEFT JOIN supplier s ON li.l_suppkey = s.s_suppkey
  WHERE l_linenumber IN (2, 5))""",
    "payment_milestones": """payment_milestones AS (
  SELECT project_id, user_id, 'M' || CAST(l_linenumber AS VARCHAR) AS milestone_name,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
         CAST(l_shipdate AS DATE) AS due_date,
         CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS received_date,
         CASE l_linestatus WHEN 'F' THEN 'received' WHEN 'O' THEN 'pending' END AS status,
         CAST(NULL AS VARCHAR) AS note, source
  FROM li WHERE l_linenumber IN (3, 6))""",
    "users": """users AS (
  SELECT CAST(user_id AS VARCHAR) AS id,
         CASE WHEN user_id % 4 = 0 THEN 'pro' ELSE 'starter' END AS plan,
         CAST(CASE user_id % 4 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE 60 END AS INTEGER) AS plan_limit,
         0 AS usage_count
  FROM (SELECT DISTINCT user_id FROM events) e)""",
    "calls": """calls AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id FROM events)""",
}
_NEEDS = {"labor_costs": ["li"], "material_costs": ["li"], "payment_milestones": ["li"]}
_ORDER = ["projects", "li", "labor_costs", "material_costs", "payment_milestones", "users", "calls"]


def with_ledgers(body: str, *names: str, extra: str = "") -> str:
    """Prefix ``body`` with the ledger CTEs it names (plus ``extra`` CTEs)."""
    need = set(names)
    for n in names:
        need.update(_NEEDS.get(n, []))
    parts = [CTE[n] for n in _ORDER if n in need]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body


def money(expr: str) -> str:
    return f"CAST(ROUND({expr}, 2) AS DOUBLE)"


def margin(profit: str, contract: str) -> str:
    return (f"CASE WHEN COALESCE(CAST({contract} AS DOUBLE), 0) = 0 THEN 0.0 "
            f"ELSE ROUND(CAST({profit} AS DOUBLE) / CAST({contract} AS DOUBLE) * 100, 1) END")


ORACLE: dict[str, str] = {}
