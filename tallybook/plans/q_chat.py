"""Registered chat-log and free-SQL queries over ``conversations`` and the ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions import display as D
from tallybook.operators import chatlog as CL
from tallybook.operators import freesql as FS
from tallybook.operators import pnl
from tallybook.plans.catalog import register
from tallybook.plans.oracle import money, with_ledgers
from tallybook.plans.q_pnl import _EXACT_CHILDREN, LEDGER_NAMES
from tallybook.sources import fixtures as fx
from tallybook.sources.tables import table

# RE2 twin of chatlog.WS
WS_RE2 = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
          r"\x{202f}\x{205f}\x{3000}]")


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


def _conv(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@register("role_map", """SELECT conv_id, turn,
  CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS model_role FROM conversations""")
def role_map(spark, sf_dir):
    """Chat roles mapped to the model's roles."""
    c = _conv(spark, sf_dir)
    return c.select("conv_id", "turn", CL.role_map("role").alias("model_role"))


# Stand-in stored model output: some assistant replies carry an SQL block
# (multi-line) or an empty one before their text.
def _model_output_spark(c):
    tag = F.concat(F.lit("<sql>\n  SELECT COUNT(*) FROM projects\n  WHERE user_id = '"),
                   F.col("conv_id").cast("string"), F.lit("'\n</sql>\n"))
    return (F.when(F.col("turn") % 3 == 1, F.concat(tag, F.col("text"), F.lit("\n<sql>SELECT 2</sql>")))
             .when(F.col("turn") % 3 == 2, F.concat(F.lit("<sql> \n </sql>"), F.col("text")))
             .otherwise(F.col("text")))


_MODEL_OUTPUT_SQL = """CASE WHEN turn % 3 = 1 THEN '<sql>' || chr(10) || '  SELECT COUNT(*) FROM projects'
    || chr(10) || '  WHERE user_id = ''' || CAST(conv_id AS VARCHAR) || '''' || chr(10) || '</sql>' || chr(10)
    || text || chr(10) || '<sql>SELECT 2</sql>'
  WHEN turn % 3 = 2 THEN '<sql> ' || chr(10) || ' </sql>' || text ELSE text END"""


@register("extract_sql", f"""SELECT conv_id, turn,
  CASE WHEN regexp_matches(o, '(?s)<sql>.*?</sql>')
       THEN nullif({_strip_sql("regexp_extract(o, '(?s)<sql>(.*?)</sql>', 1)")}, '') END AS sql_text
FROM (SELECT conv_id, turn, {_MODEL_OUTPUT_SQL} AS o FROM conversations WHERE role = 'assistant') t""")
def extract_sql(spark, sf_dir):
    """X11: first SQL block of each stored assistant reply (none/empty -> NULL)."""
    c = _conv(spark, sf_dir).filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", CL.extract_sql(_model_output_spark(c)).alias("sql_text"))


@register("answer_words", f"""SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, l[i] || ' ' AS chunk
FROM (SELECT conv_id, turn, regexp_split_to_array({_strip_sql('text')}, '{WS_RE2}+') AS l
      FROM conversations WHERE role = 'assistant') t,
     (SELECT unnest(generate_series(1, 100000)) AS i) g
WHERE i <= len(l) AND l[i] <> ''""")
def answer_words(spark, sf_dir):
    """Assistant answers as word chunks, in order."""
    c = _conv(spark, sf_dir).filter(F.col("role") == "assistant")
    return CL.answer_words(c)


@register("answer_markup", """SELECT conv_id, turn,
  CASE WHEN role = 'assistant'
       THEN replace(regexp_replace(text, '\\*\\*(.*?)\\*\\*', '<strong>\\1</strong>', 'g'), chr(10), '<br/>')
       ELSE replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS html
FROM conversations""")
def answer_markup(spark, sf_dir):
    """Answers to display markup, questions HTML-escaped."""
    c = _conv(spark, sf_dir)
    return c.select("conv_id", "turn",
                    F.when(F.col("role") == "assistant", D.answer_markup("text"))
                     .otherwise(D.escape_html("text")).alias("html"))


def _tail_sql(k: int) -> str:
    return f"""SELECT conv_id, turn, role, text FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) t
WHERE rn <= {k}"""


@register("history_tail", _tail_sql(20))
def history_tail(spark, sf_dir):
    """Last 20 messages per conversation."""
    return CL.history_tail(_conv(spark, sf_dir), 20).select("conv_id", "turn", "role", "text")


@register("history_tail_4", _tail_sql(4))
def history_tail_4(spark, sf_dir):
    """W1 with a tail of 4 (fixture conversations have at most 8 turns)."""
    return CL.history_tail(_conv(spark, sf_dir), 4).select("conv_id", "turn", "role", "text")


SYSTEM_HEAD = "ledger assistant; tenant "


@register("message_assembly", f"""WITH t AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rd,
         COUNT(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
k AS (SELECT *, LEAST(n, 21) AS m, LEAST(n, 21) - rd AS idx FROM t WHERE rd <= 21)
SELECT conv_id, CAST(idx AS INTEGER) AS pos,
  CASE WHEN idx = 0 OR rd = 1 THEN 'user' WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS role,
  CASE WHEN idx = 0 THEN '{SYSTEM_HEAD}' || CAST(conv_id AS VARCHAR) || chr(10) || chr(10) || text
       ELSE text END AS content
FROM k""")
def message_assembly(spark, sf_dir):
    """First-round message list per conversation (system text on the first)."""
    c = _conv(spark, sf_dir)
    sys = F.concat(F.lit(SYSTEM_HEAD), F.col("conv_id").cast("string"))
    return CL.message_assembly(c, sys)


_ROUND2 = """WITH t AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rd,
         COUNT(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
k AS (SELECT *, LEAST(n, 21) AS m FROM t WHERE rd <= 21),
h AS (SELECT conv_id, m - rd AS idx, CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS role, text FROM k WHERE rd > {lost}
      UNION ALL SELECT conv_id, {answer_at}, 'model', '<sql>SELECT ' || CAST(conv_id AS VARCHAR) || '</sql>' FROM k WHERE rd = 1
      UNION ALL SELECT conv_id, {answer_at} + 1, 'user', 'ผลลัพธ์จากฐานข้อมูล:' || chr(10)
        || CASE WHEN conv_id % 3 = 0 THEN 'ไม่พบข้อมูล' ELSE '[' || CAST(conv_id AS VARCHAR) || ']' END
        || chr(10) || chr(10) || 'กรุณาสรุปคำตอบเป็นภาษาไทยที่เข้าใจง่าย' FROM k WHERE rd = 1)
SELECT conv_id, CAST(idx AS INTEGER) AS pos, CASE WHEN idx = 0 THEN 'user' ELSE role END AS role,
  CASE WHEN idx = 0 THEN 'ledger assistant; tenant ' || CAST(conv_id AS VARCHAR) || chr(10) || chr(10) || text ELSE text END AS content
FROM h"""


def _second_round(spark, sf_dir, keep_question):
    c = _conv(spark, sf_dir)
    cid = F.col("conv_id").cast("string")
    answers = c.select("conv_id").distinct().select(
        "conv_id", F.concat(F.lit("<sql>SELECT "), cid, F.lit("</sql>")).alias("first_answer"),
        F.when(F.col("conv_id") % 3 == 0, F.lit(CL.NO_DATA)).otherwise(F.concat(F.lit("["), cid, F.lit("]"))).alias("result_text"))
    return CL.second_round(c, F.concat(F.lit(SYSTEM_HEAD), cid), answers, keep_question=keep_question)


@register("second_round", _ROUND2.format(lost=1, answer_at="m - 1"))
def second_round(spark, sf_dir):
    """Second-round message list per conversation, as the reference sends it (the question left out)."""
    return _second_round(spark, sf_dir, False)


@register("second_round_question", _ROUND2.replace("WHERE rd > {lost}", "").format(answer_at="m").replace(
    "CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END", "CASE WHEN role = 'assistant' AND rd > 1 THEN 'model' ELSE 'user' END"))
def second_round_question(spark, sf_dir):
    """Second-round message list with the question kept."""
    return _second_round(spark, sf_dir, True)


@register("result_text", with_ledgers("""SELECT u.id AS key, CASE WHEN u.usage_count % 7 = 0 THEN 'เกิดข้อผิดพลาด: no table'
  ELSE COALESCE('[' || chr(10) || r.j || chr(10) || ']', 'ไม่พบข้อมูล') END AS result_text
FROM users u LEFT JOIN (SELECT user_id, string_agg('  {' || chr(10) || '    "id": "' || id || '",' || chr(10) || '    "name": "' || name
  || '"' || chr(10) || '  }', ',' || chr(10) ORDER BY id) AS j FROM projects GROUP BY user_id) r ON r.user_id = u.id""", "users", "projects"))
def result_text(spark, sf_dir):
    """Per user the whole result text of a question for the user's projects (array, no data, or error)."""
    p = fx.projects(spark, sf_dir)
    cols = p.select("id", "name")
    asked = fx.users(spark, sf_dir).select(F.col("id").alias("key"), F.when(F.col("usage_count") % 7 == 0, F.lit("no table")).alias("error"))
    return CL.result_text(asked, p.select(F.col("user_id").alias("key"), F.col("id").alias("pos"), CL.row_json(cols).alias("row_json")))


def _json_sql(cols_types) -> str:
    parts = []
    for c, kind in cols_types:
        v = f"COALESCE(to_json({c}), 'null')"
        parts.append(f"'    \"{c}\": ' || {v}")
    return "'  {' || chr(10) || " + " || ',' || chr(10) || ".join(parts) + " || chr(10) || '  }'"


_JSON_COLS = [("id", "s"), ("user_id", "s"), ("name", "s"), ("client_name", "s"),
              ("contract_value", "d"), ("status", "s"), ("labor_total", "d"), ("material_total", "d"),
              ("received", "d"), ("estimated_profit", "d")]


@register("rows_to_json", with_ledgers(f"""SELECT id, {_json_sql(_JSON_COLS)} AS row_json FROM (
SELECT id, user_id, name, client_name, {money('contract_value')} AS contract_value, status,
       {money('labor_total')} AS labor_total, {money('material_total')} AS material_total,
       {money('received')} AS received, {money('contract_value - labor_total - material_total')} AS estimated_profit
FROM x) r""", *LEDGER_NAMES, extra=_EXACT_CHILDREN.strip().lstrip(",").strip()))
def rows_to_json(spark, sf_dir):
    """Each project-list row as the JSON object text handed to the answer writer."""
    pl = pnl.project_list(fx.projects(spark, sf_dir), fx.labor_costs(spark, sf_dir),
                          fx.material_costs(spark, sf_dir), fx.payment_milestones(spark, sf_dir))
    return pl.select("id", CL.row_json(pl).alias("row_json"))


FREE_SQL = """SELECT p.user_id, COUNT(*) AS n_projects,
  CAST(SUM(p.contract_value) AS DOUBLE) AS contract_total,
  CAST(COALESCE(SUM(l.s), 0) AS DOUBLE) AS labor_total
FROM projects p
LEFT JOIN (SELECT project_id, SUM(total_amount) AS s FROM labor_costs GROUP BY project_id) l
  ON l.project_id = p.id
GROUP BY p.user_id"""


def _views(sf_dir):
    return lambda s: {"projects": fx.projects(s, sf_dir), "labor_costs": fx.labor_costs(s, sf_dir),
                      "material_costs": fx.material_costs(s, sf_dir),
                      "payment_milestones": fx.payment_milestones(s, sf_dir)}


@register("run_sql", with_ledgers(FREE_SQL, "projects", "labor_costs"))
def run_sql(spark, sf_dir):
    """Q3: a free SQL question run on the ledgers (all tenants: an admin job)."""
    return FS.run_sql(spark, FREE_SQL, _views(sf_dir))


@register("tenant_views", with_ledgers("""SELECT user_id, 'projects' AS table_name, COUNT(*) AS n_rows
FROM projects WHERE user_id IS NOT NULL GROUP BY 1
UNION ALL SELECT user_id, 'labor_costs', COUNT(*) FROM labor_costs WHERE user_id IS NOT NULL GROUP BY 1
UNION ALL SELECT user_id, 'material_costs', COUNT(*) FROM material_costs WHERE user_id IS NOT NULL GROUP BY 1
UNION ALL SELECT user_id, 'payment_milestones', COUNT(*) FROM payment_milestones WHERE user_id IS NOT NULL GROUP BY 1""",
                                       "projects", "labor_costs", "material_costs", "payment_milestones"))
def tenant_views(spark, sf_dir):
    """Q2: rows of each ledger that each tenant's views hold, for all users with a project."""
    views = _views(sf_dir)(spark)
    return FS.visible_rows(FS.tenant_views(views, views["projects"].select("user_id").distinct()))


TENANT_SQL = """SELECT p.id, p.name, COUNT(l.project_id) AS n_labor FROM projects p
LEFT JOIN labor_costs l ON l.project_id = p.id GROUP BY p.id, p.name"""
TENANT = "1"


@register("tenant_sql", with_ledgers("SELECT p.id, p.name, COUNT(l.project_id) AS n_labor "
                                     f"FROM (SELECT * FROM projects WHERE user_id = '{TENANT}') p "
                                     f"LEFT JOIN (SELECT * FROM labor_costs WHERE user_id = '{TENANT}') l "
                                     "ON l.project_id = p.id GROUP BY p.id, p.name", "projects", "labor_costs"))
def tenant_sql(spark, sf_dir):
    """Q2 + Q3: one tenant's free SQL, which names no user, over that tenant's views."""
    return FS.run_sql(spark, TENANT_SQL, _views(sf_dir), user_id=TENANT)
