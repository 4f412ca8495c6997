
import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from tallybook import schemas as S
from tallybook.functions import chunk as CH
from tallybook.functions import clean as C
from tallybook.functions import display as D
from tallybook.operators import chatlog as CL
from tallybook.operators import common as CM
from tallybook.operators import freesql as FS
from tallybook.operators import grid as G
from tallybook.operators import ingest
from tallybook.operators import mapping as M
from tallybook.operators import messages as MS
from tallybook.operators import pnl
from tallybook.operators import quota as Q
from tallybook.operators import store as ST
from tallybook.session import checkpoint_dir


def _ledgers(spark, projects, labor, material, milestones):
    def df(rows, schema):
        fields = [f for f in schema.fields]
        return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], schema)
    return (df(projects, S.PROJECTS), df(labor, S.LABOR_COSTS), df(material, S.MATERIAL_COSTS),
            df(milestones, S.PAYMENT_MILESTONES))


def d(x):
    import decimal
    return decimal.Decimal(str(x))


def test_readme_golden_numbers(spark):
    p, lab, mat, ms = _ledgers(
        spark,
        [{"id": "p1", "user_id": "u1", "name": "บ้านสมชาย", "contract_value": d("1200000.00")}],
        [{"project_id": "p1", "user_id": "u1", "work_days": d("5.0"), "daily_rate": d("600.00"),
          "total_amount": d("3000.00"), "paid_amount": d("0")}],
        [{"project_id": "p1", "user_id": "u1", "quantity": d("10"), "unit_price": d("150"),
          "total_amount": d("1500.00")}], [])
    r = pnl.project_summary(p, lab, mat, ms, user_id="u1", project_id="p1").first()
    assert r.total_cost == 4500 and r.estimated_profit == 1195500
    assert r.margin_pct == 99.6 and r.profit_margin == "99.6%"
    assert r.unpaid_labor == 3000 and r.received == 0 and r.pending_receive == 0
    # another user's project is not visible
    assert pnl.project_summary(p, lab, mat, ms, user_id="u2", project_id="p1").count() == 0


def test_fanout_law_and_zero_contract(spark):
    p, lab, mat, ms = _ledgers(
        spark,
        [{"id": "p1", "user_id": "u", "name": "a", "contract_value": d("100")},
         {"id": "p2", "user_id": "u", "name": "b", "contract_value": d("0")}],
        [{"project_id": "p1", "total_amount": d(10), "paid_amount": d(4)},
         {"project_id": "p1", "total_amount": d(20), "paid_amount": None}],
        [{"project_id": "p1", "total_amount": d(5)}, {"project_id": "p1", "total_amount": d(7)},
         {"project_id": "p1", "total_amount": d(1)}],
        [{"project_id": "p1", "amount": d(50), "status": "received"},
         {"project_id": "p2", "amount": d(9), "status": "pending"}])
    ex = {r.project_id: r for r in pnl.project_summary(p, lab, mat, ms).collect()}
    ref = {r.project_id: r for r in pnl.project_summary(p, lab, mat, ms, mode="reference").collect()}
    assert ex["p1"].labor_total == 30 and ref["p1"].labor_total == 30 * 3 * 1
    assert ex["p1"].material_total == 13 and ref["p1"].material_total == 13 * 2 * 1
    assert ex["p1"].received == 50 and ref["p1"].received == 50 * 2 * 3
    assert ex["p1"].unpaid_labor == 6 and ref["p1"].unpaid_labor == 6 * 3
    assert ex["p2"].margin_pct == 0.0 and ex["p2"].profit_margin == "0%"
    assert ex["p2"].pending_receive == 9


@pytest.mark.parametrize("raw,value,bad", [
    ("฿1,234.50", 1234.5, False), ("1,200 บาท", 1200.0, False), ("๑๕๐", 150.0, False),
    ("-500", 500.0, False), ("(500)", 500.0, False), ("1e3", 13.0, False), ("", 0.0, False),
    (None, 0.0, False), ("nan", 0.0, False), ("1.2.3", None, True), ("5.", 5.0, False)])
def test_clean_number(spark, raw, value, bad):
    r = spark.createDataFrame([(raw,)], "x string").select(
        C.clean_number("x").alias("v"), C.number_is_bad("x").alias("b")).first()
    assert r.v == value and r.b == bad


def test_clean_number_keep_sign(spark):
    r = spark.createDataFrame([("-500",), ("(7)",)], "x string").select(C.clean_number("x", True).alias("v"))
    assert sorted(x.v for x in r.collect()) == [-500.0, -7.0]


@pytest.mark.parametrize("raw,all_,ref", [
    ("15/01/2025", "2025-01-15", "2025-01-15"), ("15-01-2025", "2025-01-15", None),
    ("2025-01-15", "2025-01-15", None), ("15/01/25", "2025-01-15", None),
    ("15/01/70", "1970-01-15", None), ("15 Jan 2025", "2025-01-15", None),
    ("15 January 2025", "2025-01-15", None), ("31/02/2025", None, None),
    ("15/01/2568", "2568-01-15", None), ("5/1/2025", "2025-01-05", "2025-01-05"), ("junk", None, None)])
def test_parse_date(spark, raw, all_, ref):
    r = spark.createDataFrame([(raw,)], "x string").select(
        C.parse_date("x").cast("string").alias("a"), C.parse_date("x", "reference").cast("string").alias("r")).first()
    assert r.a == all_ and r.r == ref


def test_derive_total_entry(spark):
    df = spark.createDataFrame([(None, 5.0, 600.0), (0.0, 5.0, 600.0), (10.0, 5.0, 600.0), (0.0, 0.0, 600.0)],
                               "t double, a double, b double")
    got = [r.v for r in df.select(C.derive_total_entry("t", "a", "b").alias("v")).collect()]
    assert got == [3000.0, 3000.0, 10.0, 0.0]


def _grid(spark, rows):
    return spark.createDataFrame([("f", "s", 0, i, c) for i, c in enumerate(rows)],
                                 "file string, sheet string, sheet_idx int, row_idx long, cells array<string>")


def test_fill_modes_and_blocks(spark):
    g = _grid(spark, [["Title", None, None], ["a", "b", "c"], ["1", None, "x"], [None, None, None],
                      ["2", "y", None]])
    down = {r.row_idx: r.cells for r in G.grid_fill(g, "down", block=4096).collect()}
    down2 = {r.row_idx: r.cells for r in G.grid_fill(g, "down", block=2).collect()}
    assert down == down2
    assert down[2] == ["1", "b", "x"] and down[3] == ["1", "b", "x"] and down[4] == ["2", "y", "x"]
    both = {r.row_idx: r.cells for r in G.grid_fill(g, "both").collect()}
    assert both[0] == ["Title", "Title", "Title"]
    right = {r.row_idx: r.cells for r in G.grid_fill(g, "right").collect()}
    assert right[2] == ["1", "1", "x"]


def test_header_intended_vs_reference(spark):
    g = _grid(spark, [["Daily report", None, None], ["Worker", "Days", "Daily Rate"], ["A", "5", "600"]])
    f = G.grid_fill(g)
    assert G.header_detect(g, f).first().header_row == 1
    assert G.header_detect(g, f, "reference").first().header_row == 0  # merged title wins (B3)


def test_mapping_and_import_end_to_end(spark):
    g = _grid(spark, [["ค่าแรงเดือนนี้", None, None, None, None],
                      ["ชื่อช่าง", "วันทำงาน", "ค่าแรง/วัน", "จ่ายแล้ว", "วันที่"],
                      ["สมชาย", "๕", "600", "", "15/01/2025"],
                      ["สมศรี", "2", "฿1,000.00", "500", "16/01/25"]])
    imp = ingest.import_grid(g)
    st = imp.sheet_types.first()
    assert st.table_type == "labor"
    rows = sorted(ingest.ledger_rows(imp.typed, spark.createDataFrame([("f", "p1", "u1")],
                                                                      "file string, project_id string, user_id string"),
                                     "labor").collect(), key=lambda r: r.worker_name)
    assert [float(r.total_amount) for r in rows] == [3000.0, 2000.0]  # derived: no total column (X3)
    assert [str(r.work_date) for r in rows] == ["2025-01-15", "2025-01-16"]
    assert rows[0].source == "excel_import" and rows[0].project_id == "p1"
    rep = ingest.import_report(imp, spark.createDataFrame([("f", "p1", "u1")], "file string, project_id string, user_id string")).first()
    assert rep.status == "success" and rep.rows_loaded == 2 and rep.rows_total == 2


def test_unknown_sheet_skipped(spark):
    g = _grid(spark, [["หัวข้อ", "ค่า"], ["ลูกค้า", "x"]])
    imp = ingest.import_grid(g)
    rep = ingest.import_report(imp, spark.createDataFrame([("f", "p", "u")], "file string, project_id string, user_id string")).first()
    assert rep.status == "skipped" and rep.reason == ingest.SKIP_REASON


def test_mapping_json_fences(spark):
    raw = '```json\n{"results": {"S1": {"table_type": "labor", "column_mapping": {"ชื่อ": "worker_name", "x": null}}}}\n```'
    r = spark.createDataFrame([(raw,)], "raw string").select(M.mapping_json(F.col("raw")).alias("m")).first()
    assert r.m.results["S1"].table_type == "labor"
    assert r.m.results["S1"].column_mapping["ชื่อ"] == "worker_name"


def test_first_k_and_ordered_rank_skewed(spark):
    rows = [("hot", i) for i in range(5000)] + [("cold", i) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, o long")
    top = CM.first_k(df, ["k"], "o", 3, block=16)
    assert sorted((r.k, r.o) for r in top.collect()) == [("cold", 0), ("cold", 1), ("cold", 2),
                                                        ("hot", 0), ("hot", 1), ("hot", 2)]
    last = CM.first_k(df, ["k"], "o", 2, block=16, descending=True)
    assert sorted(r.o for r in last.filter("k = 'hot'").collect()) == [4998, 4999]
    ranked = CM.ordered_rank(df.repartition(5), ["k"], ["o"], num_partitions=8)
    bad = ranked.filter(F.col("rn") != F.col("o") + 1).count()
    assert bad == 0 and ranked.count() == 5007


def test_ordered_rank_many_partitions_and_columns(spark):
    """Ranks stay exact with payload columns and far more rows than a boundary sample holds."""
    n = 1_500_000
    df = (spark.range(0, n, 1, 24).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 3).cast("string")).alias("k"),
                                          F.xxhash64("id").alias("o"), F.col("id"), F.concat(F.lit("question "), "id").alias("q")))
    got = CM.ordered_rank(df, ["k"], ["o", "id"], num_partitions=40)
    per = {r.k: (r.n, r.d, r.lo, r.hi) for r in got.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("rn").alias("d"),
                                                                     F.min("rn").alias("lo"), F.max("rn").alias("hi")).collect()}
    assert per == {k: (n // 3, n // 3, 1, n // 3) for k in (None, "1", "2")}
    sample = got.filter("k = '1'").orderBy("o").limit(2000).collect()
    assert [r.rn for r in sample] == list(range(1, 2001))


def test_quota_rule(spark):
    users = spark.createDataFrame([("a", "starter", 2, 0), ("b", "pro", 1, 5), ("c", "starter", None, 0),
                                   ("d", "starter", 0, 9), ("e", "starter", 3, 3)],
                                  "id string, plan string, plan_limit int, usage_count int")
    calls = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, 0, i), u) for i, u in
                                   enumerate(["a", "a", "a", "b", "b", "c", "d", "e", "z"])],
                                  "event_id long, ts timestamp, user_id string")
    got = {r.event_id: (r.allowed, r.message) for r in Q.quota_gate(calls, users).collect()}
    assert [got[i][0] for i in range(9)] == [True, True, False, True, True, True, True, False, True]
    assert got[2][1] == "ใช้ครบโควต้าแล้ว (2/2 คำถาม) กรุณาอัปเกรดแพ็กเกจ"
    inc = {r.id: r.usage_count for r in Q.usage_increment(users, calls).collect()}
    assert inc["a"] == 2 and inc["e"] == 3
    ens = {r.id: (r.plan, r.plan_limit) for r in Q.user_ensure(users, calls).collect()}
    assert ens["z"] == ("starter", 100)


@pytest.mark.parametrize("text,sql", [
    ("no tag", None), ("<sql>SELECT 1</sql>", "SELECT 1"), ("a <sql> x </sql> b <sql>y</sql>", "x"),
    ("<sql>\nSELECT *\nFROM t\n</sql>", "SELECT *\nFROM t"), ("<sql>  </sql>", None)])
def test_extract_sql(spark, text, sql):
    r = spark.createDataFrame([(text,)], "t string").select(CL.extract_sql("t").alias("s")).first()
    assert r.s == sql


def test_words_markup_pct(spark):
    df = spark.createDataFrame([(1, 1, "  **กำไร** 1,000\nบาท ")], "conv_id long, turn long, text string")
    assert [r.chunk for r in CL.answer_words(df).orderBy("pos").collect()] == ["**กำไร** ", "1,000 ", "บาท "]
    r = df.select(D.answer_markup("text").alias("h"), D.escape_html(F.lit("<a&b>")).alias("e"),
                  D.usage_pct(F.lit(450)).alias("p"), D.money_text(F.lit(2.5)).alias("m")).first()
    assert r.h == "  <strong>กำไร</strong> 1,000<br/>บาท " and r.e == "&lt;a&amp;b&gt;"
    assert r.p == 100.0 and r.m == "2 บาท"


def test_message_assembly_no_history(spark):
    c = spark.createDataFrame([(1, 0, "user", "q?")], "conv_id long, turn long, role string, text string")
    rows = CL.message_assembly(c, F.lit("SYS")).collect()
    assert [(r.role, r.content) for r in rows] == [("user", "SYS\n\nq?")]


@pytest.mark.parametrize("n", [0, 150, 2500, 20000])
def test_chunk_laws(n):
    import random
    rnd = random.Random(n)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12))) for _ in range(n)]
    text = ""
    for w in words:
        text += w + rnd.choice([" ", " ", " ", "\n", "\n\n"])
    chunks = CH.split_text(text)
    assert all(len(c) <= CH.CHUNK_SIZE for c in chunks)
    assert "".join(text.split()) in "".join("".join(c.split()) for c in chunks) or not text.strip() or \
        all(w in "".join(chunks) for w in words)
    for a, b in zip(chunks, chunks[1:]):
        shared = max((k for k in range(0, min(len(a), len(b)) + 1) if a.endswith(b[:k])), default=0)
        assert shared <= CH.CHUNK_OVERLAP


@pytest.mark.parametrize("text", ["word " * 40_000, "x" * 200_000, "line of words\n" * 15_000 + "y" * 50_000])
def test_chunks_come_one_by_one(text):
    """What the splitter holds besides the text does not grow with it, and each chunk's place is right."""
    import tracemalloc
    tracemalloc.start()
    n, end = 0, 0
    for start, chunk in CH.chunk_spans(text):
        assert text.startswith(chunk, start) and len(chunk) <= CH.CHUNK_SIZE and not text[end:start].strip()
        n, end = n + 1, start + len(chunk)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not text[end:].strip() and n >= len(text) // CH.CHUNK_SIZE and peak < 200_000


@pytest.mark.parametrize("text,size,overlap,want", [
    ("", 10, 2, []), ("  \n\n ", 10, 2, []), ("one two", 10, 2, ["one two"]),
    ("one two three four", 10, 4, ["one two", "two three", "four"]), ("one two three four", 9, 4, ["one two", "three", "four"]),
    ("aaaa\n\nbbbb\n\ncccc", 12, 0, ["aaaa\n\nbbbb", "cccc"]),
    ("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]),
    ("first line\nsecond line\n\nthird", 12, 3, ["first line", "second line", "third"])])
def test_chunk_cases(text, size, overlap, want):
    assert CH.split_text(text, size, overlap) == want


def test_doc_type_and_gate(spark):
    df = spark.createDataFrame([("a/b/Report.PDF",), ("x.docx",), ("img.jpeg",), ("s.xlsx",), (".bashrc",),
                                ("noext",), ("a.b/c",)], "p string")
    from tallybook.operators import docs as DC
    got = [r.t for r in df.select(DC.doc_type("p").alias("t")).collect()]
    assert got == ["PDF", "DOCX", "IMG", "Excel", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    gates = [r.g for r in df.select(ST.file_gate("p").alias("g")).collect()]
    assert gates == [False, False, False, True, False, False, False]


def test_messages_broken_and_route(spark):
    good = '{"events":[{"type":"message","message":{"type":"text","text":" จ่ายค่าแรงสมชาย 5 วัน วันละ 600 งานบ้านสมชาย "},"replyToken":"t1"},' \
           '{"type":"message","message":{"type":"sticker"},"replyToken":"t2"}]}'
    payloads = spark.createDataFrame([("u1", good), ("u1", '{"events": [')], "user_id string, body string")
    ev = MS.event_scan(payloads)
    assert ev.filter("bad_json").count() == 1 and ev.filter("not bad_json").count() == 2
    msgs = MS.message_parse(MS.message_filter(ev))
    projects = spark.createDataFrame([("p9", "u1", "บ้านสมชาย"), ("p8", "u1", "บ้าน")], "id string, user_id string, name string")
    r = MS.route(MS.project_name_match(msgs, projects)).first()
    assert r.msg_type == "record_labor" and r.project_id == "p9" and r.route == "labor_costs"
    assert float(r.total_amount) == 3000.0
    assert r.reply == "✅ บันทึกค่าแรงสำเร็จ\nโครงการ: บ้านสมชาย\nช่าง: สมชาย\nยอด: 3,000 บาท"


def test_run_sql_guard_and_tenant(spark):
    views = lambda s: {"projects": s.createDataFrame([("p1", "u1"), ("p2", "u2")], "id string, user_id string")}
    assert FS.run_sql(spark, "SELECT id FROM projects", views, user_id="u1").count() == 1
    assert FS.run_sql(spark, "DROP TABLE projects", views).columns == ["error"]
    assert FS.run_sql(spark, "SELECT nope FROM projects", views).columns == ["error"]
    assert FS.run_sql(spark, "with p as (select * from projects) select (select max(id) from p) m, id, id from p", views, user_id="u1").count() == 1


@pytest.mark.parametrize("sql", [
    "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "SELECT * FROM projects WHERE id IN (SELECT id FROM json.`/tmp/x`)",
    "WITH t AS (SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`) SELECT * FROM t",
    "WITH t AS (SELECT * FROM projects) INSERT OVERWRITE DIRECTORY '/tmp/never-written' USING parquet SELECT * FROM t",
    "INSERT INTO projects VALUES ('x', 'y')", "SELECT * FROM default.projects", "SELECT * FROM elsewhere", "SHOW TABLES",
    "SELECT reflect('java.lang.System', 'getenv')", "SELECT java_method('java.lang.System', 'getenv') FROM projects",
    "SELECT 1/0", "SELECT CAST(id AS INT) FROM projects", "SELEKT 1", "", "SELECT 1; DROP TABLE projects", "CACHE TABLE projects"])
def test_run_sql_refuses(spark, sql):
    views = lambda s: {"projects": s.createDataFrame([("p1", "u1"), ("p2", "u2")], "id string, user_id string")}
    out = FS.run_sql(spark, sql, views, user_id="u1")
    assert out.columns == ["error"] and out.count() == 1
    assert not os.path.exists("/tmp/never-written")


def test_schema_text(spark):
    rows = FS.schema_text(spark).collect()
    assert {r.table_name for r in rows} == set(FS.QUERY_TABLES)
    assert [r.meaning for r in rows if (r.table_name, r.column_name) == ("labor_costs", "worker_name")] == ["ชื่อช่าง"]
    assert "Relation: labor_costs.project_id = projects.id" in FS.schema_prompt(spark)


def test_store_create_and_idempotent_append(spark):
    loc = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex[:8]}"
    paths = ST.ledger_create(spark, loc)
    assert set(paths) == set(S.LEDGERS)
    rows = spark.createDataFrame([("x", "p", "u", "M1", d(5), None, None, "pending", None, "manual", None)],
                                 S.PAYMENT_MILESTONES)
    ST.ledger_append(rows, loc, "payment_milestones", "b1")
    ST.ledger_append(rows, loc, "payment_milestones", "b1")  # retried batch
    assert spark.read.parquet(f"{loc}/payment_milestones/batch=b1").count() == 1


def test_stream_dedupes_reply_tokens(spark, tmp_path):
    from tallybook.streaming import messages as SM
    from tallybook.streaming.runner import await_query, run_folder
    body = '{"events":[{"type":"message","message":{"type":"text","text":"ซื้อปูน 10 ถุง 1,500 บาท งานบ้าน"},"replyToken":"same"}]}'
    src = f"{checkpoint_dir(spark)}/src-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([("a", "u1", body), ("b", "u1", body)], "payload_id string, user_id string, body string") \
         .write.parquet(src)
    out = run_folder(spark, "test")
    projects = spark.createDataFrame([("p1", "u1", "บ้าน")], "id string, user_id string, name string")
    q = SM.start(spark, src, "payload_id string, user_id string, body string", projects, out)
    await_query(q, 300)
    rows = spark.read.parquet(f"{out}/ledgers/material_costs").collect()
    assert len(rows) == 1 and rows[0].project_id == "p1" and float(rows[0].total_amount) == 1500.0
    assert os.path.isdir(out)
