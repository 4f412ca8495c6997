"""Cases that the rendered inputs never visit: wide files, fractions, values that do not fit, missing tokens, several batches."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tallybook.operators import grid as G
from tallybook.operators import ingest
from tallybook.operators import mapping as M
from tallybook.operators import messages as MS
from tallybook.operators import store as ST
from tallybook.session import checkpoint_dir
from tallybook.streaming import messages as SM
from tallybook.streaming import sessions as SS
from tallybook.streaming import usage as SU
from tallybook.streaming.runner import await_query, run_folder


def folder(spark):
    return f"{checkpoint_dir(spark)}/cases-{uuid.uuid4().hex[:8]}"


def sheet(spark, *rows, name="S", file="f.xlsx"):
    return spark.createDataFrame([(file, name, 0, i, list(r)) for i, r in enumerate(rows)],
                                 "file string, sheet string, sheet_idx int, row_idx long, cells array<string>")


def test_csv_wider_than_any_default(spark):
    path = folder(spark)
    wide = ",".join(str(i) for i in range(70))
    quoted = '"a, ""b""\nc",' + ",".join(str(i) for i in range(75))
    spark.createDataFrame([(f"x,y\n{wide}\n{quoted}",)], "value string").coalesce(1).write.text(path, lineSep="\n")
    rows = G.grid_scan(spark, path).orderBy("row_idx").collect()
    assert [len(r.cells) for r in rows] == [2, 70, 76]
    assert rows[2].cells[0] == 'a, "b"\nc' and rows[2].cells[-1] == "74" and rows[1].cells[-1] == "69"
    c = G.file_catalog(spark, path).collect()
    assert [(r.rows, r.columns, r.header) for r in c] == [(3, 76, ["x", "y"])]


def imported(spark, *rows, **kw):
    return ingest.import_grid(sheet(spark, *rows), **kw)


def test_total_from_fractions(spark):
    t = imported(spark, ("Worker", "Days", "Daily Rate"), ("A", "0.25", "600"), ("B", "1.5", "333.335")).typed.orderBy("row_idx").collect()
    assert [float(r.total_amount) for r in t] == [150.0, 500.0]
    assert all(r.n_bad == 0 and r.bad_values == {} for r in t)


def test_values_that_do_not_fit_keep_their_text(spark):
    imp = imported(spark, ("Worker", "Days", "Daily Rate", "Amount"), ("A", "99999999", "1", "5"), ("B", "1", "2", "3"))
    t = imp.typed.orderBy("row_idx").collect()
    assert t[0].work_days is None and t[0].n_bad == 1 and t[0].bad_values == {"work_days": "99999999"}
    imports = spark.createDataFrame([("f.xlsx", "p", "u")], "file string, project_id string, user_id string")
    assert ingest.ledger_rows(imp.typed, imports, "labor").count() == 2
    assert ingest.ledger_rows(imp.typed, imports, "labor", on_bad="fail_sheet").count() == 0
    r = ingest.import_report(imp, imports, on_bad="fail_sheet").first()
    assert (r.status, r.rows_loaded) == ("error", 0)


def test_override_of_a_missed_column(spark):
    over = spark.createDataFrame([("f.xlsx", "S", "Zzz", "work_days", None)],
                                 "file string, sheet string, source_name string, field string, table_type string")
    t = imported(spark, ("Worker", "Zzz", "Daily Rate"), ("A", "5", "600"), overrides=over).typed.collect()
    assert [(float(r.work_days), float(r.total_amount), r.n_bad) for r in t] == [(5.0, 3000.0, 0)]
    typed = over.withColumn("field", F.lit("item_name")).withColumn("table_type", F.lit("material"))
    t = imported(spark, ("Aaa", "Zzz"), ("x", "brick"), overrides=typed).typed.collect()
    assert [(r.table_type, r.item_name) for r in t] == [("material", "brick")]
    moved = spark.createDataFrame([("f.xlsx", "S", "Bbb", "worker_name")], "file string, sheet string, source_name string, field string")
    t = imported(spark, ("Worker", "Bbb", "Days"), ("A", "B", "5"), overrides=moved).typed.collect()
    assert [r.worker_name for r in t] == ["B"]


def test_stored_mapping_wins(spark):
    raw = '```json\n{"results": {"S": {"table_type": "labor", "column_mapping": {"Xx": "worker_name", "Yy": "work_days", "no": "note"}}}}\n```'
    stored = M.stored_mapping(spark.createDataFrame([("f.xlsx", raw)], "file string, raw string"))
    t = imported(spark, ("Xx", "Yy", "Amount"), ("A", "2", "7"), stored=stored).typed.collect()
    assert [(r.table_type, r.worker_name, float(r.work_days), r.total_amount) for r in t] == [("labor", "A", 2.0, None)]


def test_header_blanks(spark):
    r = spark.createDataFrame([(" Daily _Rate ",)], "h string").select(M.norm(F.col("h")).alias("n")).first()
    assert r.n == "dailyrate" == M.norm_py(" Daily _Rate ")


def test_entries_with_reasons(spark):
    raw = spark.createDataFrame([(1, "u", "[1"), (2, "u", '{"project_id":"p"}'), (3, "u", '{"project_id":"p","milestone_name":"m","amount":5}'),
                                 (4, "u", '{"milestone_name":"m","amount":5}')], "entry_id int, user_id string, body string")
    got = {r.entry_id: (r.valid, r.reason) for r in ST.typed_entry(raw, "payment_milestones").collect()}
    assert got == {1: (False, "not a JSON object"), 2: (False, "milestone_name is missing"), 3: (True, None), 4: (False, "project_id is missing")}


def test_ledger_by_project(spark):
    loc = folder(spark)
    ST.ledger_create(spark, loc)
    assert ST.read_ledger(spark, loc, "payment_milestones").count() == 0
    raw = spark.createDataFrame([(i, "u", f'{{"project_id":"p{i % 5}","milestone_name":"m","amount":{i}}}') for i in range(20)],
                                "entry_id int, user_id string, body string")
    rows = ST.manual_rows(ST.typed_entry(raw, "payment_milestones"), "payment_milestones")
    for _ in range(2):
        ST.ledger_append(rows, loc, "payment_milestones", "b1")
    assert ST.read_ledger(spark, loc, "payment_milestones").count() == 20
    mine = ST.read_ledger(spark, loc, "payment_milestones", "p3")
    assert sorted(float(r.amount) for r in mine.collect()) == [3.0, 8.0, 13.0, 18.0]


def body(*events):
    parts = [f'{{"type":"message","message":{{"type":"text","text":"{t}"}}' + (f',"replyToken":"{k}"' if k else "") + "}" for t, k in events]
    return '{"events":[' + ",".join(parts) + "]}"


BUY = "ซื้อปูน {} ถุง 1,500 บาท งานบ้าน"
PROJECTS = [("p1", "u1", "บ้าน"), ("p2", "u1", "ร้าน")]


def test_messages_without_tokens(spark):
    pay = spark.createDataFrame([("a", "u1", body((BUY.format(1), None), (BUY.format(2), None))), ("b", "u1", body((BUY.format(3), "t"), (BUY.format(4), "t"))),
                                 ("c", "u1", body(("จ่ายค่าแรงสมชาย 5 วัน วันละ 600", None)))], "payload_id string, user_id string, body string")
    projects = spark.createDataFrame(PROJECTS, "id string, user_id string, name string")
    r = MS.route(MS.project_name_match(MS.message_parse(MS.message_filter(MS.event_scan(pay))), projects), projects)
    rows = r.orderBy("payload_id", "event_idx").collect()
    assert [x.route for x in rows] == ["material_costs"] * 4 + ["reject"] and {x.project_id for x in rows[:4]} == {"p1"}
    assert rows[4].reply.endswith("\nโครงการที่มี: บ้าน, ร้าน")
    ids = [x.id for x in MS.message_rows(r, "material_costs").collect()]
    assert len(set(ids)) == 4 and None not in ids


def test_stored_replies_of_the_model(spark):
    m = spark.createDataFrame([("a", 0, "u1", "free text", '```json\n{"type":"record_material","item_name":"ปูน","quantity":2,"total_amount":70}\n```'),
                               ("a", 1, "u1", "free text", "{broken"), ("a", 2, "u1", BUY.format(2), None)],
                              "payload_id string, event_idx int, user_id string, text string, model_reply string")
    rows = MS.route(MS.model_parse(m).withColumn("project_id", F.lit("p")).withColumn("project_name", F.lit("บ้าน"))).orderBy("event_idx").collect()
    assert [(x.msg_type, x.route) for x in rows] == [("record_material", "material_costs"), ("error", "error"), ("record_material", "material_costs")]
    assert float(rows[0].total_amount) == 70 and "ปูน 2 " in rows[0].reply
    assert rows[1].reply.startswith(MS.ERROR_TEXT)


def put(spark, path, rows, schema):
    """One file per call, as a stream's source gets them."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_message_stream_without_tokens(spark):
    src, out = folder(spark), run_folder(spark, "cases")
    schema = "payload_id string, user_id string, body string"
    for i in range(3):
        put(spark, src, [(f"x{i}", "u1", body((BUY.format(i + 1), None))), (f"y{i}", "u1", body((BUY.format(9), "same")))], schema)
    projects = spark.createDataFrame(PROJECTS, "id string, user_id string, name string")
    await_query(SM.start(spark, src, schema, projects, out, files_per_batch=1), 300)
    rows = spark.read.parquet(f"{out}/ledgers/material_costs").collect()
    assert sorted(float(r.quantity) for r in rows) == [1.0, 2.0, 3.0, 9.0] and len({r.id for r in rows}) == 4


def test_session_tails_over_batches(spark):
    src, out = folder(spark), run_folder(spark, "cases")
    schema = "conv_id long, turn long, role string, text string"
    for turns in ((0, 1), (2,), (3,)):
        put(spark, src, [(1, t, "user", f"t{t}") for t in turns], schema)
    put(spark, src, [(2, 0, "user", "other")], schema)
    await_query(SS.start(spark, src, schema, out, k=2, files_per_batch=1), 300)
    assert sorted(map(tuple, SS.tails(spark, out).collect())) == [(1, 2, "user", "t2"), (1, 3, "user", "t3"), (2, 0, "user", "other")]


def test_usage_counts_over_batches(spark):
    src, out = folder(spark), run_folder(spark, "cases")
    schema = "event_id long, ts timestamp, user_id string"
    at = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t").first().t
    for b in range(3):
        put(spark, src, [(10 * b + i, at, u) for i, u in enumerate(["a", "a", "b", None])], schema)
    users = spark.createDataFrame([("a", "starter", 5, 1)], "id string, plan string, plan_limit int, usage_count int")
    await_query(SU.start(spark, src, schema, users, out, files_per_batch=1), 300)
    rows = spark.read.parquet(f"{out}/gated").collect()
    mine = sorted((r.rn, r.allowed) for r in rows if r.user_id == "a")
    assert mine == [(1, True), (2, True), (3, True), (4, True), (5, False), (6, False)]
    assert sorted(r.rn for r in rows if r.user_id == "b") == [1, 2, 3] and sorted(r.rn for r in rows if r.user_id is None) == [1, 2, 3]
    assert not os.path.exists(f"{out}/never")


def test_monthly_usage_over_batches_bases_and_a_late_call(spark):
    src, out = folder(spark), run_folder(spark, "cases")
    schema = "event_id long, ts timestamp, user_id string"
    day = lambda d: spark.sql(f"SELECT timestamp'{d} 12:00:00' AS t").first().t
    jan, feb = day("2024-01-31"), day("2024-02-01")
    batches = [[jan, jan], [jan, feb], [feb], [feb, jan], [feb]]
    for b, times in enumerate(batches):
        put(spark, src, [(10 * b + i, t, u) for i, t in enumerate(times) for u in ("a", None)], schema)
    users = spark.createDataFrame([("a", "starter", 3, 99)], "id string, plan string, plan_limit int, usage_count int")
    run = lambda **how: await_query(SU.start(spark, src, schema, users, out, files_per_batch=1, monthly=True, **how), 300)
    run(merge_every=2)
    mine = {r.event_id: (r.rn, r.allowed) for r in spark.read.parquet(f"{out}/gated").filter("user_id = 'a'").collect()}
    # January: 0, 1, 10 and the late 31; February: 11, 20, 30, 40
    assert mine == {0: (1, True), 1: (2, True), 10: (3, True), 31: (4, False),
                    11: (1, True), 20: (2, True), 30: (3, True), 40: (4, False)}
    assert sorted(os.listdir(f"{out}/base")) == ["1", "3"]
    total = {(r.user_id, str(r.month)): r.seen for r in SU.seen(spark, out).collect()}
    assert total == {("a", "2024-01-01"): 4, ("a", "2024-02-01"): 4, (None, "2024-01-01"): 4, (None, "2024-02-01"): 4}
    put(spark, src, [(50, feb, "a")], schema)
    run(merge_every=2)
    assert SU.seen(spark, out).filter("user_id = 'a' AND month = DATE'2024-02-01'").first().seen == 5
    with pytest.raises(ValueError):
        run(merge_every=3)


@pytest.mark.parametrize("text,n", [("", 0), ("x" * 2001, 3)])
def test_chunk_only_long(spark, text, n):
    from tallybook.operators import docs as DC
    df = spark.createDataFrame([(1, text), (2, "short\n\nlines"), (3, None)], "doc_id long, text string")
    got = DC.chunk_text(df).collect()
    assert [r.chunk for r in got if r.doc_id == 2] == ["short", "lines"]
    assert len([r for r in got if r.doc_id == 1]) == n and all(r.doc_id != 3 for r in got)


def test_chunk_rows_over_many_handed_batches(spark, monkeypatch):
    from tallybook.functions.chunk import split_text
    from tallybook.operators import docs as DC
    monkeypatch.setattr(DC, "CHUNK_BATCH", 3000)
    texts = {i: ("\n" if i % 2 else " ").join(f"w{i}x{j}" for j in range(200 * i)) for i in range(1, 12)} | {12: "a\n  b \n\nc", 13: " \n", 14: None, 15: "z" * 9000}
    rows = DC.chunk_text(spark.createDataFrame(list(texts.items()), "k long, t string").coalesce(2), "k", "t").collect()
    joined = {k: "\n\n".join(x.strip() for x in t.split("\n") if x.strip()) for k, t in texts.items() if t is not None}
    assert all(joined[r.k].startswith(r.chunk, r.start) for r in rows)
    for k, t in texts.items():
        mine = [r.chunk for r in sorted((r for r in rows if r.k == k), key=lambda r: r.chunk_idx)]
        want = [] if t is None else split_text(joined[k]) if sum(len(x.strip()) for x in t.split("\n")) > 2000 else [x.strip() for x in t.split("\n") if x.strip()]
        assert mine == want, k
    assert [(r.start, r.split) for r in rows if r.k == 12] == [(0, False), (3, False), (6, False)]


def test_tails_over_many_batches_and_a_repeated_one(spark):
    """Tails over bases and loose batches, in batches of any order of turns, and after a batch that is written again."""
    src, out = folder(spark), run_folder(spark, "cases")
    schema = "conv_id long, turn int, role string, text string"
    turns = [(c, t, "user", f"t{c}-{t}") for t in range(14) for c in range(3) if t % (c + 1) == 0]
    for i in range(7):
        put(spark, src, turns[i::7], schema)
    await_query(SS.start(spark, src, schema, out, k=4, files_per_batch=1, merge_every=3), 300)
    assert SS.batches_done(spark, out) == 7
    want = sorted(r for c in range(3) for r in [x for x in turns if x[0] == c][-4:])
    assert sorted(map(tuple, SS.tails(spark, out).collect())) == want
    again = spark.read.schema(SS.OUT_SCHEMA).parquet(f"{out}/tails/6")
    rows = again.collect()
    spark.createDataFrame(rows, SS.OUT_SCHEMA).write.mode("overwrite").parquet(f"{out}/tails/6")
    assert sorted(map(tuple, SS.tails(spark, out).collect())) == want
    with pytest.raises(ValueError):
        SS.start(spark, src, schema, out, k=5, merge_every=3)
    none = run_folder(spark, "cases")
    assert SS.tails(spark, none).count() == 0


def test_message_stream_with_stored_replies(spark):
    src, out = folder(spark), run_folder(spark, "cases")
    put(spark, src, [("a", "u1", body(("hello there", "r1"), (BUY.format(2), "r2"), ("again", "r3")))],
        "payload_id string, user_id string, body string")
    projects = spark.createDataFrame(PROJECTS, "id string, user_id string, name string")
    replies = spark.createDataFrame([("a", 0, '{"type":"record_labor","worker_name":"W","total_amount":5}'), ("a", 2, "no json"),
                                     ("zz", 0, "{}")], "payload_id string, event_idx int, model_reply string")
    await_query(SM.start(spark, src, "payload_id string, user_id string, body string", projects, out, replies=replies), 300)
    got = {r.reply_token: (r.route, r.reply) for r in spark.read.parquet(f"{out}/replies").collect()}
    assert got["r1"][0] == "reject" and got["r2"][0] == "material_costs"
    assert got["r3"] == ("error", MS.ERROR_TEXT + "not a JSON object: no json")


def test_messages_match_by_a_key_of_16_bytes(spark):
    msgs = spark.createDataFrame([("p" * 300, 0, "u", "งานบ้าน"), ("p" * 300, 1, "u", "-"), (None, 0, "u", "งานบ้าน"), ("q", None, "u", "งานบ้าน"), ("q", 0, "v", "งานบ้าน")],
                                 "payload_id string, event_idx int, user_id string, text string")
    projects = spark.createDataFrame([("1", "u", "บ้าน"), ("2", "u", "งานบ้าน"), ("3", "w", "บ้าน")], "id string, user_id string, name string")
    got = MS.project_name_match(msgs, projects)
    assert got.columns == [*msgs.columns, "project_id", "project_name"]
    assert sorted((str(r.payload_id)[:1], r.event_idx, r.project_id) for r in got.filter("project_id is not null").collect()) == [("p", 0, "2")] and got.count() == 5
    assert {len(r[0]) for r in MS.keyed(msgs).select(MS.KEY).filter("_m is not null").collect()} == {16}
    replies = spark.createDataFrame([("p" * 300, 0, "a"), ("p" * 300, 0, "b"), (None, 0, "c")], "payload_id string, event_idx int, model_reply string")
    assert sorted(r.model_reply or "" for r in MS.with_replies(msgs, replies).collect()) == ["", "", "", "", "b"]
