"""Short sheets are dealt once; payloads are parsed once; both give what the longer ways give."""

import time

from pyspark.sql import functions as F

from tallybook.operators import grid as G
from tallybook.operators import ingest
from tallybook.operators import messages as MS
from tallybook.session import CLEANUP_CONF, store

ROWS = [("a", "S", 0, 0, ["Jobs", None, None]), ("a", "S", 0, 1, ["Worker", "Days", "Daily Rate"]), ("a", "S", 0, 2, ["A", "๕", "฿1,000.50"]),
        ("a", "S", 0, 3, [None, "1.2.3", "7"]), ("a", "T", 1, 0, ["x", "y"]), ("a", "T", 1, 0, ["x", "y"]), ("a", "T", 1, 1, ["1", None]),
        ("b", "S", 0, 0, [None, None]), ("b", "S", 0, 1, None), ("b", "U", 1, 0, ["Item", "Qty", "Date"]), ("b", "U", 1, 1, ["cement", "-3", "16/01/25"]),
        ("b", "U", 1, 2, ["sand", "", "31/02/2025"]), (None, "S", 0, 0, ["Worker", "Days"]), (None, "S", 0, 1, ["B", "2"])]


def grid(spark):
    return spark.createDataFrame(ROWS, "file string, sheet string, sheet_idx int, row_idx long, cells array<string>")


def rows(df):
    return sorted(df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0])


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_short_sheets_import_as_tall_ones_do(spark):
    short, tall = ingest.import_grid(grid(spark)), ingest.import_grid(grid(spark), block=1)
    for part in ("headers", "sheet_types", "column_map", "body", "typed"):
        frames = [getattr(imp, part).filter("file is not null") for imp in (short, tall)]    # sheets without a file meet no import
        if part == "typed":
            frames = [df.withColumn("mapped", F.array_sort("mapped")) for df in frames]
        assert rows(frames[0]) == rows(frames[1]), part
    assert short.typed.count() == 4 and {r.n_bad for r in short.typed.collect()} == {0, 1}
    assert "hashpartitioning(file" not in plan(short.typed)      # no row is dealt by sheet again for its type


def test_headers_and_body_as_their_joins_give(spark):
    g = grid(spark)
    filled = G.grid_fill(g)
    want = G.header_detect(g, filled)
    headers, body = G.fill_and_search(g)
    assert plan(headers).count("Arguments: hashpartitioning(file") == 1
    assert rows(headers) == rows(want) and rows(body) == rows(G.body_rows(filled, want))
    assert [r.sheet for r in headers.collect()].count("T") == 2   # the header row that comes twice


def test_payloads_are_parsed_once(spark):
    bodies = ['{"events":[{"type":"message","message":{"type":"text","text":" hi "},"replyToken":"t"},null,{"type":"follow"}]}',
              '{"events":[]}', "{}", '{"events":[{"type"', None, '"text"', '{"events":7}']
    p = spark.createDataFrame([(str(i), "u", b) for i, b in enumerate(bodies)], "payload_id string, user_id string, body string")
    got = MS.event_scan(p)
    assert sorted((r.payload_id, r.event_idx, r.event_type, r.text, r.bad_json) for r in got.select(
        "payload_id", "event_idx", F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce("text", F.lit("")).alias("text"), "bad_json").collect()) == [
        ("0", 0, "message", " hi ", False), ("0", 1, "", "", False), ("0", 2, "follow", "", False), ("3", -1, "", "", True), ("4", -1, "", "", True)]
    assert "Union" not in plan(got)


def test_samples_as_body_and_headers_give(spark):
    more = [("a", "T", 1, r, [str(r), None, "z"]) for r in range(2, 9)] + [("c", "V", 0, 0, ["h", "h2"]), ("c", "V", 0, 1, [None, None])]
    g = spark.createDataFrame(ROWS + more, "file string, sheet string, sheet_idx int, row_idx long, cells array<string>")
    want = G.sheet_sample(*reversed(G.fill_and_search(g)), k=3)
    got = G.filled_samples(g, 3)
    assert rows(got) == rows(want) == rows(G.filled_samples(g, 3, block=1)) and got.count() >= 3
    assert plan(got).count("Arguments: hashpartitioning(file") == 1


def test_a_stored_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before = files()
    stored = store(df, "shuffled")
    until = time.time() + 20
    while files() - before and time.time() < until:     # executors are told to delete, not waited for
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(CLEANUP_CONF, None) is None
    assert stored.count() == df.count() == 7
