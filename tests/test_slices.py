"""Slices of a stream's input: many files each, in order."""

import uuid

import pytest
from pyspark.sql import functions as F

from tallybook.plans import q_stream as Q
from tallybook.session import checkpoint_dir
from tallybook.sources import stored as S

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small(spark, monkeypatch):
    top = f"{checkpoint_dir(spark)}/slices-{uuid.uuid4().hex[:8]}"
    monkeypatch.setattr(S, "stored_path", lambda spark, name, sf_dir: f"{top}/{name}")
    monkeypatch.setattr(S, "SLICE_ROWS", 40)


@pytest.mark.parametrize("order", ["id", "few"])
def test_slices_of_many_files(spark, small, order):
    made = spark.range(1000).select("id", F.when(F.col("id") < 990, 0).otherwise(F.col("id") - 985).alias("few"))
    path, each = S.stored_slices(spark, order, SF, lambda: made, order)
    assert each == 7 and S.stored_slices(spark, order, SF, None, order) == (path, each)
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).collect()
    assert sorted(r.id for r in rows) == list(range(1000))
    assert S._n_files(spark, path) % each == 0
    if order == "id":
        files = sorted({(r.t, r.f) for r in rows})
        assert len(files) == 28
        slices = [{f for _, f in files[i:i + 7]} for i in range(0, 28, 7)]
        ends = [(min(r.id for r in rows if r.f in s), max(r.id for r in rows if r.f in s)) for s in slices]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("key", ["usage_stream", "session_stream", "message_stream"])
def test_streams_over_slices_of_many_files(spark, small, key, monkeypatch):
    many = sorted(map(str, getattr(Q, key)(spark, SF).collect()))
    monkeypatch.setattr(S, "stored_path", lambda spark, name, sf_dir, top=f"{checkpoint_dir(spark)}/one-{uuid.uuid4().hex[:8]}": f"{top}/{name}")
    monkeypatch.setattr(S, "SLICE_ROWS", 1 << 30)
    assert sorted(map(str, getattr(Q, key)(spark, SF).collect())) == many
