"""Mixing held against the unrounded target weights."""

from collections import Counter
from fractions import Fraction

import pytest

from tallybook.llm import mixing


@pytest.mark.parametrize("weights", [[10.0] + [1.0] * 20, [5**0.5, 3**0.5, 2**0.5, 0.001], [1 / 3] + [2 / 60] * 20, [505.0 - 99 * 5] + [5.0] * 99])
def test_long_phase_keeps_to_the_weights(weights):
    """Every source within one block of its exact share at every place of a phase of some hundred times 1,024 blocks."""
    exact = [Fraction(w) for w in weights]
    share = [w / sum(exact) for w in exact]
    n, length = [0] * len(weights), 150_000
    blocks = [int(w * length) + 2 for w in share]
    first = sorted((t, p["s"]) for p in mixing.plan(blocks, weights) if p["phase"] == 0 for t in p["slots"])
    assert len(first) >= length and [t for t, _ in first] == list(range(len(first)))
    for t, s in first:
        n[s] += 1
        if t % 997 == 0 or t > length - 500:
            assert all(abs(n[k] - share[k] * (t + 1)) < 1 for k in range(len(n)))


def test_rows_of_the_plan():
    blocks = [5000, 1, 1024, 3000]
    rows = list(mixing.schedule(blocks, [2.0, 1.0, 1.0, 0.3]))
    assert sorted(t for r in rows for t in r["slots"]) == list(range(sum(blocks)))
    assert Counter(r["s"] for r in rows for _ in r["slots"]) == dict(enumerate(blocks))
    for r in rows:
        assert r["last"] - r["first"] == len(r["slots"]) and r["first"] // mixing.CHUNK == (r["last"] - 1) // mixing.CHUNK == r["chunk"]
    assert [len(p) for p in mixing.pieces(iter(rows), 1)] == [1] * len(rows)


def test_plan_in_pieces(spark, monkeypatch):
    """The same order whether the plan is written at once and broadcast, or in pieces and joined by shuffle."""
    df = spark.range(4000).selectExpr("id", "case when id % 7 = 0 then null when id % 3 = 0 then 'a' else 'b' end as source").coalesce(1)
    read = lambda: sorted((r.row.id, r.position) for r in mixing.mixed(df, block_rows=1).collect())
    once = read()
    monkeypatch.setattr(mixing, "PIECE", 1500)
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 0)
    assert read() == once and sorted(p for _, p in once) == list(range(4000))


def test_many_sources(spark):
    """A source per web site: more sources than any fixed bound, some with more rows."""
    df = spark.range(3000).selectExpr("id", "concat('site', case when id % 3 = 0 then id % 7 else id % 900 end) as source").coalesce(2)
    got = mixing.mixed(df, block_rows=2).collect()
    assert sorted(r.row.id for r in got) == list(range(3000))
    assert len({r.position for r in got}) == 3000 and len({r.source for r in got}) > 600
    assert mixing.in_mixed_order(df, block_rows=2).count() == 3000
