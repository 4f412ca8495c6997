"""Sharding, exact dedup and mixing against plain Python."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import pytest

from tallybook.llm import exactdedup, mixing, queries, sharding


def score(key, shard, weight):
    u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -weight / math.log(u), -shard


def shard_of(key, weights):
    key = "null" if key is None else key
    return -max(score(key, i, w) for i, w in enumerate(weights) if w > 0)[1]


def check_shards(rows, got, weights):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), shard_of(i, weights), shard_of(i, [*weights, 1.0]))
                   for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, len(weights))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("weights", [[1.0] * 16, [1.0, 2.0, 0.0, 5.0]])
def test_shards(docs, odd, weights):
    for df in (docs, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        check_shards(rows, sharding.shard_rows(df, weights).collect(), weights)


def test_shard_weights_hold(spark):
    n = Counter(r.shard for r in sharding.shard_rows(spark.range(8000).selectExpr("id as doc_id", "'x' as text"), [1.0, 3.0]).collect())
    assert 0.72 < n[1] / 8000 < 0.78


def test_shards_empty_and_bad(nothing):
    assert sharding.shard_rows(nothing, [1.0]).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(nothing, [0.0])


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, [1.0] * 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert all(r.shard == shard_of(r.doc_id, [1.0] * 4) for r in back.select("doc_id", "shard").collect())


def groups(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    by = defaultdict(list)
    for i, t in rows:
        by[low(t)].append(i)
    return Counter((i, max((x for x in by[low(t)] if x is not None), default=None), len(by[low(t)]),
                    hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows), len(by)


def test_exact_groups(docs, odd):
    for df in (docs, odd):
        want, n = groups([tuple(r) for r in df.select("doc_id", "text").collect()])
        got = exactdedup.exact_groups(df).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == n and all(r.doc_id == r.keep_id for r in kept)


def test_exact_empty(nothing):
    assert exactdedup.exact_groups(nothing).collect() == []


def test_one_name_for_two_chunks(spark):
    """Chunks that share a 64-bit name are told apart by their proofs."""
    rows = spark.createDataFrame([(1, [5, 6], ["a", "b"]), (2, [5, 6], ["a", "c"]), (3, [5, 6], ["a", "b"]), (4, [], [])],
                                 "row bigint, names array<bigint>, proofs array<string>")
    got = {r.row: [tuple(x) for x in r.extra] for r in exactdedup.verified(rows).collect()}
    assert got[1] == got[3] != got[2] and got[4] == []


def test_chunks_join_to_the_text(spark, odd):
    text = "".join(chr(97 + i * i % 26) for i in range(20_000)) + "\n" + "Long sentence. " * 900
    df = odd.select("text").unionAll(spark.createDataFrame([(text,)], "text string")).filter("text is not null")
    from pyspark.sql import functions as F
    for r in df.select("text", exactdedup.chunks(F.col("text")).alias("c")).collect():
        assert "".join(r.c) == r.text and all(0 < len(c) <= 4096 for c in r.c)


def slow_cycle(share):
    """Earliest deadline first by trying every released block at every slot."""
    total, done, out = sum(share), [0] * len(share), []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // n), s) for s, n in enumerate(share) if done[s] < n and done[s] * total // n <= t]
        due, s = min(ready)
        assert due > t
        out.append(s)
        done[s] += 1
    return out


@pytest.mark.parametrize("share", [[1], [1, 1], [7, 2, 1], [500, 300, 100, 99, 25], [1] * 9 + [55]])
def test_cycle_stays_within_one_block(share):
    got = mixing.cycle(share)
    assert got == slow_cycle(share)
    n = [0] * len(share)
    for t, s in enumerate(got, 1):
        n[s] += 1
        assert all(abs(n[k] - share[k] * t / len(got)) < 1 for k in range(len(share)))


def test_mixed_documents(spark, docs):
    got = queries.op7_mix(spark, os.path.dirname(docs.inputFiles()[0].removeprefix("file:").removeprefix("//"))).collect()
    check_mix(got, Counter(r.source for r in docs.collect()), 16, 0.5)


def check_mix(got, counts, block, temper):
    names = sorted(counts, key=lambda c: (c is not None, c or ""))
    plan = mixing.plan([-(-counts[s] // block) for s in names], [counts[s] ** temper for s in names])
    slot = {}
    for p in plan:
        for b in range(p["first"], p["last"]):
            q, n = b - p["first"], len(p["slots"])
            slot[names[p["s"]], b] = p["start"] + q // n * p["total"] + p["slots"][q % n]
    assert sorted(slot.values()) == list(range(len(slot)))
    ranks = defaultdict(list)
    for r in got:
        assert r.slot == slot[r.source, r.source_rank // block] and r.position == r.slot * block + r.source_rank % block
        ranks[r.source].append(r.source_rank)
    assert all(sorted(v) == list(range(counts[s])) for s, v in ranks.items()) and ranks.keys() == counts.keys()


def test_mixed_odd_rows(spark, odd, nothing):
    got = mixing.mixed(odd, block_rows=2).collect()
    check_mix(got, Counter(r.source for r in odd.collect()), 2, 0.5)
    out = mixing.in_mixed_order(odd, block_rows=2)
    assert out.columns == odd.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert mixing.mixed(nothing).collect() == [] and mixing.in_mixed_order(nothing).collect() == []
    with pytest.raises(ValueError):
        mixing.mixed(odd, {"a": 1.0, "b": 0.0, "c": 1.0, None: 1.0})


def test_order_of_files(spark, docs):
    wide = docs.repartition(5)
    placed = {r.row.doc_id: r.position for r in mixing.mixed(docs.coalesce(1)).collect()}
    out = mixing.in_mixed_order(docs.coalesce(1)).collect()
    assert [placed[r.doc_id] for r in out] == sorted(placed.values())
    assert mixing.in_mixed_order(wide).count() == docs.count()
