"""Learning takes every labelled row, whole, however long its text is and however many tasks hold the rows."""

import numpy as np

from tallybook.llm import toxicity


def rows(spark, n, words):
    r = np.random.default_rng(5)
    pool = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    make = lambda bad: " ".join([*r.choice(pool, words), *(["vilest"] * bad), *r.choice(pool, 10)])
    data = [(i, make(i % 4 == 0), "xx" if i % 3 else None, int(i % 4 == 0)) for i in range(n)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, toxic int")
    return df.drop("toxic"), df.select("doc_id", "toxic")


def right(spark, net, words):
    docs, labels = rows(spark, 120, words)
    said = {r.doc_id: r.predicted for r in toxicity.score(docs, net).collect()}
    return np.mean([said[r.doc_id] == r.toxic for r in labels.collect()])


def test_long_texts_are_learned_from(spark):
    docs, labels = rows(spark, 300, 6_000)       # 24,000 bytes each
    net = toxicity.learn(docs, labels)
    assert net.ready and right(spark, net, 40) > 0.95


def test_several_shards_learn_one_net(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    docs, labels = rows(spark, 900, 40)
    assert toxicity.examples(docs, labels, "doc_id", "text", "lang", "toxic").select("shard").distinct().count() == 5
    net = toxicity.learn(docs, labels)
    assert right(spark, net, 40) > 0.95


def test_examples_shuffle_a_text_once(spark, monkeypatch):
    """Texts and their names meet in the shard; null ids and texts, equal texts of several ids and repeated rows as ever."""
    plans, keep = {}, toxicity.keep

    def noted(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name, *more)

    monkeypatch.setattr(toxicity, "keep", noted)
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", None), (2, "a", "w"), (3, "b", None), (3, "c", "y"), (4, "d", "y"), (None, "e", "y"), (5, None, "y"), (6, "f", "z")],
                                 "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (5, 1), (None, 1), (6, None), (9, 1)], "doc_id bigint, toxic int")
    got = toxicity.examples(docs, labels, "doc_id", "text", "lang", "toxic")
    assert got.columns == ["h", "t", "l", "toxic", "back", "shard"]
    assert sorted((r.t, r.l, r.toxic) for r in got.collect()) == [("a", "x", 1), ("b", None, 0), ("c", "y", 0)]
    plan = plans["toxic-examples"]
    assert plan.count("Exchange ") == 1 and "Join" not in plan
