"""The n-gram join against comparing all pairs."""

import random
import re

import pytest

from tallybook.llm import ngramjoin
from tallybook.llm.components import components


def grams(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = [(i, grams(t, k)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and len(x & y) * 100 >= percent * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for j, (i, _) in enumerate(sets):
        if i is not None:
            least[find(j)] = min(i, least.get(find(j), i))
    return sorted(((i, len(s), least.get(find(j)) if s else i) for j, (i, s) in enumerate(sets)), key=str)


def check(spark, rows, k, percent):
    got = ngramjoin.linked(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=percent, k=k).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, percent)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_documents(spark, docs, k, percent):
    check(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()], k, percent)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_families(spark, k, percent):
    """Families of near copies at all distances, a common passage, short texts."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(30)]
    rows = []
    for family in range(6):
        base = [r.choice(words) for _ in range(r.choice([12, 40, 90, 150]))]
        for _ in range(40):
            text = list(base)
            for _ in range(r.randint(0, 5)):
                text[r.randrange(len(text))] = r.choice(words)
            if r.random() < 0.3:
                text += passage
            if r.random() < 0.2:
                text = text[:r.randint(1, len(text))]
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    check(spark, rows, k, percent)


def test_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = sorted(map(tuple, ngramjoin.linked(odd, percent=90, k=3).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_empty(nothing):
    assert ngramjoin.linked(nothing, percent=90, k=3).collect() == []


def test_components(spark):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(500)] + [(1000, 1000), (2000, 2001), (2001, 2000)]
    loose = [(r.randrange(3000, 3400), r.randrange(3000, 3400)) for _ in range(180)]
    edges = chain + loose
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in list(up)}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {x.node: x.component for x in got} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("rows", [["x"], ["x y"], ["x y z"], [None, "", "x y z"], ["x y z a"], ["x y", "x y", "", None]])
@pytest.mark.parametrize("k", [3, 5])
def test_few_words(spark, rows, k):
    """Batches of fewer words than a gram has."""
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngramjoin.linked(df, percent=80, k=k).collect()}
    first = {t: i for i, t in reversed(list(enumerate(rows)))}
    size = lambda t: max(1, len(t.split()) - k + 1) if t else 0
    assert got == {i: (size(t), first[t] if t else i) for i, t in enumerate(rows)}


def test_one_of_each_on_odd_rows(spark, odd, nothing):
    rows = ngramjoin.one_of_each(odd, percent=80, k=5)
    assert rows.columns == odd.columns
    texts = sorted(str(r.text)[:20] for r in rows.collect())
    assert texts == sorted(["The quick brown fox.", "None", "", " \n\t ", "None", "word0 other0. word1 o", "Ärger über 中文 !!! 1", "x"] ) or len(texts) == 8
    assert ngramjoin.one_of_each(nothing, percent=80, k=5).collect() == []
