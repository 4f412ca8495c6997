"""Language id, toxicity and the pipeline: brute force for the parts, held-out accuracy for the whole."""

import zlib

import numpy as np
import pytest

from tallybook.llm import common, langid, queries, toxicity
from tallybook.llm.common import documents

MID = "/root/testdata/sf0.01"


def phrases(text, sample):
    """Greedy longest stretches of the text that occur in the sample."""
    n = i = 0
    while i < len(text):
        size = 1
        while i + size < len(text) and bytes(text[i:i + size + 1]) in sample:
            size += 1
        n, i = n + 1, i + size
    return n


def test_automaton_parses_like_searching():
    r = np.random.default_rng(3)
    for alphabet in (3, 6):
        sample = r.integers(0, alphabet - 1, 400).astype(np.uint8)      # the last code is not in the sample
        step = langid.automaton(sample.tolist(), alphabet)
        for _ in range(30):
            text = r.integers(0, alphabet, 60).astype(np.uint8)
            state, count = len(step) - alphabet, 0
            for c in text.tolist():
                v = int(step[state + c])
                count, state = count + (v & 1), v >> 1
            assert count == phrases(text.tobytes(), sample.tobytes())


def test_lockstep_equals_one_by_one():
    model = langid.Model({"a": ["the cat sat on the mat and the dog"], "b": ["der hund und die katze sind im haus"]})
    texts = ["the dog sat", "die katze", "x" * 700, "the mat " * 100, "Ünd 1234 hund", "q"]
    together = model.bits_per_char(texts)
    alone = np.concatenate([model.bits_per_char([t]) for t in texts])
    assert np.allclose(together, alone)
    for t, row in zip(texts, together):
        numbers = model.letters(t)
        for k in range(2):
            codes = model.alphabets[k].table[numbers]
            count = 0
            for lo in range(0, len(codes), langid.BLOCK):
                state, n = len(model.steps[k]) - model.alphabets[k].size, 0
                for c in codes[lo:lo + langid.BLOCK].tolist():
                    v = int(model.steps[k][state + c])
                    n, state = n + (v & 1), v >> 1
                count += n
            assert row[k] == pytest.approx(count * model.bits[k] / len(codes))


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in documents(spark, MID).select("doc_id", "lang").collect()}
    got = queries.op2_langid(spark, MID).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_odd_rows(odd, nothing):
    got = {(r.doc_id, r.lang_pred) for r in langid.learn_and_identify(odd, common.id_mod(4) == 2).collect()}
    said = dict(got)
    assert all(said[k] == "und" for k in (2, 3, 4)) and said[1] in ("en", "de") and said[7] in ("en", "de")
    assert len(langid.learn_and_identify(odd, common.id_mod(4) == 2).collect()) == 11
    assert langid.learn_and_identify(nothing, common.id_mod(4) == 2).collect() == []
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


def test_language_of_few_texts_beside_many_copies(spark):
    texts = [("en", "the cat sat on the mat and the dog ran away"), ("en", "we know what the weather will be tomorrow")]
    rows = [(i, *texts[i % 2][::-1]) for i in range(6000)]
    rows += [(10_000 + i, f"le chat numero {i} est sur la table et le chien {i * 7} court dans la rue", "fr") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = langid.learn_sample(df, text_col="text", lang_col="lang", rows=400, chars=200)
    assert len(sample["en"]) == 2 and len(sample["fr"]) == 300
    said = langid.identify(df, sample).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in said} == {"en": 6000, "fr": 300}


def test_languages_of_many_letters():
    """Scripts with more letters than codes, and two languages in each of two scripts."""
    r = np.random.default_rng(5)
    script = {"zh": range(0x4E00, 0x5A00), "ja": [*range(0x3041, 0x3090), *range(0x5200, 0x5600)], "ko": range(0xAC00, 0xB400),
              "ru": range(0x430, 0x44F), "el": range(0x3B1, 0x3C9), "th": range(0xE01, 0xE2F), "am": range(0x1200, 0x1240)}

    def words_of(lang, seed):
        g = np.random.default_rng(seed)
        return ["".join(map(chr, g.choice(list(script[lang]), 3))) for _ in range(400)]

    vocabulary = {lang: words_of(lang, k) for k, lang in enumerate(script)} | {"zh2": words_of("zh", 50), "ru2": words_of("ru", 51)}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang], n))
    model = langid.Model({lang: [text(lang, 50) for _ in range(60)] for lang in vocabulary})
    truth = [lang for lang in vocabulary for _ in range(20)]
    said = [lang for lang, _ in model.predict([text(lang, 20) for lang in truth])]
    assert sum(a == b for a, b in zip(truth, said)) >= 0.98 * len(truth)


def test_sample_is_bounded(spark):
    sample = langid.learn_sample(documents(spark, MID), text_col="text", lang_col="lang", rows=20, chars=50)
    assert sorted(sample) == ["de", "en", "es", "fr"]
    assert all(10 <= len(v) <= 20 and max(map(len, v)) <= 50 for v in sample.values())


def slow_score(net, text):
    """The net on one text, word by word."""
    words = toxicity.Words.of([text])
    x = net.embed[words.word] + net.embed[words.head]
    top = []
    for f, s in zip(net.filters, net.shift):
        best = np.full(toxicity.FILTERS, -np.inf)
        for i in range(len(x)):
            best = np.maximum(best, s + sum(x[i + k] @ f[k] for k in range(len(f)) if i + k < len(x)))
        top += np.maximum(best, 0).tolist()
    return float(np.dot(top, net.top) + net.bias)


def test_batches_score_like_single_texts():
    net = toxicity.Net()
    net.langs, net.profile, net.threshold, net.ready = ["a"], np.zeros((1 << toxicity.COARSE, 1), np.float32), np.zeros(1), True
    texts = ["one two three", "", "vier fünf, sechs! sieben", "x" * 50, "123 ...", "a b c d e f g"]
    together = net.scores(texts)
    assert together[1] == together[4] == 0
    for t, s in zip(texts, together):
        if any(c.isalpha() for c in t):
            z = slow_score(net, t) + np.log(0.7 / 0.3)
            assert s == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_toxicity_learns_words():
    r = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    make = lambda bad: " ".join([*r.choice(words, 40), *(["vilest"] * bad), *r.choice(words, 10)])
    y = [int(i % 4 == 0) for i in range(600)]
    net = toxicity.fit([make(t) for t in y], y, ["xx"] * 600, 0.25)
    test = [i % 2 for i in range(200)]
    assert np.mean((net.scores([make(t) for t in test]) >= 0.7) == np.array(test)) > 0.97


def test_toxicity_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (2, 1), (None, 1), (8, None)], "doc_id bigint, toxic int")
    net = toxicity.learn(odd, labels)
    got = toxicity.score(odd, net).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    none = toxicity.learn(nothing, labels)
    assert {r.predicted for r in toxicity.score(odd, none).collect()} == {0}
    assert toxicity.score(nothing, net).collect() == []
    assert toxicity.without_toxic(odd, none).count() == 11


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    clean = [r.predicted for r in got if not labels[r.doc_id]]
    toxic = [r.predicted for r in got if labels[r.doc_id]]
    assert np.mean(clean) < 0.03 and np.mean(toxic) > 0.6


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = documents(spark, MID)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.keep(stage(spark, docs, MID), "test-stage")
        if name != "packing":
            assert out.columns == docs.columns
            counts.append(out.count())
        docs, before = out, docs
        if name == "toxicity":
            kept = {r.doc_id for r in out.collect()}
            gone = {r.doc_id for r in before.collect()} - kept
            assert sum(labels.get(i, 1) for i in gone) >= 0.7 * len(gone)
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    pieces = docs.collect()
    assert len({p.doc_id for p in pieces}) == counts[4]
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
