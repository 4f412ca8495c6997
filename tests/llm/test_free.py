"""Quality rules, license scans and packing against plain Python."""

import re
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from tallybook.llm import licenses, packing, quality

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BLANK = "[^\x20\x09-\x0D]+"


def base(text):
    words = re.findall(BLANK, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(BLANK, x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_measures(docs, odd, nothing):
    for df in (docs, odd):
        got = quality.judge(df).collect()
        want = Counter((r.doc_id, *base(r.text)) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed and r.quality >= 0.5) and 0 <= r.quality <= 1
    assert quality.judge(nothing).collect() == []


def test_quality_labels(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(docs.inputFiles()[0].replace("documents", "labels")).collect()}
    got = [(r.kept, labels[r.doc_id]) for r in quality.judge(docs).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(k == bool(y) for k, y in got) >= 0.97 * len(got)


def test_em_finds_planted_accuracies():
    r = np.random.default_rng(1)
    right = [0.95, 0.9, 0.85, 0.6, 0.8, 0.75]
    y = r.random(20_000) < 0.8
    votes = [[0 if r.random() < 0.2 else (1 if (r.random() < a) == t else -1) for a in right] for t in y]
    post = quality.estimate(sorted(Counter(map(tuple, votes)).items()))
    assert np.mean([(post[tuple(v)] >= 0.5) == t for v, t in zip(votes, y)]) > 0.95
    assert quality.estimate([]) == {} and 0 < quality.estimate([((0, 0), 3)])[0, 0] < 1


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def within(words, phrase, edits):
    """Does a run of whole words lie within so many edits of the phrase (Sellers' recurrence)."""
    text = " ".join(words)
    starts = {0, *(i + 1 for i, c in enumerate(text) if c == " ")}
    ends = {len(text), *(i for i, c in enumerate(text) if c == " ")}
    for s in starts:
        row = list(range(len(phrase) + 1))
        if len(phrase) <= edits:
            return True
        for j in range(s, min(len(text), s + len(phrase) + edits)):
            new = [row[0] + 1]
            for i, c in enumerate(phrase, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != text[j])))
            row = new
            if j + 1 in ends and row[-1] <= edits:
                return True
    return False


def test_licenses(docs, odd, nothing):
    for df in (docs, odd):
        rows = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect()}
        want = set()
        for r in df.select("doc_id", "text").collect():
            w = words_of(r.text)
            places, labels = [], set()
            for phrase, label in licenses.BASE.items():
                p = phrase.split()
                hit = [i for i in range(len(w)) if w[i:i + len(p)] == p]
                places += hit
                labels |= {label} if hit else set()
            want.add((r.doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
        assert rows == want
    assert licenses.scan(nothing).collect() == []


TEXTS = ["Released under teh MIT license.", "gnu lesser genral public licence", "All rigths reserved", "all right reserved now", "ALL RIGHTS RESERVED",
         "the apache licence, version 2.0", "apachelicense version 2 0", "Mozila Publc License", "mozilla fun license", "creative comons attribution sharealike",
         "permission is hereby granted, free of charge to any persn obtaining a copy of this softwre", "nothing at all here", "",
         "licensed under cc by", "x licensed undr cc by nc y", "eclipse public license and mozilla public license", "mit license mit license"]


def noted(w, phrase, edits):
    """Does the notice stand in the words; before a bar without edits."""
    head, _, rest = phrase.rpartition("|")
    if not head:
        return within(w, rest, edits)
    first = head.split()
    return any(w[i:i + len(first)] == first and regex.fullmatch(f"(?:{rest}){{e<={edits}}}", " ".join(w[i + len(first):j]))
               for i in range(len(w)) for j in range(i + len(first) + 1, i + len(first) + 4))


@pytest.mark.parametrize("text, labels", [
    ("MIT Licence", "mit"), ("Apache Lisence", "apache"), ("Creative Commons by 4.0", "cc-by"), ("the apache licenses of old", "apache"), ("limit license", ""),
    ("it license", ""), ("apache silence", ""), ("commit lisence", "")])
def test_bare_notices(text, labels):
    assert licenses.scan_text(text, licenses.Scanner())[5] == labels


@pytest.mark.parametrize("text", TEXTS)
def test_fuzzy_notices(text):
    find = licenses.Scanner()
    row = licenses.scan_text(text, find)
    w = words_of(text)
    want = {label for label, phrase, edits in licenses.NOTICES if noted(w, phrase, edits)} | set(filter(None, row[4].split(",")))
    assert set(filter(None, row[5].split(","))) == want
    for s in row[7]:
        assert any(noted(w[s["first_word"]:s["first_word"] + s["n_words"]], p, e) for name, p, e in licenses.NOTICES if name == s["label"])
    assert 0 <= row[6] <= 1 and (row[6] > 0) == bool(row[5])


def check_pieces(rows, got, window):
    whole = Tokenizer.from_file(VOCABULARY)
    made = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    docs, rooms = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        docs[r.doc_id].append((r.sequence_id, r.offset, r.start, r.doc_tokens, ids))
        rooms[r.sequence_id].append((r.offset, r.length))
    for s in rooms.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= window
    built = Counter()
    for i, pieces in docs.items():
        pieces.sort(key=lambda p: p[:2])
        text = []
        for _, _, start, n, ids in pieces:
            assert start == len(text)
            text += ids.tolist()
            if len(text) == n:
                built[i, tuple(text)] += 1
                text = []
        assert not text
    assert built == made
    lengths = [s[-1][0] + s[-1][1] for s in rooms.values()]
    return sum(0 if n & (n - 1) == 0 else window - n for n in lengths) / max(1, sum(lengths))


def test_packing(docs, odd, nothing):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert check_pieces(rows, packing.pack(docs, VOCABULARY, end_id=2).collect(), 4096) < 0.02
    check_pieces(rows, packing.pack(docs, VOCABULARY, end_id=2, window=64, stride=8).collect(), 64)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check_pieces(rows, packing.pack(odd, VOCABULARY, end_id=2).collect(), 4096)
    assert packing.pack(nothing, VOCABULARY, end_id=2).collect() == []


def test_words_encode_like_whole_texts():
    odd = ["İstanbul ΣΊΣΥΦΟΣ ς", "don't  stop...now , a.b , ,x. <|endoftext|> <|ENDOFTEXT|>", "été Å Å", "tab\tand\x1cfs em\r\nnl",
           "a" * 300 + " " + "中文字 123,456.78 ½", "  ", "", "We'LL 'S ́ x", "naïve. Élan, ß.", "x́. ẛ̣,"]
    e = packing.Encoder(VOCABULARY, 2)
    for _ in range(2):
        for t, b in zip(odd, e(odd)):
            assert np.frombuffer(b, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [2], t


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(4)
    for _ in range(60):
        places = np.cumsum(np.append(0, r.integers(1, 7, 14))).tolist()
        costs = [0.0, *r.choice([0.0, 4.0, 24.0], 13).tolist(), 0.0]
        window = 12

        def price(bounds):
            return sum(window - (b - a) for a, b in zip(bounds[:-1], bounds[1:-1])) + sum(costs[places.index(b)] for b in bounds[1:-1])

        best = {places[0]: 0.0}
        for j in range(1, len(places)):
            padding = lambda p: window - (places[j] - p) if j < len(places) - 1 else 0  # noqa: B023, E731
            best[places[j]] = costs[j] + min(best[p] + padding(p) for p in places[:j] if places[j] - p <= window)
        got = packing.cuts(places, costs, window)
        assert got[0] == 0 and got[-1] == places[-1] and max(b - a for a, b in zip(got, got[1:])) <= window
        assert price(got) == pytest.approx(best[places[-1]])


def test_words_equal_whole_texts_on_odd_letters():
    """Capital sigma, dotted capital I, marks after letters, combining marks, special tokens' beginnings."""
    r = random.Random(3)
    pool = "aİI.,Σςσßé<| |>\n\t!?'中🙂 ́ẞ1"
    texts = ["".join(r.choice(pool) if i % 2 or r.random() < 0.5 else chr(r.choice([r.randrange(0xD800), r.randrange(0x20, 0x500)]))
                     for _ in range(r.randrange(14))) for i in range(100_000)]
    whole, words = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY, 2)
    want = [e.ids + [2] for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    wrong = [t for t, w, g in zip(texts, want, words(texts)) if np.frombuffer(g, "<u4").tolist() != w]
    assert not wrong, wrong[:5]


def test_marks_that_join_only_the_small_letter():
    """NFC leaves a capital with dialytika and an accent as two characters; lower-cased first, they would join."""
    texts = ["Ϋ́", "1Ϋ́'x", "ẞΪ́ ", "á ΫA", "plain Text"]
    whole, words = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY, 2)
    for t, b in zip(texts, words(texts)):
        assert np.frombuffer(b, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids + [2], t
