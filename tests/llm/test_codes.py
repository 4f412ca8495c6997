"""Byte-level BPE, vector codes and the source audit against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallybook.llm import bytebpe, divergence, queries, vectorcode

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def code():
    return bytebpe.Coder(RANKS, PATTERN)


def numbers(raw):
    return np.frombuffer(raw, "<u4")


def odd_texts(n, seed=0):
    r = random.Random(seed)
    pools = ["ab -'!\n\r\t  ", "aaaaaaa---- ==", "İßΣςé中文字ไทย한글🙂👩‍👩‍👧‍́", "0123456789.,", "<|endoftext|>'s'll've're", "\x1c\x1f\x85\xa0  　﻿\x00 \n",
             "abababababcabc", "".join(map(chr, range(0x20, 0x250)))]
    for _ in range(n):
        if r.random() < 0.2:
            yield "".join(chr(r.choice([r.randrange(0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randrange(12)))
        else:
            pool = "".join(r.sample(pools, r.randrange(1, 3)))
            yield "".join(r.choice(pool) for _ in range(r.randrange(60)))


def test_bpe_odd_texts(code, reference):
    texts = list(odd_texts(20_000))
    got = code.encode(texts)
    for text, ids in zip(texts, got):
        assert numbers(ids).tolist() == reference.encode_ordinary(text)
        assert code.decode(numbers(ids)).decode() == text


def test_bpe_classes_of_all_characters(code, reference):
    texts = [f"a{c}1{c}!{c}  {c}{c} a" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and ord(c) % 7 in (0, 3) or ord(c) < 0x3100]
    for text, ids in zip(texts, code.encode(texts)):
        assert numbers(ids).tolist() == reference.encode_ordinary(text), hex(ord(text[1]))


def test_bpe_pieces_join_to_the_whole(reference):
    text = "".join(odd_texts(3000, 4)) + "中文。" * 500
    pieces = list(bytebpe.pieces_of(text, 300))
    assert "".join(pieces) == text and len(pieces) > 50
    assert [i for p in pieces for i in reference.encode_ordinary(p)] == reference.encode_ordinary(text)


def test_bpe_other_pattern(reference):
    pattern = r"\p{N}{1,3}|[^\s\p{N}]+|\s+"
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    own = bytebpe.Coder(RANKS, pattern)
    texts = list(odd_texts(2000, 5))
    assert [numbers(i).tolist() for i in own.encode(texts)] == [other.encode_ordinary(t) for t in texts]


def test_bpe_memo_is_bounded(code, monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMO", 50)
    for _ in range(3):
        code.encode([" ".join(f"w{i}x" for i in range(200)) + " " + "y" * 500])
        assert len(code.memo) <= 50


def test_bpe_offsets(spark):
    rows = [(1, "Größe 🙂 中文 don't"), (2, None), (3, ""), (4, "🙂🙂")]
    out = bytebpe.encoded(spark.createDataFrame(rows, "doc_id int, text string"), RANKS, PATTERN, offsets=True).collect()
    table = bytebpe.Coder(RANKS, PATTERN).tokens
    for r in out:
        text = dict(rows)[r["doc_id"]] or ""
        ids = numbers(bytes(r["ids"])).tolist()
        assert len(ids) == r["n_tokens"] == len(r["char_start"]) == len(r["char_end"])
        at = 0
        for i, s, e in zip(ids, r["char_start"], r["char_end"]):
            assert s == len(text.encode()[:at + 1].decode("utf-8", "ignore") + "?") - 1 or s < e
            at += len(table[i])
            assert table[i] in text[s:e].encode()
        assert at == len(text.encode())
        if text:
            assert min(r["char_start"]) == 0 and max(r["char_end"]) == len(text)


def test_bpe_decode_split_characters(spark, reference):
    ids = np.array(reference.encode_ordinary("中🙂"), "<u4")
    rows = [(1, ids.tobytes(), "x"), (2, ids[:-1].tobytes(), "x"), (3, b"", "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "k int, ids binary, decoded string")
    got = {r["k"]: r["decoded"] for r in bytebpe.decoded(df, RANKS, PATTERN, as_text=True).collect()}
    assert got[1] == "中🙂" and got[3] == "" and got[4] is None
    assert got[2].startswith("中") and got[2].endswith("�")
    raw = {r["k"]: r["decoded"] for r in bytebpe.decoded(df, RANKS, PATTERN).collect()}
    assert bytes(raw[1]) == "中🙂".encode()


def test_bpe_query(spark, reference):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_byte_bpe(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(reference.encode_ordinary(d["text"] or ""), "<u4")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_bpe_odd_rows(odd, nothing):
    out = bytebpe.decoded(bytebpe.encoded(odd, RANKS, PATTERN, offsets=True), RANKS, PATTERN, as_text=True).collect()
    assert sorted((r["doc_id"] or -1, r["decoded"]) for r in out) == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.collect())
    assert bytebpe.decoded(bytebpe.encoded(nothing, RANKS, PATTERN), RANKS, PATTERN).count() == 0


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Whole search over all entries, in Python numbers."""
    good = [(i, lab, [int(np.floor(256 * np.float64(v))) for v in x]) for i, x, lab in rows
            if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(good[0][2]) // parts
    cut = [[r[2][p * w:(p + 1) * w] for p in range(parts)] for r in good]
    books = [[cut[e][p] for e in range(min(entries, len(good)))] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [[min((dist(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        given = nearest()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, given) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(v) // len(mine) for v in zip(*mine)]
    given = nearest()
    label = collections.Counter()
    for r, g in zip(good, given):
        label[r[1]] += sum(d for d, _ in g)
    rows = sorted((r[0] if r[0] is not None else -1, "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g), label[r[1]]) for r, g in zip(good, given))
    flat = ",".join(str(v) for p in books for e in p for v in e)
    return rows, hashlib.sha256(flat.encode()).hexdigest()


VECTORS = "vec_id bigint, embedding array<float>, label int"


def ran_codes(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{VECTORS}, code string, ints int")
    coded, books = vectorcode.encoded(df)
    out = vectorcode.with_label_error(coded).collect()
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["code"], r["error"], r["label_error"]) for r in out), vectorcode.codebooks_digest(books)


def test_nearest_entries_with_ties():
    r = np.random.default_rng(1)
    for t in range(150):
        n, k, d = r.integers(1, 300), r.integers(1, 65), r.integers(1, 5)
        x = r.integers(-6, 7, (n, d)) if t % 2 else r.integers(-60, 70, (n, d))
        e = x[:k]
        full = ((x[:, None] - e[None]) ** 2).sum(2)
        for old in (np.zeros(n, np.uint8), r.integers(0, len(e), n).astype(np.uint8), full.argmin(1).astype(np.uint8)):
            index, best, _ = vectorcode.reassign(x, e, old)
            assert (index == full.argmin(1)).all() and (best == full.min(1)).all()


def test_core_and_rings_spare_distances():
    r = np.random.default_rng(2)
    centers = r.integers(-2000, 2000, (64, 4))
    x = centers[r.integers(0, 64, 5000)] + r.integers(-20, 20, (5000, 4))
    index, _, _ = vectorcode.reassign(x, centers, np.zeros(5000, np.uint8))
    assert vectorcode.reassign(x, centers, index.astype(np.uint8))[2] < 2 * 5000


@pytest.mark.parametrize("n", [3, 64, 300])
def test_codes(spark, n):
    r = random.Random(n)
    rows = [(r.randrange(n), [r.choice([r.gauss(0, 1), 0.25, -0.5]) for _ in range(32)], r.choice([1, 2, None])) for _ in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1], 7)]
    bad = [(5, None, 1), (6, [], 1), (7, [None] * 32, 1), (8, [float("nan")] * 32, 2), (9, [float("inf")] + [0.0] * 31, None)]
    assert ran_codes(spark, rows + [b for b in bad if b[1] != []]) == brute_codes(rows)


def test_codes_of_nothing(spark):
    assert ran_codes(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    assert ran_codes(spark, [(1, None, 1)])[0] == []


def test_codes_refuse(spark):
    with pytest.raises(ValueError):
        vectorcode.encoded(spark.createDataFrame([(1, [1.0] * 15, 1)], VECTORS))
    with pytest.raises(Exception, match="differ in length"):
        vectorcode.encoded(spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], VECTORS))
    with pytest.raises(Exception, match="too large"):
        vectorcode.encoded(spark.createDataFrame([(1, [1e30] * 16, 1)], VECTORS))


def brute_audit(rows, least=10, top=10):
    rows = [((text or ""), (lang or ""), (source or "")) for text, lang, source in rows]
    fold = {i: i + 32 for i in range(65, 91)}
    found = [(lang, source, collections.Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(fold)))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in found}:
        mine = [r for r in found if r[0] == lang]
        docs = collections.Counter(t for r in mine for t in r[2])
        kept = sorted(t for t in docs if docs[t] >= least)
        counts = {s: collections.Counter() for _, s, _ in mine}
        for _, s, c in mine:
            counts[s].update({t: c[t] for t in c if docs[t] >= least})
        whole = sum(counts.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in counts.items():
            pair = [(-sum(f(p(c, t), p(o, t)) for t in kept), name.encode()) for name, o in counts.items() if name != s]
            term = [(-f(p(c, t), p(whole, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return sorted(out)


def audit(spark, rows, **k):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, source string, term string, n int, p int")
    return sorted(map(tuple, divergence.audited(df, **k).collect()))


def audit_rows(seed, n, sources, words):
    r = random.Random(seed)
    for _ in range(n):
        lang = r.choice(["en", "de", None, ""])
        text = r.choice([None, "", " ".join(r.choice(words[:r.randrange(1, len(words))]) for _ in range(r.randrange(40)))]) if r.random() < 0.2 else \
            " ".join(r.choice(words) for _ in range(r.randrange(60)))
        yield text, lang, r.choice(sources)


def test_audit(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Ünder", "ÜNDER", "don't", "A1b2", "中文", "x_y", "Z"]
    rows = list(audit_rows(1, 400, ["a", "b", "c", None, "É", "z" * 40], words)) + [("... 123", "fr", "only"), (None, "fr", "other"), ("aa", "it", "one")]
    assert audit(spark, rows) == brute_audit(rows)


def test_audit_in_many_blocks(spark, monkeypatch):
    for name, value in (("TERMS", 16), ("SOURCES", 3), ("COLUMNS", 10)):
        monkeypatch.setattr(divergence, name, value)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = [(t, "en", s) for t, _, s in audit_rows(2, 300, [f"s{i}" for i in range(11)], words)]
    level = np.array([[1, 0, 2, 0], [0, 0, 2, 1], [5, 5, 0, 0]])
    price = level * 100 + 7 + np.arange(4)
    price[level == 0] = np.tile(7 + np.arange(4), (3, 1))[level == 0]
    f = lambda a, b: (a - b) ** 2 // (a + b)
    want = [[sum(f(int(x[s]), int(x[t])) - f(7 + s, 7 + t) for x in price) for t in range(4)] for s in range(4)]
    assert divergence.joint_prices(level, price, 7 + np.arange(4), 0).tolist() == want
    right = divergence.joint_prices(level, price, 7 + np.arange(4), 2)
    assert right[:2, 2:].tolist() == [row[2:] for row in want[:2]] and not right[2:].any()
    assert audit(spark, rows) == brute_audit(rows)


def test_audit_long_text_and_empty(spark, nothing, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "ENTRIES", 20)
    rows = [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i * 7 % 26)}" for i in range(500)), "en", f"s{k % 3}") for k in range(12)]
    assert audit(spark, rows) == brute_audit(rows)
    assert divergence.audited(nothing).count() == 0


def test_audit_without_kept_terms(spark):
    rows = [("one two", "en", "a"), ("three", "en", "b"), (None, "en", "c")]
    got = audit(spark, rows)
    assert got == brute_audit(rows) and {r[4] for r in got} == {0} and len(got) == 6
