"""Toxicity by a convolutional text classifier, trained in numpy.

Words become hashed embeddings (the word and its first letters), filters of several
widths run over them, each filter keeps its maximum over the whole text, and a
logistic layer reads these maxima.  Thresholds are set per language on rows kept from
training; the language of a text is inferred from its words, so a score depends on
text alone.  Everything per word is a numpy operation over many texts at once.
"""

from __future__ import annotations

import copy
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tallybook.llm.common import batches, keep, likely_in
from tallybook.llm.langid import code_points, letters

BITS, WIDTH, FILTERS, PREFIX = 17, 12, 8, 4
WIDTHS = (1, 2, 3)
#: Buckets of the word profile that infers the language.
COARSE = 12
#: Characters scored together.
CHUNK = 200_000
CUT = 0.7
EPOCHS, BATCH = 6, 32
#: Labelled texts that one task trains on before the tasks' nets are averaged, and numbers in a block of a summed vector.
SHARD_ROWS, BLOCK = 12_000, 65_536
#: Thresholds are sought on logits in steps of one in so many.
LOGIT_STEPS = 256
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word, bucket of its first letters, and the text it belongs to.

    Words are runs of letters of the lower-cased text; the hash is a polynomial over
    their code points, from prefix sums over all texts at once.
    """
    lower = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lower])
    codes = code_points("\n".join(lower) + "\n")
    inside = letters()[codes]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(max(len(codes) + 1, CHUNK))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(77)) * up[:len(codes)], out=total[1:])

    def bucket(stop: np.ndarray) -> np.ndarray:
        return (mixed((total[stop] - total[start]) * down[start]) >> np.uint64(64 - BITS)).astype(np.int32)

    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    return bucket(end), bucket(np.minimum(start + PREFIX, end)) ^ 1, owner


@dataclass
class Words:
    """Words of several texts, each text between zero rows so that filters never cross texts."""

    word: np.ndarray
    head: np.ndarray
    first: np.ndarray  # row where each text begins, its leading zero row

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        word, head, owner = hashed_words(texts)
        count = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(count + 3) - count - 3
        at = np.arange(len(word)) + 3 * owner + 1
        rows = len(word) + 3 * len(texts)
        out = [np.full(rows, 1 << BITS, dtype=np.int32) for _ in range(2)]
        out[0][at], out[1][at] = word, head
        return cls(*out, first)


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = (1 << BITS) + 1
        self.embed = (rng.normal(size=(size, WIDTH)) * 0.05).astype(np.float32)
        self.filters = [(rng.normal(size=(w, WIDTH, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, 0] = np.abs(f[0, 0]) + 0.5
        self.shift = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.top = np.full(FILTERS * len(WIDTHS), 0.2, dtype=np.float32)
        self.bias = np.float32(-1)
        self.embed[-1] = 0
        self.langs: list[str] = []
        self.profile = np.zeros((1 << COARSE, 0), dtype=np.float32)
        self.threshold = np.zeros(1)
        self.common = np.zeros((size, 1), dtype=np.float32)
        self.ready = False

    def start_from(self, samples: list[Words], y: np.ndarray) -> None:
        """First embedding column: how much oftener a bucket occurs in toxic texts, drawn to 0 when rare.

        Buckets seen in fewer than three texts stay 0 for good: they would learn single texts by heart.
        """
        seen = np.full((2, len(self.embed)), 0.0)
        for w, t in zip(samples, y):
            seen[int(t), np.unique(np.concatenate([w.word, w.head]))] += 1
        self.weigh(seen, np.bincount(y.astype(int), minlength=2))

    def weigh(self, seen: np.ndarray, n: np.ndarray) -> None:
        """:meth:`start_from`, of the texts of each class that hold a bucket and the texts of each class."""
        odds = np.log((seen[1] + 0.2) / (n[1] + 0.4)) - np.log((seen[0] + 0.2) / (n[0] + 0.4))
        both = seen.sum(axis=0)
        self.embed[:, 0] = np.clip(odds, -3, 3) * both / (both + 4)
        self.common = (both >= 3).astype(np.float32)[:, None]
        self.common[-1] = 0
        self.embed *= self.common

    def maxima(self, w: Words) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        x = self.embed[w.word] + self.embed[w.head]
        out, maps = [], []
        for f, s in zip(self.filters, self.shift):
            y = x @ f[0] + s
            for k in range(1, len(f)):
                y[:-k] += (x @ f[k])[k:]
            maps.append(y)
            out.append(np.maximum.reduceat(y, w.first, axis=0))
        return np.concatenate(out, axis=1), maps, x

    def logits(self, w: Words) -> np.ndarray:
        return np.maximum(self.maxima(w)[0], 0) @ self.top + self.bias

    def train(self, samples: list[Words], y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.05) -> None:
        """Adagrad over shuffled batches; gradients reach only the places that hold a maximum."""
        rng, powers = np.random.default_rng(11), self.fresh_powers()
        for _ in range(epochs):
            order = rng.permutation(len(samples))
            for lo in range(0, len(order), batch):
                part = order[lo:lo + batch]
                self.step(joined([samples[i] for i in part]), y[part], powers, rate)

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.shift, self.top]

    def fresh_powers(self) -> list[np.ndarray]:
        """Summed squares of gradients: of the dense parts, of the embeddings, of the bias."""
        return [*[np.full_like(p, 1e-2) for p in self.dense()], np.full(len(self.embed), 1e-2, dtype=np.float32), np.full(1, 1e-2)]

    def step(self, w: Words, y: np.ndarray, powers: list[np.ndarray], rate: float = 0.05) -> None:
        """One batch; changes the net and ``powers`` in place."""
        dense, deep, bias_power = self.dense(), powers[-2], powers[-1]
        peak, maps, x = self.maxima(w)
        live = np.maximum(peak, 0)
        p = 1 / (1 + np.exp(-(live @ self.top + self.bias)))
        g = ((p - y) / len(y)).astype(np.float32)
        grads = [np.zeros_like(q) for q in dense]
        grads[-1] = live.T @ g
        back = g[:, None] * self.top * (peak > 0)
        rows, deltas = [], []
        stop = np.append(w.first[1:], len(w.word))
        for k, (f, m) in enumerate(zip(self.filters, maps)):
            b = back[:, k * FILTERS:(k + 1) * FILTERS]
            at = np.stack([m[a:z].argmax(axis=0) + a for a, z in zip(w.first, stop)])
            grads[len(self.filters) + k] = b.sum(axis=0)
            for j in range(len(f)):
                pos = np.minimum(at + j, len(x) - 1)
                ok = (at + j < len(x))[..., None]
                grads[k][j] = np.einsum("nfd,nf->df", x[pos] * ok, b)
                rows.append(pos.ravel())
                deltas.append((b[..., None] * f[j].T[None] * ok).reshape(-1, WIDTH))
        for q, gq, s in zip(dense, grads, powers):
            s += gq * gq
            q -= rate * gq / np.sqrt(s)
        gb = float(g.sum())
        bias_power += gb * gb
        self.bias -= np.float32(rate * gb / np.sqrt(bias_power[0]))
        pos, d = np.concatenate(rows), np.concatenate(deltas)
        for index in (w.word, w.head):
            touched, back_to = np.unique(index[pos], return_inverse=True)
            move = np.zeros((len(touched), WIDTH), dtype=np.float32)
            np.add.at(move, back_to, d)
            deep[touched] += (move * move).mean(axis=1)
            self.embed[touched] -= self.common[touched] * rate * move / np.sqrt(deep[touched])[:, None]

    def state(self, powers: list[np.ndarray]) -> np.ndarray:
        """All that training changes, as one vector."""
        return np.concatenate([p.ravel().astype(np.float32) for p in (self.embed, *self.dense(), np.array([self.bias]), *powers)])

    def take(self, state: np.ndarray, powers: list[np.ndarray]) -> None:
        """Sets what :meth:`state` gives."""
        at = 0
        bias = np.zeros(1, np.float32)
        for p in (self.embed, *self.dense(), bias, *powers):
            p[...] = state[at:at + p.size].reshape(p.shape)
            at += p.size
        self.bias = np.float32(bias[0])

    def language(self, w: Words) -> np.ndarray:
        """Index of the likeliest language of each text by its words."""
        if len(self.langs) < 2:
            return np.zeros(len(w.first), dtype=int)
        rows = np.append(self.profile, np.zeros((1, len(self.langs)), np.float32), axis=0)
        return np.add.reduceat(rows[w.word >> (BITS - COARSE)], w.first, axis=0).argmax(axis=1)

    def learn_languages(self, samples: list[Words], langs: list[str | None]) -> None:
        self.langs = sorted({g for g in langs if g is not None})
        seen = np.full((1 << COARSE, len(self.langs)), 0.5)
        for w, g in zip(samples, langs):
            if g is not None:
                words = w.word[w.word < 1 << BITS] >> (BITS - COARSE)
                seen[:, self.langs.index(g)] += np.bincount(words, minlength=1 << COARSE) / max(1, len(words))
        self.profile = np.log(seen / seen.sum(axis=0)).astype(np.float32)

    def calibrate(self, samples: list[Words], y: np.ndarray, share: float, least: int = 8) -> None:
        """Per language the logit that errs least when a ``share`` of all texts is toxic.

        A language with fewer than ``least`` kept-back texts of a class takes the common threshold.
        """
        w = joined(samples)
        self.calibrate_counts(self.logits(w), self.language(w), y, 1 - y, share, least)

    def calibrate_counts(self, z: np.ndarray, lang: np.ndarray, toxic: np.ndarray, clean: np.ndarray, share: float, least: int = 8) -> None:
        """:meth:`calibrate`, of numbers of toxic and clean texts at logits."""
        def best(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
            order = np.argsort(z, kind="stable")
            z, toxic, clean = z[order], toxic[order], clean[order]
            miss = share * np.append(0, np.cumsum(toxic)) / max(1, toxic.sum())
            false = (1 - share) * (clean.sum() - np.append(0, np.cumsum(clean))) / max(1, clean.sum())
            room = np.concatenate([[1.0], np.diff(z), [1.0]])
            cost = miss + false
            low = np.flatnonzero(cost <= cost.min() + 1e-12)
            k = low[room[low].argmax()]
            return float(z[0] - 0.5 if k == 0 else z[-1] + 0.5 if k == len(z) else (z[k - 1] + z[k]) / 2)

        common = best(z, toxic, clean)
        self.threshold = np.full(max(1, len(self.langs)), common)
        for k in range(len(self.langs)):
            own = lang == k
            if min(toxic[own].sum(), clean[own].sum()) >= least:
                self.threshold[k] = best(z[own], toxic[own], clean[own])

    def scores(self, texts: list[str]) -> np.ndarray:
        """From 0 to 1; the language's threshold is at ``CUT``.  Texts without words score 0."""
        if not self.ready:
            return np.zeros(len(texts))
        w = Words.of(texts)
        z = self.logits(w) - self.threshold[self.language(w)]
        out = 1 / (1 + np.exp(-np.clip(z + np.log(CUT / (1 - CUT)), -30, 30)))
        empty = np.append(w.first[1:], len(w.word)) - w.first == 3
        return np.where(empty, 0.0, out)


def joined(samples: list[Words]) -> Words:
    sizes = [len(s.word) for s in samples]
    starts = np.cumsum(sizes) - sizes
    return Words(np.concatenate([s.word for s in samples]), np.concatenate([s.head for s in samples]), starts)


def fit(texts: list[str], toxic: list[int], langs: list[str | None], share: float) -> Net:
    """Trains on four fifths of the sample and calibrates on the rest; without both classes the net stays unready."""
    net = Net()
    y = np.array(toxic, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return net
    samples = [Words.of([t]) for t in texts]
    back = np.arange(len(y)) % 5 == 4
    if min(y[back].sum(), (1 - y[back]).sum()) < 1:
        back = np.ones(len(y), dtype=bool)
        learn = back
    else:
        learn = ~back
    net.learn_languages(samples, langs)
    own = [s for s, k in zip(samples, learn) if k]
    net.start_from(own, y[learn])
    net.train(own, y[learn])
    net.calibrate([s for s, k in zip(samples, back) if k], y[back], share)
    net.ready = True
    return net


def examples(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str) -> DataFrame:
    """Every labelled text once, ``h, t, l, toxic, back, shard``, stored: a shard's rows lie together, in the order of a hash.

    Rows with a null text, id or label are passed over; an id with several labels, and a text of several ids, counts as
    toxic if any says so.  A fifth, ``back``, is kept from training."""
    said = (labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("key"))
            .agg(F.max(F.col(label_col)).cast("int").alias("toxic")))
    text = F.col(text_col)
    rows = df.filter(text.isNotNull()).select(F.col(id_col).alias("key"), F.xxhash64(text).alias("h"), text.alias("t"), F.col(lang_col).alias("l"))
    known = keep(rows.select("key", "h").join(said, "key").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("key").alias("key")), "toxic-keys")
    shards = 1 + known.count() // SHARD_ROWS
    # a text is read at the one id that names it; only rows with equal id and text are put together.  Names and texts meet
    # in the shard itself, so that a text is shuffled once, and most texts without a label are not shuffled at all
    names = known.select("key", "h", F.lit(None).cast("string").alias("t"), F.lit(None).cast(rows.schema["l"].dataType).alias("l"), "toxic")
    both = likely_in(rows, known).withColumn("toxic", F.lit(None).cast("int")).unionByName(names)
    dealt = both.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).repartition(shards, "shard")
    one = (dealt.groupBy("shard", "h", "key").agg(F.first("t", ignorenulls=True).alias("t"), F.min("l").alias("l"), F.max("toxic").alias("toxic"))
           .filter(F.col("toxic").isNotNull()))
    back = F.pmod(F.shiftright("h", 20), F.lit(5)) == 4
    placed = one.select("h", "t", "l", "toxic", back.alias("back"), "shard")
    return keep(placed.sortWithinPartitions("shard", "h"), "toxic-examples")


def summed(rows: DataFrame, add, size: int) -> np.ndarray:
    """The sum over all tasks of the vector of ``size`` numbers that ``add(batches)`` gives for a task's rows.

    The driver gets the summed blocks alone."""
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = add(tables)
        if v is not None:
            for k, lo in enumerate(range(0, size, BLOCK)):
                yield pa.RecordBatch.from_pydict({"k": [k], "v": [v[lo:lo + BLOCK].astype("<f8").tobytes()]})

    def total(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "v": [sum(np.frombuffer(b, "<f8") for b in part["v"]).tobytes()]})

    got = rows.mapInArrow(run, "k bigint, v binary").groupBy("k").applyInPandas(total, "k bigint, v binary").collect()
    out = np.zeros(size)
    for r in got:
        out[r["k"] * BLOCK:(r["k"] + 1) * BLOCK] = np.frombuffer(r["v"], "<f8")
    return out


def by_texts(tables: Iterator[pa.RecordBatch], budget: int = CHUNK) -> Iterator[list[tuple]]:
    """Rows ``t, l, toxic`` in lists of about ``budget`` characters."""
    out, size = [], 0
    for t in tables:
        for row in zip(*(t.column(c) for c in ("t", "l", "toxic"))):
            out.append(tuple(x.as_py() for x in row))
            size += len(out[-1][0])
            if size >= budget or len(out) == 1_000:
                yield out
                out, size = [], 0
    if out:
        yield out


def counted(net: Net, rows: DataFrame, learned: DataFrame) -> None:
    """First weights from counts over all training texts, word profiles of languages from all labelled ones."""
    net.langs = sorted(r["l"] for r in rows.filter("l is not null").select("l").distinct().collect())
    langs, size = net.langs, len(net.embed)

    def profiles(tables):
        seen = np.zeros((1 << COARSE, len(langs)))
        for part in by_texts(tables):
            for text, lang, _ in part:
                if lang is not None:
                    w = Words.of([text]).word
                    words = w[w < 1 << BITS] >> (BITS - COARSE)
                    seen[:, langs.index(lang)] += np.bincount(words, minlength=1 << COARSE) / max(1, len(words))
        return seen.ravel()

    def texts_with(tables):
        seen = np.zeros((2, size + 1))
        for part in by_texts(tables):
            for text, _, toxic in part:
                w = Words.of([text])
                seen[toxic, np.unique(np.concatenate([w.word, w.head]))] += 1
                seen[toxic, size] += 1
        return seen.ravel()

    seen = 0.5 + (summed(rows, profiles, (1 << COARSE) * len(langs)) if langs else np.zeros(0)).reshape(1 << COARSE, len(langs))
    net.profile = np.log(seen / seen.sum(axis=0)).astype(np.float32)
    seen = summed(learned, texts_with, 2 * (size + 1)).reshape(2, -1)
    net.weigh(seen[:, :-1], seen[:, -1])


def train_over(net: Net, learned: DataFrame) -> None:
    """Rounds over all texts: every task trains the round's net on its shards, and the nets are averaged by their numbers of texts."""
    powers = net.fresh_powers()
    size = len(net.state(powers))

    def trained(tables):
        start, own, total, at = net.state(powers), [p.copy() for p in powers], np.zeros(size + 1), None
        ours = copy.deepcopy(net)

        def close(n):
            total[:-1] += n * ours.state(own)
            total[-1] += n
            ours.take(start, own)

        n, part = 0, []
        for t in tables:
            for shard, text, toxic in zip(*(t.column(c).to_pylist() for c in ("shard", "t", "toxic"))):
                if part and (shard != at or len(part) == BATCH):
                    ours.step(joined([w for w, _ in part]), np.array([y for _, y in part], np.float32), own)
                    part = []
                if n and shard != at:
                    close(n)
                    n = 0
                at = shard
                part.append((Words.of([text]), toxic))
                n += 1
        if part:
            ours.step(joined([w for w, _ in part]), np.array([y for _, y in part], np.float32), own)
        if n:
            close(n)
        return total if total[-1] else None

    for _ in range(EPOCHS):
        v = summed(learned, trained, size + 1)
        net.take(v[:-1] / v[-1], powers)


def thresholds(net: Net, kept: DataFrame, share: float) -> None:
    """:meth:`Net.calibrate` over all rows of ``kept``, from counts of rounded logits by language and label."""
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_texts(tables):
            w = Words.of([t for t, _, _ in part])
            z = np.round(np.clip(net.logits(w), -30, 30) * LOGIT_STEPS).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": net.language(w).astype(np.int64), "z": z, "toxic": np.array([y for _, _, y in part], np.int64)})

    n = F.count(F.lit(1)).alias("n")
    got = kept.mapInArrow(run, "lang bigint, z bigint, toxic bigint").groupBy("lang", "z", "toxic").agg(n).orderBy("lang", "z", "toxic").toPandas()
    z, y, lang, n = got["z"].to_numpy() / LOGIT_STEPS, got["toxic"].to_numpy(), got["lang"].to_numpy(), got["n"].to_numpy()
    net.calibrate_counts(z, lang, y * n, (1 - y) * n, share)


def learn(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          label_col: str = "toxic") -> Net:
    """A net from all labelled rows and their whole texts (see :func:`examples`); Spark passes over them for the counts,
    the rounds of training and the thresholds, and the driver holds the net alone."""
    rows = examples(df, labels, id_col, text_col, lang_col, label_col)
    size = {(r["toxic"], r["back"]): r["n"] for r in rows.groupBy("toxic", "back").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sum(v for (t, _), v in size.items() if t == toxic) for toxic in (0, 1)]
    net = Net()
    if not all(n):
        return net
    split = all((t, b) in size for t in (0, 1) for b in (False, True))
    learned, kept = (rows.filter("not back"), rows.filter("back")) if split else (rows, rows)
    counted(net, rows, learned)
    train_over(net, learned)
    thresholds(net, kept, n[1] / sum(n))
    net.ready = True
    return net


def learn_outside(df: DataFrame, sf_dir: str, held_out: Column) -> Net:
    """:func:`learn` from the table ``labels`` and the rows of ``df`` where ``held_out`` is false or null."""
    labels = df.sparkSession.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return learn(df.filter(~F.coalesce(held_out, F.lit(False))), labels)


def without_toxic(df: DataFrame, net: Net, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text scores below ``CUT``, with all columns; null and empty texts stay."""
    @F.pandas_udf(DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.concatenate([np.zeros(0), *(net.scores(g) for g in batches((t or "" for t in s), CHUNK))]))

    return df.filter(scored(F.coalesce(F.col(text_col), F.lit(""))) < CUT)


def score(df: DataFrame, net: Net, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, score, predicted``, from whole texts alone.

    Null, empty and wordless texts score 0, as do all texts when the net had no two classes to
    learn from.  Equal texts score alike; other columns are not read; an empty table gives an
    empty result.
    """
    schema = StructType([StructField("doc_id", df.schema[id_col].dataType),
                         StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    out = to_arrow_schema(schema)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            if not t.num_rows:
                continue
            parts = [net.scores(g) for g in batches((x.as_py() or "" for x in t.column(1)), CHUNK)]
            s = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [t.column(0).cast(out.types[0]), pa.array(s), pa.array((s >= CUT).astype(np.int32))], schema=out)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
