"""Audit of how far sources of a language differ in their words, by one-hot level products.

A term's count in a group (language and source) is its level there.  Indicator columns, one for each (group, level), over
the terms as rows give a 0/1 matrix; the matrix transposed times itself holds for every two groups the joint table of
their levels: how many terms have level a here and level b there.  A pair's divergence is priced from those tables, one price
a cell instead of one a term.  The product is taken in blocks of terms and of sources, each block a task's
work, and in slices of a block whose columns stay few; entries are whole numbers below the row count, exact
in any float.  Level 0 is a column like the others; terms that no source of a block knows are priced by their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallybook.llm.common import keep

#: Terms of a block, sources on each side of a block, indicator columns of a slice.
TERMS, SOURCES, COLUMNS = 4096, 64, 512
#: Entries that a task gathers before it hands them on, and bytes of a text split at once.
ENTRIES, PIECE = 400_000, 4_000_000
#: Bytes of a term are ASCII letters, lower-cased here, and all bytes beyond ASCII; the rest are blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about PIECE bytes that end at a blank."""
    flat = raw.translate(_FOLD)
    at = 0
    while len(flat) - at > PIECE:
        cut = flat.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield flat[at:cut].split()
        at = cut
    yield flat[at:].split() if at else flat.split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of ``docs(lang, source, text)``: occurrences and documents, and a row with a null term per group."""
    schema = StructType([StructField("lang", StringType()), StructField("source", StringType()), StructField("term", StringType()),
                         StructField("n", LongType()), StructField("docs", LongType())])
    out = to_arrow_schema(schema)

    def rows(found: dict) -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), (count, within) in found.items():
            langs += [lang] * (len(count) + 1)
            sources += [source] * (len(count) + 1)
            terms += [None, *(t.decode("utf-8") for t in count)]
            n += [0, *count.values()]
            docs += [0, *map(within.__getitem__, count)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((langs, sources, terms, n, docs), out.types)], schema=out)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = {}, 0
        for t in tables:
            for lang, source, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2)):
                count, within = found.setdefault((lang, source), (Counter(), Counter()))
                size -= len(count)
                seen: set[bytes] = set()
                for words in word_lists(text.as_py() or b""):
                    count.update(words)
                    seen.update(words)
                within.update(seen)
                size += len(count)
                if size > ENTRIES:
                    yield rows(found)
                    found, size = {}, 0
        if found:
            yield rows(found)

    part = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, terms: str) -> Column:
    """1 + floor(10 ** 9 * (n + 2) / (total + 2 * terms)), in whole numbers throughout; null without terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + CAST(({n} + 2) AS DECIMAL(20,0)) * 1000000000 DIV ({total} + 2 * {terms}) END").cast("long")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) DIV ({p} + {q})")


def joint_prices(level: np.ndarray, price: np.ndarray, base: np.ndarray, left: int, most_columns: int = COLUMNS) -> np.ndarray:
    """[source, source] sums over terms (rows) of the divergence beyond that of two unknown terms, for pairs of a left and a right source.

    ``level`` and ``price`` are [term, source]; a price depends on source and level alone.  Sources before ``left`` are the
    left side, those from there on the right; ``left`` 0 means that every source is on both sides.
    """
    terms, sources = level.shape
    low = np.subtract.outer(base, base) ** 2 // np.add.outer(base, base)
    total = np.zeros(sources * sources, dtype=np.int64)
    wide = level.max(initial=0) + 1
    code = level + np.arange(sources) * wide
    waiting = [np.argsort(level.max(axis=1), kind="stable")]
    while waiting:
        rows = waiting.pop()
        columns, first, place = np.unique(code[rows], return_index=True, return_inverse=True)
        if len(columns) > most_columns and len(rows) > 1:
            waiting += [rows[:len(rows) // 2], rows[len(rows) // 2:]]
            continue
        one_hot = np.zeros((len(rows), len(columns)), dtype=np.float32)
        one_hot[np.arange(len(rows))[:, None], place.reshape(len(rows), sources)] = 1
        source, cost = columns // wide, price[rows].ravel()[first]
        border = np.searchsorted(source, left)  # columns are in order of their sources
        a, b = (one_hot[:, :border], one_hot[:, border:]) if left else (one_hot, one_hot)
        joint = a.T @ b
        i, j = np.nonzero(joint)
        n = joint[i, j].astype(np.int64)
        j = j + border if left else j
        x, y, s, t = cost[i], cost[j], source[i], source[j]
        gain = n * ((x - y) ** 2 // (x + y) - low[s, t])
        total += np.bincount(s * sources + t, weights=gain, minlength=sources * sources).astype(np.int64)
    return total.reshape(sources, sources)


def block_gains(key: tuple, pdf: pd.DataFrame, width: int, most_columns: int) -> pd.DataFrame:
    """One block of the product: rows of a term, a source and a count, and a row without a term for each source of the block."""
    known = pdf[pdf["term"].isna()].sort_values("place")
    source, base = known["place"].to_numpy(np.int64), known["p"].to_numpy(np.int64)
    cells = pdf[pdf["term"].notna()]
    row, names = pd.factorize(cells["term"])
    column = np.searchsorted(source, cells["place"].to_numpy(np.int64))
    level = np.zeros((len(names), len(source)), dtype=np.int64)
    price = np.tile(base, (len(names), 1))
    level[row, column] = cells["n"].to_numpy(np.int64)
    price[row, column] = cells["p"].to_numpy(np.int64)
    left = 0 if key[1] == key[2] else int(np.searchsorted(source, key[2] * width))
    gain = joint_prices(level, price, base, left, most_columns) if len(names) else np.zeros((len(source), len(source)), np.int64)
    a, b = np.nonzero(gain)
    a, b = a[a < b], b[a < b]
    return pd.DataFrame({"lang": key[0], "a": source[a], "b": source[b], "gain": gain[a, b]})


def audited(df: DataFrame, *, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) group of ``df``.

    Terms are runs of ASCII letters (lower-cased) and characters beyond ASCII; a language keeps the terms of ``least_docs`` or more of
    its documents.  ``pair`` rows compare the group with each other source of the language; ``term`` rows are the ``top`` terms
    that it has and that weigh more in it than in the language.  Values come first by size, then by the item's bytes.
    Null texts, languages and sources are empty ones and groups like others; a group without terms takes part; a
    language of one source has no pairs; one without kept terms has pairs of value 0 and no terms.  Repeated rows count each; other
    columns are not read; an empty table gives an empty result.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(said(lang_col).alias("lang"), said(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    counts = keep(term_counts(docs), "term-counts")
    kept = keep(counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
                .filter(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "kept-terms")
    cells = keep(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-cells")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    in_order = Window.partitionBy("lang").orderBy("source")
    groups = (counts.filter("term IS NULL").select("lang", "source")
              .join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
              .withColumn("place", F.row_number().over(in_order).cast("long") - 1))
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = keep(groups.join(sources, "lang").withColumn("p0", probability("0", "total", "terms")), "groups")
    priced = keep(cells.join(groups, ["lang", "source"]).withColumn("p", probability("n", "total", "terms"))
                  .withColumn("q", probability("lang_n", "lang_total", "terms")), "priced-cells")
    return pairs(groups, priced).unionByName(terms(priced, top))


def pairs(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """The ``pair`` rows: a price for the terms that neither source knows, and the products' prices for the others."""
    blocks = F.ceil(F.col("terms") / TERMS).cast("int")
    mine = F.floor(F.col("place") / SOURCES).cast("int")
    last = F.floor((F.col("sources") - 1) / SOURCES).cast("int")
    sides = lambda df: (df.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
                        .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")))
    columns = ["lang", "i", "j", "block", "place", "term", "n", "p"]
    several = F.col("sources") > 1
    cells = sides(priced.filter(several).withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int"))).select(*columns)
    known = sides(groups.filter(several & (F.col("terms") > 0)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))).select(
        *columns[:5], F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.col("p0").alias("p"))
    width, most_columns = SOURCES, COLUMNS
    block = lambda key, pdf: block_gains(key, pdf, width, most_columns)
    gains = (cells.unionByName(known).groupBy("lang", "i", "j", "block").applyInPandas(block, "lang string, a long, b long, gain long")
             .groupBy("lang", "a", "b").agg(F.sum("gain").alias("gain")))
    gains = keep(gains, "pair-gains")
    side = lambda s: groups.select("lang", F.col("source").alias(f"source_{s}"), F.col("place").alias(s), F.col("p0").alias(f"p_{s}"), "terms").drop(
        *(["terms"] if s == "b" else []))
    both = (side("a").join(side("b"), "lang").filter("a < b").join(gains, ["lang", "a", "b"], "left")
            .withColumn("value", F.coalesce(F.col("terms") * divergence("p_a", "p_b"), F.lit(0)) + F.coalesce("gain", F.lit(0))))
    both = keep(both.select("lang", "source_a", "source_b", "value"), "pair-values")
    every = both.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").unionByName(
        both.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value"))
    return ranked(every, "pair")


def terms(priced: DataFrame, top: int) -> DataFrame:
    """The ``term`` rows: terms of the group that weigh more than in the language."""
    more = priced.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    return ranked(more, "term").filter(F.col("rank") <= top)


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
