"""Quality by weak supervision: rules vote or abstain, EM learns how far to trust each.

Measures are taken per text inside Arrow batches; votes are few enough to be counted
by pattern (3 to the number of rules at most), so expectation-maximisation runs on
that small table however many documents there are, and the posterior of a pattern
is attached to its documents by a join on the pattern number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from tallybook.llm.common import keep

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_digits", "n_ends", "n_marks", "n_symbol_words"]
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SYMBOL_TO_HASH = bytes.maketrans(SYMBOLS.encode(), b"#" * len(SYMBOLS))


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text; words are runs of anything but ASCII blanks."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        seen: dict[tuple, int] = {}
        for t in triples:
            seen[t] = seen.get(t, 0) + 1
        covered = bytearray(n)
        for i, t in enumerate(triples):
            if seen[t] > 1:
                covered[i:i + 3] = b"\1\1\1"
        repeated = sum(covered)
    upper = sum(map(bytes.isupper, words))
    symbols = sum(map(text.count, SYMBOLS))
    marked = sum(b"#" in w for w in raw.translate(SYMBOL_TO_HASH).split()) if symbols else 0
    return (n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines),
            upper, sum(map(text.count, "0123456789")), sum(map(text.count, ".!?")),
            len(raw) - len(raw.translate(None, MARKS)), marked)


@pandas_udf(StructType([StructField(c, LongType()) for c in MEASURES]))
def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        yield pd.DataFrame([measure(t) for t in s], columns=MEASURES, dtype="int64")


def vote(bad: Column, good: Column) -> Column:
    """-1, 1 or 0 for no opinion."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule looks at one side of a text; most texts get an opinion from most rules."""
    c = F.col
    words, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    mean = c("word_chars") / words
    return {
        "length": vote(c("n_words") < 50, c("n_words") >= 80),
        "word_length": vote((mean < 3) | (mean > 12), (mean >= 3.5) & (mean <= 9)),
        "symbols": vote(c("n_symbols") * 10 > words, c("n_symbols") * 100 <= words),
        "marks": vote(c("n_marks") * 100 > chars * 15, c("n_marks") * 100 <= chars * 8),
        "symbol_words": vote(c("n_symbol_words") * 10 > words, c("n_symbol_words") * 50 <= words),
        "repeated_lines": vote(c("n_dup_lines") * 4 > lines, c("n_dup_lines") == 0),
        "repeated_words": vote(c("n_repeat_words") * 10 > words * 3, c("n_repeat_words") * 20 <= words),
        "shouting": vote(c("n_upper") * 10 > words * 3, c("n_upper") * 20 <= words),
        "digits": vote(c("n_digits") * 5 > chars, c("n_digits") * 20 <= chars),
        "sentences": vote(c("n_ends") * 200 < words, c("n_ends") * 40 >= words),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Posterior that a text is good, by vote pattern.

    One hidden class (good or bad); given the class each rule votes good, bad or
    abstains by its own probabilities, which EM fits to the counts, starting from the
    majority vote.  Add-one smoothing keeps them inside (0, 1); the share of
    a rule's votes that is right stays at one half or more, which names the classes.
    Ties of the majority and all-abstain patterns start at one half.
    """
    if not patterns:
        return {}
    m = len(patterns[0][0])
    post = {p: 0.5 if sum(p) == 0 else (0.9 if sum(p) > 0 else 0.1) for p, _ in patterns}
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        prior = (sum(n * post[p] for p, n in patterns) + 1) / (total + 2)
        table = []
        for j in range(m):
            got = {(y, v): 1.0 for y in (0, 1) for v in (-1, 0, 1)}
            for p, n in patterns:
                got[1, p[j]] += n * post[p]
                got[0, p[j]] += n * (1 - post[p])
            prob = {(y, v): got[y, v] / sum(got[y, x] for x in (-1, 0, 1)) for y, v in got}
            for v, right in ((1, 1), (-1, 0)):  # a vote never speaks for the other class
                low = (prob[0, v] + prob[1, v]) / 2
                if prob[right, v] < low:
                    prob[0, v] = prob[1, v] = low
            table.append(prob)
        new = {}
        for p, _ in patterns:
            good, bad = prior, 1 - prior
            for j, v in enumerate(p):
                good *= table[j][1, v]
                bad *= table[j][0, v]
            new[p] = good / (good + bad)
        moved = max(abs(new[p] - post[p]) for p in new)
        post = new
        if moved < 1e-9:
            break
    return post


def judge(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of ``df`` with its measures, votes, posterior and verdict.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, votes, quality, kept``.  A null or empty text has measures 0 and fails.
    ``kept`` is false for a failed text, else whether ``quality >= least``.  Repeated rows
    are judged alike; other columns are not read; an empty table gives an empty result.
    The driver sees one row per vote pattern, at most 3 to the number of rules.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    voted = rules()
    rows = df.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    code = sum((c + 1) * 3**j for j, c in enumerate(voted.values()))
    kept = keep(rows.select("doc_id", *base, code.cast("int").alias("code"),
                            ((F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).alias("base_failed")),
                "quality")
    seen = [(r["code"], r["n"]) for r in kept.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()]
    unpack = lambda k: tuple(k // 3**j % 3 - 1 for j in range(len(voted)))
    post = estimate(sorted((unpack(k), n) for k, n in seen))
    table = kept.sparkSession.createDataFrame(
        [(k, list(unpack(k)), float(post[unpack(k)])) for k, _ in seen], "code int, votes array<int>, quality double")
    return kept.join(F.broadcast(table), "code").select(
        "doc_id", *base, "base_failed", "votes", "quality",
        (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"))
