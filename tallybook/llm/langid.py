"""Language id by cross-parsing entropy.

For every language a suffix automaton of labelled text tells how far a text goes on
as some stretch of that language's sample.  Parsing a text greedily into longest such
stretches, the language that needs the fewest phrases (normalised by the size of its sample
and the length of the text) wins.  Automata are dense transition tables, and texts
are parsed in lockstep, block by block, so each step is a few numpy operations over
thousands of blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tallybook.llm.common import batches, keep, small_or_shuffled

#: Characters of a block; a phrase never crosses its end, which adds at most one phrase to every 256 characters, in all languages alike.
BLOCK = 256
#: Characters parsed in lockstep.
CHUNK = 1_500_000
UNDECIDED = "und"


def learn_sample(df: DataFrame, *, text_col: str, lang_col: str, rows: int, chars: int) -> dict[str, list[str]]:
    """Passages of labelled text: from each of ``rows`` labelled rows of a language one passage of ``chars`` characters.

    Rows and the passage's place are chosen by a hash of the text, so the sample is the same in every
    run and its size has a bound: languages x rows x chars.  Equal texts count once.
    """
    text = F.col(text_col)
    spans = F.greatest(F.ceil(F.char_length(text) / chars), F.lit(1))
    picked = (df.filter(text.isNotNull() & F.col(lang_col).isNotNull() & (F.trim(text) != ""))
              .select(F.col(lang_col).alias("lang"), F.xxhash64(text).alias("h"),
                      F.substring(text, F.pmod(F.xxhash64(text, F.lit(1)), spans).cast("int") * chars + 1, F.lit(chars)).alias("passage")))
    # of a language with many rows only hashes in a range that holds a few times ``rows`` are ranked
    # ``rows``; copies must not narrow it, so distinct texts are counted
    many = keep(picked.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).withColumnRenamed("lang", "_lang"), "languages")
    place = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    near = (picked.join(small_or_shuffled(many), F.col("lang") == F.col("_lang")).filter(place * F.col("n") <= 8 * rows)
            .select("lang", "h", "passage").distinct())
    order = Window.partitionBy("lang").orderBy("h", "passage")
    top = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rows)
    found: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "k").collect():
        found.setdefault(r["lang"], []).append(r["passage"])
    return found


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


_letter = np.zeros(0, dtype=bool)


def letters() -> np.ndarray:
    """By code point: is it a letter."""
    global _letter
    if not len(_letter):
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def letter_counts(texts: list[str]) -> Counter[str]:
    count: Counter[str] = Counter()
    for t in texts:
        count.update(t.lower())
    return Counter({c: n for c, n in count.items() if c.isalpha()})


class Letters:
    """Numbers of characters: 0 for what is not a letter, 1.. for all letters of the samples, the last for any other."""

    def __init__(self, known: list[str]):
        self.known = known
        self.table = np.where(letters(), len(known) + 1, 0).astype(np.int32)
        self.table[[ord(c) for c in known]] = np.arange(1, len(known) + 1)

    def __call__(self, text: str) -> np.ndarray:
        """Numbers of the lower-cased text between two 0; a run of non-letters is one 0."""
        codes = self.table[code_points(f" {text.lower()} ")]
        blank = codes == 0
        return codes[np.append(True, ~(blank[1:] & blank[:-1]))]


class Alphabet:
    """One language's codes of the numbers of :class:`Letters`: 0 for no letter, a code for each of the ``most`` commonest letters
    of its own sample, HASHED codes that its rarer letters share, and the last for letters that it never shows."""

    HASHED = 48

    def __init__(self, letters_of: Letters, count: Counter[str], most: int = 62):
        kept = sorted(count, key=lambda c: (-count[c], c))
        shared = self.HASHED if len(kept) > most else 0
        self.size = min(len(kept), most) + shared + 2
        self.table = np.full(len(letters_of.known) + 2, self.size - 1, dtype=np.uint8)
        self.table[0] = 0
        place = {c: i + 1 for i, c in enumerate(letters_of.known)}
        for i, c in enumerate(kept):
            self.table[place[c]] = i + 1 if i < most else most + 1 + ord(c) * 2654435761 % (1 << 32) % shared


def automaton(codes: list[int], alphabet: int) -> np.ndarray:
    """Dense suffix automaton with restarts: step[state * alphabet + code] = 2 * next * alphabet + phrase_start.

    Where a state has no edge a phrase begins with this code, at the root's edge.  The last state,
    where parsing starts, has no edge at all; a code that the sample lacks leads there, a phrase of its own.
    """
    edge: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(edge)
        edge.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edge[p]:
            edge[p][c] = new
            p = link[p]
        if p >= 0:
            q = edge[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(edge)
                edge.append(dict(edge[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edge[p].get(c) == q:
                    edge[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    root = np.full(alphabet, len(edge), dtype=np.int32)
    for c, to in edge[0].items():
        root[c] = to
    step = np.tile((root * (2 * alphabet) + 1).astype(np.int32), len(edge) + 1)
    where = np.array([s * alphabet + c for s, e in enumerate(edge) for c in e], dtype=np.int64)
    to = np.array([t for e in edge for t in e.values()], dtype=np.int32)
    step[where] = to * (2 * alphabet)
    return step


class Model:
    """Automata of the languages of a sample; memory is bounded by ``total`` characters over all of them."""

    def __init__(self, sample: dict[str, list[str]], total: int = 240_000):
        self.langs = sorted(sample)
        counts = [letter_counts(sample[lang]) for lang in self.langs]
        self.letters = Letters(sorted(set().union(*counts)))
        share = max(2_000, total // max(1, len(self.langs)))
        self.alphabets, self.steps, self.bits = [], [], []
        for lang, count in zip(self.langs, counts):
            alphabet = Alphabet(self.letters, count)
            numbers = np.concatenate([*(self.letters(p) for p in sample[lang]), np.zeros(0, np.int32)])[:share]
            self.alphabets.append(alphabet)
            self.steps.append(automaton(alphabet.table[numbers].tolist(), alphabet.size))
            self.bits.append(math.log2(len(numbers) + 2))

    def bits_per_char(self, texts: list[str]) -> np.ndarray:
        """[text, language]: phrases x log2(sample size) / length; rows of texts without letters are 0."""
        coded = [self.letters(t) for t in texts]
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        blocks = -(-sizes // BLOCK)
        flat = np.zeros(int(blocks.sum()) * BLOCK, dtype=np.int32)
        starts = (np.cumsum(blocks) - blocks) * BLOCK
        for c, s in zip(coded, starts):
            flat[s:s + len(c)] = c
        grid = flat.reshape(-1, BLOCK)
        fill = np.full(len(grid), BLOCK)
        ended = np.cumsum(blocks)[blocks > 0] - 1
        fill[ended] = (sizes - (blocks - 1) * BLOCK)[blocks > 0]
        order = np.argsort(-fill, kind="stable")
        shown, live = np.ascontiguousarray(grid[order].T), np.searchsorted(-fill[order], -np.arange(BLOCK), side="left")
        owner = np.repeat(np.arange(len(texts)), blocks)[order]
        out = np.zeros((len(texts), len(self.langs)))
        for k, (step, alphabet) in enumerate(zip(self.steps, self.alphabets)):
            grid = alphabet.table[shown]
            state = np.full(len(fill), len(step) - alphabet.size, dtype=np.int32)
            phrases = np.zeros(len(fill), dtype=np.int32)
            for j in range(BLOCK):
                n = live[j]
                if not n:
                    break
                v = step[state[:n] + grid[j, :n]]
                phrases[:n] += v & 1
                np.right_shift(v, 1, out=state[:n])
            out[:, k] = np.bincount(owner, weights=phrases, minlength=len(texts)) * self.bits[k]
        return out / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; of equal languages the first in the alphabet wins.

        The score is the winner's share of weights that halve for every tenth of a bit
        per character more.
        """
        said = [UNDECIDED] * len(texts)
        score = [0.0] * len(texts)
        letter = letters()
        known = [i for i, t in enumerate(texts) if t and letter[code_points(t)].any()]
        if not known or not self.langs:
            return list(zip(said, score))
        bits = self.bits_per_char([texts[i] for i in known])
        best = bits.argmin(axis=1)
        weight = np.exp2((bits.min(axis=1, keepdims=True) - bits) * 10)
        share = 1 / weight.sum(axis=1)
        for i, b, s in zip(known, best, share):
            said[i], score[i] = self.langs[b], float(s)
        return list(zip(said, score))


_models: dict[str, Model] = {}


def identify(df: DataFrame, sample: dict[str, list[str]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, lang_pred, score``, from whole texts alone.

    ``lang_pred`` is a language of ``sample``, or ``und`` with score 0 for a text that is
    null, empty or has no letter, and for all texts if the sample is empty.  Repeated texts get equal answers;
    other columns are not read; an empty table gives an empty result.  The sample (bounded
    by its parameters) travels with the function; each worker builds the automata once.
    """
    schema = StructType([StructField("doc_id", df.schema[id_col].dataType),
                         StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    out = to_arrow_schema(schema)
    name = str(hash(str(sorted(sample.items()))))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            _models[name] = Model(sample)
        model = _models[name]
        for t in tables:
            rows = []
            for group in batches((x.as_py() or "" for x in t.column(1)), CHUNK):
                rows += model.predict(group)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [t.column(0).cast(out.types[0]), *(pa.array(c, k) for c, k in zip(zip(*rows), out.types[1:]))], schema=out)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def learn_and_identify(df: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       rows: int = 400, chars: int = 200) -> DataFrame:
    """:func:`identify` on all rows after learning from labelled rows where ``held_out`` is false or null.

    ``rows`` and ``chars`` bound the sample per language.
    """
    learn = df.filter(~F.coalesce(held_out, F.lit(False)))
    sample = learn_sample(learn, text_col=text_col, lang_col=lang_col, rows=rows, chars=chars)
    return identify(df, sample, id_col=id_col, text_col=text_col)
