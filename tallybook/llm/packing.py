"""Packing token streams into windows by order-preserving dynamic programming.

Documents are taken in the order in which Spark hands them to a task, encoded,
and laid end to end.  A window is a run of that stream of at most ``window`` tokens; it may begin and
end at a document end (free), a sentence end (small penalty) or, where sentences are
long, at a mark every ``stride`` tokens (larger penalty).  The cuts chosen
minimise padding plus penalties; the best earlier cut for each place comes from a
monotone queue, so the work is linear in the number of allowed places.
No shuffle: each input split is packed by itself, and its last, short run is split into
powers of two, which need no padding.
"""

from __future__ import annotations

import operator
import unicodedata
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tallybook.llm.common import batches

FREE, SENTENCE, INSIDE = 0.0, 4.0, 24.0
#: Words longer than this are encoded but not remembered; so many words are remembered per worker.
LONG_WORD, REMEMBERED = 40, 600_000
#: Tokens that one dynamic programme covers at most before it is settled.
BLOCK = 4_000_000


#: Byte-level tokenizers write a byte that prints as itself, others as characters from 256 on (fixed values).
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def lowered(text: str) -> str:
    """The text in lower case where that changes no token, else as it is.

    The tokenizer lower-cases later, after NFC.  Left alone are texts with a final sigma, a dotted capital I (two characters
    when lower) or special tokens' names, and those that NFC changes before or after lower-casing: a mark may join a small letter
    but not its capital.
    """
    if text.isascii():
        return text if "<|" in text else text.lower()
    if "\u03a3" in text or "\u0130" in text or "<|" in text:
        return text
    low = text.lower()
    return low if unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else text


class Encoder:
    """Word-by-word encoding with a bounded memory of words, equal to encoding whole texts.

    Right for byte-level BPE whose normaliser lower-cases and whose pre-tokenizer drops white
    space, so that no token crosses a blank; only the ASCII space and line feed are split at here.  The fast path is checked
    against whole texts in the tests.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.known: dict[str, bytes] = {"": b""}
        vocab = self.tokenizer.get_vocab()
        top = max(vocab.values(), default=0) + 1
        self.stops = np.zeros(max(top, end_id + 1), dtype=bool)
        for token, i in vocab.items():
            bare = token.removesuffix("</w>")
            if bare and bare[-1] in ".!?" and not any(c.isalnum() for c in bare):
                self.stops[i] = True
        self.stops[end_id] = False

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not known yet; a letter followed by one closing mark is two runs of tokens."""
        bare = {w[:-1] if len(w) > 1 and w[-1] in ".," and w[:-1].lower()[-1].isalpha() else w for w in words}
        fresh = bare.difference(self.known)
        # a lower-case word of letters is one pre-token: the model alone gives its ids
        plain = {w for w in fresh if w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w)}
        made, tokenize = {}, self.model.tokenize
        for w in plain:
            byte_text = w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS)
            made[w] = array("I", [t.id for t in tokenize(byte_text)]).tobytes()
        rest = list(fresh - plain)
        made.update(zip(rest, (np.array(e.ids, dtype="<u4").tobytes() for e in
                               self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
        for mark in ".,":
            if mark not in self.known:
                self.known[mark] = np.array(self.tokenizer.encode(mark, add_special_tokens=False).ids, "<u4").tobytes()
        for w in words:
            if w not in made:
                made[w] = (made.get(w[:-1]) or self.known[w[:-1]]) + self.known[w[-1]]
        return made

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [lowered(t).replace("\n", " ").split(" ") for t in texts]
        known = self.known
        fresh = set().union(*split).difference(known)
        made = self._learn(fresh) if fresh else {}
        known.update(made)
        get = known.__getitem__
        out = [b"".join(map(get, s)) + self.end for s in split]
        full = len(known) > REMEMBERED
        for w in made:
            if full or len(w) > LONG_WORD:
                del known[w]
        return out


def cuts(places: list[int], costs: list[float], window: int) -> list[int]:
    """Places to cut at, the first and the last included, no two neighbours over ``window`` apart.

    ``places`` grow from the stream's start to its end, no gap over ``window``;
    ``costs`` is what a cut there adds.  Cost of a window: its padding
    ``window - length``.  With best[j] = costs[j] + min over i of best[i] + window -
    (places[j] - places[i]), the minimum of best[i] + places[i] over the reachable i slides
    along with j; a queue of rising values keeps it.  Of equal choices the earlier cut wins.
    The last window's padding is free: it is cut in powers of two afterwards, so what a block lacks to whole
    windows gathers there.
    """
    n = len(places)
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(places[0], 0)])
    for j in range(1, n):
        at = places[j]
        while places[queue[0][1]] < at - window:
            queue.popleft()
        value, i = queue[0]
        best[j] = b = value + window - at + costs[j]
        back[j] = i
        b += at
        while queue and queue[-1][0] > b:
            queue.pop()
        queue.append((b, j))
    reach = [i for i in range(bisect_left(places, places[-1] - window), n - 1)]
    if reach:
        back[-1] = min(reach, key=best.__getitem__)
    out, j = [places[-1]], n - 1
    while j:
        j = back[j]
        out.append(places[j])
    return out[::-1]


def allowed(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and their costs; ``ends`` are the documents' ends in the stream."""
    kind = np.zeros(len(ids) + 1, dtype=np.uint8)
    kind[1:][stops[ids]] = 2
    kind[ends] = 1
    kind[0] = 1
    hard = np.flatnonzero(kind)
    gap = np.diff(hard)
    wide = np.flatnonzero(gap > 2 * stride)
    many = (gap[wide] - 1) // stride
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    kind[np.repeat(hard[wide], many) + (nth + 1) * stride] = 3
    places = np.flatnonzero(kind)
    return places, np.array([0.0, FREE, SENTENCE, INSIDE])[kind[places]]


@dataclass
class Piece:
    doc: int
    start: int
    length: int
    sequence: int
    offset: int
    at: int


def pack_block(lengths: np.ndarray, ids: np.ndarray, stops: np.ndarray, window: int, stride: int) -> Iterator[Piece]:
    """Pieces of one block of documents; ``sequence`` counts from 0."""
    ends = np.cumsum(lengths)
    places, cost = allowed(ids, ends, stops, stride)
    bounds = cuts(places.tolist(), cost.tolist(), window)
    # the last window is the block's remainder: powers of two need no padding
    out = bounds[:-1]
    if bounds[-1] - out[-1] < window:
        while (rest := bounds[-1] - out[-1]) & (rest - 1):
            out.append(out[-1] + (1 << (rest.bit_length() - 1)))
    out.append(bounds[-1])
    doc = 0
    for k, (a, b) in enumerate(zip(out, out[1:])):
        at = a
        while at < b:
            while ends[doc] <= at:
                doc += 1
            upto = min(b, int(ends[doc]))
            yield Piece(doc, at - int(ends[doc] - lengths[doc]), upto - at, k, at - a, at)
            at = upto


def pack(df: DataFrame, vocabulary: str, *, end_id: int, window: int = 4096, stride: int = 32,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Packs every document of ``df``; one row per piece.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on
    request, ``ids`` (the piece's token ids, little-endian unsigned 32-bit).  Each document
    is its token ids followed by ``end_id``; a null or empty text is that id alone.
    Texts of any length are cut where the programme says; repeated rows and ids are
    packed one by one; other columns are not read; an empty table gives an empty result.
    ``sequence_id`` is unique; it holds the split's number and a count.

    Memory: one block of at most ``BLOCK`` tokens (or one document, if longer).
    """
    if not 1 <= 2 * stride <= window:
        raise ValueError("stride must be at most half a window")
    kind = df.schema[id_col].dataType
    fields = [StructField("doc_id", kind)] + [StructField(c, LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(StructField("ids", BinaryType()))
    schema = StructType(fields)
    out = to_arrow_schema(schema)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, end_id)
        first = TaskContext.get().partitionId() << 40
        keys: list = []
        made: list[bytes] = []
        held = 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal first, held
            lengths = np.array([len(b) // 4 for b in made], dtype=np.int64)
            raw = b"".join(made)
            ids = np.frombuffer(raw, dtype="<u4")
            columns: list[list] = [[] for _ in out.names]
            last = -1
            for p in pack_block(lengths, ids, encode.stops, window, stride):
                part = raw[4 * p.at:4 * (p.at + p.length)]
                row = (keys[p.doc], p.start, p.length, zlib.crc32(part), int(lengths[p.doc]), first + p.sequence, p.offset, part)
                for c, v in zip(columns, row):
                    c.append(v)
                last = p.sequence
                if len(columns[0]) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types)], schema=out)
                    columns = [[] for _ in out.names]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types)], schema=out)
            first += last + 1
            keys.clear()
            made.clear()
            held = 0

        for table in tables:
            at = 0
            for group in batches(map(operator.methodcaller("as_py"), table.column(1)), 400_000):
                keys.extend(table.column(0).slice(at, len(group)).to_pylist())
                at += len(group)
                for b in encode(group):
                    made.append(b)
                    held += len(b) // 4
                if held >= BLOCK:
                    yield from settle()
        if made:
            yield from settle()

    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, schema)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, end_id: int) -> Encoder:
    """One encoder per worker process and vocabulary; the vocabulary file is on every machine."""
    if (vocabulary, end_id) not in _encoders:
        _encoders[vocabulary, end_id] = Encoder(vocabulary, end_id)
    return _encoders[vocabulary, end_id]
