"""Byte-level BPE over Arrow batches, with offsets, and its way back.

The tokenizers library runs the merges; its vocabulary is built from a file of ranks (a token's bytes in
base64 and its rank, one a line).  That library knows tokens as printable characters, one for each byte, so
the table from bytes to characters is built here and read backwards to decode.  Offsets come
from the tokens' byte lengths: byte places are mapped to character places by counting the
bytes that begin a character.  A token may hold a part of a character; decoding joins bytes first and
reads characters afterwards, so characters split over tokens come back whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tallybook.llm.common import batches

#: Characters encoded at once, characters of a piece of a long text, and units remembered by a worker.
CHUNK, PIECE, MEMO = 1_000_000, 500_000, 600_000
#: Longest unit that is remembered.
SHORT = 64
#: White space as the pattern sees it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
#: Characters of new units that are encoded together.
RUN = 20_000
#: No match of PATTERN goes on from another character to white space, so these units are encoded as they are in the whole.
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Where a long text is cut: before white space, or between a letter and a mark that begins no shortened word.
BORDER = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-zА-яぁ-ゖァ-ヺ一-龥가-힣])(?=[!-&(-/:-@\\[-`{{-~、。！，？])")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable and no blank, else the next free one from U+0100."""
    itself = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in itself else free))
        free += b not in itself
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Coder:
    """Encoder and decoder of one file of ranks."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers
        ranks = read_ranks(path)
        seen = byte_characters()
        spell = lambda token: "".join(map(seen.__getitem__, token))
        # every two known parts of a token may become it, at the token's rank
        merges = [(spell(t[:i]), spell(t[i:])) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t))
                  if t[:i] in ranks and t[i:] in ranks]
        model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte_of = {c: b for b, c in enumerate(seen)}
        names = self.tokenizer.get_vocab()
        self.tokens: list[bytes] = [b""] * (max(names.values(), default=-1) + 1)
        for name, i in names.items():
            self.tokens[i] = bytes(map(byte_of.__getitem__, name))
        self.spaced = pattern == public_tokenizers.PATTERN
        self.memo: dict[str, bytes] = {}
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit; each distinct unit goes through the library once while it is remembered."""
        if not self.spaced:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [[UNIT.findall(piece) for piece in pieces_of(text)] for text in texts]
        new = set().union(*(units for pieces in cut for units in pieces)).difference(self.memo)
        self.learn(list(new))
        out = [b"".join([self.memo[u] for units in pieces for u in units]) for pieces in cut]
        for unit in new:
            if len(unit) > SHORT:
                del self.memo[unit]
        if len(self.memo) > MEMO:
            self.memo = {}
        return out

    def learn(self, units: list[str]) -> None:
        """Encodes units in runs: a unit that begins with white space after another character is encoded as it is alone.

        A line feed goes before a unit that begins otherwise, and its id is taken off again; a unit of white space goes alone.
        """
        runs, run, size = [], [], 0
        for unit in units:
            if unit[0] in BLANKS and unit[-1] in BLANKS:
                runs.append([unit])
                continue
            run.append(unit)
            size += len(unit)
            if size > RUN:
                runs.append(run)
                run, size = [], 0
        if run:
            runs.append(run)
        texts = ["".join([u if u[0] in BLANKS else "\n" + u for u in run]) for run in runs]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            extra = [u[0] not in BLANKS for u in run] if len(run) > 1 or run[0][-1] not in BLANKS else [False]
            sizes = np.array([len(u.encode("utf-8")) for u in run]) + extra
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1
            raw, at = ids.tobytes(), 0
            for unit, end, more in zip(run, (ends * 4).tolist(), extra):
                self.memo[unit] = raw[at + 4 * more:end]
                at = end

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last; tokens that share a character both name it."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.lengths[ids])
        return character[end - self.lengths[ids]], character[end - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def pieces_of(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that are encoded as they are in the whole."""
    at = 0
    while len(text) - at > size:
        cut = BORDER.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encoded(df: DataFrame, path: str, pattern: str, *, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_tokens`` and ``ids``, little-endian unsigned 32-bit numbers.

    Matches of ``pattern`` are encoded one by one with the ranks in ``path`` (a file on every executor) as the
    tiktoken library would, without special tokens: their strings are ordinary text.  Texts are cut into units at white space, which
    is right for the public pattern; with another pattern each text is encoded in one go.  With ``offsets`` also
    ``char_start`` and ``char_end``, arrays of character places in the text.  Null and empty texts have no
    ids; repeated rows and ids, null ids too, all come back; other columns are not read; an empty table gives an empty
    result.  Long texts are encoded whole, in pieces; a single match has no upper length.
    """
    fields = [StructField("doc_id", df.schema[id_col].dataType), StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    if offsets:
        fields += [StructField("char_start", ArrayType(IntegerType())), StructField("char_end", ArrayType(IntegerType()))]
    schema = StructType(fields)
    out = to_arrow_schema(schema)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for t in tables:
            at = 0
            for group in batches((x.as_py() or "" for x in t.column(1)), CHUNK):
                ids = code.encode(group)
                columns = [t.column(0).slice(at, len(group)).cast(out.types[0]), pa.array([len(i) // 4 for i in ids], pa.int64()),
                           pa.array(ids, pa.binary())]
                if offsets:
                    spans = [code.offsets(text, np.frombuffer(i, "<u4")) for text, i in zip(group, ids)]
                    columns += [pa.array([s[k] for s in spans], out.types[3]) for k in range(2)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)
                at += len(group)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decoded(df: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", as_text: bool = False) -> DataFrame:
    """The rows of ``df`` with ``decoded``: the bytes of the ids, or with ``as_text`` their characters.

    Bytes are joined before characters are read, so a character split over tokens is whole; as text, bytes that form no
    character (ids of a text cut inside one) read as U+FFFD.  Null ids decode to null, no ids to nothing;
    an id beyond the vocabulary is an error.  A column named ``decoded`` is replaced.
    """
    kept = [f for f in df.schema.fields if f.name != "decoded"]
    schema = StructType([*kept, StructField("decoded", StringType() if as_text else BinaryType())])
    out = to_arrow_schema(schema)
    place = [f.name for f in kept].index(ids_col)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for t in tables:
            whole = (None if x.as_py() is None else code.decode(np.frombuffer(x.as_py(), "<u4")) for x in t.column(place))
            said = pa.array([b if b is None or not as_text else b.decode("utf-8", "replace") for b in whole], out.types[-1])
            yield pa.RecordBatch.from_arrays([*(c.cast(k) for c, k in zip(t.columns, out.types)), said], schema=out)

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
