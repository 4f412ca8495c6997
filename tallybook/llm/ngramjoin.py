"""Similarity join of word n-gram sets by Jaccard, with grouped prefixes.

1. Every text becomes its set of hashed n-grams; equal sets are one set from here on.
2. A set with more n-grams of its own than a link allows cannot link; a fixed share of the hash
   space, over all documents, proves this for most sets without forming a pair.
3. The rest are ordered by ascending document count; sets with the same size and the same prefix form a group,
   groups meet in the lists of their prefix n-grams, and size and position bounds filter
   group pairs.
4. Members are verified on their whole sets, first each with the leader of a list,
   then only pairs that union-find has not yet put together: a large family of near copies costs a row per member, not per pair,
   and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tallybook.llm.common import batches, keep, keep_placed, let_go, small_or_shuffled
from tallybook.llm.components import components

CHUNK = 400_000
#: Bits of the filter that spares unlinkable texts the second pass: a fixed size, broadcast.
FILTER_BITS = 22
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_BASE = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word k-grams of each text.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; a text of fewer words is
    one gram of them all; a text without words has the empty set.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw])
    codes = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    edge = np.diff((~_BLANK[codes]).astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(max(len(codes), CHUNK))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * up[:len(codes)], out=total[1:])
    word = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, np.cumsum(sizes) - sizes)
    count = np.diff(np.append(first, len(start)))
    gram = word.copy()
    for j in range(1, k):
        gram[:max(0, len(word) - j)] = _mix(gram[:max(0, len(word) - j)] * np.uint64(0x9E3779B97F4A7C15) + word[j:])
    out = []
    for f, n in zip(first.tolist(), count.tolist()):
        if n >= k:
            out.append(np.unique(gram[f:f + n - k + 1]))
        elif n:
            h = np.array([n], dtype=np.uint64)
            for j in range(f, f + n):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + word[j:j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def digest(grams: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def set_table(df: DataFrame, id_col: str, text_col: str, k: int, share: float) -> DataFrame:
    """``id, n, hi, lo, low``: size and 128-bit name of each row's set, and its grams in the lowest ``share`` of the hash space."""
    schema = StructType([StructField("id", df.schema[id_col].dataType), StructField("n", IntegerType()),
                         StructField("hi", LongType()), StructField("lo", LongType()), StructField("low", ArrayType(LongType()))])
    out = to_arrow_schema(schema)
    top = np.uint64(int(share * 2**64))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            at = 0
            for group in batches((x.as_py() or "" for x in t.column(1)), CHUNK):
                sets = shingle_sets(group, k)
                names = np.array([digest(s) for s in sets], dtype=np.int64)
                low = _lists([s[:np.searchsorted(s, top)] for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [t.column(0).slice(at, len(group)).cast(out.types[0]), pa.array(np.array([len(s) for s in sets], np.int32)),
                     pa.array(names[:, 0]), pa.array(names[:, 1]), low.cast(out.types[4])], schema=out)
                at += len(group)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def whole_sets(df: DataFrame, text_col: str, k: int, wanted: bytes) -> DataFrame:
    """``hi, lo, n, grams`` of rows whose name may be wanted; ``wanted`` is a bit per residue of ``lo``."""
    schema = StructType([StructField("hi", LongType()), StructField("lo", LongType()), StructField("n", IntegerType()),
                         StructField("grams", ArrayType(LongType()))])
    out = to_arrow_schema(schema)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8), bitorder="little")
        for t in tables:
            for group in batches((x.as_py() or "" for x in t.column(0)), CHUNK):
                kept = []
                for s in shingle_sets(group, k):
                    if len(s):
                        hi, lo = digest(s)
                        if bits[lo % len(bits)]:
                            kept.append((hi, lo, s))
                if kept:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int64()),
                         pa.array([len(x[2]) for x in kept], pa.int32()), _lists([x[2] for x in kept]).cast(out.types[3])], schema=out)

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, schema)


def filter_bits(names: DataFrame) -> bytes:
    """Which residues of ``lo`` occur, as 2 ** FILTER_BITS bits built by Spark's bitmap aggregate."""
    residue = F.pmod(F.col("lo"), F.lit(1 << FILTER_BITS))
    rows = (names.groupBy(F.bitmap_bucket_number(residue + 1).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(residue + 1)).alias("bits")).collect())
    out = bytearray((1 << FILTER_BITS) // 8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at:at + 4096] = bytes(r["bits"])[:4096]
    return bytes(out)


def linked(df: DataFrame, *, percent: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id, n_shingles, component_id``.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of word
    ``k``-grams; ``component_id`` is the smallest id that links reach, the row's own included.
    Null, empty and wordless texts have 0 grams, link with nothing and keep
    their own id.  Rows with equal sets always link; repeated ids and null ids are
    allowed (a null id never is the smallest unless all are null).  Whole texts are read, other
    columns are not; an empty table gives an empty result.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    part = percent / 100
    most_lost = F.floor(F.col("n") * (100 - percent) / 100)
    whole = keep(set_table(df, id_col, text_col, k, min(1.0, max(0.05, 1.6 * (1 - part)))), "grams")
    # grams that no other set has, among those of the share
    lonely = (whole.select("hi", F.explode("low").alias("g")).groupBy("g").agg(F.min("hi").alias("hi"), F.max("hi").alias("top"))
              .filter("hi = top").groupBy("hi").agg(F.count(F.lit(1)).alias("own")))
    sets = whole.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    sets = keep(sets.join(lonely, "hi", "left").withColumn("open", F.coalesce("own", F.lit(0)) <= most_lost)
                .select("hi", "lo", "n", "least", "open"), "sets")
    rows = keep(whole.drop("low"), "rows")
    let_go(whole)
    open_sets = sets.filter("open").select("hi", "lo")
    full = (whole_sets(df, text_col, k, filter_bits(open_sets)).dropDuplicates(["hi", "lo"])
            .join(open_sets, ["hi", "lo"], "left_semi"))
    full = keep(full.withColumn("uid", F.monotonically_increasing_id()), "open-sets")
    entries = postings(full, percent)
    edges = keep(verified(star_pairs(entries, percent), full, percent), "links")
    known = components(edges)
    mixed = mixed_entries(entries, known)
    let_go(entries)
    more = keep(verified(cross_pairs(mixed, percent), full, percent), "links")
    let_go(mixed)
    found = keep(components(edges.unionByName(more)), "components")
    let_go(edges, more)
    named = (full.select("uid", "hi", "lo").join(found, F.col("uid") == F.col("node")).select("hi", "lo", "component")
             .join(sets.select("hi", "lo", "least"), ["hi", "lo"]))
    least = keep(named.groupBy("component").agg(F.min("least").alias("smallest")), "least")
    final = keep(sets.select("hi", "lo", "least").join(
        named.join(least, "component").select("hi", "lo", "smallest"), ["hi", "lo"], "left")
        .select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.coalesce("smallest", "least").alias("_c")), "final")
    same = (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))
    return rows.join(small_or_shuffled(final), same, "left").select(
        "id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("_c")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(df: DataFrame, *, percent: int, k: int, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with all columns, of each component the first in input order; texts without words all stay."""
    placed = keep_placed(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text")), [], "near")
    said = linked(placed.select("place", "text"), percent=percent, k=k, id_col="place")
    gone = keep(said.filter("id <> component_id").select(F.col("id").alias("_gone")), "gone")
    return placed.join(small_or_shuffled(gone), F.col("place") == F.col("_gone"), "left_anti").select("row.*")


def postings(full: DataFrame, percent: int) -> DataFrame:
    """``g, gid, uid, n, own, i``: prefix grams of every set that can still link.

    Grams are ordered by (number of sets, hash).  The ``own`` grams of one set alone come first and
    need no list; ``i`` is a gram's place in the order.  Sets of equal size, ``own`` and prefix share
    the group ``gid``, its smallest ``uid``.
    """
    grams = full.select("uid", "n", F.explode("grams").alias("g"))
    shared = keep(grams.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("g").alias("_g"), "c"), "shared")
    ordered = (grams.join(shared, F.col("g") == F.col("_g")).groupBy("uid", "n")
               .agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("s"))
               .withColumn("own", F.col("n") - F.size("s")))
    lost = F.floor(F.col("n") * (100 - percent) / 100).cast("int")
    prefix = (ordered.filter(F.col("own") <= lost)
              .select("uid", "n", "own", F.slice("s", F.lit(1), lost + 1 - F.col("own")).alias("s"))
              .select("uid", "n", "own", F.col("s.g").alias("prefix")))
    prefix = keep(prefix, "prefixes")
    let_go(shared)
    groups = keep(prefix.groupBy("n", "own", "prefix").agg(F.min("uid").alias("gid"))
                  .select(F.col("n").alias("_n"), F.col("own").alias("_own"), F.col("prefix").alias("_p"), "gid"), "prefix-groups")
    same = (F.col("n") == F.col("_n")) & (F.col("own") == F.col("_own")) & (F.col("prefix") == F.col("_p"))
    out = keep(prefix.join(groups, same).select("uid", "gid", "n", "own", F.posexplode("prefix").alias("at", "g"))
               .select("g", "gid", "uid", "n", "own", (F.col("at") + F.col("own")).alias("i")), "postings")
    let_go(prefix, groups)
    return out


def _possible(x: str, y: str, percent: int):
    """Bounds on the overlap of two sets that meet at places ``i`` of their orders."""
    c = lambda s, name: F.col(f"{s}.{name}")
    need = F.ceil((c(x, "n") + c(y, "n")) * percent / (100 + percent))
    after = F.least(c(x, "n") - c(x, "i"), c(y, "n") - c(y, "i"))
    before = F.least(c(x, "i") - c(x, "own"), c(y, "i") - c(y, "own"))
    return ((c(x, "n") * 100 >= c(y, "n") * percent) & (c(y, "n") * 100 >= c(x, "n") * percent)
            & (c(x, "n") - c(x, "own") >= need) & (c(y, "n") - c(y, "own") >= need) & (after + before >= need))


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each member with its group's first set, and with the leaders of its lists that the bounds allow.

    A list's leader, one per class of similar sizes, is the set with the fewest rare grams.
    """
    size = F.floor(F.log(F.col("n")) / math.log(100 / min(percent, 99)))
    groups = entries.filter("uid = gid").withColumn("size", size)
    leaders = keep(groups.groupBy("g", "size").agg(F.min(F.struct("i", "n", "gid", "own")).alias("l"))
                   .select(F.col("g").alias("lg"), F.col("size").alias("lsize"), "l.*"), "leaders")
    met = (groups.alias("x").join(leaders.alias("y"), (F.col("x.g") == F.col("y.lg")) & (F.col("x.size") == F.col("y.lsize")))
           .filter((F.col("x.gid") != F.col("y.gid")) & _possible("x", "y", percent))
           .select(F.col("x.gid").alias("gid"), F.col("y.gid").alias("lead")).distinct())
    members = entries.select("gid", "uid").distinct()
    return (members.join(met, "gid").select(F.col("uid").alias("a"), F.col("lead").alias("b"))
            .unionByName(members.filter("uid <> gid").select(F.col("uid").alias("a"), F.col("gid").alias("b"))).distinct())


def mixed_entries(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Entries, with their component so far, of lists that hold several components."""
    own = keep(entries.join(known, F.col("uid") == F.col("node"), "left")
               .select("g", "uid", "n", "own", "i", F.coalesce("component", "uid").alias("c")), "entries")
    several = keep(own.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
                   .select(F.col("g").alias("_g")), "several")
    mixed = keep(own.join(several, F.col("g") == F.col("_g"), "left_semi"), "mixed")
    let_go(own, several)
    return mixed


def cross_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of members that share a list, satisfy the bounds and lie in different components so far."""
    return (mixed.alias("x").join(mixed.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.uid") < F.col("y.uid"))
                                  & (F.col("x.c") != F.col("y.c")) & _possible("x", "y", percent))
            .select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct())


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough."""
    side = lambda s: full.select(F.col("uid").alias(s), F.col("n").alias(f"n_{s}"), F.col("grams").alias(f"g_{s}"))
    # a one-element array binds the overlap, which is used twice, to one evaluation
    near = F.exists(F.array(F.size(F.array_intersect("g_a", "g_b"))),
                    lambda both: both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent)
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(near).select("a", "b")
