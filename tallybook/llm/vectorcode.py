"""Vector codes: product codebooks learned by ball k-means.

Vectors become integers and are cut into equal parts; each part position has a codebook of integer entries.
A round gives every part to its nearest entry and moves each entry to the floor of its parts' mean.  An entry and
its parts form a ball.  Only entries less than twice the ball's radius away are its neighbours; a part nearer to
its entry than half the way to the nearest neighbour lies in the stable core and keeps its entry unseen; the others
lie in rings, the k-th of which can only be nearest to the entry itself or one of its k nearest neighbours.  All of
it is exact: squared distances are integers, and bounds include ties.

Rows are spread over Spark's tasks; a ball's radius is taken over the rows of a batch, which is
at most the whole ball's and so never wrong.  Between rounds only sums and counts per entry are gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tallybook.llm.common import keep, small_or_shuffled

#: Numbers of a batch of vectors held by a task at once.
BATCH = 4_000_000
#: Largest component times scale: beyond, exact sums would leave 64 bits.
MOST = 1 << 26


def part_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows."""
    d = x - entries
    return np.einsum("ij,ij->i", d, d)


def reassign(x: np.ndarray, entries: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of every row (ties to the lower index), its squared distance, and how many distances were taken.

    ``old`` is any assignment; the nearer it is to the right one, the fewer rows leave the core.
    """
    own = part_distances(x, entries[old])
    best, index, taken = own.copy(), old.astype(np.int64), len(x)
    apart = np.stack([part_distances(np.broadcast_to(e, entries.shape), entries) for e in entries])
    order = np.argsort(apart, axis=1, kind="stable")
    apart = np.take_along_axis(apart, order, axis=1)
    radius = np.zeros(len(entries), dtype=np.int64)
    np.maximum.at(radius, old, own)
    # half the distance to an entry is at most a row's distance <=> apart <= 4 * own; the ball's radius bounds its rows' rings
    neighbours = (apart <= 4 * radius[:, None]).sum(axis=1)
    rows = np.flatnonzero(neighbours[old] > 1)
    for k in range(int(neighbours.max(initial=0))):
        rows = rows[(neighbours[old[rows]] > k) & (apart[old[rows], k] <= 4 * own[rows])]
        if not len(rows):
            break
        candidate = order[old[rows], k]
        d = part_distances(x[rows], entries[candidate])
        taken += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (candidate < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], candidate[better]
    return index, best, taken


def _numbers(column: pa.Array, kind) -> np.ndarray:
    """The values of a list column without nulls, a row a vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _assigned(rows: DataFrame, books: np.ndarray, first: bool) -> DataFrame:
    """``rows`` (``ints`` and, but for the first round, ``entries``) with the entry of each part and the summed squared distances."""
    kept = [f for f in rows.schema.fields if f.name not in ("entries", "error")]
    schema = StructType([*kept, StructField("entries", BinaryType()), StructField("error", LongType())])
    out = to_arrow_schema(schema)
    place = {f.name: i for i, f in enumerate(rows.schema.fields)}
    parts, _, width = books.shape

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH // (parts * width))
        for whole in tables:
            for at in range(0, len(whole), step):
                t = whole.slice(at, step)
                x = _numbers(t.column(place["ints"]), np.int64)
                old = (np.zeros((len(x), parts), np.uint8) if first
                       else np.frombuffer(b"".join(t.column(place["entries"]).to_pylist()), np.uint8).reshape(len(x), parts))
                found, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p in range(parts):
                    index, d, _ = reassign(x[:, p * width:(p + 1) * width], books[p], old[:, p])
                    found[:, p] = index
                    error += d
                yield pa.RecordBatch.from_arrays(
                    [*(t.column(place[f.name]) for f in kept), pa.array([r.tobytes() for r in found], pa.binary()), pa.array(error)],
                    schema=out)

    return rows.mapInArrow(run, schema)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry at the floor of its parts' mean; partial sums of each task meet in Spark."""
    parts, n, width = books.shape
    schema = StructType([StructField("cell", IntegerType()), StructField("n", LongType()), StructField("total", ArrayType(LongType()))])
    out = to_arrow_schema(schema)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
        for t in tables:
            x = _numbers(t.column(0), np.int64).reshape(-1, parts, width)
            cell = np.frombuffer(b"".join(t.column(1).to_pylist()), np.uint8).reshape(-1, parts) + np.arange(parts) * n
            count += np.bincount(cell.ravel(), minlength=parts * n)
            np.add.at(total, cell.ravel(), x.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64())).cast(out.types[2])],
                                         schema=out)

    sums = (rows.select("ints", "entries").mapInArrow(run, schema).select("cell", "n", F.posexplode("total").alias("at", "v"))
            .groupBy("cell", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")))
    moved = books.copy()
    for r in sums.collect():  # one row per number of the codebooks
        moved[r["cell"] // n, r["cell"] % n, r["at"]] = r["v"] // r["n"]
    return moved


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(df: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id",
            vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every usable vector, and the final codebooks [part, entry, place].

    A vector that is null or holds a null or non-finite component goes.  Component x becomes floor(scale * x); vectors are cut
    into ``parts`` equal parts.  The first codebooks are those of the ``entries`` smallest ids (ties, and null
    ids after all others, by the vector); with fewer vectors there are fewer entries.  Repeated rows count each; no usable vector
    gives an empty result and empty codebooks.  Vectors of unequal lengths, a length that ``parts`` does not divide, more than 256
    entries and components beyond 2 ** 26 are errors.  Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    small = F.assert_true(F.forall(x, lambda v: F.abs(v.cast("double")) * scale < MOST), F.lit("a component is too large for exact sums"))
    rows = (df.filter(usable).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                                     F.when(small.isNull(), ints).alias("ints"), F.size(x).alias("size")))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    if not first:
        return (rows.filter(F.lit(False)).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")),
                np.zeros((parts, 0, 0), np.int64))
    length = len(first[0]["ints"])
    if any(len(r["ints"]) != length for r in first):
        raise ValueError("vectors differ in length")
    if not length or length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} parts")
    fits = F.assert_true(F.col("size") == length, F.lit("vectors differ in length"))
    rows = rows.filter(fits.isNull()).select("vec_id", "label", F.col("ints").cast("array<int>").alias("ints"))
    books = np.ascontiguousarray(np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1))
    # without an entry to start from, the first one is as good as any
    state = keep(_assigned(rows, books, True), "coded")
    for turn in range(rounds):
        books = _moved(state, books)
        state = keep(_assigned(state, books, False), "coded")
    return state.select("vec_id", "label", F.lower(F.hex("entries")).alias("code"), "error"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, its errors summed over equal labels (nulls together)."""
    sums = keep(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(small_or_shuffled(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
