"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut into chunks whose ends depend on its content alone, every chunk is
named by a verified identifier, and texts are compared by their ordered lists of
identifiers.  Only names move between tasks, never texts or chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import keep, lower_ascii

#: A chunk runs to the first sentence or line end after 1,024 characters, or to 4,096.
CHUNK = r"(?s).{1024,4094}?(?:\n|[.!?] )|.{1,4096}"


def chunks(text: Column) -> Column:
    """The text cut at content-defined places; the chunks joined give the text. Empty text: no chunk."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return (df.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
            .select("doc_id", F.sha2("_t", 256).alias("text_sha256"),
                    F.transform(chunks(F.col("_t")), lambda c: F.struct(
                        F.xxhash64(c).alias("name"), F.sha2(c, 256).alias("proof"))).alias("made"))
            .select("doc_id", "text_sha256", F.col("made.name").alias("names"), F.col("made.proof").alias("proofs"),
                    F.monotonically_increasing_id().alias("row")))


def verified(rows: DataFrame) -> DataFrame:
    """Adds ``extra``: for each chunk whose 64-bit name stands for several contents, its
    place and the number of its content under that name; an empty list nearly always.

    Chunk contents are told apart by SHA-256.  A chunk that a third of all rows
    hold is one row per task before the shuffle.
    """
    pairs = rows.select(F.explode(F.arrays_zip("names", "proofs")).alias("c")).select("c.names", "c.proofs")
    known = pairs.groupBy("names", "proofs").agg(F.count(F.lit(1)).alias("n"))
    doubtful = (known.groupBy("names").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
                .select(F.col("names").alias("d_name")))
    ranks = (known.join(doubtful, known["names"] == doubtful["d_name"], "left_semi")
             .groupBy("names").agg(F.sort_array(F.collect_set("proofs")).alias("all"))
             .select(F.col("names").alias("d_name"), F.posexplode("all").alias("variant", "d_proof")))
    places = (rows.select("row", F.posexplode(F.arrays_zip("names", "proofs")).alias("at", "c"))
              .select("row", "at", F.col("c.names").alias("d_name"), F.col("c.proofs").alias("d_proof")))
    extra = (places.join(ranks, ["d_name", "d_proof"], "inner")
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "variant"))).alias("_x")))
    none = F.array().cast("array<struct<at:int,variant:int>>")
    return (rows.join(extra.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
            .withColumn("extra", F.coalesce("_x", none)).drop("_x", "_row"))


def exact_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty, and empty texts are equal to each other.  Of equal texts the row with the largest id
    stays; a null id loses to any other; of rows that repeat the largest id one stays.
    Extra columns of ``df`` are not read; an empty table gives an empty result.
    """
    rows = verified(keep(recipes(df, id_col, text_col), "recipes")).select(
        "doc_id", "text_sha256", "names", "extra", "row", F.xxhash64("names", "extra").alias("h"))
    groups = rows.groupBy("h", "names", "extra").agg(
        F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    # stored, so that the join below reads both sides through exchanges whose hot parts Spark can split
    many = keep(groups.filter("group_size > 1").select(
        F.col("h").alias("g_h"), F.col("names").alias("g_names"), F.col("extra").alias("g_extra"), "top", "group_size"),
        "groups")
    same = (F.col("h") == F.col("g_h")) & (F.col("names") == F.col("g_names")) & (F.col("extra") == F.col("g_extra"))
    alone = F.col("top").isNull()
    return rows.join(many, same, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("top.row") == F.col("row"))).alias("kept"),
        "text_sha256")


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns (ids must be unique and not null)."""
    stay = exact_groups(df, id_col=id_col, text_col=text_col).filter("kept").select(F.col("doc_id").alias("_stay"))
    return df.join(stay, F.col(id_col) == F.col("_stay"), "left_semi")
