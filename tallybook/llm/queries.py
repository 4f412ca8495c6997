"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from pyspark.sql import functions as F

from tallybook.llm import (bytebpe, divergence, exactdedup, langid, licenses, linededup, mixing, ngramjoin, packing, quality, sharding,
                           toxicity, vectorcode)
from tallybook.llm.common import documents, embeddings, id_mod


def op1_pack(spark, sf_dir):
    """All documents packed into windows of 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2,
                        with_ids=False)


def op2_langid(spark, sf_dir):
    """Language of all documents, learned from rows outside the held-out quarter."""
    said = langid.learn_and_identify(documents(spark, sf_dir), id_mod(4) == 2)
    return said.select("doc_id", (id_mod(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_shard(spark, sf_dir):
    """All documents in 16 equal shards by rendezvous hashing of doc_id."""
    return sharding.shard_rows(documents(spark, sf_dir), [1.0] * 16)


def op4_toxicity(spark, sf_dir):
    """Toxicity of all documents, learned from labelled rows outside the held-out third."""
    docs = documents(spark, sf_dir)
    said = toxicity.score(docs, toxicity.learn_outside(docs, sf_dir, id_mod(3) == 1))
    return said.select("doc_id", (id_mod(3) == 1).alias("held_out"), "score", "predicted")


def op5_quality(spark, sf_dir):
    """Quality verdicts of all documents by weak supervision."""
    return quality.judge(documents(spark, sf_dir))


def op6_exact_dedup(spark, sf_dir):
    """Exact groups of all documents by verified chunk recipes."""
    return exactdedup.exact_groups(documents(spark, sf_dir))


OP6_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(s) AS text_sha256
FROM t WINDOW g AS (PARTITION BY s)
"""

def op7_mix(spark, sf_dir):
    """All documents in an order that follows tempered source weights at every place."""
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mixing.mixed(docs).select("row.doc_id", "source", "source_rank", "block", "phase", "slot", "position")


def op8_line_dedup(spark, sf_dir):
    """Every line of all documents with its component and whether it stays."""
    return linededup.judged(documents(spark, sf_dir)).select("doc_id", "line_no", "line_id", "kept")


def op9_license_scan(spark, sf_dir):
    """License phrases and fuzzy notices in all documents."""
    return licenses.scan(documents(spark, sf_dir))


def op10_ngram_join(spark, sf_dir):
    """Components of all documents linked by a Jaccard similarity of 0.9 or more of 3-word sets."""
    return ngramjoin.linked(documents(spark, sf_dir), percent=90, k=3).withColumnRenamed("id", "doc_id")


def op11_byte_bpe(spark, sf_dir):
    """All documents encoded by byte-level BPE and decoded again."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bytebpe.decoded(bytebpe.encoded(documents(spark, sf_dir), ranks, pattern), ranks, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_vector_codes(spark, sf_dir):
    """Codes of all usable vectors: 16 parts, 64 entries, 2 rounds."""
    coded, books = vectorcode.encoded(embeddings(spark, sf_dir))
    return vectorcode.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vectorcode.codebooks_digest(books)).alias("codebooks_sha256"))


_NEAREST = """SELECT r, label, p, x, min(d * 64 + e) AS best FROM (
  SELECT part.r, part.label, part.p, part.x, book.e,
         CAST(list_sum(list_transform(list_zip(part.x, book.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM part JOIN {book} AS book ON part.p = book.p) GROUP BY r, label, p, x"""
_MOVED = """SELECT p, e, list(v ORDER BY i) AS x FROM (
  SELECT p, e, i, coalesce(s.v, old.v) AS v FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {book}) old
  LEFT JOIN (SELECT p, e, i, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM (
    SELECT p, best % 64 AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {given}) GROUP BY p, e, i) s USING (p, e, i))
GROUP BY p, e"""
OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM kept),
part AS (SELECT r, vec_id, label, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x FROM numbered, range(16) AS t(p)),
book0 AS (SELECT p, r - 1 AS e, x FROM part WHERE r <= 64),
given0 AS ({_NEAREST.format(book="book0")}),
book1 AS ({_MOVED.format(book="book0", given="given0")}),
given1 AS ({_NEAREST.format(book="book1")}),
book2 AS ({_MOVED.format(book="book1", given="given1")}),
given2 AS ({_NEAREST.format(book="book2")}),
coded AS (SELECT r, label, string_agg(format('{{:02x}}', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error
          FROM given2 GROUP BY r, label),
digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
           FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM book2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY coded.label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN numbered USING (r), digest
"""


def op13_source_divergence(spark, sf_dir):
    """How far the sources of each language differ, in all, and the terms that set each one apart."""
    return divergence.audited(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
w AS (SELECT k, lang, source, unnest(ts) AS t FROM d),
counted AS (SELECT lang, source, t, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, t, count(*) AS n FROM w GROUP BY lang, t HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
langs AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS total, count(*) AS terms FROM kept GROUP BY lang),
cell AS (SELECT g.lang, g.source, kept.t, coalesce(c.n, 0) AS n, kept.n AS lang_n
         FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
totals AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM cell GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.t, c.n, 1 + (CAST(1000000000 AS HUGEINT) * (c.n + 2)) // (x.total + 2 * l.terms) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (c.lang_n + 2)) // (l.total + 2 * l.terms) AS q
      FROM cell c JOIN totals x ON x.lang = c.lang AND x.source = c.source JOIN langs l ON l.lang = c.lang),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                CAST(coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.t = x.t
         GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, t AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term)
WHERE rank <= 10
"""


def pipeline(spark, sf_dir):
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pack, op2_langid, op3_shard, op4_toxicity, op5_quality, op6_exact_dedup, op7_mix, op8_line_dedup, op9_license_scan, op10_ngram_join,
                                 op11_byte_bpe, op12_vector_codes, op13_source_divergence, pipeline)}
ORACLE = {"op6_exact_dedup": OP6_SQL, "op12_vector_codes": OP12_SQL, "op13_source_divergence": OP13_SQL}
