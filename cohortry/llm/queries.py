"""The registered queries of this package: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import configure

from . import alignment, collocations, decontaminate, exact_dedup, license_scan, line_dedup, neighbours, ngram_join, packing, secret_scan, suffix_dedup, token_counts, toxicity
from .store import importable, tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    """Register ``fn(table) -> DataFrame``, where ``table(name)`` reads a table of the folder."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        configure(spark)
        importable(spark)
        return fn(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    run.__doc__, run.__module__ = fn.__doc__, fn.__module__
    QUERIES[fn.__name__] = run
    return fn


@query
def op7_toxicity(table):
    """Toxicity score of every document; learnt from rows outside the held-out fold."""
    docs = table("documents")
    model = toxicity.train(docs, table("labels"), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, model, "doc_id", "text")
    return scored.select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences", "worst_score", "worst_start", "worst_end",
    )


@query
def op4_token_counts(table):
    """Tokens of every whole text under the 32k piece vocabulary, and whether they exceed 4096."""
    counted = token_counts.count_tokens(table("documents"), tokenizer_file("piece_bpe_32k.model"), "doc_id", "text")
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op9_best_fit_packing(table):
    """All documents in sequences of at most 2048 tokens: place of each piece."""
    return packing.pack_documents(table("documents"), tokenizer_file("word_bpe_49k.json"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query
def op8_neighbours(table):
    """The five nearest vectors of every 50th vector, searched exactly."""
    vectors = table("embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", k=5, factor=1.0)


@query
def op2_secret_scan(table):
    """Secrets of every whole text: fixed patterns and novel strings in sensitive context."""
    return secret_scan.scan(table("documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query
def op6_license_scan(table):
    """Licence phrases and labels of every whole text."""
    return license_scan.scan(table("documents"), "doc_id", "text").withColumnRenamed("id", "doc_id").drop("matches")


@query
def op5_ngram_jaccard(table):
    """Components of documents whose sets of 3-word shingles reach the Jaccard similarity 0.9."""
    joined = ngram_join.join_documents(table("documents"), "doc_id", "text", width=3, top=90, bottom=100)
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op3_decontamination(table):
    """Benchmark items in documents: one row per document and item."""
    found = decontaminate.leaks(table("documents"), "doc_id", "text", table("benchmark"), "item_id", "text")
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("item", "item_id")


@query
def op10_suffix_dedup(table):
    """Every text without the bytes of 400-byte strings that start anywhere else too."""
    return suffix_dedup.remove_repeats(table("documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query
def op1_line_dedup(table):
    """Lines that repeat or nearly repeat an earlier line, per document."""
    return line_dedup.dedup_lines(table("documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query
def op12_exact_dedup(table):
    """Equal texts: the row that stays, the size of its group and the digest, for every document."""
    found = exact_dedup.duplicates(table("documents"), "doc_id", "text")
    return found.withColumnsRenamed({"id": "doc_id", "digest": "text_sha256"})


SQL["op12_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op11_token_alignment(table):
    """Groups and links between the byte-level and the piece tokens of every document, with corpus-wide pair counts."""
    found = alignment.alignments(table("documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id")


@query
def op13_collocations(table):
    """The 2000 best collocations of each language."""
    return collocations.mine(table("documents"), "text", "lang")


SQL["op13_collocations"] = """
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts
), worded AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces
), spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), totals AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang
), one AS (SELECT lang, w[i] AS w1, count(*)::HUGEINT AS f FROM spots GROUP BY ALL
), two AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*)::HUGEINT AS f FROM spots WHERE i < len(w) GROUP BY ALL
), three AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*)::HUGEINT AS f FROM spots WHERE i < len(w) - 1 GROUP BY ALL HAVING count(*) >= 10
), scored2 AS (
  SELECT b.lang, b.w1, b.w2, b.f AS a, x.f AS l, y.f AS r, 1000000 * b.f * b.f // (x.f * y.f) AS score
  FROM two b JOIN one x ON x.lang = b.lang AND x.w1 = b.w1 JOIN one y ON y.lang = b.lang AND y.w1 = b.w2 WHERE b.f >= 10
), cut3 AS (
  SELECT c.lang, c.w1, c.w2, c.w3, c.f AS a, x.f AS l1, q.f AS r1, p.f AS l2, y.f AS r2,
         1000000 * c.f * c.f // (x.f * q.f) AS s1, 1000000 * c.f * c.f // (p.f * y.f) AS s2
  FROM three c JOIN one x ON x.lang = c.lang AND x.w1 = c.w1 JOIN one y ON y.lang = c.lang AND y.w1 = c.w3
  JOIN two p ON p.lang = c.lang AND p.w1 = c.w1 AND p.w2 = c.w2 JOIN two q ON q.lang = c.lang AND q.w1 = c.w2 AND q.w2 = c.w3
), held AS (
  SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL
), found AS (
  SELECT s.lang, s.w1 || ' ' || s.w2 AS phrase, a, l, r, score FROM scored2 s LEFT JOIN held h ON h.lang = s.lang AND h.w1 = s.w1 AND h.w2 = s.w2
  WHERE h.longer IS NULL OR 100 * h.longer < 50 * a
  UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cut3
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM found)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""
