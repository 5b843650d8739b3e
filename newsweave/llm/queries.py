"""Registered queries of the operators in this folder and, where SQL can express them, their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm import bag_search, block_search, byte_bpe, decontaminate, grace_dedup, hamming_dedup, hard_negatives, language_id, license_scan, pii, recurrent_lm, style_tree, token_files
from newsweave.llm.common import crc_column, table
from newsweave.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# A-Z only: DuckDB's lower() also changes other letters.
ASCII_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = lambda spark, sf_dir: function(use_utc(spark), sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return keep


@query("op10_grace_dedup", f"""
WITH d AS (SELECT doc_id, {ASCII_LOWERED.format("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM d WINDOW g AS (PARTITION BY body)""")
def op10(spark, sf_dir):
    found = grace_dedup.exact_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("fingerprint")).alias("text_sha256"))


@query("op3_decontaminate", """
WITH benchmark_words AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(13, len(w)) AS width, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM benchmark_words WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
document_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS gram FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM document_words, widths)),
hits AS (SELECT doc_id, i, p.width, item FROM places p JOIN windows x ON x.width = p.width AND x.gram = p.gram),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS place FROM (SELECT DISTINCT doc_id, i, width FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM document_words d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items t ON t.doc_id = d.doc_id""")
def op3(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontaminate.hit_count().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


@query("op1_pii")
def op1(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("personal_data").alias("s"))
    base = F.filter("s", lambda x: ~x["disguised"])
    counts = [F.size(F.filter(F.col("base")["kind"], pii.same_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2(pii.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.span_list(F.col("s")).alias("spans"))


@query("op7_language_id")
def op7(spark, sf_dir):
    held_out = crc_column("doc_id") % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    profiles = language_id.learn_profiles(docs.filter("not held_out"))
    return language_id.identify(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")


@query("op8_byte_bpe")
def op8(spark, sf_dir):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


@query("op2_token_files")
def op2(spark, sf_dir):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), definition, end_id=2)
    return token_files.read_token_files(manifest).withColumnRenamed("id", "doc_id")


@query("op9_style_tree")
def op9(spark, sf_dir):
    found = style_tree.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op6_hamming_dedup")
def op6(spark, sf_dir):
    return hamming_dedup.near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


@query("op4_recurrent_lm")
def op4(spark, sf_dir):
    return recurrent_lm.score_documents(table(spark, sf_dir, "documents"))


@query("op5_license_scan")
def op5(spark, sf_dir):
    """The documents as a tree of files: projects of 200 ids with folders by source, language and last digit of the id.  By its hash, a file lies in one of
    the four levels, and every fourth is named as a licence file."""
    docs, crc = table(spark, sf_dir, "documents"), crc_column("doc_id")
    parts = F.array(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 200).cast("string")), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), (F.col("doc_id") % 10).cast("string"))
    folder = F.array_join(F.slice(parts, F.lit(1), (crc % 4 + 1).cast("int")), "/", "none")
    name = F.concat_ws("-", F.when(F.floor(crc / 4) % 4 == 0, "LICENSE").otherwise("file"), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", "text", F.concat_ws("/", folder, name).alias("path")).withColumn("is_license_file", license_scan.is_license_path(F.col("path")))
    return license_scan.scan_licenses(files).select("doc_id", "path", "license", "license_score", "license_from", "license_dir")


TERMS = "regexp_extract_all(" + ASCII_LOWERED.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op11_bag_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS terms FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({TERMS})) AS term FROM benchmark),
total AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, total GROUP BY term, docs),
f AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)) AS f FROM t, total),
s AS (SELECT q, item_id, r, doc_id, sum(w * f)::BIGINT AS score FROM i JOIN f USING (term) JOIN w USING (term) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM p WHERE rank <= 50""")
def op11(spark, sf_dir):
    return bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


# Finite numbers only, and a vector of them; the pairs meet only for vectors of the same length.
USABLE_VECTOR = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op12_block_search", f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND {USABLE_VECTOR} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""")
def op12(spark, sf_dir):
    return block_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op13_hard_negatives", f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {USABLE_VECTOR}),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.e::DOUBLE[], r.e::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(r.e) = len(a.e)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op13(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)
