"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, langid, licenses, negatives, ngram_join, packing, quality_rules, site_tree, spelling, toxicity, warc, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.apply_policy(entries, ("base", 1), "_base")
    out = quality_rules.apply_policy(base, ("web", 2), "kept")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "n_chars", "n_lines", "failures")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=5, percent=75)


def held_out(fold: int, held: int) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, by remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % fold == held


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out(3, 1)))
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_matches")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(4, 2)))
    return langid.identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    digests = encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "ids")
    decoded = byte_bpe.decode_ids(digests, ranks)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.responses_of_pages(table(spark, sf_dir, "pages"))
    return warc.derivatives(responses).select("page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "block_digest", "source_digest", "n_bytes", F.sha2("record", 256).alias("record_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, room=4096)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.damaged_words(table(spark, sf_dir, "documents"), least_chars=6, every=199)
    return spelling.spelling_forms(spelling.vocabulary(words, least=5), ratio=5)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.integer_vectors(table(spark, sf_dir, "embeddings"), scale=256)
    shifted = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(shifted, F.col("vec_id") % 100 == 0, n_positive=5, n_negative=5, window=(80, 100))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, length(t) AS n_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM d),
m AS (SELECT doc_id, n_chars, n_symbols, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(generate_series(1, n_words - 4)) AS i FROM m WHERE n_words >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2),
p AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(p.n, 0) AS n_repeat_words FROM m LEFT JOIN p USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 50 * n_symbols > n_chars THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN n_words = 0 THEN 64 ELSE 0 END) AS failures FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, CAST(n_chars AS BIGINT) AS n_chars, CAST(n_lines AS BIGINT) AS n_lines, CAST(failures AS BIGINT) AS failures
FROM f
"""

OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP13_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, a.q AS anchor, b.vec_id, b.label, b.q, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, anchor_label, anchor, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id, anchor_label, anchor ORDER BY score DESC, vec_id) AS place
  FROM s WHERE vec_id <> anchor_id AND label = anchor_label QUALIFY place <= 5),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.anchor, place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.anchor_label = p.anchor_label AND s.anchor = p.anchor
  WHERE s.label <> p.anchor_label AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_toxicity": op3_toxicity,
        "op4_language_id": op4_language_id,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_license_scan": op6_license_scan,
        "op7_warc_derivatives": op7_warc_derivatives,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_token_shards": op9_token_shards,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_html_extraction": op12_html_extraction,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict:
    return {"op1_quality_rules": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op8_exact_dedup": OP8_SQL, "op13_hard_negatives": OP13_SQL}
