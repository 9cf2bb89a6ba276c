"""SQL twins of the queries, for DuckDB on the same tables."""

from __future__ import annotations

from . import draft_queries, graph_oracles, item_queries, reply_queries, review_queries, run_queries, staged_queries

CLEAN = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
BARE = r"lower(regexp_replace(coalesce({0}, ''), '[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]+', '', 'g'))"


def clean(c: str) -> str:
    return CLEAN.format(c)


def bare(c: str) -> str:
    return BARE.format(c)


def bigrams(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN [] WHEN length({c}) <= 2 THEN [{c}] ELSE list_distinct([substring({c}, i, 2) FOR i IN generate_series(1, length({c}) - 1)]) END"


def index_of(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE round({both} / (len({a}) + len({b}) - {both}), 6) END"


SCORE_BLOCK = """count(*) FILTER (WHERE {j} AND {s} IS NOT NULL) AS count, count(*) FILTER (WHERE NOT ({j} AND {s} IS NOT NULL)) AS failed,
  round(avg(CASE WHEN {j} AND {s} IS NOT NULL THEN CAST({s} = 1.0 AS INTEGER) END), 6) AS strict,
  round(avg(CASE WHEN {j} AND {s} IS NOT NULL THEN {s} END), 6) AS relaxed"""


def score_report(source: str, task: str, score: str, judged: str) -> str:
    block = SCORE_BLOCK.format(j=judged, s=score)
    return f"""
WITH src AS ({source}), t AS (SELECT {task} AS block, {block} FROM src GROUP BY 1)
SELECT * FROM t UNION ALL SELECT 'micro', {block} FROM src
UNION ALL SELECT 'macro', count(*), CAST(coalesce(sum(failed), 0) AS BIGINT), round(avg(strict), 6), round(avg(relaxed), 6) FROM t WHERE count > 0
"""


def parse_single(b: str) -> str:
    return f"""(CASE WHEN regexp_matches({b}, '^.*%$') THEN (CASE WHEN regexp_matches(regexp_extract({b}, '^(.*)%$', 1), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST(regexp_extract({b}, '^(.*)%$', 1) AS DOUBLE) / 100 END)
 WHEN regexp_matches({b}, '[wWkK]$') THEN (CASE WHEN regexp_matches({b}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)[wWkK]$') THEN CAST(regexp_extract({b}, '^(.*).$', 1) AS DOUBLE) * (CASE WHEN lower(right({b}, 1)) = 'w' THEN 10000 ELSE 1000 END) END)
 WHEN regexp_matches({b}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST({b} AS DOUBLE) END)"""


ORACLES = {
    "rank_quality_report": score_report(
        f"""SELECT d.doc_id, concat_ws('/', lang, CASE WHEN n <= q33 THEN 'low' WHEN n <= q67 THEN 'medium' ELSE 'high' END) AS task, coalesce(CAST(quality AS DOUBLE), 0.0) AS quality
 FROM (SELECT doc_id, lang, length({clean('text')}) AS n FROM documents) d
 CROSS JOIN (SELECT quantile_cont(n, 1/3::DOUBLE) AS q33, quantile_cont(n, 2/3::DOUBLE) AS q67 FROM (SELECT length({clean('text')}) AS n FROM documents))
 LEFT JOIN labels USING (doc_id)""", "task", "quality", "true"),
    "text_features": f"""
SELECT doc_id, length({clean('text')}) AS n_clean, length(regexp_replace({clean('text')}, '\\s+', ' ', 'g')) AS n_normal,
  regexp_matches(text, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]') AS cjk, length({bare('text')}) AS n_bare,
  CASE WHEN {clean('text')} = '' THEN 0 ELSE greatest(1, len(list_filter(regexp_split_to_array({clean('text')}, '[。！？!?；;…\\n]+'), lambda x: regexp_replace(x, '\\s+', '', 'g') <> ''))) END AS n_sentences,
  len(regexp_extract_all(text, '[?？]')) AS n_questions, len(regexp_extract_all(text, '[!！]')) AS n_calls, len(regexp_extract_all(text, '[.,;:!?]')) AS n_signs,
  CAST(regexp_matches({bare('text')}, 'license|token') AS INTEGER) AS has_keyword,
  (length({bare('text')}) - length(replace({bare('text')}, 'the', ''))) // 3 + (length({bare('text')}) - length(replace({bare('text')}, 'ing', ''))) // 3 AS n_keywords
FROM documents""",
    "ngram_jaccard": f"""
WITH t AS (SELECT conv_id, turn, text FROM conversations),
p AS (SELECT conv_id, turn, {bare('text')} AS x, {bare('nxt')} AS y FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM t) WHERE nxt IS NOT NULL),
g AS (SELECT conv_id, turn, CASE WHEN x = '' THEN [] WHEN length(x) <= 2 THEN [x] ELSE list_distinct([substring(x, i, 2) FOR i IN generate_series(1, length(x) - 1)]) END AS a,
  CASE WHEN y = '' THEN [] WHEN length(y) <= 2 THEN [y] ELSE list_distinct([substring(y, i, 2) FOR i IN generate_series(1, length(y) - 1)]) END AS b FROM p)
SELECT conv_id, turn, len(a) AS n_a, len(b) AS n_b, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS index FROM g""",
    "question_stems": r"""
WITH s AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+(\.[0-9]+)?', '<num>', 'g'), '[^a-z0-9<>]+', ' ', 'g'), ' +', ' ', 'g')) AS stem FROM conversations WHERE role = 'user'),
c AS (SELECT stem, count(*) AS size FROM s GROUP BY 1)
SELECT stem, size, size > 1 AS duplicate, round(size / (SELECT count(*) FROM s), 6) AS share FROM c""",
    "tagged_answers": f"""
SELECT conv_id, turn, md5({clean('text')}) AS inside, md5({clean('text')}) AS whole,
  md5(coalesce(nullif(regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_-]', '', 'g'), ''), 'unknown')) AS segment,
  concat_ws('_', conv_id, turn) AS slug FROM conversations WHERE role = 'assistant'""",
    "parsed_numbers": f"""
WITH p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, p_size AS n, p_retailprice FROM part)
SELECT p_partkey, round(p_retailprice, 2) AS price, round({parse_single("s || '%'")}, 6) AS percent, n * 10000.0 AS wan, n * 1000.0 AS kilo, n + 1.0 AS span, CAST(n AS DOUBLE) AS half, CAST(NULL AS DOUBLE) AS missing, CAST(NULL AS DOUBLE) AS exponent FROM p""",
    "order_dates": """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(round((o_orderkey % 96) / 96.0 * 86400) AS BIGINT) % 86400 AS sec FROM orders)
SELECT o_orderkey, strftime(day, '%G-W%V') AS week, CAST(day AS VARCHAR) AS written, CAST(day AS VARCHAR) AS counted, 'soon' AS other,
  lpad(CAST(sec // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') AS clock FROM o""",
    "number_expressions": """
SELECT l_returnflag, l_linestatus, round(sum(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END), 4) AS ratios, round(sum(greatest(0.02, least(l_discount, 0.08))), 4) AS clamped,
  round(sum(ln(1 + l_extendedprice)), 3) AS logs, count(*) FILTER (WHERE l_quantity <= 30) AS short,
  round(sum(CASE WHEN l_quantity > 1 AND l_quantity <= 100 THEN l_quantity / 100 WHEN l_quantity BETWEEN 0 AND 1 THEN l_quantity ELSE 0 END), 4) AS confidences
FROM lineitem GROUP BY 1, 2""",
    "quartile_segments": """
WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c, quantile_cont(c_acctbal, 0.05) AS p5, quantile_cont(c_acctbal, 0.95) AS p95 FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'tail' WHEN c_acctbal <= b THEN 'waist' WHEN c_acctbal <= c THEN 'shoulder' ELSE 'head' END AS segment,
  CASE WHEN c_acctbal <= a THEN 'slow' WHEN c_acctbal >= c THEN 'fast' ELSE 'medium' END AS rate, round(greatest(0, least(1, (c_acctbal - p5) / (p95 - p5))), 6) AS scaled FROM customer, q""",
    "judge_scores": """
WITH a AS (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS v), t AS (SELECT event_id, (event_id % 5) / 4.0::DOUBLE AS c, (event_id // 5 % 5) / 4.0::DOUBLE AS g, (event_id // 25 % 5) / 4.0::DOUBLE AS k FROM events),
s AS (SELECT *, (SELECT v FROM a ORDER BY round(abs(0.4::DOUBLE * c + 0.4::DOUBLE * g + 0.2::DOUBLE * k - v), 9), v LIMIT 1) AS n FROM t)
SELECT event_id, CASE WHEN least(c, g) = 0 THEN least(n, 0.25) WHEN least(c, g) = 0.25 THEN least(n, 0.5) ELSE n END AS score, CAST(NULL AS DOUBLE) AS off FROM s""",
    "frame_grid": """
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS t, least(3.0, p_size) AS h FROM part),
i AS (SELECT *, unnest(generate_series(0, CASE WHEN t <= h THEN 2 ELSE 15 END)) AS i FROM p)
SELECT p_partkey, CAST(i AS INTEGER) AS frame_index, round(CASE WHEN i < 3 THEN (i + 0.5) * h / 3 ELSE least(h + (i - 3 + 0.5) * (t - h) / 13, t - 0.1) END, 2) AS timestamp_s FROM i""",
    "content_ids": """SELECT o_orderkey, 'ord_' || substring(sha256('{"customer":' || o_custkey || ',"note":null,"priority":"' || o_orderpriority || '"}'), 1, 12) AS id FROM orders""",
    "event_json": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS found, CAST(NULL AS VARCHAR) AS strict, 'NOT_OBJECT' AS lead, 'NOT_OBJECT' AS broken, 'MISSING_KEY' AS other, true AS private FROM events""",
    "public_documents": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "scored_labels": "SELECT d.doc_id, lang, coalesce(CAST(quality AS DOUBLE), 0.0) AS quality, quality IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "score_blocks": score_report("SELECT lang, CAST(quality AS DOUBLE) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "lang", "score", "score IS NOT NULL"),
    "line_closure": """
WITH o AS (SELECT o_orderkey, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT s_suppkey, s_nationkey, nation FROM lineitem JOIN o ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
p AS (SELECT p_partkey FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0) ON l_partkey = p_partkey)
SELECT 'supplier' AS kind, count(*) AS n_refs, count(s_suppkey) AS n_resolved, count(*) - count(s_suppkey) AS n_unresolved, count(*) FILTER (WHERE s_nationkey <> nation) AS n_cross_owner, round(100.0 * count(s_suppkey) / count(*), 6) AS closure_percent FROM s
UNION ALL SELECT 'part', count(*), count(p_partkey), count(*) - count(p_partkey), 0, round(100.0 * count(p_partkey) / count(*), 6) FROM p""",
    "ordered_lines": """SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_linenumber <> 2) AS INTEGER) AS n, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber DESC) FILTER (WHERE l_linenumber <> 2), '') AS lines FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1""",
    "nearest_events": """
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS DOUBLE) AS s FROM events), p AS (SELECT user_id, event_id AS purchase_id, s FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, event_id AS view_id, s AS t FROM e WHERE event_type = 'view'),
d AS (SELECT purchase_id, view_id FROM p JOIN v ON p.user_id = v.user_id AND t BETWEEN s - 7200 AND s + 7200),
n AS (SELECT purchase_id, view_id, row_number() OVER (PARTITION BY purchase_id ORDER BY abs(t - s), view_id) AS rn FROM p JOIN v USING (user_id) WHERE purchase_id NOT IN (SELECT purchase_id FROM d))
SELECT purchase_id, view_id, 'direct' AS link FROM d UNION ALL SELECT purchase_id, view_id, 'nearest' FROM n WHERE rn = 1""",
    "cache_status": """
SELECT CASE WHEN doc_id % 11 = 0 THEN 'not_applicable' WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'stale' ELSE 'current' END AS status, count(*) AS n FROM documents GROUP BY 1""",
    "spearman_grid": """
WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation, ln(1 + n) AS n_orders, ln(1 + s) AS spent FROM customer JOIN o ON c_custkey = o_custkey),
l AS (SELECT 'balance' AS feature, 'n_orders' AS metric, balance AS x, n_orders AS y FROM c UNION ALL SELECT 'balance', 'spent', balance, spent FROM c UNION ALL SELECT 'nation', 'n_orders', nation, n_orders FROM c UNION ALL SELECT 'nation', 'spent', nation, spent FROM c),
r AS (SELECT feature, metric, rank() OVER (PARTITION BY feature, metric ORDER BY x) + (count(*) OVER (PARTITION BY feature, metric, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature, metric ORDER BY y) + (count(*) OVER (PARTITION BY feature, metric, y) - 1) / 2.0 AS ry FROM l)
SELECT feature, metric, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1, 2""",
    "interaction_strata": """
WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), q AS (SELECT event_type, quantile_cont(ln(1 + n), 1/3::DOUBLE) AS a, quantile_cont(ln(1 + n), 2/3::DOUBLE) AS b FROM e GROUP BY 1),
b AS (SELECT user_id, event_type, CASE WHEN ln(1 + n) <= a THEN 'low' WHEN ln(1 + n) <= b THEN 'medium' ELSE 'high' END AS band FROM e JOIN q USING (event_type))
SELECT user_id, string_agg(event_type || '=' || band, '|' ORDER BY event_type) AS cohort_key, count(*) AS n_metrics FROM b GROUP BY 1""",
    "roc_auc_by_lang": """
WITH d AS (SELECT lang, n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS r FROM d)
SELECT lang, count(*) FILTER (WHERE y = 1) AS n_positive, count(*) FILTER (WHERE y = 0) AS n_negative,
  round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0), 6) AS auc FROM r GROUP BY 1""",
    "label_agreement": """
WITH d AS (SELECT quality AS t, CAST(n_chars > 500 AS INTEGER) AS p, greatest(0, least(1, n_chars / 2000.0)) AS b FROM documents JOIN labels USING (doc_id)),
l AS (SELECT v, (SELECT count(*) FROM d WHERE t = v AND p = v) AS tp, (SELECT count(*) FROM d WHERE t <> v AND p = v) AS fp, (SELECT count(*) FROM d WHERE t = v AND p <> v) AS fn FROM (SELECT t AS v FROM d UNION SELECT p FROM d))
SELECT count(*) AS n_labels, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, (SELECT round(avg((b - t) * (b - t)), 6) FROM d) AS brier FROM l""",
    "duplicate_conflicts": """
WITH e AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, event_id % 3 AS value FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, day, value ORDER BY event_id) > 1 AS duplicate, first(value) OVER (PARTITION BY user_id, event_type, day ORDER BY event_id) <> value AS conflict FROM e""",
    "first_documents": """
SELECT doc_id, lang, md5(text) AS key, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 THEN 'KEPT' ELSE 'DUPLICATE' END AS reason FROM documents""",
    "hash_sample": """
WITH p AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM p)
SELECT doc_id, lang FROM r WHERE rn <= greatest(1, ceil(n * 0.1::DOUBLE))""",
    "round_robin": """
WITH r AS (SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) AS sweep FROM customer)
SELECT * FROM r ORDER BY sweep, c_mktsegment, c_nationkey LIMIT 200""",
    "group_split": """
WITH g AS (SELECT source, sha256('42|' || source) AS h FROM (SELECT DISTINCT source FROM documents)), r AS (SELECT source, row_number() OVER (ORDER BY h, source) AS rk, count(*) OVER () AS n FROM g),
s AS (SELECT source, CASE WHEN rk <= n - greatest(1, n // 10) * 2 THEN 'train' WHEN rk <= n - greatest(1, n // 10) THEN 'val' ELSE 'test' END AS split FROM r)
SELECT source, doc_id, split FROM documents JOIN s USING (source)""",
    "quota_selection": """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r2 FROM a WHERE r <= 1),
c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r3 FROM b WHERE r2 <= 2)
SELECT o_orderkey, o_custkey FROM c WHERE r3 <= 4""",
    "candidate_scores": r"""
WITH t AS (SELECT conv_id, turn, lower(text) AS a, len(regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?')) AS w FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, round(round((conv_id % 10) / 10.0 * 50, 6) + least(18, turn % 4 * 3 + conv_id % 3 * 8) + CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 10 END + CASE WHEN conv_id % 4 = 0 THEN 8 ELSE 0 END + turn % 5 * 2
  - CASE WHEN regexp_matches(a, 'flips through|turns the pages|holds up|points to|shows the product|rotates the product') THEN 45 ELSE 0 END - greatest(0, w - 30) * 0.5, 6) AS score FROM t""",
    "question_checks": r"""
WITH t AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 12 AS i, text, string_split(text, ' ')[1] AS first FROM conversations),
u AS (SELECT conv_id, turn, i, CASE WHEN i < 9 THEN 'BP' ELSE 'CM' END AS task,
  trim(CASE i WHEN 0 THEN 'What is happening?' WHEN 1 THEN text || ' 吗?' WHEN 2 THEN 'Is claim_contradicted the ' || text || '?' WHEN 3 THEN 'Who holds up the ' || text || '?' WHEN 4 THEN text || '?' ELSE text END) AS q,
  trim(CASE i WHEN 5 THEN '答' WHEN 6 THEN trim(repeat('word ', 25)) WHEN 7 THEN 'see the spec_id' WHEN 8 THEN '3 cups' ELSE first END) AS a FROM t),
s AS (SELECT *, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS qs, trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) AS sa, len(regexp_extract_all(q, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?')) AS w,
  regexp_matches(q, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]') AS qz, regexp_matches(a, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]') AS az,
  'evidenceunit|evidence unit|commercecue|commerce cue|commercialrelation|commercial relation|evidence_id|evidence_refs|cue_id|relation_id|spec_id|task_type|task_subtype|\bclaim_contradicted\b' AS meta FROM u)
SELECT conv_id, turn, coalesce(array_to_string(list_filter([CASE WHEN q = '' OR qz THEN 'NON_ENGLISH_QUESTION' END, CASE WHEN q <> '' AND NOT ends_with(q, '?') THEN 'MISSING_QUESTION_MARK' END, CASE WHEN w < 5 OR w > 45 THEN 'QUESTION_LENGTH_OUT_OF_RANGE' END,
  CASE WHEN qs IN ('what is shown in the video', 'what happens in the video', 'what does the video show', 'what is happening', 'what is the main point') THEN 'GENERIC_QUESTION' END,
  CASE WHEN length(a) > 3 AND sa <> '' AND contains(qs, sa) THEN 'ANSWER_LEAKAGE' END, CASE WHEN az THEN 'NON_ENGLISH_GOLD_ANSWER' END, CASE WHEN regexp_matches(lower(q), meta) OR regexp_matches(lower(a), meta) THEN 'BENCHMARK_META_LEAKAGE' END,
  CASE WHEN task = 'BP' AND regexp_matches(lower(q || ' ' || a), 'flips through|turns the pages|holds up|points to the product|shows the product|rotates the product') THEN 'BACKGROUND_HANDLING_QUESTION' END,
  CASE WHEN task = 'BP' AND i = 6 THEN 'BP_ANSWER_TOO_LONG' END], lambda x: x IS NOT NULL), ','), '') AS codes FROM s""",
    "cohort_selection": """
WITH h AS (SELECT doc_id, lang, source, doc_id IN (5, 17) AS anchor, sha256('42|' || doc_id) AS h FROM documents),
p AS (SELECT *, CASE WHEN anchor THEN 0 WHEN row_number() OVER (PARTITION BY source ORDER BY anchor DESC, h) = 1 THEN 1 ELSE 2 END AS pass FROM h),
s AS (SELECT *, row_number() OVER (PARTITION BY pass, lang ORDER BY h) AS sweep FROM p),
r AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY pass, sweep, lang, h) AS INTEGER) AS turn FROM s) SELECT * FROM r WHERE turn <= 60""",
    "translation_jobs": r"""
WITH j AS (SELECT 'turn' AS object_type, conv_id || ':' || turn AS object_id, 'text' AS source_field, text AS s FROM conversations UNION ALL SELECT 'turn', conv_id || ':' || turn, 'role', role FROM conversations UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), 'text', text FROM benchmark),
d AS (SELECT DISTINCT object_type, object_id, source_field, sha256(s) AS source_sha256 FROM j WHERE trim(s) <> '')
SELECT *, 'tr_' || substring(sha256('{"digest":"' || source_sha256 || '","field":"' || source_field || '","key":"' || object_id || '","kind":"' || object_type || '","version":"v1"}'), 1, 16) AS translation_id FROM d""",
    "token_costs": """
SELECT doc_id, round((n_chars * CASE WHEN lang = 'de' THEN 1.0::DOUBLE ELSE 2.0 END + n_chars % 100 * CASE WHEN lang = 'de' THEN 4.0::DOUBLE ELSE 8.0 END) / 1000000, 6) AS cost_usd FROM documents""",
    "language_flags": """
SELECT doc_id, CAST(regexp_matches(string_split(text, chr(10))[1], '下单|去拍|拍下|购买|入手|冲|囤|抢|带回家|点链接|别错过') AS INTEGER) AS title_has_cta, CAST(regexp_matches(text, '放心|官方|正品|包邮|安全|无添加|不伤|保障|售后|退') AS INTEGER) AS text_has_risk_reduction,
  len(regexp_extract_all(string_split(text, chr(10))[1], '[?？]')) AS title_question_count, len(regexp_extract_all(text, '[!！]')) AS text_exclamation_count FROM documents""",
    "cross_modal": f"""
WITH d AS (SELECT doc_id, {bare('string_split(text, chr(10))[1]')} AS t, {bare('text')} AS b, {bare('source')} AS p, {bare('lang')} AS l FROM documents),
g AS (SELECT *, {bigrams('t')} AS gt, {bigrams('b')} AS gb, {bigrams('p')} AS gp FROM d),
j AS (SELECT doc_id, {index_of('gt', 'gb')} AS title_text_jaccard, {index_of('gt', 'gp')} AS title_product_jaccard, {index_of('gb', 'gp')} AS text_product_jaccard,
  CAST(contains(t, l) OR contains(t, p) AS INTEGER) AS category_in_title, CAST(contains(b, l) OR contains(b, p) AS INTEGER) AS category_in_text FROM g)
SELECT *, round((title_text_jaccard + title_product_jaccard + text_product_jaccard + category_in_title + category_in_text) / 5, 6) AS consistency_score FROM j""",
    "top_orders": """SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 10""",
    "validated_lines": """
WITH v AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_discount > 0.09 THEN 'CHALLENGER_REVISE' END, CASE WHEN l_quantity < 2 THEN 'BELOW_MIN_CONFIDENCE' END, CASE WHEN l_tax > l_discount + 0.07 THEN 'CONFLICT' END], lambda x: x IS NOT NULL) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(array_to_string(c, ','), '') AS codes, CASE WHEN len(c) = 0 THEN 'ACCEPT' WHEN c[1] = 'CHALLENGER_REVISE' THEN 'REPAIR' WHEN c[1] = 'CONFLICT' THEN 'HUMAN_REVIEW' ELSE 'REJECT' END AS disposition,
  CASE WHEN len(c) = 0 THEN 'accepted' WHEN c[1] = 'CHALLENGER_REVISE' THEN 'diagnostics' WHEN c[1] = 'CONFLICT' THEN 'queue' ELSE 'rejected' END AS channel FROM v""",
    "disposition_summary": """
WITH v AS (SELECT CASE WHEN l_discount > 0.09 THEN 'diagnostics' WHEN l_quantity < 2 THEN 'rejected' WHEN l_tax > l_discount + 0.07 THEN 'queue' ELSE 'accepted' END AS c FROM lineitem)
SELECT round(count(*) FILTER (WHERE c = 'queue') / count(*) FILTER (WHERE c <> 'diagnostics'), 6) AS ambiguity, count(*) FILTER (WHERE c = 'accepted') AS accepted, count(*) FILTER (WHERE c = 'queue') AS queue, count(*) FILTER (WHERE c = 'rejected') AS rejected FROM v""",
    "page_assets": r"""
WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS path FROM pages), n AS (SELECT path, regexp_extract(path, '([^/]+?)(\.[^./]*)?$', 1) AS stem FROM p)
SELECT stem AS entity_id, CAST(count(*) AS INTEGER) AS n_paths, min(path) AS first_path FROM n WHERE regexp_matches(stem, '^[0-9]+$') GROUP BY 1
UNION ALL SELECT '', CAST(count(*) AS INTEGER), min(path) FROM n WHERE NOT regexp_matches(stem, '^[0-9]+$')""",
    "category_profile": """
SELECT lang, source, count(*) AS n, round(avg(CAST(quality IS NOT NULL AS INTEGER)), 6) AS labelled, round(avg(CAST(n_chars > 1000 AS INTEGER)), 6) AS long, round(quantile_cont(n_chars, 0.5), 6) AS median_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""",
    "task_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "ordered_ids": """
WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2), t AS (SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM f GROUP BY 1)
SELECT user_id, CAST(count(*) AS INTEGER) AS n, any_value(types) AS types, min(event_id) AS first_id FROM events JOIN t USING (user_id) GROUP BY 1""",
    "last_rows": """SELECT CAST(user_id AS VARCHAR) AS user, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1""",
    "classified_events": """
SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'money' WHEN event_type IN ('view', 'click') THEN 'attention' ELSE 'money2' END AS kind, CASE WHEN event_type IN ('view', 'click') THEN upper(event_type) ELSE 'OTHER' END AS kept,
  CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'view' END AS strongest FROM events""",
    "benchmark_leaks": """SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1""",
    "model_replies": "SELECT conv_id, turn, length(text) AS n_input, length(text) % 7 <> 0 AS success FROM conversations WHERE role = 'user'",
}


def oracle_sql() -> dict:
    return {k: v.strip() for k, v in (ORACLES | graph_oracles.ORACLES | reply_queries.ORACLES | item_queries.ORACLES | draft_queries.ORACLES | review_queries.ORACLES | staged_queries.ORACLES | run_queries.ORACLES).items()}
