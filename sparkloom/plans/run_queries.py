"""Queries of runs on the driver tables: changed ranges of a table, a translation run, histograms of scores; and their SQL twins."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import aggregates
from ..sources.scans import table
from ..sources.sinks import cut, shared_folder
from . import evaluation, graph_queries, integrity, pipelines, programs, realizer, translations, verification
from .graph_oracles import BASE


def orders_twice(spark, d):
    """Orders as they are, and as a later version: orders of the last day are missing, customers of one segment number changed, an order of the first day has a new number."""
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    ends = old.agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    met = aggregates.with_global(old, ends)
    key = F.when(F.col("day") == F.col("_first"), -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    new = met.filter(F.col("day") < F.col("_last")).select(key.alias("o_orderkey"), F.when(F.col("o_custkey") % 97 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderstatus", "o_totalprice", "day")
    return old, new


def changed_orders(spark, d):
    """Orders that differ between two versions, with their range; found by descending from the roots of both trees."""
    old, new = orders_twice(spark, d)
    return integrity.changed_rows(old, new, "o_orderkey", 3)


def changed_ranges(spark, d):
    """Ranges of orders that differ, with their numbers of rows."""
    old, new = orders_twice(spark, d)
    return integrity.changed_ranges(integrity.digest_tree(old, "o_orderkey", 3), integrity.digest_tree(new, "o_orderkey", 3), 3)


def turns(spark, d):
    """Turns and benchmark items as translation jobs; roles of turns are cached, some of them under an old prompt."""
    conv = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text", "role")
    found = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    jobs = pipelines.translation_jobs([(conv, "turn", "id", ["text", "role"]), (found, "item", "id", ["text"])], "v2")
    old = F.when(F.length("object_id") % 2 == 0, "v1").otherwise("v0")
    cache = jobs.filter("source_field = 'role'").select(*translations.KEY, F.concat(F.lit("译"), "source_text").alias("translated_text"), F.lit("m0").alias("translation_method"), old.alias("prompt_version"), F.lit(True).alias("audit_only"))
    return jobs, cache


def told(calls):
    """A client that repeats texts behind a mark, gives some back as they are and leaves others out."""
    size = lambda t: F.length(t["source_text"])
    answer = lambda t: F.struct(t["source_sha256"].alias("source_sha256"), F.when(size(t) % 5 == 0, t["source_text"]).otherwise(F.concat(F.lit("译文："), t["source_text"])).alias("translated_text"))
    reply = F.to_json(F.struct(F.transform(F.filter("texts", lambda t: size(t) % 7 > 0), answer).alias("translations")))
    return calls.select("batch", F.lit(True).alias("success"), reply.alias("reply"), F.lit(None).cast("string").alias("error"), F.lit("m1").alias("model"))


def translation_run(spark, d):
    """What became of each job."""
    jobs, cache = turns(spark, d)
    done = translations.run_translations(jobs, cache, told, f"{shared_folder(spark)}/tr-{uuid4().hex}", "v2", ("v1",))
    return done.select("object_type", "object_id", "source_field", "status", "translation_method", F.length("translated_text").alias("n_chars"))


def translation_report(spark, d):
    """The run in numbers: each distinct text that is not cached is asked once."""
    jobs, cache = turns(spark, d)
    folder = f"{shared_folder(spark)}/tr-{uuid4().hex}"
    done = translations.run_translations(jobs, cache, told, folder, "v2", ("v1",))
    return translations.run_report(done, cache, spark.read.parquet(f"{folder}/calls"))


def quality_histogram(spark, d):
    """The histogram that resamples of quality by language are drawn from."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return aggregates.value_histogram(docs, ["lang"], "quality")


def judged(spark, d):
    """Documents as questions, labels as answers (each given twice), and a judge that follows the labels; some of its replies cannot be read or fail."""
    n = F.col("doc_id")
    unit = lambda i: F.struct(F.concat(F.lit(f"e{i}_"), n.cast("string")).alias("evidence_id"), F.col("lang").alias("modality"), F.col("source").alias("content_en"), (n % 5).alias("likes"), F.lit("in").alias("note"))
    cue = F.struct(F.concat(F.lit("c"), n.cast("string")).alias("cue_id"), F.lit("PRICE").alias("cue_type"), F.struct(n.alias("gmv")).alias("inner"), F.col("text").alias("draft"))
    gold = table(spark, d, "documents").select(
        n.cast("string").alias("vqa_id"), F.col("source").alias("video_id"), F.col("source").alias("question"), F.element_at(F.array(*map(F.lit, ("BP", "CM", "SS", "AE"))), (n % 4 + 1).cast("int")).alias("task_type"), F.col("lang").alias("gold_answer"),
        F.when(n % 3 > 0, F.array(unit(1), unit(2))).alias("evidence_context"), F.struct(F.array(cue).alias("commerce_cues")).alias("graph_context"),
    )
    once = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("vqa_id"), F.concat_ws("/", "quality", "toxic").alias("answer"))
    return gold, once.unionByName(once)


def judge(asked):
    """Scores by the answer in the payload."""
    n = F.col("vqa_id").cast("bigint")
    output = F.get_json_object("payload", "$.model_output")
    good, clean = output.startswith("1"), output.endswith("0")
    score = lambda c: F.when(c, 1.0).otherwise(F.when(n % 2 == 0, 0.5).otherwise(0.0))
    reply = F.to_json(F.struct(F.lit(1).alias("score"), score(good).alias("correctness"), score(clean).alias("grounding"), F.lit(0.5).alias("completeness"), F.lit("fine").alias("reason")))
    return asked.select("vqa_id", (n % 13 > 0).alias("success"), F.when(n % 11 == 0, "so so").otherwise(reply).alias("reply"))


def judge_payloads(spark, d):
    """What a judge is shown: allowed fields only."""
    gold, answers = judged(spark, d)
    met = gold.join(evaluation.one_answer(answers, "vqa_id"), "vqa_id")
    p = evaluation.judge_payload(met, F.col("answer"))
    at = lambda path: F.get_json_object("p", f"$.{path}")
    shown = met.select("vqa_id", p.alias("p"))
    return shown.select("vqa_id", at("model_output").alias("model_output"), at("evidence_context.evidence_refs").alias("evidence"), at("graph_context").alias("graph"), at("evidence_context.answer_type").alias("answer_type"))


def judged_details(spark, d):
    """Each question's score, or why it has none."""
    return evaluation.evaluate_answers(*judged(spark, d), judge)[0].select("vqa_id", "task_type", "missing", "score", "fault")


def judged_report(spark, d):
    """Scores by task, micro and macro."""
    return evaluation.evaluate_answers(*judged(spark, d), judge)[1]


def verified_relations(spark, d):
    """Every relation of the graph with a second reader's verdict and the number of frames it was shown for it."""
    n = F.col("event_id")
    units = cut(graph_queries.units(spark, d).withColumn("frame_indices", F.when(F.col("modality") == "visual", F.array((n % 9).cast("int")))), "units")
    cues = graph_queries.cues(units)
    contexts = cut(verification.relation_contexts(graph_queries.relations(cues), cues, units), "contexts")  # read for the calls, and for the numbers of frames

    def read(calls):
        number = lambda r: F.substring(r["relation_id"], 2, 20).cast("bigint") % 4
        verdict = lambda r: F.when(number(r) == 0, "reject").when(number(r) == 1, "Ambiguous").otherwise("PASS")
        judged = F.transform("relations", lambda r: F.struct(r["relation_id"].alias("relation_id"), verdict(r).alias("verdict"), F.lit("seen").alias("reason")))
        return calls.select("call", F.lit(True).alias("success"), F.to_json(F.struct(judged.alias("verifications"))).alias("reply"))

    done = verification.verified_relations(contexts, read)
    return done.join(contexts.select("relation_id", F.size("frames").alias("n_frames")), "relation_id").select("relation_id", "verdict", "n_frames")


def rendered_questions(spark, d):
    """Every event as an item whose question a template makes."""
    n = F.col("event_id")
    at = F.element_at(F.array(*[F.struct(*map(F.lit, p[:3])) for p in programs.PROGRAMS]), (n % len(programs.PROGRAMS) + 1).cast("int"))
    items = table(spark, d, "events").withColumn("_p", at).select(
        "event_id", F.col("_p.col1").alias("task_type"), F.col("_p.col2").alias("task_subtype"), F.col("_p.col3").alias("question_format"),
        F.when(n % 2 == 0, F.to_json(F.struct(F.when(n % 4 == 0, "Price").otherwise(F.col("event_type")).alias("subject"), F.lit("old").alias("claim")))).alias("target"),
        F.when(n % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("claim"), F.lit("Color").alias("predicate"), F.lit("yes").alias("answer")))).otherwise('{"relation": "", "b": "second", "a": "first"}').alias("gold_value"),
    )
    return programs.rendered_questions(items, programs.program_table(spark)).select("event_id", "question_program_id", "question", "answer")


def diversity_report(spark, d):
    """Turns as questions about their role and their conversation's number: repeats, and evidence that several tasks use."""
    n = F.col("turn")
    turns = table(spark, d, "conversations").select(F.col("text").alias("question"), F.when(n % 2 == 0, "BP").otherwise("CM").alias("task_type"), F.array(F.lit(" "), (F.length("text") % 50).cast("string"), F.col("role")).alias("evidence_refs"))
    return programs.diversity(turns)


def realized_twice(spark, d):
    """Every event as a spec that cites two units; after a first run some units change, and a second run makes only their specs anew."""
    n, e = F.col("event_id"), graph_queries.units(spark, d)
    specs = e.select(F.concat(F.lit("s"), n).alias("spec_id"), "video_id", F.element_at(F.array(*map(F.lit, graph_queries.TASKS)), (n % 4 + 1).cast("int")).alias("task_type"), F.array_compact(F.array("evidence_id", F.concat(F.lit("e"), F.col("next_id")))).alias("evidence_refs"), n.alias("number"))
    units = e.select("evidence_id", "content_en", "value")
    later = units.withColumn("value", F.when(F.substring("evidence_id", 2, 20).cast("bigint") % 40 == 0, "changed").otherwise(F.col("value")))

    def write(asked):
        k = F.col("number")
        question = F.concat(F.lit("What does the buyer learn about item "), k.cast("string"), F.when(k % 9 == 0, ".").otherwise("?"))
        return asked.select("part_key", (k % 17 > 0).alias("success"), F.to_json(F.struct(question.alias("question"), F.lit("its price").alias("answer"))).alias("reply"))

    def check(asked):
        k = F.col("number")
        verdict = F.when(k % 5 == 0, "REJECT").when(k % 7 == 0, "HUMAN_REVIEW").otherwise("PASS")
        return asked.select("part_key", F.lit(True).alias("success"), realizer.verdict_json(F.col("spec_id"), verdict).alias("reply"))

    folder = f"{shared_folder(spark)}/qa-{uuid4().hex}"
    first = cut(realizer.realized(specs, units, None, write, check, "v1", f"{folder}/1").select(*realizer.PARTS), "parts")
    return realizer.realized(specs, later, first, write, check, "v1", f"{folder}/2")


def realized_questions(spark, d):
    """What became of each spec, and whether its part was reused."""
    return realized_twice(spark, d).select("spec_id", "route", F.array_join("reasons", ",").alias("codes"), "reused")


ALL = (realized_questions, rendered_questions, diversity_report, verified_relations, judge_payloads, judged_details, judged_report, changed_orders, changed_ranges, translation_run, translation_report, quality_histogram)

VERSIONS = """WITH o AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), e AS (SELECT min(day) AS a, max(day) AS z FROM o),
n AS (SELECT CASE WHEN day = a THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey % 97 = 0 AS moved FROM o, e WHERE day < z),
p AS (SELECT o_orderkey AS k, substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 3) AS prefix, CASE WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_orderkey IS NULL THEN 'added' WHEN moved THEN 'changed' END AS change,
  o.o_orderkey IS NOT NULL AS was, n.o_orderkey IS NOT NULL AS now FROM o FULL JOIN n USING (o_orderkey))"""
JOBS = r"""WITH j AS (SELECT 'turn' AS object_type, conv_id || ':' || turn AS object_id, 'text' AS source_field, text AS s FROM conversations UNION SELECT 'turn', conv_id || ':' || turn, 'role', role FROM conversations UNION SELECT 'item', CAST(item_id AS VARCHAR), 'text', text FROM benchmark),
r AS (SELECT *, source_field = 'role' AND length(object_id) % 2 = 0 AS held FROM j WHERE NOT regexp_matches(coalesce(s, ''), '^\s*$')),
t AS (SELECT *, CASE WHEN held THEN 'reused' WHEN regexp_full_match(s, '[a-z][a-z0-9]*(_[a-z0-9]+)+') THEN 'translated' WHEN length(s) % 5 = 0 OR length(s) % 7 = 0 THEN 'failed' ELSE 'translated' END AS status,
  regexp_full_match(s, '[a-z][a-z0-9]*(_[a-z0-9]+)+') AS code FROM r)"""
JUDGED = """WITH g AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS vqa_id, ['BP', 'CM', 'SS', 'AE'][CAST(doc_id % 4 + 1 AS INTEGER)] AS task_type, lang, source FROM documents),
a AS (SELECT CAST(doc_id AS VARCHAR) AS vqa_id, min(quality || '/' || toxic) AS answer FROM labels GROUP BY 1),
m AS (SELECT g.*, answer, answer IS NULL AS missing, CASE WHEN answer LIKE '1%' THEN 1.0::DOUBLE WHEN n % 2 = 0 THEN 0.5 ELSE 0 END AS c, CASE WHEN answer LIKE '%0' THEN 1.0::DOUBLE WHEN n % 2 = 0 THEN 0.5 ELSE 0 END AS k FROM g LEFT JOIN a USING (vqa_id)),
v AS (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS v),
s AS (SELECT *, (SELECT v FROM v ORDER BY round(abs(0.4::DOUBLE * c + 0.4::DOUBLE * k + 0.1::DOUBLE - v), 9), v LIMIT 1) AS near FROM m),
o AS (SELECT *, CASE WHEN missing THEN NULL WHEN n % 13 = 0 THEN 'JUDGE_FAILED' WHEN n % 11 = 0 THEN 'NO_SCORE' END AS fault, CASE WHEN least(c, k) = 0 THEN least(near, 0.25) ELSE near END AS got FROM s),
d AS (SELECT *, CASE WHEN missing THEN 0.0::DOUBLE WHEN fault IS NULL THEN got END AS score FROM o)"""
PROGRAM_ROWS = ", ".join(f"({i}, '{'|'.join(p[:3])}', '{p[0]}', '{p[3].replace(chr(39), chr(39) * 2)}')" for i, p in enumerate(programs.PROGRAMS))
ORACLES = {
    "realized_questions": """WITH e AS (SELECT event_id AS n, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS m FROM events)
SELECT 's' || n AS spec_id, CASE WHEN n % 17 = 0 OR n % 9 = 0 OR n % 5 = 0 THEN 'rejected' WHEN n % 7 = 0 THEN 'human_review' ELSE 'accepted' END AS route,
  CASE WHEN n % 17 = 0 THEN 'WRITER_FAILED' WHEN n % 9 = 0 THEN 'MISSING_QUESTION_MARK' WHEN n % 5 = 0 THEN 'QA_REJECT' ELSE '' END AS codes, n % 40 <> 0 AND coalesce(m % 40 <> 0, true) AS reused FROM e""",
    "rendered_questions": f"""WITH p(i, id, task, t) AS (VALUES {PROGRAM_ROWS}),
e AS (SELECT event_id AS n, p.*, CASE WHEN event_id % 4 = 0 THEN 'price' WHEN event_id % 2 = 0 THEN event_type ELSE 'target object' END AS subject, CASE WHEN event_id % 3 = 0 THEN 'color' ELSE 'observable attribute' END AS predicate,
  CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN 'old' ELSE 'the stated claim' END AS claim FROM events JOIN p ON p.i = event_id % {len(programs.PROGRAMS)})
SELECT n AS event_id, id AS question_program_id, replace(replace(replace(t, '{{subject}}', subject), '{{predicate}}', predicate), '{{claim}}', claim) AS question, CASE WHEN n % 3 = 0 THEN 'yes' ELSE 'first' END AS answer FROM e""",
    "diversity_report": r"""WITH r AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[0-9]+(\.[0-9]+)?', '<num>', 'g'), '[^a-z0-9<>]+', ' ', 'g'), ' +', ' ', 'g')) AS stem, turn % 2 AS task, role, length(text) % 50 AS k FROM conversations),
s AS (SELECT stem, count(*) AS n FROM r GROUP BY 1), g AS (SELECT count(DISTINCT task) AS a, count(DISTINCT stem) AS b FROM r GROUP BY role, k)
SELECT CAST(sum(n) AS BIGINT) AS question_count, CAST(sum(n - 1) AS BIGINT) AS exact_duplicate_count, round(max(n) / sum(n), 6) AS max_stem_share, (SELECT count(*) FROM g WHERE a > 1) AS cross_task_reuse_count, (SELECT count(*) FROM g WHERE a > 1 AND b > 1) AS non_marginal_reuse_count FROM s""",
    "verified_relations": f"""{BASE} SELECT 'r' || r.event_id AS relation_id, CASE r.event_id % 4 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'AMBIGUOUS' ELSE 'PASS' END AS verdict, CAST(count(DISTINCT v.event_id % 9) FILTER (WHERE v.modality = 'visual') AS INTEGER) AS n_frames
  FROM rel r LEFT JOIN refs f USING (event_id) LEFT JOIN ev v ON f.ref = v.evidence_id GROUP BY r.event_id""",
    "judge_payloads": f"""{JUDGED} SELECT vqa_id, answer AS model_output, CASE WHEN n % 3 = 0 THEN '[]' ELSE '[{{"evidence_id":"e1_' || n || '","modality":"' || lang || '","content_en":"' || source || '"}},{{"evidence_id":"e2_' || n || '","modality":"' || lang || '","content_en":"' || source || '"}}]' END AS evidence,
  '{{"commerce_cues":[{{"cue_id":"c' || n || '","cue_type":"PRICE"}}],"commercial_relations":[]}}' AS graph, 'open' AS answer_type FROM d WHERE NOT missing""",
    "judged_details": f"{JUDGED} SELECT vqa_id, task_type, missing, score, fault FROM d",
    "judged_report": f"""{JUDGED}, t AS (SELECT task_type AS block, count(score) AS count, count(*) - count(score) AS failed, round(avg((score = 1)::INT::DOUBLE), 6) AS strict, round(avg(score), 6) AS relaxed FROM d GROUP BY 1)
  SELECT * FROM t UNION ALL SELECT 'micro', count(score), count(*) - count(score), round(avg((score = 1)::INT::DOUBLE), 6), round(avg(score), 6) FROM d
  UNION ALL SELECT 'macro', count(*), CAST(coalesce(sum(failed), 0) AS BIGINT), CAST(round(CAST(avg(strict) AS DECIMAL(20, 10)), 6) AS DOUBLE), CAST(round(CAST(avg(relaxed) AS DECIMAL(20, 10)), 6) AS DOUBLE) FROM t WHERE count > 0""",
    "changed_orders": f"{VERSIONS} SELECT k AS o_orderkey, prefix, change FROM p WHERE change IS NOT NULL",
    "changed_ranges": f"{VERSIONS} SELECT prefix, count(*) FILTER (WHERE was) AS n_old, count(*) FILTER (WHERE now) AS n_new FROM p GROUP BY prefix HAVING bool_or(change IS NOT NULL)",
    "translation_run": f"""{JOBS} SELECT object_type, object_id, source_field, status, CASE WHEN held THEN 'm0' WHEN code THEN 'deterministic-machine-code-v1' WHEN status = 'translated' THEN 'm1' END AS translation_method,
  CAST(CASE WHEN held THEN length(s) + 1 WHEN code THEN length(s) + 5 WHEN status = 'translated' THEN length(s) + 3 END AS INTEGER) AS n_chars FROM t""",
    "translation_report": f"""{JOBS} SELECT count(*) AS n_jobs, count(*) FILTER (WHERE held) AS n_reused, count(*) FILTER (WHERE status = 'translated') AS n_translated, count(*) FILTER (WHERE status = 'failed') AS n_failed,
  count(*) FILTER (WHERE status <> 'failed') AS n_written, count(*) FILTER (WHERE source_field = 'role' AND NOT held) AS n_stale, count(DISTINCT s) FILTER (WHERE NOT held AND NOT code) AS n_asked FROM t""",
    "quality_histogram": "SELECT lang, CAST(quality AS DOUBLE) AS value, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL",
}
