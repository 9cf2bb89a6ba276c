"""Questions written and checked by a model, in parts that are known by what they were made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import windows
from ..sources import sinks
from . import integrity, replies

PARTS = ["part_key", "spec_id", "video_id", "task_type", "question", "answer", "route", "reasons"]


def part_keys(specs: DataFrame, evidence: DataFrame, version: str) -> DataFrame:
    """specs with part_key: a digest of the spec's row, of the evidence rows it cites (whatever their order) and of the prompt's version.

    specs: spec_id (unique) and evidence_refs among its columns; evidence: evidence_id and whatever else a question may hang on. An id without evidence counts as itself.
    """
    rows = evidence.select(F.col("evidence_id").alias("_ref"), integrity.row_number_of(evidence).alias("_v"))
    cited = specs.select("spec_id", F.explode(F.array_distinct(F.coalesce("evidence_refs", F.array().cast("array<string>")))).alias("_ref")).join(rows, "_ref", "left")
    sums = cited.groupBy("spec_id").agg(F.sum(F.coalesce("_v", F.lit(0))).alias("_s"), F.count_if(F.col("_v").isNull()).alias("_lost"))
    own = F.to_json(F.struct(*sorted(specs.columns)), {"ignoreNullFields": "false"})
    return specs.join(sums, "spec_id", "left").withColumn("part_key", F.sha2(F.concat_ws("|", own, F.col("_s").cast("string"), F.col("_lost").cast("string"), F.lit(version)), 256)).drop("_s", "_lost")


def realized(specs: DataFrame, evidence: DataFrame, cache: DataFrame | None, write: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], version: str, folder: str) -> DataFrame:
    """PARTS and reused for every spec: route is accepted, rejected or human_review, with reasons.

    specs: spec_id, video_id, task_type, evidence_refs and what the writer needs. A spec whose part is in the cache (PARTS) is taken from there; the others are
    written (write: part_key, success, reply with question and answer), and what is well written is checked (check: part_key, success, reply of a quality verdict), once
    each, with the replies kept in folder. So a changed row of evidence makes only the specs that cite it anew. A failed call, a reply that cannot be read, a broken
    rule of questions or a REJECT rejects; HUMAN_REVIEW goes to people. A null id is left out; empty tables give none; of a repeated cached part the smallest counts.
    """
    keyed = sinks.written_once(specs.sparkSession, f"{folder}/keys", lambda: part_keys(specs.filter("spec_id IS NOT NULL"), evidence, version))
    held = None if cache is None else cache.groupBy("part_key").agg(F.min(F.struct("question", "answer", "route", "reasons")).alias("_p"))
    step = lambda name, make: sinks.written_once(specs.sparkSession, f"{folder}/{name}", make)
    fresh = keyed if held is None else step("fresh", lambda: keyed.join(held.select("part_key"), "part_key", "left_anti"))
    told = step("written", lambda: fresh.select("part_key", "spec_id").join(write(fresh).select("part_key", "success", "reply"), "part_key", "left"))
    part = lambda name: text.clean(replies.field(F.col("reply"), name))
    said_of = told.withColumns({"question": part("question"), "answer": part("answer")})
    unread = F.when(~F.coalesce("success", F.lit(False)), "WRITER_FAILED").when(F.try_parse_json(F.coalesce("reply", F.lit(""))).isNull() | (F.col("question") == ""), "WRITER_PARSE_ERROR")
    issues = F.when(unread.isNotNull(), F.array(unread)).otherwise(replies.realized_issues(F.col("question"), F.col("answer")))
    # a table of its own: its issues are a condition of the check and stand in the result
    said = step("said", lambda: said_of.withColumn("issues", issues).select("part_key", "spec_id", "question", "answer", "issues"))
    good = said.filter("size(issues) = 0")
    judged = step("checked", lambda: good.select("part_key", "spec_id").join(check(fresh.join(good.select("part_key", "question", "answer"), "part_key")).select("part_key", "success", "reply"), "part_key", "left"))
    read = replies.quality_reply(judged.withColumn("reply", F.when(F.col("success"), F.col("reply"))), "reply", "spec_id").select("part_key", "verdict", F.when(F.coalesce("success", F.lit(False)), F.col("refused")).otherwise("CHECK_FAILED").alias("_fault"), "failed")
    met = said.join(read, "part_key", "left")
    route = F.when(F.col("verdict") == "PASS", "accepted").when(F.col("verdict") == "HUMAN_REVIEW", "human_review").otherwise("rejected")
    reasons = F.array_compact(F.concat("issues", F.array("_fault"), F.coalesce(F.transform("failed", F.upper), F.array().cast("array<string>")), F.array(F.when(F.col("verdict") == "REJECT", "QA_REJECT"))))
    of = keyed.select("part_key", "video_id", "task_type")
    made = met.select("part_key", "spec_id", "question", "answer", route.alias("route"), reasons.alias("reasons")).join(of, "part_key").select(*PARTS, F.lit(False).alias("reused"))
    if held is None:
        return made
    kept = keyed.join(held, "part_key").select("part_key", "spec_id", "video_id", "task_type", "_p.question", "_p.answer", "_p.route", "_p.reasons", F.lit(True).alias("reused"))
    return made.unionByName(kept)


def monitoring_sample(parts: DataFrame, share: float, version: str) -> DataFrame:
    """Accepted parts that people look at: for each task the first max(1, ceil(share * n)) by a digest of version and spec, so each version has a sample of its own."""
    tagged = parts.filter("route = 'accepted'").withColumn("_tag", F.concat_ws("|", F.lit(version), "spec_id"))
    return windows.hash_sample(tagged, "task_type", "_tag", share).drop("_tag")


def verdict_json(spec_id: Column, verdict: Column) -> Column:
    """A quality verdict in which all fields hold, for scripted checkers."""
    return F.to_json(F.struct(spec_id.alias("spec_id"), verdict.alias("verdict"), F.lit("looks fine").alias("reason"), *[F.lit(True).alias(f) for f in replies.QUALITY_FIELDS]))
