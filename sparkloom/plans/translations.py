"""The translation run: what is not cached is asked once for each distinct text, in calls of bounded size, and spread back to all jobs that need it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested, text
from ..sources import sinks
from . import graph, replies

KEY = ["object_type", "object_id", "source_field", "source_sha256"]
# Code words that need no model, and what goes before and after texts.
MACHINE_CODE = r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$"
CODE_PREFIX, DIAGNOSTIC_PREFIX, KEPT_TOKENS = "审计代码：", "审计诊断：", "（保留标记：%s）"
#: Distinct texts of a window in which calls are cut.
BUCKET_TEXTS = 10_000


def with_missing_tokens(source, translated):
    """A translation followed by the upper-case tokens of its source that it lacks; text that is no translation stays as it is."""
    lost = text.missing_tokens(source, translated)
    before, after = KEPT_TOKENS.split("%s")
    return F.when(text.contains_cjk(translated) & (F.size(lost) > 0), F.concat(translated, F.lit(before), F.array_join(lost, "、"), F.lit(after))).otherwise(translated)


def call_batches(texts: DataFrame, budget: int) -> DataFrame:
    """batch and texts (source_sha256, source_text): calls of at most budget characters, or one longer text. Calls are cut inside buckets of hashes, each small."""
    n = texts.count()
    bucket = F.pmod(F.xxhash64("source_sha256"), F.lit(max(1, -(-n // BUCKET_TEXTS))))
    order = Window.partitionBy("_b").orderBy("source_sha256")
    placed = texts.withColumns({"_b": bucket, "_c": F.length("source_text").cast("bigint")}).withColumn("_end", F.sum("_c").over(order))
    slot = F.floor((F.col("_end") - F.col("_c")) / budget)
    packed = placed.withColumn("batch", F.concat_ws("-", F.col("_b").cast("string"), slot.cast("string")))
    return packed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("source_sha256", "source_text"))).alias("texts"))


def run_translations(jobs: DataFrame, cache: DataFrame, ask: Callable[[DataFrame], DataFrame], folder: str, version: str, usable: tuple[str, ...] = (), budget: int = 20_000) -> DataFrame:
    """jobs (translation_id, KEY, source_text) with status (reused, translated, failed), translated_text, translation_method, prompt_version and error.

    cache: KEY, translated_text, translation_method, prompt_version, audit_only; its audit rows of this version or a usable one serve a job of the same key (of several
    rows the one with the smallest text). Code words and objects of machine values are translated by rule. Every other distinct text is asked once: ask maps
    calls (batch, texts) to (batch, success, reply, error, model), where a reply lists translations by source_sha256; replies stand in folder, so a
    run that starts again does not ask again. A translation that breaks a rule, is left out or whose call failed makes its jobs failed. Repeated jobs are
    each returned, an empty table gives none, and jobs with a null text fail. A call goes a little beyond the budget by its last text.
    """
    known = cache.filter(F.col("audit_only") & F.col("prompt_version").isin(version, *usable)).groupBy(*KEY).agg(F.min(F.struct("translated_text", "translation_method", "prompt_version")).alias("_c"))
    met = jobs.join(known, KEY, "left")
    code, diagnostic = F.coalesce(F.col("source_text").rlike(MACHINE_CODE), F.lit(False)), F.coalesce(nested.machine_values(F.col("source_text")), F.lit(False))
    pending = met.filter(F.col("_c").isNull() & ~code & ~diagnostic).drop("_c")
    texts = pending.filter("source_text IS NOT NULL").groupBy("source_sha256").agg(F.min("source_text").alias("source_text"))

    def answered() -> DataFrame:
        calls = sinks.written_once(jobs.sparkSession, f"{folder}/calls", lambda: call_batches(texts, budget))
        given = ask(calls).select("batch", "success", "reply", "error", "model")
        return calls.select("batch", F.transform("texts", lambda t: t["source_sha256"]).alias("asked")).join(given, "batch", "left")

    told = sinks.written_once(jobs.sparkSession, f"{folder}/replies", answered)
    read = replies.list_reply(told, "reply", "translations", "abstentions")
    fault = F.when(~F.coalesce("success", F.lit(False)), F.coalesce("error", F.lit("no reply"))).otherwise(F.col("refused"))
    asked = read.select(F.explode("asked").alias("source_sha256"), fault.alias("_fault"), "model", "batch")
    rows = read.filter("refused IS NULL").select("batch", F.posexplode("items").alias("_at", "_json"))
    said = rows.select(text.clean(replies.field(F.col("_json"), "source_sha256")).alias("source_sha256"), "batch", "_at", text.clean(replies.field(F.col("_json"), "translated_text")).alias("_t"))
    last = said.groupBy("batch", "source_sha256").agg(F.max_by("_t", "_at").alias("_t"))  # a text that is translated twice counts as the last says
    answers = asked.join(last, ["batch", "source_sha256"], "left").select("source_sha256", "_fault", "model", F.coalesce("_t", F.lit("")).alias("_t"))

    spread = pending.join(answers, "source_sha256", "left").withColumn("translated_text", with_missing_tokens(F.col("source_text"), F.col("_t")))
    issues = graph.translation_issues(F.col("source_text"), F.col("translated_text"))
    spread = spread.withColumn("error", F.when(F.col("source_text").isNull(), "NO_TEXT").otherwise(F.coalesce("_fault", F.nullif(F.array_join(issues, ","), F.lit("")))))
    good = F.col("error").isNull()
    names = [*jobs.columns, "status", "translated_text", "translation_method", "prompt_version", "error"]
    new = spread.withColumns({"status": F.when(good, "translated").otherwise("failed"), "translated_text": F.when(good, F.col("translated_text")), "translation_method": F.when(good, F.col("model")), "prompt_version": F.lit(version)}).select(*names)
    by_rule = met.filter(F.col("_c").isNull() & (code | diagnostic)).withColumns({
        "status": F.lit("translated"), "translated_text": F.concat(F.when(code, CODE_PREFIX).otherwise(DIAGNOSTIC_PREFIX), F.col("source_text")),
        "translation_method": F.when(code, "deterministic-machine-code-v1").otherwise("deterministic-machine-diagnostic-v1"), "prompt_version": F.lit(version), "error": F.lit(None).cast("string"),
    }).select(*names)
    reused = met.filter(F.col("_c").isNotNull()).withColumns({"status": F.lit("reused"), "error": F.lit(None).cast("string")}).select(*jobs.columns, "status", "_c.translated_text", "_c.translation_method", "_c.prompt_version", "error")
    return new.unionByName(by_rule).unionByName(reused)


def next_cache(done: DataFrame) -> DataFrame:
    """The cache after a run: what was reused or translated, one row for each key."""
    rows = done.filter("status <> 'failed'").groupBy(*KEY).agg(F.min(F.struct("translation_id", "translated_text", "translation_method", "prompt_version")).alias("_r"))
    return rows.select(*KEY, "_r.*", F.lit(True).alias("audit_only"))


def run_report(done: DataFrame, cache: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: jobs, reused, translated, failed, rows written, cached rows that no job wants any more, texts asked and calls made."""
    n = lambda s: F.count_if(F.col("status") == s)
    jobs = done.agg(F.count(F.lit(1)).alias("n_jobs"), n("reused").alias("n_reused"), n("translated").alias("n_translated"), n("failed").alias("n_failed"))
    written = next_cache(done).agg(F.count(F.lit(1)).alias("n_written"))
    held = cache.join(done.filter("status = 'reused'").select(*KEY).distinct(), KEY, "left_anti").agg(F.count(F.lit(1)).alias("n_stale"))
    asked = calls.agg(F.coalesce(F.sum(F.size("texts")), F.lit(0)).cast("bigint").alias("n_asked"))
    return jobs.join(F.broadcast(written)).join(F.broadcast(held)).join(F.broadcast(asked))  # one row each
