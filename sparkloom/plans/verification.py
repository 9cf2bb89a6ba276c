"""A second reader of relations: calls of bounded size with the frames they cite, and verdicts put together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks
from . import replies

#: Relations of a window in which a video's calls are cut.
BUCKET_RELATIONS = 10_000


def relation_contexts(relations: DataFrame, cues: DataFrame, evidence: DataFrame) -> DataFrame:
    """video_id, relation_id, claim (type, rationale, texts of its ends and evidence), frames: the frames its evidence shows, in order.

    relations: relation_id (unique), video_id, relation_type, rationale_en, source_cue_ids, target_cue_ids, evidence_ids; cues: cue_id, content_en; evidence: evidence_id,
    content_en, frame_indices. One long table of references meets both tables in one join and is regrouped once; ends without a cue or unit have no text.
    """
    ref = lambda column, kind: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("ref")))
    refs = relations.select("relation_id", F.explode_outer(F.concat(ref("source_cue_ids", "source"), ref("target_cue_ids", "target"), ref("evidence_ids", "unit"))).alias("_r")).select("relation_id", "_r.*")
    none = F.array().cast("array<int>")
    known = cues.select(F.lit(True).alias("_cue"), F.col("cue_id").alias("ref"), F.col("content_en").alias("words"), none.alias("shown")).unionByName(
        evidence.select(F.lit(False).alias("_cue"), F.col("evidence_id").alias("ref"), F.col("content_en").alias("words"), F.coalesce("frame_indices", none).alias("shown"))
    )
    met = refs.withColumn("_cue", F.col("kind") != "unit").join(known, ["_cue", "ref"], "left")
    texts = lambda kind: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("words").isNotNull(), F.struct("at", "words")))), lambda x: x["words"]).alias(kind)
    gathered = met.groupBy("relation_id").agg(texts("source"), texts("target"), texts("unit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("shown", none))))).alias("frames"))
    claim = F.struct("relation_type", "rationale_en", "source", "target", F.col("unit").alias("evidence"))
    return relations.join(gathered, "relation_id").select("video_id", "relation_id", claim.alias("claim"), "frames")


def verification_calls(contexts: DataFrame, most_relations: int = 20, most_frames: int = 16) -> DataFrame:
    """call, video_id, relations (relation_id, claim), frames: each call holds about most_relations relations and most_frames frames of one video.

    A relation weighs its share of the larger of both bounds; a video's relations are filled into calls in the order of their ids, inside buckets of hashes, so
    a video with very many relations is neither one window nor one call. A relation with more frames than a call should have is alone with all of them.
    """
    sizes = contexts.groupBy("video_id").agg(F.ceil(F.count(F.lit(1)) / BUCKET_RELATIONS).alias("_n"))
    dealt = contexts.join(sizes, "video_id").withColumn("_b", F.pmod(F.xxhash64("relation_id"), F.col("_n")))
    weight = F.greatest(F.lit(1.0 / most_relations), F.size("frames") / F.lit(float(most_frames)))
    order = Window.partitionBy("video_id", "_b").orderBy("relation_id")
    placed = dealt.withColumn("_w", weight).withColumn("_before", F.sum("_w").over(order) - F.col("_w"))
    # the columns of the windows are those of the groups, so rows are not sent again
    named = placed.withColumn("_k", F.floor(F.col("_before") + 1e-9))
    packed = named.groupBy("video_id", "_b", "_k").agg(F.array_sort(F.collect_list(F.struct("relation_id", "claim"))).alias("relations"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("frames")))).alias("frames"))
    return packed.select(F.concat_ws("|", "video_id", F.col("_b").cast("string"), F.col("_k").cast("string")).alias("call"), "video_id", "relations", "frames")


def verified_relations(contexts: DataFrame, ask: Callable[[DataFrame], DataFrame], most_relations: int = 20, most_frames: int = 16) -> DataFrame:
    """Every relation with verdict (PASS, AMBIGUOUS, REJECT, or UNVERIFIED with the call's fault in reason).

    ask maps calls to (call, success, reply). A reply has to judge each relation of its call once and no other; one that does not is refused as a whole, and so
    is a call that failed or has no reply. No relation is lost: all asked ones come back, each once. An empty table gives none. Calls and replies are written
    once, so nothing is asked again.
    """
    calls = sinks.cut(verification_calls(contexts, most_relations, most_frames), "calls")
    given = sinks.cut(ask(calls).select("call", F.coalesce("success", F.lit(False)).alias("success"), "reply"), "replies")
    asked = calls.select("call", F.explode(F.transform("relations", lambda r: r["relation_id"])).alias("relation_id"))
    read = given.filter("success")
    verdicts, refused = replies.relation_verdicts(asked.join(read.select("call"), "call", "left_semi"), read, "call", "reply")
    faults = refused.select("call", F.col("refused").alias("_fault"))
    told = asked.join(verdicts, ["call", "relation_id"], "left").join(faults, "call", "left")
    lost = F.col("verdict").isNull()
    return told.select("relation_id", F.when(lost, "UNVERIFIED").otherwise(F.col("verdict")).alias("verdict"), F.when(lost, F.coalesce("_fault", F.lit("CALL_FAILED"))).otherwise(F.col("reason")).alias("reason"))
