"""Composite plans: features, cohort, evaluation, translation jobs, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested, numbers, text
from ..operators import aggregates, joins, windows

# Keyword lists of the language features.
KEYWORDS = {
    "cta": ("下单", "去拍", "拍下", "购买", "入手", "冲", "囤", "抢", "带回家", "点链接", "别错过"),
    "urgency": ("现在", "今天", "限时", "最后", "就这几天", "赶紧", "抓紧", "马上", "仅限", "只要"),
    "social_proof": ("口碑", "好评", "销量", "回购", "爆单", "都在买", "都在用", "推荐", "万人", "热销"),
    "benefit": ("好用", "好吃", "方便", "划算", "省力", "干净", "显白", "提亮", "留香", "舒服", "耐用"),
    "risk_reduction": ("放心", "官方", "正品", "包邮", "安全", "无添加", "不伤", "保障", "售后", "退"),
}


def speech_features(df: DataFrame, entity: str, transcript: str, rate: str) -> DataFrame:
    """Transcript counts and the band of the speech rate by global quartiles (one row, broadcast)."""
    cuts = aggregates.quantiles(df, rate, [0.25, 0.75], ["_q25", "_q75"]).select(F.coalesce("_q25", F.lit(0.0)).alias("_q25"), F.coalesce("_q75", F.lit(0.0)).alias("_q75"))
    t = F.col(transcript)
    n = text.sentence_count(t)
    return aggregates.with_global(df, cuts).select(
        entity, F.length(text.clean(t)).alias("video_text_chars"), n.alias("transcript_sentence_count"), text.count_of(t, "[?？]").alias("transcript_question_count"), text.count_of(t, "[!！]").alias("transcript_exclamation_count"),
        numbers.ratio(F.length(text.clean(t)), n, 0.0).alias("transcript_avg_sentence_length"), numbers.rate_band(F.col(rate), F.col("_q25"), F.col("_q75")).alias("speech_rate_bucket"),
        text.count_any(t, KEYWORDS["cta"]).alias("cta_keyword_count_in_text"), text.count_any(t, KEYWORDS["urgency"]).alias("urgency_keyword_count_in_text"),
    )


def language_features(df: DataFrame, entity: str, title: str, body: str) -> DataFrame:
    """Ten keyword flags and the punctuation counts of a title and a text."""
    flags = [text.contains_any(F.col(c), words).alias(f"{side}_has_{name}") for side, c in (("title", title), ("text", body)) for name, words in KEYWORDS.items()]
    counts = [text.count_of(F.col(c), p).alias(f"{side}_{name}") for side, c in (("title", title), ("text", body)) for name, p in (("question_count", "[?？]"), ("exclamation_count", "[!！]"))]
    return df.select(entity, *flags, *counts)


def cross_modal_features(df: DataFrame, entity: str, title: str, body: str, product: str, category: str) -> DataFrame:
    """Bigram Jaccard indices between title, text and product, and whether a category term occurs in title and text."""
    occurs = lambda c: F.exists("_pieces", lambda x: text.contains_bare(F.col(f"_bare_{c}"), x) == 1).cast("int")
    pairs = {"title_text": (title, body), "title_product": (title, product), "text_product": (body, product)}
    # bare texts, pieces and sets of grams are columns, each made once
    df = df.withColumns({"_pieces": F.transform(text.category_pieces(F.col(category)), text.bare), **{f"_bare_{c}": text.bare(F.col(c)) for c in (title, body, product)}})
    df = df.withColumns({f"_grams_{c}": text.ngrams_in_bare(F.col(f"_bare_{c}")) for c in (title, body, product)})
    indices = [F.round(text.jaccard(F.col(f"_grams_{a}"), F.col(f"_grams_{b}")), 6).alias(f"{k}_jaccard") for k, (a, b) in pairs.items()]
    wide = df.select(entity, *indices, occurs(title).alias("category_in_title"), occurs(body).alias("category_in_text"))
    return wide.withColumn("consistency_score", F.round((F.col("title_text_jaccard") + F.col("title_product_jaccard") + F.col("text_product_jaccard") + F.col("category_in_title") + F.col("category_in_text")) / 5, 6))


def follower_segments(df: DataFrame, followers: str) -> DataFrame:
    cuts = aggregates.quantiles(df, followers, [0.25, 0.5, 0.75], ["_a", "_b", "_c"])
    labels = ("tail", "waist", "shoulder", "head")
    return aggregates.with_global(df, cuts).withColumn("fan_segment", numbers.quartile_label(F.col(followers), [F.col("_a"), F.col("_b"), F.col("_c")], labels)).drop("_a", "_b", "_c")


def cohort(df: DataFrame, entity: str, strata: list[str], creator: str, anchors: list[str], total: int, seed: str = "42") -> DataFrame:
    """Anchors first, then strata in turn by a hash, creators once before any creator repeats; `turn` tells the order.

    Each creator's first entity (by hash, anchors count) belongs to the first pass, all others to the second.
    """
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(entity).cast("string")), 256)
    anchored = F.col(entity).cast("string").isin(*anchors) if anchors else F.lit(False)
    marked = df.withColumn("_anchor", anchored).withColumn("_h", order)
    firsts = marked.groupBy(F.col(creator).alias("_creator")).agg(F.min(F.struct((~F.col("_anchor")).alias("a"), "_h"))["_h"].alias("_first"))
    passes = marked.join(firsts, F.col(creator).eqNullSafe(F.col("_creator"))).withColumn("_pass", F.when(F.col("_anchor"), 0).when(F.col("_h") == F.col("_first"), 1).otherwise(2)).drop("_creator", "_first", "_anchor")
    sweeps = windows.hash_ranks(passes.withColumnRenamed("_h", "_of"), ["_pass", *strata], entity, "_sweep", F.col("_of"))
    top = sweeps.orderBy("_pass", "_sweep", *strata, "_of").limit(total)
    # a window over the limited result only
    return top.withColumn("turn", F.row_number().over(Window.orderBy("_pass", "_sweep", *strata, "_of"))).drop("_of", "_pass", "_sweep")


def evaluate(gold: DataFrame, predictions: DataFrame, key: str, judge, task: str = "task_type") -> tuple[DataFrame, DataFrame]:
    """Details of every gold row and the score report. judge is an injected client for answered rows; missing answers score 0, and of repeated
    predictions one counts (see evaluation.one_answer; evaluation.evaluate_answers is the run with payloads and replies)."""
    predictions = predictions.groupBy(key).agg(F.min("answer").alias("answer"))
    asked = gold.join(predictions.select(key, F.col("answer").alias("model_output")), key)
    schema = f"{key} string, correctness double, grounding double, completeness double, judge_success boolean"
    replies = windows.model_calls(asked, judge, schema)
    score = numbers.judge_score(F.col("correctness"), F.col("grounding"), F.col("completeness"))
    judged = replies.withColumn("score", F.when(F.col("judge_success"), score))
    missing = gold.join(predictions.select(key).distinct(), key, "left_anti").select(key, F.lit(0.0).alias("score"), F.lit(True).alias("judge_success"), F.lit(True).alias("missing"))
    details = gold.join(judged.select(key, "score", "judge_success", F.lit(False).alias("missing")).unionByName(missing), key)
    return details, aggregates.score_report(details, task, "score", "judge_success")


def translation_jobs(sources: list[tuple[DataFrame, str, str, list[str]]], prompt_version: str) -> DataFrame:
    """(table, object type, id column, text columns) to one job per distinct non-blank field value; ids follow from type, id, field and digest."""
    out = None
    for df, kind, key, fields in sources:
        long = joins.unpivoted(df.select(F.col(key).cast("string").alias("object_id"), *fields), ["object_id"], fields, "source_field", "source_text")
        part = long.filter(text.clean(F.col("source_text")) != "").withColumn("object_type", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    jobs = out.withColumn("source_sha256", F.sha2("source_text", 256)).dropDuplicates(["object_type", "object_id", "source_field", "source_sha256"])
    name = nested.content_id("tr", 16, kind=F.col("object_type"), key=F.col("object_id"), field=F.col("source_field"), digest=F.col("source_sha256"), version=F.lit(prompt_version))
    return jobs.withColumn("translation_id", name).withColumn("audit_only", F.lit(True))


def stage_fingerprint(df: DataFrame, key: str, upstream: str = "") -> DataFrame:
    """One row: a fingerprint of the table and of what it was made from, whatever the row order.

    Row digests are summed per hash prefix (at most 256 sums), and the sums are hashed, so nothing is sorted or collected.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    number = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    sums = df.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2).alias("p"), number.alias("v")).groupBy("p").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.agg(F.sha2(F.concat_ws("|", F.lit(upstream), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", F.col("s").cast("string"), F.col("n").cast("string")))), ",")), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def audit(annotations: DataFrame, evidence: DataFrame, tasks: list[str]) -> DataFrame:
    """metric, value: counts by task, evidence coverage, two-modality share of CM, videos without a required task."""
    from .evidence import with_references

    facts = with_references(annotations, "annotation_id", "evidence_ids", evidence)
    counts = facts.groupBy(F.concat(F.lit("count_"), "task_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    closed = (F.col("n_refs") > 0) & (F.col("n_missing") == 0) & (F.col("n_foreign") == 0)
    coverage = facts.agg(aggregates.rounded_ratio(F.count_if(closed), F.count(F.lit(1))).alias("value")).select(F.lit("evidence_coverage").alias("metric"), "value")
    cm = F.col("task_type") == "CM"
    modal = facts.agg(aggregates.rounded_ratio(F.count_if(cm & (F.size("modalities") >= 2)), F.count_if(cm)).alias("value")).select(F.lit("cross_modal_coverage").alias("metric"), "value")
    missing = facts.groupBy("video_id").agg(F.collect_set("task_type").alias("have")).agg(F.count_if(F.size(F.array_except(F.array(*map(F.lit, tasks)), "have")) > 0).cast("double").alias("value")).select(F.lit("videos_missing_a_task").alias("metric"), "value")
    return counts.unionByName(coverage).unionByName(modal).unionByName(missing)


def token_cost(df: DataFrame, prices: DataFrame, default_model: str) -> DataFrame:
    """cost_usd by the model's price per million tokens; unknown models cost as the default."""
    base = prices.filter(F.col("model") == default_model).select(F.col("input_price").alias("_di"), F.col("output_price").alias("_do"))
    joined = df.join(F.broadcast(prices), "model", "left").join(F.broadcast(base.limit(1)))
    cost: Column = (F.col("input_tokens") * F.coalesce("input_price", "_di") + F.col("output_tokens") * F.coalesce("output_price", "_do")) / 1_000_000
    return joined.withColumn("cost_usd", F.round(cost, 6)).drop("input_price", "output_price", "_di", "_do")
